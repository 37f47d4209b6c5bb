"""Networks with hidden layers of rectified units, trained by Adam on minibatches.

Training is data-parallel: a step reads the rows of one minibatch, tasks sum its gradients, and the sums move the parameters. All members of a stack (seeds, and cells of other widths and
units) take their step in the same reading of the rows. Rows that fit one task need no such exchange: there members train side by side in tasks that hold all rows, with the same steps. Batches, held-out rows and starting parameters go by hash and seed, so a fit doesn't depend on partitions but for the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.operators.sums import FAN, LEVELS, column_matrix, tree_sum

#: Rows that a step reads in one task, about, where there are that many, and numbers of their features at most.
ROWS_A_PART, NUMBERS_A_PART = 32768, 1 << 21
#: Parameters of all members that take their steps together where a step is a job, about: the driver holds them and Adam's means.
NUMBERS_A_STEP = 1 << 22
#: Share of the rows that is held out of a member's training, to stop it.
HELD_OUT = 0.15
#: Adam's decay of the two means of gradients, and what keeps its divisor from zero.
BETA, GAMMA, TINY = 0.9, 0.999, 1e-8


#: Sums over rows for each of some members.
Sums = Callable[..., "np.ndarray | list[np.ndarray]"]


@dataclass(frozen=True)
class Training:
    """rate: Adam's; decay: of the squared weights, over a batch's weight; batch: rows of a minibatch at least; most_steps: minibatches of an epoch at most (more rows make larger
    minibatches); patience: epochs without a gain of `gain` after which a member stops."""

    rate: float = 1e-3
    decay: float = 1e-4
    batch: int = 200
    most_steps: int = 16
    epochs: int = 300
    patience: int = 10
    gain: float = 1e-4


def layer_sizes(width: int, hidden: int | tuple[int, ...]) -> list[tuple[int, int]]:
    """(in, out) of each layer, the output's last."""
    units = [width, *([hidden] if isinstance(hidden, int) else hidden), 1]
    return list(zip(units[:-1], units[1:], strict=True))


@dataclass(frozen=True)
class Member:
    """A network of a stack: `hidden` units (a number for each of several layers) on `width` features from `start` on, the rest if None. Members of a seed hold out the same rows."""

    seed: int
    hidden: int | tuple[int, ...] = 128
    start: int = 0
    width: int | None = None


@dataclass(frozen=True)
class Network:
    """The parameters of one member, one after the other: weights (in x out) and offsets of each layer. It reads `width` features from `start` on."""

    width: int
    hidden: int | tuple[int, ...]
    at: np.ndarray
    start: int = 0

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, offsets) of each layer."""
        out, k = [], 0
        for a, b in layer_sizes(self.width, self.hidden):
            out.append((self.at[k : k + a * b].reshape(a, b), self.at[k + a * b : k + a * b + b]))
            k += a * b + b
        return out

    def logit(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(what goes into each layer, log odds) of rows."""
        z = [x[:, self.start : self.start + self.width]]
        *inner, (last, offset) = self.layers()
        for weights, offsets in inner:
            up = z[-1] @ weights
            up += offsets
            z.append(np.maximum(up, 0, out=up))
        return z, (z[-1] @ last)[:, 0] + offset[0]

    def gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The gradient of the sum of w * log loss, and that sum, and the sum of w."""
        z, out = self.logit(x)
        back = (w * (1 / (1 + np.exp(-np.clip(out, -500, 500))) - y))[:, None]
        loss = (w * np.logaddexp(0, np.where(y == 1, -out, out))).sum()
        layers, found = self.layers(), [np.array([loss, w.sum()])]
        for i in reversed(range(len(layers))):
            found += [back.sum(0), (z[i].T @ back).ravel()]
            if i:
                back = back * layers[i][0].T if back.shape[1] == 1 else back @ layers[i][0].T
                back *= z[i] > 0
        return np.concatenate(found[::-1])

    def on_raw(self, mean: np.ndarray, sd: np.ndarray) -> Network:
        """The same network for features that are not scaled."""
        own = slice(self.start, self.start + self.width)
        (first, offset), *_ = self.layers()
        scaled = [(first / sd[own, None]).ravel(), offset - (mean[own] / sd[own]) @ first]
        return Network(self.width, self.hidden, np.concatenate([*scaled, self.at[first.size + offset.size :]]), self.start)


def started(width: int, hidden: int | tuple[int, ...], seed: int, start: int = 0) -> Network:
    """Uniform starting parameters within sqrt(6 / (in + out)) of each layer."""
    r = np.random.default_rng(seed)
    bounds = [(np.sqrt(6 / (a + b)), a * b + b) for a, b in layer_sizes(width, hidden)]
    return Network(width, hidden, np.concatenate([r.uniform(-most, most, n) for most, n in bounds]), start)


class Adam:
    """One member's training: its parameters, Adam's means, and the best parameters so far."""

    def __init__(self, start: Network, how: Training):
        self.net, self.best, self.how = start, start, how
        self.mean, self.square, self.t = np.zeros_like(start.at), np.zeros_like(start.at), 0
        self.top, self.waited, self.done = -np.inf, 0, False

    def step(self, sums: np.ndarray) -> None:
        g, weight = sums[:-2].copy(), sums[-1]
        if weight <= 0:
            return
        k = 0
        for a, b in layer_sizes(self.net.width, self.net.hidden):
            g[k : k + a * b] += self.how.decay * self.net.at[k : k + a * b]
            k += a * b + b
        g /= weight
        self.t += 1
        self.mean = BETA * self.mean + (1 - BETA) * g
        self.square = GAMMA * self.square + (1 - GAMMA) * g * g
        rate = self.how.rate * np.sqrt(1 - GAMMA**self.t) / (1 - BETA**self.t)
        self.net = replace(self.net, at=self.net.at - rate * self.mean / (np.sqrt(self.square) + TINY))

    def judged(self, value: float) -> None:
        """The value (more is better) of the parameters after an epoch."""
        self.waited = 0 if value > self.top + self.how.gain else self.waited + 1
        if value > self.top:
            self.top, self.best = value, self.net
        self.done = self.waited >= self.how.patience


def trained(starts: list[Network], n_steps: int, judge_held: bool, how: Training, gradients: Sums, told: Sums) -> list[Network]:
    """The best parameters of each member.

    gradients(networks, members, batch) and told(networks, members) sum over a batch's rows and over all held-out rows: `Network.gradient`, and (weight told right, weight). After an
    epoch a member is judged by the weighted share of its held-out rows that it tells right, without held-out rows by its training loss.
    """
    members = [Adam(s, how) for s in starts]
    for epoch in range(how.epochs):
        going = [i for i, m in enumerate(members) if not m.done]
        if not going:
            break
        losses = np.zeros((len(members), 2))
        for k in range(n_steps):
            sums = gradients([members[i].net for i in going], going, (k + epoch) % n_steps)
            for i, s in zip(going, sums, strict=True):
                members[i].step(s)
                losses[i] += s[-2:]
        right = told([members[i].net for i in going], going) if judge_held else np.zeros((len(going), 2))
        for i, (hit, of) in zip(going, right, strict=True):
            members[i].judged(hit / of if of > 0 else -losses[i, 0] / max(losses[i, 1], TINY))
    return [m.best for m in members]


def right(net: Network, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.array([(w * ((net.logit(x)[1] > 0) == (y == 1))).sum(), w.sum()])


def lists(c: pa.ChunkedArray) -> list[np.ndarray]:
    """The arrays of a column, of any lengths."""
    c = c.combine_chunks()
    v, ends = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()
    return [v[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def over_tasks(rows: DataFrame, parts: int, starts: list[Network], out_of: list[int], n_steps: int, judge_held: bool, how: Training) -> list[Network]:
    """Training whose steps are jobs. rows: x, y, w, batch (0 to n_steps - 1), held (numbers, 1: not trained on; out_of: the place of each member's), in `parts` parts; kept in memory meanwhile.

    The sums of all tasks are added up in tasks, a member's in one (those of more than FAN as a tree): what comes to the driver each step is one gradient a member, however many the rows.
    """
    rows = rows.persist()
    tasks = min(parts, rows.sparkSession.sparkContext.defaultParallelism)

    def summed(of: DataFrame, nets: list[Network], going: list[int], numbers: Callable, sizes: list[int], held: bool) -> list[np.ndarray]:
        sent = rows.sparkSession.sparkContext.broadcast(nets)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    x, y, w, out = column_matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False), b.column("w").to_numpy(zero_copy_only=False), column_matrix(b.column("held")) > 0
                    keep = {k: out[:, k] == held for k in {out_of[i] for i in going}}
                    kept = {k: (x[of_k], y[of_k], w[of_k]) for k, of_k in keep.items()}
                    own = [numbers(net, *kept[out_of[i]]) for net, i in zip(sent.value, going, strict=True)]
                    total = own if total is None else [s + t for s, t in zip(total, own, strict=True)]
            if total is not None:
                n = len(total)
                columns = [pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int64()), pa.array(total, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "_task", "v"])

        sums = of.coalesce(tasks).mapInArrow(partial, "at int, _task long, v array<double>")
        got = tree_sum(sums, ["at"], 1 if tasks <= FAN else LEVELS).toArrow()
        sent.destroy()
        found = [np.zeros(n) for n in sizes]
        if got.num_rows:
            for i, v in zip(got.column("at").to_pylist(), lists(got.column("v")), strict=True):
                found[i] = v
        return found

    found = trained(
        starts,
        n_steps,
        judge_held,
        how,
        lambda nets, going, k: summed(rows.filter(F.col("batch") == k), nets, going, Network.gradient, [len(n.at) + 2 for n in nets], False),
        lambda nets, going: summed(rows, nets, going, right, [2] * len(nets), True),
    )
    rows.unpersist()
    return found


def in_a_task(rows: DataFrame, starts: list[Network], out_of: list[int], n_steps: int, judge_held: bool, how: Training) -> list[Network]:
    """The same training of rows that fit one task (fewer than two parts), one job in all: as many tasks as run at once, or members, hold the rows and train their share of the members."""
    n = min(len(starts), rows.sparkSession.sparkContext.defaultParallelism)
    load, shares = [0] * n, [[] for _ in range(n)]
    for i in sorted(range(len(starts)), key=lambda i: -len(starts[i].at)):
        k = load.index(min(load))
        load[k] += len(starts[i].at)
        shares[k].append(i)
    sent = rows.sparkSession.sparkContext.broadcast((starts, shares))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [b for b in batches if b.num_rows]
        if not t:
            return
        t = pa.Table.from_batches(t)
        x, y, w, batch = column_matrix(t.column("x")), *(t.column(c).to_numpy() for c in ("y", "w", "batch"))
        starts, shares = sent.value
        own, held = shares[t.column("share")[0].as_py()], column_matrix(t.column("held")) > 0
        del t
        for k in sorted({out_of[i] for i in own}):
            out = held[:, k]
            batches = [(x[k], y[k], w[k]) for k in (~out & (batch == s) for s in range(n_steps))]
            left = x[out], y[out], w[out]
            for i in (i for i in own if out_of[i] == k):
                best = trained([starts[i]], n_steps, judge_held, how, lambda nets, _, s, b=batches: [nets[0].gradient(*b[s])], lambda nets, _, h=left: [right(nets[0], *h)])[0]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([best.at], pa.list_(pa.float64()))], names=["member", "v"])

    each = rows.withColumn("share", F.explode(F.array(*map(F.lit, range(n)))))
    got = each.repartitionById(n, F.col("share")).mapInArrow(train, "member int, v array<double>").toArrow()
    sent.destroy()
    found = dict(zip(got.column("member").to_pylist(), lists(got.column("v")), strict=True))
    return [replace(s, at=found[i]) for i, s in enumerate(starts)]


def fit_ensemble(train: DataFrame, seeds: tuple[int, ...], hidden: int | tuple[int, ...] = 128, features: str = "features", y: str = "y", how: Training | None = None) -> list[Network] | float:
    """A network for each seed, on features as they are; for rows of a single class its label, for no rows 0."""
    return fit_members(train, [Member(s, hidden) for s in seeds], features, y, how)


def fit_members(train: DataFrame, members: list[Member], features: str = "features", y: str = "y", how: Training | None = None, deal: str | None = None) -> list[Network] | float:
    """A network for each member, on features as they are; for rows of a single class its label, for no rows 0. All of them share the readings of `train`.

    Rows without features or label are left out. Classes weigh the same. Features are scaled by the mean and deviation of all train rows, and a network's scaling is worked into its
    parameters. A row's batch and whether a seed holds it out go by the hash of its features (all of them, whatever a member reads) and label: copies of a row stay together. deal: an array
    column to hash instead, where features are results of sums, whose last digits may differ from run to run.
    """
    how = how or Training()
    known = train.filter(F.col(features).isNotNull() & F.col(y).isNotNull()).select(*[F.col(c).cast(kind).alias(name) for c, kind, name in ((features, "array<double>", "x"), (deal or features, "array<double>", "deal"), (y, "double", "y"))])
    count = known.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1), F.max(F.size("x"))).first()
    zero, one, width = count
    if not zero or not one:
        return float(one > 0)
    n = zero + one
    sums = known.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("at").toPandas()  # a row a feature
    mean, sd = sums["m"].to_numpy(), np.where(sums["s"] > 0, sums["s"], 1.0)
    sent = train.sparkSession.sparkContext.broadcast((mean, sd))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = (column_matrix(b.column("x")) - sent.value[0]) / sent.value[1] if b.num_rows else np.zeros((0, width))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *(b.column(c) for c in ("y", "w", "batch", "held"))], names=["x", "y", "w", "batch", "held"])

    steps = max(1, min(how.most_steps, -(-n // how.batch)))
    parts = max(1, n // max(1, min(ROWS_A_PART, NUMBERS_A_PART // width)))
    judge = min(zero, one) >= 2
    row = F.xxhash64("deal", "y")
    below = lambda name, share: (F.pmod(F.xxhash64(F.lit(name), row), F.lit(1 << 20)) < int(share * (1 << 20))).cast("int")
    seeds = list(dict.fromkeys(m.seed for m in members))
    held = F.array(*[below(f"held {s}", HELD_OUT) if judge else F.lit(0) for s in seeds]).alias("held")
    batch = F.pmod(F.xxhash64(F.lit("batch"), row), F.lit(steps)).cast("int").alias("batch")
    dealt = known.select("x", "y", F.when(F.col("y") == 1, n / (2 * one)).otherwise(n / (2 * zero)).alias("w"), batch, held)
    # a batch's rows next to each other, so that a step skips the rest
    spread = dealt.repartition(parts, F.xxhash64("x")).sortWithinPartitions("batch") if parts > 1 else dealt
    rows = spread.mapInArrow(scaled, "x array<double>, y double, w double, batch int, held array<int>")
    starts = [started(width - m.start if m.width is None else m.width, m.hidden, m.seed, m.start) for m in members]
    out_of = [seeds.index(m.seed) for m in members]
    if parts == 1:
        found = in_a_task(rows, starts, out_of, steps, judge, how)
    else:
        found = []
        for some in _together([len(s.at) for s in starts]):
            found += over_tasks(rows, parts, starts[some], out_of[some], steps, judge, how)
    return [f.on_raw(mean, sd) for f in found]


def _together(sizes: list[int]) -> list[slice]:
    """Runs of members with up to NUMBERS_A_STEP parameters, or one member."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > NUMBERS_A_STEP:
            out.append(slice(begin, i))
            begin, total = i, 0
        total += n
    return [*out, slice(begin, len(sizes))]


def scores(df: DataFrame, nets: list[Network] | float, n: int | list[int], features: str | Column = "features") -> Column:
    """The array of the n members' P(y = 1) for each row, or the means of members after one another, a number of them for each mean; null without features."""
    if not isinstance(nets, list):
        return F.array(*[F.lit(nets)] * n)
    each = np.array([1] * n if isinstance(n, int) else n)
    begin = np.cumsum(each) - each
    sent = df.sparkSession.sparkContext.broadcast(nets)

    @F.pandas_udf("array<double>")
    def score(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), index=x.index, dtype=object)
        known = x.notna()
        if known.any():
            a = np.stack(x[known].to_numpy())
            p = np.column_stack([1 / (1 + np.exp(-np.clip(net.logit(a)[1], -500, 500))) for net in sent.value])
            p = np.add.reduceat(p, begin, axis=1) / each
            out[known] = pd.Series(list(p), index=x.index[known])
        return out

    return score((F.col(features) if isinstance(features, str) else features).cast("array<double>"))
