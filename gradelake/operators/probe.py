"""Probes: features from per-head activations, and models that predict whether an answer is right.

Activations are never shuffled. Statistics of each head are summed in the tasks that read them, and only sums travel.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions.text import shallow_features
from gradelake.operators import network
from gradelake.operators.rank import auroc
from gradelake.operators.resample import draw_hash, numbered
from gradelake.operators.sums import column_matrix, tree_sum

RIDGE = 0.01
#: Features up to which a logistic regression takes Newton steps: their matrix is the square of that.
NEWTON_FEATURES = 512


def explode_heads(df: DataFrame, head_dim: int, vec: str = "vec", layer: str = "layer") -> DataFrame:
    """A row for each head of each layer vector: flat_head (layer-major), head_in_layer and vec of head_dim numbers. A width that head_dim doesn't divide is refused."""
    heads = F.size(vec) / head_dim
    checked = F.when(F.size(vec) % head_dim != 0, F.raise_error(F.lit(f"head_dim {head_dim} does not divide the width"))).otherwise(heads.cast("int"))
    parts = F.transform(F.sequence(F.lit(0), checked - 1), lambda h: F.slice(F.col(vec), h * head_dim + 1, head_dim))
    rest = [c for c in df.columns if c != vec]
    out = df.withColumn("_heads", checked).select(*rest, "_heads", F.posexplode(parts).alias("head_in_layer", vec))
    return out.select(*rest, (F.col(layer) * F.col("_heads") + F.col("head_in_layer")).alias("flat_head"), "head_in_layer", vec)


def vector_quality(df: DataFrame, vec: str = "vec", layer: str = "layer", limit: float = 65504.0) -> DataFrame:
    """Numbers that are not finite, the largest size, and vectors beyond the float16 limit, of each layer."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    peak = F.array_max(F.transform(F.filter(vec, lambda x: ~bad(x)), lambda x: F.abs(x).cast("double")))
    return df.groupBy(layer).agg(F.count(F.lit(1)).alias("n_vectors"), F.sum(F.size(F.filter(vec, bad))).alias("n_not_finite"), F.max(peak).alias("peak"), F.count_if(peak > limit).alias("n_beyond"))


def head_statistics(heads: DataFrame, weight: str | None = None) -> DataFrame:
    """flat_head, y, n, s (sums) and ss (sums of products, row-major) of labelled head vectors (flat_head, y, vec): sums of each task, then of all as a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            head, y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("flat_head", "y", "w"))
            x = column_matrix(b.column("vec"))
            for h, k in set(zip(head.tolist(), y.tolist(), strict=True)):
                of = (head == h) & (y == k)
                v, u = x[of], w[of]
                own = np.concatenate([[u.sum()], u @ v, ((v * u[:, None]).T @ v).ravel()])
                sums[h, k] = sums[h, k] + own if (h, k) in sums else own
        if sums:
            keys = list(sums)
            columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(keys), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sums[k] for k in keys], pa.list_(pa.float64()))], names=["flat_head", "y", "_task", "v"])

    rows = heads.select(F.col("flat_head").cast("long").alias("flat_head"), F.col("y").cast("int").alias("y"), "vec", (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"))
    part = rows.filter("y is not null and vec is not null").mapInArrow(partial, "flat_head long, y int, _task long, v array<double>")
    d = F.floor(F.sqrt(F.size("v").cast("double"))).cast("int")  # 1 + d + d * d numbers
    total = tree_sum(part, ["flat_head", "y"])
    return total.select("flat_head", "y", F.col("v")[0].alias("n"), F.slice("v", F.lit(2), d).alias("s"), F.slice("v", d + 2, d * d).alias("ss"))


def head_directions(stats: DataFrame) -> DataFrame:
    """flat_head and w: the inverse of the pooled within-class covariance (with RIDGE on its diagonal) times the difference of the class means; null for one class."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        by = {int(r.y): r for r in g.itertuples()}
        w = None
        if len(by) == 2:
            within, means, n = 0.0, {}, 0.0
            for y, r in by.items():
                s = np.array(r.s)
                means[y] = s / r.n
                within = within + np.array(r.ss).reshape(len(s), -1) - np.outer(s, s) / r.n
                n += r.n
            cov = within / max(n - 2, 1) + RIDGE * np.eye(len(means[0]))
            w = np.linalg.solve(cov, means[1] - means[0]).tolist()
        return pd.DataFrame({"flat_head": [int(g["flat_head"].iloc[0])], "w": [w]})

    return stats.groupBy("flat_head").applyInPandas(solve, "flat_head long, w array<double>")


def head_lda_auc(heads: DataFrame, weight: str | None = None) -> DataFrame:
    """flat_head, auc: how well the linear discriminant of each head ranks the rows, max(a, 1 - a); 0.5 for a single class."""
    w = F.broadcast(head_directions(head_statistics(heads, weight)).withColumnRenamed("w", "_direction"))  # one vector a head
    score = F.aggregate(F.zip_with("vec", "_direction", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    # a head of a single class has no direction: all its rows tie, and its AUROC is null
    scored = heads.join(w, "flat_head").select("flat_head", "y", F.coalesce(score, F.lit(0.0)).alias("score"), *([F.col(weight).alias("_w")] if weight else []))
    found = auroc(scored, ["flat_head"], weight="_w" if weight else None)
    return found.select("flat_head", F.coalesce(F.greatest(F.col("auroc"), 1 - F.col("auroc")), F.lit(0.5)).alias("auc"))


def head_auc_summary(aucs: DataFrame, k: int = 32) -> DataFrame:
    """max, min, mean, percentiles and the value at the top-k cut of one row a head."""
    q = F.percentile("auc", F.array(*[F.lit(x) for x in (0.5, 0.75, 0.9, 0.95, 0.99)]))
    top = F.try_element_at(F.sort_array(F.collect_list("auc"), asc=False), F.lit(k))
    out = aucs.agg(F.max("auc").alias("max_auc"), F.min("auc").alias("min_auc"), F.avg("auc").alias("mean_auc"), q.alias("q"), top.alias("cut_auc"))
    return out.select("max_auc", "min_auc", "mean_auc", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p75", "p90", "p95", "p99"))], "cut_auc")


def head_ranking(aucs: DataFrame, k: int, n_layers: int | None, n_heads: int | None = None) -> DataFrame:
    """The k best heads: rank (from 1), flat_head, auc, layer and head_in_layer, null where the number of layers isn't known. One row a head is ordered."""
    per = None if n_layers is None else n_heads // n_layers
    place = F.row_number().over(Window.orderBy(F.desc("auc"), "flat_head"))
    layer = F.lit(None).cast("long") if per is None else F.floor(F.col("flat_head") / per)
    inner = F.lit(None).cast("long") if per is None else F.col("flat_head") % per
    return aucs.withColumn("rank", place).filter(F.col("rank") <= k).select("rank", "flat_head", "auc", layer.alias("layer"), inner.alias("head_in_layer"))


def select_head_features(heads: DataFrame, top: DataFrame, keys: tuple[str, ...] = ("idx",)) -> DataFrame:
    """keys and features: the vectors of the chosen heads (flat_head, rank) end to end in order of rank."""
    few = heads.join(F.broadcast(top.select("flat_head", "rank")), "flat_head")
    rows = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "vec"))).alias("x"))
    return rows.select(*keys, F.flatten(F.col("x.vec")).cast("array<double>").alias("features"))


def moments(train: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return train.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_sd") for c in columns])


def standardize(train: DataFrame, apply_to: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """`apply_to` with columns scaled by train's means and population deviations; a constant column is only centred."""
    out = apply_to.join(F.broadcast(moments(train, columns)))
    scaled = {c: (F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_sd") > 0, F.col(f"{c}_sd")).otherwise(1.0) for c in columns}
    return out.withColumns(scaled).select(*apply_to.columns)


def _products(rows: DataFrame, x: str, y: str, by: str | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """X'X and X'Y with an intercept of each group, summed in tasks and then as a tree; only these small matrices come to the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                a, of = np.column_stack([np.ones(b.num_rows), column_matrix(b.column("x"))]), b.column("g").to_numpy()
                both = np.column_stack([a, column_matrix(b.column("y"))])
                for g in np.unique(of).tolist():
                    own = a[of == g].T @ both[of == g]
                    total[g] = total[g] + own if g in total else own
        for g, t in total.items():
            n = len(t)
            yield pa.RecordBatch.from_arrays([pa.array([g] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int64()), pa.array(list(t), pa.list_(pa.float64()))], names=["g", "i", "_task", "v"])

    group = F.col(by) if by else F.lit(0)
    part = rows.select(F.col(x).alias("x"), F.col(y).alias("y"), group.cast("int").alias("g")).mapInArrow(partial, "g int, i int, _task long, v array<double>")
    lines: dict[int, list] = {}
    for r in tree_sum(part, ["g", "i"]).orderBy("g", "i").collect():
        lines.setdefault(r.g, []).append(r.v)
    return {g: (np.array(v)[:, : len(v)], np.array(v)[:, len(v) :]) for g, v in lines.items()}


def residualize(train: DataFrame, apply_to: DataFrame, x: str = "shallow", y: str = "features", by: str | None = None, products: dict | None = None) -> DataFrame:
    """`apply_to` with what a linear fit on train predicts of y (array) from x (array) taken off it. products: those of train, if they are known. by: a column of small numbers, whose groups have fits of their own, found in one
    reading; rows of groups that train lacks stay as they are."""
    coef = apply_to.sparkSession.sparkContext.broadcast({g: np.linalg.lstsq(xx, xy, rcond=None)[0] for g, (xx, xy) in (products or _products(train, x, y, by)).items()})
    schema = apply_to.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                a, rest = np.column_stack([np.ones(len(b)), np.stack(b[x].to_numpy())]), np.stack(b[y].to_numpy()).astype(float)
                of = b[by].to_numpy() if by else np.zeros(len(b), int)
                for g in np.unique(of).tolist():
                    if g in coef.value:
                        rest[of == g] -= a[of == g] @ coef.value[g]
                b = b.assign(**{y: list(map(list, rest))})
            yield b

    return apply_to.mapInPandas(run, schema)


def with_shallow(df: DataFrame, text: str = "phase1_solution") -> DataFrame:
    """`df` with shallow: the seven features of its text as an array."""
    return df.withColumn("shallow", F.array(*shallow_features(text).values()))


def scale_array(train: DataFrame, apply_to: DataFrame, column: str) -> DataFrame:
    """The same as `standardize` for an array column: means and deviations by position."""
    sums = train.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    known = sums.orderBy("i").collect()  # a row a feature; read once, whatever is made of the result
    numbers = lambda v: F.array(*[F.lit(x).cast("double") for x in v]).cast("array<double>")
    centred = F.zip_with(column, numbers(r["m"] for r in known), lambda v, m: v - m)
    return apply_to.withColumn(column, F.zip_with(centred, numbers(r["s"] or 1.0 for r in known), lambda v, d: v / d))


def balance_train(df: DataFrame, seed: int, y: str = "y", key: str = "idx") -> DataFrame:
    """The rows of the larger class, and as many of the smaller one, drawn with replacement by hash; a single class stays as it is.

    Draws are numbers of the smaller class's keys, which are numbered in a hashed order; only keys are numbered, features move once.
    """
    sizes = sorted((r["count"], r[y]) for r in df.groupBy(y).count().collect())  # two classes
    if len(sizes) < 2:
        return df
    small, most = sizes[0][1], sizes[-1][0]
    rare = df.filter(F.col(y) == small)
    places = numbered(rare.select(y, key).distinct(), [y], key).select(key, "_i")
    draws = df.sparkSession.range(most).select(F.pmod(draw_hash(seed, F.col("id")), F.lit(places.count())).alias("_i"))
    times = draws.groupBy("_i").agg(F.count(F.lit(1)).alias("_times")).join(places, "_i").select(key, "_times")
    copies = rare.join(times, key).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return df.filter(F.col(y) != small).unionByName(copies.select(*df.columns))


@dataclass(frozen=True)
class Fit:
    """A logistic regression of a stack: its penalty is 1 / (2 c), it reads the first `width` features (all if None) of the train rows for which `rows` holds (all if None)."""

    c: float = 0.5
    width: int | None = None
    rows: Column | None = None


@dataclass(frozen=True)
class Model:
    """Intercept and coefficients on features as they are: the scaling is worked in. constant: the score if the rows had one class only."""

    intercept: float = 0.0
    coefficients: tuple[float, ...] = ()
    constant: float | None = None

    def score(self, features: str) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        weights = F.split(F.lit(" ".join(map(repr, self.coefficients))), " ").cast("array<double>")
        z = F.aggregate(F.zip_with(F.slice(features, 1, len(self.coefficients)), weights, lambda v, w: v * w), F.lit(self.intercept), lambda s, v: s + v)
        return 1 / (1 + F.exp(-z))

    def network(self, width: int, start: int = 0) -> network.Network:
        """The same scores by a network without hidden layers of `width` features from `start` on."""
        if self.constant is not None:
            return network.Network(width, (), np.array([*[0.0] * width, 500.0 if self.constant else -500.0]), start)
        return network.Network(width, (), np.array([*self.coefficients, self.intercept]), start)


def newton(rows: DataFrame, fits: list[tuple[int, float]], scales: list[tuple[np.ndarray, np.ndarray]], steps: int = 25) -> list[np.ndarray]:
    """For each of `fits` (width, c): intercept and coefficients on scaled features that minimise |b|^2 / 2 + c * sum of w * log loss over rows (x, y, w: a weight for each fit).

    Newton steps from zero, until nothing moves. Each step reads the rows once for the whole stack, sums gradients and Hessians in tasks and then by position; the numbers that come
    to the driver are the squares of the widths. The intercept has no penalty.
    """
    b = [np.zeros(width + 1) for width, _ in fits]
    ends = np.cumsum([(width + 1) * (width + 2) for width, _ in fits])
    going = set(range(len(fits)))
    for _ in range(steps):
        sent, open_ = [x.copy() for x in b], sorted(going)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {}
            for batch in batches:
                if batch.num_rows:
                    x, y, w = column_matrix(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False), column_matrix(batch.column("w"))
                    for f in open_:
                        of = w[:, f] > 0
                        width = fits[f][0]
                        a = np.column_stack([np.ones(of.sum()), (x[of, :width] - scales[f][0]) / scales[f][1]])
                        p = 1 / (1 + np.exp(-(a @ sent[f])))
                        own = a.T @ np.column_stack([w[of, f] * (p - y[of]), a * (w[of, f] * p * (1 - p))[:, None]])
                        total[f] = total[f] + own if f in total else own
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))], names=["fit", "v"])

        sums = rows.mapInArrow(partial, "fit int, v array<double>").select("fit", F.posexplode("v").alias("at", "v")).groupBy("fit", "at").agg(F.sum("v").alias("v"))
        found = np.zeros(ends[-1])
        for r in sums.collect():
            found[(ends[r["fit"] - 1] if r["fit"] else 0) + r["at"]] = r["v"]
        for f in open_:
            width, c = fits[f]
            v = c * found[(ends[f - 1] if f else 0) : ends[f]].reshape(width + 1, width + 2)
            gradient, hessian = v[:, 0], v[:, 1:] + np.diag([0.0] + [1.0] * width)
            gradient[1:] += b[f][1:]
            move = np.linalg.solve(hessian, gradient)
            b[f] = b[f] - move
            if np.abs(move).max() < 1e-11:
                going.discard(f)
        if not going:
            break
    return b


def _kept(rows: DataFrame, *columns: str) -> tuple[DataFrame, bool]:
    """These columns of `rows`, kept for several readings, and whether the caller is to let go of them: rows that are kept already stay as they are."""
    return (rows, False) if rows.is_cached else (rows.select(*columns).persist(), True)


def fit_stack(train: DataFrame, fits: dict[str, Fit], features: str = "features", y: str = "y") -> dict[str, Model]:
    """A logistic regression for each of `fits`, with balanced class weights on features standardised by its own rows. Each Newton step of all of them is one reading of the rows,
    which are kept meanwhile: `train` itself is read once."""
    train, own = _kept(train, *((features, y) if all(f.rows is None for f in fits.values()) else train.columns))
    whole = train.select(F.size(features)).first()[0]
    holds = [F.coalesce(f.rows, F.lit(False)) if f.rows is not None else F.lit(True) for f in fits.values()]
    widths = [f.width or whole for f in fits.values()]
    count = train.agg(*[F.count_if(h & (F.col(y) == k)) for h in holds for k in (0, 1)]).first()
    sizes = [(count[2 * i], count[2 * i + 1]) for i in range(len(holds))]
    balance = [F.when(h, F.when(F.col(y) == 1, n / max(1, 2 * one)).otherwise(n / max(1, 2 * zero))).otherwise(0.0) for h, (zero, one) in zip(holds, sizes, strict=True) for n in (zero + one,)]
    rows = train.filter(F.col(y).isNotNull()).select(F.col(features).alias("x"), F.col(y).cast("double").alias("y"), F.array(*[w.cast("double") for w in balance]).alias("w"))
    of = lambda v, i: F.when(F.get("w", F.lit(i)) > 0, v)
    flat = rows.select("w", F.posexplode("x").alias("at", "v")).groupBy("at")
    moments = flat.agg(*[g(of(F.col("v"), i)).alias(f"{g.__name__}_{i}") for i in range(len(holds)) for g in (F.avg, F.stddev_pop)]).orderBy("at").collect()  # a row a feature
    usable = [i for i, (zero, one) in enumerate(sizes) if zero and one]
    scales = {}
    for i in usable:
        mean, sd = (np.array([r[f"{g}_{i}"] for r in moments[: widths[i]]], float) for g in ("avg", "stddev_pop"))
        scales[i] = mean, np.where(sd > 0, sd, 1.0)
    chosen = rows.select("x", "y", F.array(*[F.get("w", F.lit(i)) for i in usable]).alias("w")) if usable else rows
    found = newton(chosen, [(widths[i], list(fits.values())[i].c) for i in usable], [scales[i] for i in usable]) if usable else []
    if own:
        train.unpersist()
    out = {}
    for i, name in enumerate(fits):
        if i not in usable:
            out[name] = Model(constant=float(sizes[i][1] > 0))
            continue
        b, (mean, sd) = found[usable.index(i)], scales[i]
        out[name] = Model(float(b[0] - (b[1:] * mean / sd).sum()), tuple((b[1:] / sd).tolist()))
    return out


def fit_lr(train: DataFrame, apply_to: DataFrame, features: str = "features", c: float = 0.5, y: str = "y") -> DataFrame:
    """`apply_to` with score: P(right) by a logistic regression with balanced class weights on standardised features, penalty 1 / (2 c). A single class gives its own value.

    Newton steps on summed Hessians up to NEWTON_FEATURES features, beyond them Spark's L-BFGS: the same strictly convex problem, so the same coefficients.
    """
    train, own = _kept(train, features, y)
    first = train.select(F.size(features)).first()
    if first is None or first[0] <= NEWTON_FEATURES:
        model = fit_stack(train, {"lr": Fit(c)}, features, y)["lr"] if first else Model(constant=0.0)
        if own:
            train.unpersist()
        return apply_to.withColumn("score", model.score(features))
    sizes = {int(r[y]): r["count"] for r in train.groupBy(y).count().collect()}
    n = sum(sizes.values())
    if len(sizes) < 2:
        if own:
            train.unpersist()
        return apply_to.withColumn("score", F.lit(float(next(iter(sizes), 0))))
    t, a = scale_array(train, train, features), scale_array(train, apply_to, features)
    t = t.withColumn("_w", F.when(F.col(y) == 1, n / (2 * sizes[1])).otherwise(n / (2 * sizes[0])))
    t = t.select(F.col(y).cast("double").alias("label"), array_to_vector(features).alias("_x"), "_w")
    model = LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, probabilityCol="_p", maxIter=200).fit(t)
    if own:
        train.unpersist()
    return _scored(model, a, apply_to, features)


def _scored(model, scaled: DataFrame, apply_to: DataFrame, features: str) -> DataFrame:
    out = model.transform(scaled.withColumn("_x", array_to_vector(features)))
    return out.select(*[c for c in apply_to.columns if c != "score"], vector_to_array("_p")[1].alias("score"))


def fit_mlp_ensemble(train: DataFrame, apply_to: DataFrame, seeds: tuple[int, ...] = (0, 1, 2, 3, 4), hidden: int = 128, features: str = "features", y: str = "y", epochs: int = 300) -> DataFrame:
    """A row for each row of `apply_to` and seed: member, score (P(right); null without features). One hidden layer of rectified units, Adam, early stopping on held-out rows; all seeds
    are fitted in the same readings of `train`. `ensemble` averages the members. A single class gives its own value."""
    train, own = _kept(train, features, y)
    nets = network.fit_ensemble(train, seeds, hidden, features, y, network.Training(epochs=epochs))
    if own:
        train.unpersist()
    found = apply_to.drop("member", "score").withColumn("_p", network.scores(apply_to, nets, len(seeds), features))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("member"), F.get("_p", F.lit(i)).alias("score")) for i, s in enumerate(seeds)]))
    return found.withColumn("_m", each).withColumns({"score": F.col("_m.score"), "member": F.col("_m.member")}).drop("_p", "_m")


def ensemble(members: DataFrame, keys: tuple[str, ...] = ("idx",), y: str = "y") -> DataFrame:
    return members.groupBy(*keys).agg(F.first(y).alias(y), F.avg("score").alias("score"))


def seed_aucs(members: DataFrame, y: str = "y") -> DataFrame:
    """member, auroc of each seed's model, with the mean and deviation over seeds on every row."""
    a = auroc(members, ["member"], y=y)
    whole = a.agg(F.avg("auroc").alias("mean_auroc"), F.stddev_samp("auroc").alias("sd_auroc"))
    return a.join(F.broadcast(whole))


def shallow_probe(train: DataFrame, apply_to: DataFrame, text: str = "phase1_solution") -> DataFrame:
    """P(right) by the seven shallow features of the text alone; rows that have them (shallow) need no text."""
    t, a = (d if "shallow" in d.columns else with_shallow(d, text) for d in (train, apply_to))
    return fit_lr(t, a, "shallow").select(*apply_to.columns, "score")


def score_with(detector: str, train: DataFrame, apply_to: DataFrame, c: float = 0.5, hidden: int = 128, seeds: tuple[int, ...] = (0, 1, 2, 3, 4), epochs: int = 300) -> DataFrame:
    """`apply_to` with score by a named detector: lr or mlp (seeds averaged), on raw features or on what `shallow` doesn't explain of them (controlled)."""
    model, _, kind = detector.partition("_")
    train, own = _kept(train, "features", "y", *(["shallow"] if kind == "controlled" else []))
    fitted, apply_to = controlled(train, apply_to) if kind == "controlled" else (train, apply_to)
    if model == "lr":
        out = fit_lr(fitted, apply_to, c=c)
    else:
        nets = network.fit_ensemble(fitted, seeds, hidden, how=network.Training(epochs=epochs))
        out = apply_to.withColumn("score", mean_score(apply_to, nets, len(seeds)))
    if own:
        train.unpersist()
    return out


def controlled(train: DataFrame, apply_to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with what train's shallow features, standardised, explain of the features taken off. What is learned of train is known when this returns."""
    t, a = scale_array(train, train, "shallow"), scale_array(train, apply_to, "shallow")
    sums = _products(t, "shallow", "features", None)
    return residualize(t, t, products=sums), residualize(t, a, products=sums)


def mean_score(df: DataFrame, nets: list[network.Network] | float, n: int, features: str | Column = "features") -> Column:
    """The mean of the members' P(right)."""
    return F.aggregate(network.scores(df, nets, n, features), F.lit(0.0), lambda s, p: s + p) / n


def fit_raw_and_controlled(train: DataFrame, apply_to: DataFrame, model: str = "lr", **how) -> DataFrame:
    """detector (raw, controlled) and score of the rows of `apply_to` (features, shallow) by both variants of a model. `train` is read once for both."""
    keys = [c for c in apply_to.columns if c not in ("features", "shallow", "score", "detector")]
    train, own = _kept(train, "features", "shallow", "y")
    out = [score_with(f"{model}_{k}", train, apply_to, **how).select(*keys, "score", F.lit(k).alias("detector")) for k in ("raw", "controlled")]
    if own:
        train.unpersist()
    return out[0].unionByName(out[1])


def transfer_matrix(splits: dict[str, tuple[DataFrame, DataFrame]], keys: tuple[str, ...] = ("idx",), detector: str = "lr_raw", **how) -> DataFrame:
    """source, target, keys, y, score: a model (and, controlled, the coefficients of shallow features) fitted on each source's train rows scores each target's
    test rows. splits: few named pairs. Regressions on raw features of all sources are one stack."""
    columns = lambda d, source, target: d.select(source.alias("source"), target.alias("target"), *keys, "y", "score")
    kept = functools.reduce(DataFrame.unionByName, [train.select("features", "y", F.lit(source).alias("_source")) for source, (train, _) in splits.items()]).persist() if detector == "lr_raw" else None
    if kept is not None and kept.select(F.size("features") <= NEWTON_FEATURES).first()[0]:
        models = fit_stack(kept, {s: Fit(how.get("c", 0.5), rows=F.col("_source") == s) for s in splits})
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), m.score("features").alias("score")) for s, m in models.items()]))
        out = [columns(test.withColumn("_m", each).withColumn("score", F.col("_m.score")), F.col("_m.source"), F.lit(target)) for target, (_, test) in splits.items()]
    else:
        out = [columns(score_with(detector, train, test, **how), F.lit(source), F.lit(target)) for source, (train, _) in splits.items() for target, (_, test) in splits.items()]
    if kept is not None:
        kept.unpersist()
    return functools.reduce(DataFrame.unionByName, out)


def transfer_deltas(scores: DataFrame) -> DataFrame:
    """source, target, auroc, in_distribution (the target's own model) and retained (their difference)."""
    m = auroc(scores, ["source", "target"])
    own = m.filter("source = target").select("target", F.col("auroc").alias("in_distribution"))
    return m.join(own, "target").withColumn("retained", F.col("auroc") - F.col("in_distribution"))


def features_of(heads: DataFrame, top: DataFrame, keys: tuple[str, ...], shallow: DataFrame | None = None) -> DataFrame:
    """keys, y, features of the chosen heads, and shallow if a table of keys and shallow is given."""
    few = heads.join(F.broadcast(top.select("flat_head", "rank")), "flat_head").dropna(subset=list(keys))
    rows = few.groupBy(*keys).agg(F.first("y").alias("y"), F.array_sort(F.collect_list(F.struct("rank", "vec"))).alias("x"))
    out = rows.select(*keys, F.flatten(F.col("x.vec")).cast("array<double>").alias("features"), "y")
    return out if shallow is None else out.join(shallow.select(*keys, "shallow"), list(keys))


def sweep(train_heads: DataFrame, test_heads: DataFrame, grid: dict[str, tuple], default: dict, detectors: tuple[str, ...] = ("lr_raw",), shallow: DataFrame | tuple[DataFrame, DataFrame] | None = None, keys: tuple[str, ...] = ("idx",), **how) -> DataFrame:
    """axis, cell, detector, auroc: one axis (topk, c, hidden) at a time around the default, for cells that a detector's model depends on. Head AUCs are worked out once.

    Train rows are put together once and kept, raw and controlled side by side. The regressions of all cells are one stack, and so are all cells' networks of both kinds: the features of fewer
    heads are the first of those of more, with what shallow features explain taken off each alone. More heads than there are: all. Test rows are read once for all cells and detectors.
    shallow: a table of keys and shallow, or one for train and one for test.
    """
    most = max([default["topk"], *grid.get("topk", ())])
    ranked = head_ranking(head_lda_auc(train_heads), most, None)
    chosen = ranked.collect()  # the chosen heads
    order = ranked.sparkSession.createDataFrame(chosen, ranked.schema)
    cells = [("default", "default", default), *[(a, str(v), default | {a: v}) for a, values in grid.items() for v in values]]
    train, test = (features_of(h, order, keys, s) for h, s in zip((train_heads, test_heads), shallow if isinstance(shallow, tuple) else (shallow, shallow), strict=True))
    whole = train.persist()
    size = train_heads.select(F.size("vec")).first()[0]
    # every step is a job over the kept rows: no more tasks than their number asks for
    train = whole.coalesce(max(whole.sparkSession.sparkContext.defaultParallelism, whole.count() * len(chosen) * size // network.NUMBERS_A_PART))
    width = lambda v: min(v["topk"], len(chosen)) * size
    kinds = sorted({d.partition("_")[2] for d in detectors}, reverse=True)
    if "controlled" in kinds:
        both = controlled(*(d.select("features", "shallow", "y", F.col("features").alias("raw")) for d in (train, test)))
        kept, target = (d.select("raw", F.col("features").alias("controlled"), "y") for d in both)
    else:
        kept, target = (d.select(F.col("features").alias("raw"), "y") for d in (train, test))
    kept = kept.persist()
    every = [(axis, cell, d, v) for d in detectors for axis, cell, v in cells if (axis, d.partition("_")[0]) not in (("c", "mlp"), ("hidden", "lr"))]
    # names: of the scores of a row of target, in their order; regressions are networks without hidden layers there, so one function finds all scores
    names, fitted, alone, start = [], [], [], {k: i * len(chosen) * size for i, k in enumerate(kinds)}
    for kind in kinds:
        fits = {(axis, cell, d): Fit(v["c"], width(v)) for axis, cell, d, v in every if d == f"lr_{kind}"}
        if fits and len(chosen) * size <= NEWTON_FEATURES:
            models = fit_stack(kept, fits, kind)
            names += models
            fitted += [m.network(fits[name].width, start[kind]) for name, m in models.items()]
            continue
        for name, f in fits.items():
            alone.append((name, fit_lr(*(d.select(F.slice(kind, 1, f.width).alias("features"), "y") for d in (kept, target)), c=f.c)))
    seeds, each = how.get("seeds", (0, 1, 2, 3, 4)), [1] * len(names)
    nets = {(axis, cell, d): (v.get("hidden", 128), start[d.partition("_")[2]], width(v)) for axis, cell, d, v in every if d.startswith("mlp")}
    if nets:
        members = [network.Member(s, *of) for of in nets.values() for s in seeds]
        found = network.fit_members(kept.select(F.concat(*kinds).alias("features"), "raw", "y"), members, how=network.Training(epochs=how.get("epochs", 300)), deal="raw")
        names += nets
        each += [len(seeds)] * len(nets) if isinstance(found, list) else [1] * len(nets)
        fitted += found if isinstance(found, list) else [Model(constant=found).network(size, 0)] * len(nets)
    kept.unpersist()
    whole.unpersist()
    out = [scored.select(F.lit(len(names) + i).alias("_at"), "y", "score") for i, (_, scored) in enumerate(alone)]
    if fitted:
        out.append(target.select("y", network.scores(target, fitted, each, F.concat(*kinds)).alias("_s")).select(F.posexplode("_s").alias("_at", "score"), "y").select("_at", "y", "score"))
    of = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("axis", "cell", "detector"), name, strict=True)]) for name in [*names, *(name for name, _ in alone)]])
    return auroc(functools.reduce(DataFrame.unionByName, out), ["_at"]).select(F.get(of, F.col("_at")).alias("_m"), "auroc").select("_m.axis", "_m.cell", "_m.detector", "auroc")


def replicate_weights(units: DataFrame, reps: int, seed: int, keys: tuple[str, ...] = ("idx",), attempts: int = 10) -> DataFrame:
    """keys and w, an array: how often each of `units` (keys, y; distinct) is drawn in each replicate, as many with replacement as there are.

    A replicate in which one class is missing is drawn anew, `attempts` times at most; then all its numbers are 0. Only keys are numbered and drawn, by hash: no dependence on partitions.
    """
    placed = numbered(units.select(F.struct(*keys).alias("_unit"), "y"), [], "_unit")
    n = units.count()

    def drawn(tries: dict[int, int]) -> DataFrame:
        at = [F.struct(F.lit(r).alias("r"), F.pmod(draw_hash(seed, F.lit(r), F.lit(t), F.col("id")), F.lit(n)).alias("_i")) for r, t in tries.items()]
        each = units.sparkSession.range(n).select(F.explode(F.array(*at)).alias("d")).select("d.*")
        times = each.groupBy("_i").agg(F.array(*[F.count_if(F.col("r") == r) for r in range(reps)]).alias("w"))
        return placed.join(times, "_i").select("_unit.*", "y", "w")

    chosen, open_ = {}, range(reps) if n else ()
    for t in range(attempts):
        tries = {r: t for r in open_}
        if not tries:
            break
        seen = drawn(tries).agg(*[F.count_if((F.get("w", F.lit(r)) > 0) & (F.col("y") == k)) for r in tries for k in (0, 1)]).first()
        chosen |= {r: t for i, r in enumerate(tries) if seen[2 * i] and seen[2 * i + 1]}
        open_ = [r for r in tries if r not in chosen]
    if not chosen:
        return units.select(*keys, F.array_repeat(F.lit(0).cast("long"), reps).alias("w"))
    return drawn(chosen).select(*keys, "w")


def train_resample_auc(train_heads: DataFrame, test_heads: DataFrame, reps: int = 8, seed: int = 0, topk: int = 32, detector: str = "lr_raw", shallow: DataFrame | None = None, keys: tuple[str, ...] = ("idx",), **how) -> DataFrame:
    """replicate, auroc on test: train rows are drawn with replacement, heads chosen, features residualised (controlled) and the model fitted anew each time.

    All replicates share the readings: their weights lie beside each row, the statistics and AUCs of heads are those of (replicate, head) pairs, residuals and regressions one stack.
    A task's sums hold a d x d matrix for each replicate, head and class. Replicates that lack a class after ten draws are left out.
    """
    weights = replicate_weights(train_heads.select(*keys, "y").distinct(), reps, seed, keys)
    pairs = F.filter(F.transform("_w", lambda v, i: F.struct(i.alias("replicate"), v.alias("w"))), lambda p: p["w"] > 0)
    drawn = train_heads.drop("w", "replicate").join(weights.withColumnRenamed("w", "_w"), list(keys)).select(*keys, "y", "flat_head", "vec", F.explode(pairs).alias("p")).select(*keys, "y", "flat_head", "vec", "p.*")
    n_heads = (train_heads.agg(F.max("flat_head")).first()[0] or 0) + 1
    aucs = head_lda_auc(drawn.withColumn("flat_head", F.col("replicate").cast("long") * n_heads + F.col("flat_head")), "w")
    aucs = aucs.select(F.floor(F.col("flat_head") / n_heads).cast("int").alias("replicate"), (F.col("flat_head") % n_heads).alias("flat_head"), "auc")
    place = F.row_number().over(Window.partitionBy("replicate").orderBy(F.desc("auc"), "flat_head"))
    top = aucs.withColumn("rank", place).filter(F.col("rank") <= topk).select("replicate", "flat_head", "rank")
    top = F.broadcast(top.sparkSession.createDataFrame(top.collect(), top.schema))  # topk heads a replicate

    def features(rows: DataFrame, *more: str) -> DataFrame:
        x = F.array_sort(F.collect_list(F.struct("rank", "vec"))).alias("x")
        out = rows.groupBy(*keys, "replicate").agg(F.first("y").alias("y"), x, *[F.first(c).alias(c) for c in more])
        out = out.withColumn("features", F.flatten(F.col("x.vec")).cast("array<double>")).drop("x")
        return out if shallow is None else out.join(shallow.select(*keys, "shallow"), list(keys))

    train = features(drawn.join(top, ["replicate", "flat_head"]), "w").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("w")))).drop("w", "_copy")
    train = kept = train.persist()
    test = features(test_heads.drop("replicate").join(top, "flat_head"))
    model, _, kind = detector.partition("_")
    every = sorted({r.replicate for r in top.select("replicate").distinct().collect()})
    if kind == "controlled":
        sums = _products(train, "shallow", "features", "replicate")
        train, test = (residualize(train, d, by="replicate", products=sums) for d in (train, test))
    if model == "lr" and every and train.select(F.size("features")).first()[0] <= NEWTON_FEATURES:
        models = fit_stack(train.select("replicate", "features", "y"), {str(r): Fit(how.get("c", 0.5), rows=F.col("replicate") == r) for r in every})
        kept.unpersist()
        score = functools.reduce(lambda w, r: w.when(F.col("replicate") == r, models[str(r)].score("features")), every[1:], F.when(F.col("replicate") == every[0], models[str(every[0])].score("features")))
        return auroc(test.withColumn("score", score), ["replicate"])
    each = [score_with(f"{model}_raw", *(d.filter(F.col("replicate") == r) for d in (train, test)), **how).select("replicate", "y", "score") for r in every]
    kept.unpersist()
    return auroc(functools.reduce(DataFrame.unionByName, each, test.select("replicate", "y", F.lit(0.0).alias("score")).limit(0)), ["replicate"])


def spread(draws: DataFrame, value: str = "auroc") -> DataFrame:
    return draws.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


