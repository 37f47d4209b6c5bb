"""Bootstrap: draws by hash, so they depend on no partitioning, and weighted metrics of every replicate.

`bootstrap_weights` draws rows (or whole clusters) exactly and in SQL. For many replicates of rank metrics `paired_intervals` needs no drawn rows: rows
with equal scores and label are exchangeable, so the counts of the distinct cells are drawn. Cells lie in hash parts; a replicate's draws are split down to
the parts by seeded binomials, and in a part among its cells, so any task can work out any part's counts, and they are the same however many cells there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.operators.rank import BUDGETS, auroc, beside, budget_metrics, rank_metrics
from gradelake.operators.routing import FRACTIONS, gain_over_random

#: Distinct (score_a, score_b, y) cells that are sent to every task at most; beyond, Spark sums the same draws.
MAX_CELLS = 1_000_000
#: Cells of a part among which its draws are shared out, about.
PART_CELLS = 1 << 16


def draw_hash(seed: int, *parts: Column) -> Column:
    """A 32-bit number from the md5 of seed and parts, joined by colons."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


#: Leading hexadecimal digits of the order hash that cut a group into ranges to be numbered.
_DIGITS = 3


def numbered(units: DataFrame, group: list[str], unit: str) -> DataFrame:
    """`units` (distinct, in groups) with _i, their place from 0 in a hashed order of their group, and _n, its size. A group is numbered in 4096 ranges, in parallel."""
    order = F.md5(F.col(unit).cast("string"))
    at = units.withColumns({"_order": order, "_range": F.conv(F.substring(order, 1, _DIGITS), 16, 10).cast("int")})
    sizes = at.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(*group)
    before = w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"), F.sum("_rows").over(w).alias("_n"))
    same = [F.col(f"u.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group] + [F.col("u._range") == F.col("s._range")]
    nth = F.row_number().over(Window.partitionBy(*group, "_range").orderBy("_order", unit)) - 1
    placed = at.withColumn("_nth", nth).alias("u").join(sizes.alias("s"), same)
    return placed.select(*[F.col(f"u.{c}").alias(c) for c in units.columns], (F.col("_first") + F.col("_nth")).alias("_i"), "_n")


def bootstrap_weights(df: DataFrame, n_boot: int, seed: int, unit: str = "idx", by: tuple[str, ...] = ("run",), strata: str | None = None) -> DataFrame:
    """(by, b, unit, w): how often each unit is drawn in replicate b, with replacement; units not drawn are left out.

    Units are rows, or clusters where `unit` names one that rows share. With strata as many are drawn of each class as it has. Draws depend on
    seed, b, stratum and position in a hashed order alone, so detectors that are compared see the same. A draw is a row until it is counted; for very large
    groups `poisson_weights` and `paired_intervals` need none.
    """
    group = [*by, *([strata] if strata else [])]
    placed = numbered(df.select(*group, unit).distinct(), group, unit)
    label = F.col(strata).cast("string") if strata else F.lit("all")
    b = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")
    draws = placed.select(*group, "_n", F.col("_i").alias("_j"), b)
    picked = draws.withColumn("_i", F.pmod(draw_hash(seed, F.col("b"), label, F.col("_j")), F.col("_n")))
    counts = picked.groupBy(*group, "b", "_i").agg(F.count(F.lit(1)).alias("w"))
    return counts.join(placed.select(*group, "_i", unit), [*group, "_i"]).select(*group, "b", unit, "w")


def poisson_weights(df: DataFrame, n_boot: int, seed: int, unit: str = "idx", by: tuple[str, ...] = ("run",)) -> DataFrame:
    """(by, b, unit, w) like `bootstrap_weights` for groups of any size: each unit counts a Poisson(1) number of times, by hash, so nothing is numbered or ordered."""
    units = df.select(*by, unit).distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    return units.withColumn("w", poisson(seed, F.col("b"), F.col(unit)).cast("long")).filter("w > 0").select(*by, "b", unit, "w")


def poisson(seed: int, *parts: Column) -> Column:
    """A Poisson(1) number by hash, below 9."""
    u = (draw_hash(seed, *parts) + 0.5) / float(1 << 32)
    cuts = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda x: x < u))


def percentile_ci(draws: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """mean, low and high (2.5 and 97.5 per cent, linear) of the replicates that are defined, and whether they leave zero out."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    out = draws.groupBy(*by).agg(F.count(value).alias("n_draws"), F.avg(value).alias("mean"), q.alias("_q"))
    return out.select(*by, "n_draws", "mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), ((F.col("_q")[0] > 0) | (F.col("_q")[1] < 0)).alias("excludes_zero"))


def weighted(df: DataFrame, weights: DataFrame, unit: str = "idx") -> DataFrame:
    keys = [c for c in weights.columns if c not in ("b", "w")]
    return df.join(weights, keys)


def two_scores(df: DataFrame, a: str, b: str) -> DataFrame:
    """`df` with _score_a and _score_b, and without columns that are named like those of weights."""
    return df.withColumns({"_score_a": F.col(f"`{a}`"), "_score_b": F.col(f"`{b}`")}).drop("b", "w")


def paired_bootstrap(df: DataFrame, a: str, b: str, n_boot: int, seed: int, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """(by, b, auroc, ap, aurc): the differences of detectors a and b (columns) in class-stratified replicates, drawn row by row."""
    df = two_scores(df, a, b)
    w = weighted(df, bootstrap_weights(df, n_boot, seed, by=by, strata="y"))
    keys = [*by, "b"]
    one = lambda s: rank_metrics(w, keys, s, weight="w")
    x, z = one("_score_a"), one("_score_b")
    j = x.alias("x").join(z.alias("z"), keys)
    return j.select(*keys, *[(F.col(f"x.{m}") - F.col(f"z.{m}")).alias(m) for m in ("auroc", "ap", "aurc")])


def paired_budget_bootstrap(df: DataFrame, a: str, b: str, n_boot: int, seed: int, by: tuple[str, ...] = ("run",), budgets: tuple[float, ...] = BUDGETS) -> DataFrame:
    """(by, b, budget, recall, residual_risk): the differences at each budget in class-stratified replicates."""
    df = two_scores(df, a, b)
    w = weighted(df, bootstrap_weights(df, n_boot, seed, by=by, strata="y"))
    keys = [*by, "b"]
    x, z = (budget_metrics(w, keys, s, budgets=budgets, weight="w").alias(n) for s, n in (("_score_a", "x"), ("_score_b", "z")))
    return x.join(z, [*keys, "budget"]).select(*keys, "budget", *[(F.col(f"x.{m}") - F.col(f"z.{m}")).alias(m) for m in ("recall", "residual_risk")])


def paired_recall_bootstrap(df: DataFrame, flag_a: str, flag_b: str, n_boot: int, seed: int, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """(by, b, difference): recall of wrong answers by flag_a less that by flag_b; replicates without wrong answers are null."""
    w = weighted(df, bootstrap_weights(df, n_boot, seed, by=by))
    wrong = F.when(F.col("y") == 0, F.col("w")).otherwise(0)
    recall = lambda f: F.try_divide(F.sum(wrong * F.col(f).cast("int")), F.sum(wrong))
    return w.groupBy(*by, "b").agg((recall(flag_a) - recall(flag_b)).alias("difference"))


def cluster_bootstrap(df: DataFrame, a: str, b: str, cluster: str, n_boot: int, seed: int, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """(by, b, difference): AUROC of a less that of b, whole clusters drawn together; null in replicates with a single class."""
    df = two_scores(df, a, b)
    w = weighted(df, bootstrap_weights(df, n_boot, seed, cluster, by))
    keys = [*by, "b"]
    x, z = auroc(w, keys, "_score_a", weight="w"), auroc(w, keys, "_score_b", weight="w")
    return x.alias("x").join(z.alias("z"), keys).select(*keys, (F.col("x.auroc") - F.col("z.auroc")).alias("difference"))


def two_sample_delta(perturbed: DataFrame, reference: DataFrame, score: str, n_boot: int, seed: int, cluster: str = "template", by: tuple[str, ...] = ("run",), minus: str | None = None) -> DataFrame:
    """(by, b, difference): AUROC on the perturbed set (clusters drawn) less that on the reference (rows drawn, apart). minus: less the same of another score."""
    keys = [*by, "b"]
    p = weighted(perturbed, bootstrap_weights(perturbed, n_boot, seed, cluster, by))
    r = weighted(reference, bootstrap_weights(reference, n_boot, seed + 1, "idx", by))
    delta = lambda s: auroc(p, keys, s, weight="w").alias("x").join(auroc(r, keys, s, weight="w").alias("z"), keys).select(*keys, (F.col("x.auroc") - F.col("z.auroc")).alias("difference"))
    if minus is None:
        return delta(score)
    return delta(score).alias("x").join(delta(minus).alias("z"), keys).select(*keys, (F.col("x.difference") - F.col("z.difference")).alias("difference"))


def routing_gain_bootstrap(df: DataFrame, n_boot: int, seed: int, order: str = "score", by: tuple[str, ...] = ("run",), fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """(by, b, fraction, gain_over_random) with the routing order worked out in each replicate."""
    w = weighted(df, bootstrap_weights(df, n_boot, seed, by=by))
    return gain_over_random(w, [*by, "b"], fractions, order, weight="w").drop("m")


def routing_gain_difference(df: DataFrame, a: str, b: str, n_boot: int, seed: int, by: tuple[str, ...] = ("run",), fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """(by, b, fraction, difference): gain over random of routing by a less that by b, in the same replicates."""
    x, z = (routing_gain_bootstrap(df, n_boot, seed, s, by, fractions).alias(n) for s, n in ((a, "x"), (b, "z")))
    return x.join(z, [*by, "b", "fraction"]).select(*by, "b", "fraction", (F.col("x.gain_over_random") - F.col("z.gain_over_random")).alias("difference"))


def template_delta_bootstrap(pairs: DataFrame, n_boot: int, seed: int, template: str = "template", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, b, mean_delta) over templates drawn with replacement."""
    w = weighted(pairs, bootstrap_weights(pairs, n_boot, seed, template, by))
    return w.groupBy(*by, "b").agg((F.sum(F.col("delta") * F.col("w")) / F.sum("w")).alias("mean_delta"))


def part_total(cuts: np.ndarray, i: int, key: tuple[int, ...], name: bytes) -> int:
    """How many of cuts[-1] draws fall into part i of parts that begin at `cuts`: halves share draws by a binomial that is seeded by key, the half's place and name."""
    lo, hi, left = 0, len(cuts) - 1, int(cuts[-1])
    while hi - lo > 1 and left:
        mid = (lo + hi) // 2
        share = (cuts[mid] - cuts[lo]) / (cuts[hi] - cuts[lo])
        first = int(np.random.default_rng([*key, lo, hi, *name]).binomial(left, share))
        lo, hi, left = (lo, mid, first) if i < mid else (mid, hi, left - first)
    return left


def part_draws(n: np.ndarray, cuts: np.ndarray, i: int, key: tuple[int, ...], name: bytes) -> np.ndarray:
    """How often each cell of part i is drawn, whose cells stand for n rows each."""
    return np.random.default_rng([*key, i, i + 1, *name]).multinomial(part_total(cuts, i, key, name), n / n.sum())


def in_parts(cells: DataFrame, run: str) -> DataFrame:
    """`cells` (run, _a, _b, _y, _n) with _part: as many hash parts of a run's class as its cells need."""
    sizes = cells.groupBy(run, "_y").agg(F.count(F.lit(1)).alias("_cells"))
    part = F.pmod(F.xxhash64("_a", "_b"), 1 + F.floor(F.col("_cells") / PART_CELLS))
    return beside(cells, sizes, [run, "_y"]).withColumn("_part", part).drop("_cells")


def drawn_cells(cells: DataFrame, n_boot: int, seed: int, run: str) -> DataFrame:
    """(run, b, _score_a, _score_b, y, w): the cells that each replicate draws and how often. A row for each of them, whatever number of rows they stand for."""
    group = [run, "_y", "_part"]
    own = cells.filter("_y in (0, 1)").groupBy(*group).agg(F.collect_list(F.struct("_a", "_b", "_n")).alias("_own"), F.sum("_n").alias("_size"))
    sizes = own.groupBy(run, "_y").agg(F.sort_array(F.collect_list(F.struct("_part", "_size"))).alias("_sizes"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (r, y, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("run", "_y", "_part")), strict=True)):
                a, z, n = (batch.column("_own")[i].values.field(c).to_numpy(zero_copy_only=False) for c in ("_a", "_b", "_n"))
                order = np.lexsort((z, a))
                a, z, n = a[order], z[order], n[order]
                parts, rows = (batch.column("_sizes")[i].values.field(c).to_numpy() for c in ("_part", "_size"))
                cuts, at = np.append(0, np.cumsum(rows)), int(np.searchsorted(parts, part))
                for b in range(n_boot):
                    w = part_draws(n, cuts, at, (seed, b, y), (r or "").encode())
                    hit = w > 0
                    k = int(hit.sum())
                    if k:
                        cols = [pa.array([r] * k, pa.string()), pa.array(np.full(k, b)), pa.array(a[hit]), pa.array(z[hit]), pa.array(np.full(k, y, np.int32)), pa.array(w[hit])]
                        yield pa.RecordBatch.from_arrays(cols, names=["run", "b", "_score_a", "_score_b", "y", "w"])

    rows = beside(own, sizes, [run, "_y"]).select(F.col(run).cast("string").alias("run"), "_y", "_part", "_own", "_sizes")
    return rows.mapInArrow(draw, "run string, b long, _score_a double, _score_b double, y int, w long")


def cell_metrics(score: np.ndarray, wrong: np.ndarray, pos: np.ndarray, budgets: tuple[float, ...]) -> list[float]:
    """auroc, ap, aurc, and recall and residual risk at each budget, from the counts of cells (any order, scores may repeat)."""
    return place_metrics(np.unique(score, return_inverse=True)[1], wrong, pos, budgets)


def place_metrics(where: np.ndarray, wrong: np.ndarray, pos: np.ndarray, budgets: tuple[float, ...]) -> list[float]:
    """`cell_metrics` of cells whose scores have these places in order."""
    w, p = np.bincount(where, wrong), np.bincount(where, pos)
    n = w + p
    used = n > 0
    w, p, n = w[used], p[used], n[used]
    cn, cw = np.cumsum(n), np.cumsum(w)
    total, all_wrong = cn[-1], cw[-1]
    au = (p * (cw - w / 2)).sum() / (p.sum() * all_wrong) if p.sum() and all_wrong else np.nan
    ap = (w * cw / cn).sum() / all_wrong if all_wrong else np.nan
    above_n, above_w = total - cn, all_wrong - cw
    h = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, int(total) + 1))])
    ac = (w + (above_w - above_n * w / n) * (h[(above_n + n).astype(int)] - h[above_n.astype(int)])).sum() / total
    out = [au, ap, ac]
    for b in budgets:
        m = max(1, min(total - 1, np.floor(b * total + 0.5)))
        k = int(np.searchsorted(cn, m))
        caught = cw[k] - w[k] + (m - (cn[k] - n[k])) * w[k] / n[k]
        out += [caught / all_wrong if all_wrong else np.nan, (all_wrong - caught) / (total - m) if total > m else np.nan]
    return out


def metric_names(budgets: tuple[float, ...]) -> list[str]:
    return ["auroc", "ap", "aurc", *[f"{m}_{b:g}" for b in budgets for m in ("recall", "residual_risk")]]


def summed_intervals(cells: DataFrame, n_boot: int, seed: int, budgets: tuple[float, ...], run: str) -> DataFrame:
    """What `paired_intervals` gives, from drawn cells that Spark orders and sums."""
    w, keys = drawn_cells(cells, n_boot, seed, run), ["run", "b"]

    def both(x: DataFrame, z: DataFrame, on: list[str], metrics: tuple[str, ...]) -> DataFrame:
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"z.{c}")) for c in on]
        return x.alias("x").join(z.alias("z"), same).select(*[F.col(f"x.{c}") for c in on], *[(F.col(f"x.{m}") - F.col(f"z.{m}")).alias(m) for m in metrics])

    whole = both(*(rank_metrics(w, keys, c, weight="w") for c in ("_score_a", "_score_b")), keys, ("auroc", "ap", "aurc"))
    at = both(*(budget_metrics(w, keys, c, budgets=budgets, weight="w") for c in ("_score_a", "_score_b")), [*keys, "budget"], ("recall", "residual_risk"))
    values = [F.max(F.when(F.abs(F.col("budget") - v) < 1e-12, F.col(m))).alias(f"{m}_{v:g}") for v in budgets for m in ("recall", "residual_risk")]
    wide = at.groupBy(*keys).agg(*values)
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"z.{c}")) for c in keys]
    out = whole.alias("x").join(wide.alias("z"), same, "left").select("x.*", *[F.col(f"z.`{c}`") for c in wide.columns if c not in keys])
    return out.select(*keys, *[F.coalesce(F.col(f"`{m}`"), F.lit(float("nan"))).alias(m) for m in metric_names(budgets)])


def paired_intervals(df: DataFrame, a: str, b: str, n_boot: int = 2000, seed: int = 0, budgets: tuple[float, ...] = BUDGETS, run: str = "run") -> DataFrame:
    """(run, b, metrics): differences of a and b in class-stratified replicates, each drawn as cell counts.

    The cells of a run are the distinct (a, b, y) with their counts. A draw depends on seed, run, replicate and the run's cells alone. Up to MAX_CELLS cells are sent
    to all tasks and replicates are spread over tasks; beyond, Spark orders and sums the drawn cells: the same draws, so the same figures but for rounding.
    """
    spark = df.sparkSession
    scores = [F.col(c).cast("double").alias(n) for c, n in ((a, "_a"), (b, "_b"))]
    cells = in_parts(df.groupBy(run, *scores, F.col("y").cast("int").alias("_y")).agg(F.count(F.lit(1)).alias("_n")), run)
    if cells.limit(MAX_CELLS + 1).count() > MAX_CELLS:
        return summed_intervals(cells, n_boot, seed, budgets, run)
    names = metric_names(budgets)

    def prepared(c: pd.DataFrame) -> tuple:
        """The parts of each class in order (row numbers, counts, cuts of parts, place), the labels, and both scores' places."""
        c = c.sort_values(["_y", "_part", "_a", "_b"], ignore_index=True)
        n, parts = c["_n"].to_numpy(), []
        for k in (0, 1):
            own = [g.to_numpy() for _, g in c.index.to_series()[c["_y"] == k].groupby(c["_part"])]
            cuts = np.append(0, np.cumsum([n[g].sum() for g in own]))
            parts += [(k, g, n[g], cuts, i) for i, g in enumerate(own)]
        return parts, c["_y"].to_numpy(), [np.unique(c[x], return_inverse=True)[1] for x in ("_a", "_b")]

    groups = cells.toPandas().groupby(run, dropna=False)
    table = spark.sparkContext.broadcast({None if pd.isna(k) else k: prepared(g) for k, g in groups})

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch.itertuples(index=False):
                parts, y, places = table.value[name.run]
                drawn = np.zeros(len(y))
                for k, at, n, cuts, i in parts:
                    drawn[at] = part_draws(n, cuts, i, (seed, int(name.b), k), (name.run or "").encode())
                both = [place_metrics(p, drawn * (y == 0), drawn * (y == 1), budgets) for p in places]
                rows.append([name.run, int(name.b), *(np.array(both[0]) - np.array(both[1]))])
            yield pd.DataFrame(rows, columns=["run", "b", *names])

    runs = cells.select(F.col(run).alias("run")).distinct()
    todo = runs.join(spark.range(n_boot).select(F.col("id").alias("b"))).repartition("run", "b")
    return todo.mapInPandas(replicate, "run string, b long, " + ", ".join(f"`{x}` double" for x in names))
