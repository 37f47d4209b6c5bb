"""Routing compute: the answers with the lowest scores get the majority's answer instead of the greedy one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.operators.rank import at_ranks, with_running

FRACTIONS = tuple(i / 20 for i in range(21))


def gain_cells(df: DataFrame, by: list[str], order: str = "score", greedy: str = "greedy_ok", major: str = "major_ok", weight: str | None = None) -> DataFrame:
    """Tie groups of the routing order with n, greedy, major and gain (major - greedy)."""
    w = F.col(weight) if weight else F.lit(1)
    g = df.groupBy(*by, F.col(order).alias("score")).agg(F.sum(w).alias("n"), F.sum(w * F.col(greedy)).alias("greedy"), F.sum(w * F.col(major)).alias("major"))
    return g.filter("n > 0").withColumn("gain", F.col("major") - F.col("greedy"))


def routed(df: DataFrame, by: list[str], fractions: tuple[float, ...] = FRACTIONS, order: str = "score", weight: str | None = None, rounding=lambda x: F.floor(x + 0.5), descending: bool = False) -> DataFrame:
    """For each fraction: m routed, and the gain of those m (ties in expectation), with the group's totals."""
    cells = with_running(gain_cells(df, by, order, weight=weight), by, descending, values=("n", "gain", "greedy"))
    ranks = F.transform(F.array(*map(F.lit, fractions)), lambda f: F.struct(f.alias("label"), rounding(f * F.col("n_all")).cast("long").alias("m")))
    gained = F.col("gain_before") + (F.col("m") - F.col("n_before")) * F.col("gain") / F.col("n")
    return at_ranks(cells, by, ranks, "m", "fraction").select(*by, "fraction", "m", F.when(F.col("m") == 0, 0.0).otherwise(gained).alias("gained"), "n_all", "gain_all", "greedy_all")


def routed_accuracy(df: DataFrame, by: list[str], fractions: tuple[float, ...] = FRACTIONS, order: str = "score") -> DataFrame:
    """Accuracy when the lowest-score fraction takes the majority's answer; m is rounded half to even."""
    r = routed(df, by, fractions, order, rounding=F.bround)
    return r.select(*by, "fraction", "m", ((F.col("greedy_all") + F.col("gained")) / F.col("n_all")).alias("accuracy"))


def gain_over_random(df: DataFrame, by: list[str], fractions: tuple[float, ...] = FRACTIONS, order: str = "score", weight: str | None = None) -> DataFrame:
    """Gain of routing by score above routing as many at random: gained / n - m / n * mean gain."""
    r = routed(df, by, fractions, order, weight)
    n = F.col("n_all")
    return r.select(*by, "fraction", "m", (F.col("gained") / n - F.col("m") / n * F.col("gain_all") / n).alias("gain_over_random"))


def routing_baselines(df: DataFrame, by: list[str], k: int = 5, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """For each fraction: the exact random line, the oracle (largest gains first), both costs an item; repairs, breaks and routing all."""
    gain = F.col("major_ok") - F.col("greedy_ok")
    n = F.count(F.lit(1))
    t = df.groupBy(*by).agg(n.alias("n"), F.avg("greedy_ok").alias("greedy"), F.avg("major_ok").alias("route_all"), F.count_if(gain > 0).alias("repairs"), F.count_if(gain < 0).alias("breaks"))
    t = t.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions)))).withColumn("m", F.floor(F.col("fraction") * F.col("n")))
    r = F.col("fraction")
    oracle = F.col("greedy") + (F.least("m", "repairs") - F.greatest(F.lit(0), F.col("m") - (F.col("n") - F.col("breaks")))) / F.col("n")
    return t.select(
        *by, "fraction", "m", "repairs", "breaks", "route_all",
        (F.col("greedy") + r * (F.col("route_all") - F.col("greedy"))).alias("random_accuracy"),
        oracle.alias("oracle_accuracy"), (1 - r + r * k).alias("cost_replace"), (1 + r * k).alias("cost_extra"),
    )


def oracle_curve(df: DataFrame, by: list[str], fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """The oracle's accuracy by ordering the items themselves by gain, m cut off."""
    d = df.withColumn("score", F.col("major_ok") - F.col("greedy_ok"))
    r = routed(d, by, fractions, rounding=F.floor, descending=True)
    return r.select(*by, "fraction", ((F.col("greedy_all") + F.col("gained")) / F.col("n_all")).alias("accuracy"))


def peak(curve: DataFrame, by: list[str], value: str = "accuracy") -> DataFrame:
    """The best value of a curve and the least fraction that has it."""
    best = F.max_by("fraction", F.struct(F.col(value), -F.col("fraction")))
    return curve.groupBy(*by).agg(F.max(value).alias("peak"), best.alias("peak_fraction"))


