"""Report tables over metrics, and identities that they must satisfy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.operators.rank import BUDGETS, budget_metrics, rank_metrics, tie_groups, with_running
from gradelake.operators.routing import FRACTIONS, oracle_curve, routing_baselines


def main_metrics(scores: DataFrame, detectors: tuple[str, str] = ("probe", "judge"), by: tuple[str, ...] = ("run",)) -> DataFrame:
    """A row a run: n, n_wrong, prevalence, each metric of both detectors and their difference. scores: long, by detector."""
    m = rank_metrics(scores, [*by, "detector"])
    names = ("auroc", "ap", "aurc")
    wide = m.groupBy(*by).pivot("detector", list(detectors)).agg(*[F.first(x).alias(x) for x in names])
    size = m.groupBy(*by).agg(F.max("n").alias("n"), F.max("n_wrong").alias("n_wrong"))
    out = size.join(wide, list(by)).withColumn("prevalence", F.col("n_wrong") / F.col("n"))
    for x in names:
        p, q = (F.col(f"{d}_{x}") for d in detectors)
        out = out.withColumn(f"{x}_difference", p - q)
    return out


def with_intervals(main: DataFrame, draws: DataFrame, metrics: tuple[str, ...] = ("auroc", "ap", "aurc")) -> DataFrame:
    """`main` with the low and high ends of each difference over the replicates of `draws` (run, b, metrics)."""
    q = lambda m: F.percentile(F.when(~F.isnan(m), F.col(m)), F.array(F.lit(0.025), F.lit(0.975)))
    ends = draws.groupBy("run").agg(*[q(m).alias(m) for m in metrics])
    ends = ends.select("run", *[F.col(m)[i].alias(f"{m}_{n}") for m in metrics for i, n in enumerate(("low", "high"))])
    return main.join(ends, "run", "left")


def fixed_budget_table(scores: DataFrame, detectors: tuple[str, str] = ("probe", "judge"), by: tuple[str, ...] = ("run",), budgets: tuple[float, ...] = BUDGETS) -> DataFrame:
    """A row a run and budget: reviewed, recall and residual risk of both detectors, and the gains of the first."""
    m = budget_metrics(scores, [*by, "detector"], budgets=budgets)
    wide = m.groupBy(*by, "budget", "reviewed").pivot("detector", list(detectors)).agg(F.first("recall").alias("recall"), F.first("residual_risk").alias("residual_risk"))
    a, b = detectors
    return wide.withColumns({"recall_gain": F.col(f"{a}_recall") - F.col(f"{b}_recall"), "risk_gain": F.col(f"{b}_residual_risk") - F.col(f"{a}_residual_risk")})


def check_risk_identity(budget_table: DataFrame, main: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """The risk gain must be prevalence * recall gain / (1 - m / n): the largest discrepancy of each run."""
    j = budget_table.join(main.select(*by, "n", "prevalence"), list(by))
    d = F.abs(F.col("risk_gain") - F.col("prevalence") * F.col("recall_gain") / (1 - F.col("reviewed") / F.col("n")))
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n_budgets"), F.max(d).alias("max_discrepancy"))


def check_auroc_identity(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """The mean recall over all budgets m = 1 .. n must be p / 2 + (1 - p) * auroc + 1 / (2 n), p the share of wrong answers: both sides."""
    c = with_running(tie_groups(df, by, score, y), by)
    n, w = F.col("n"), F.col("wrong")
    recalls = F.sum(n * F.col("wrong_before") + w * (n + 1) / 2)  # sum over m within the cell
    pairs = F.sum(F.col("pos") * (F.col("wrong_before") + w / 2))
    t = c.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("wrong").alias("n_wrong"), F.sum("pos").alias("n_pos"), recalls.alias("_r"), pairs.alias("_p"))
    mean = F.try_divide(F.col("_r"), F.col("n_wrong").cast("double") * F.col("n"))
    p = F.col("n_wrong") / F.col("n")
    right = p / 2 + (1 - p) * F.try_divide(F.col("_p"), F.col("n_pos").cast("double") * F.col("n_wrong")) + 1 / (2 * F.col("n"))
    return t.select(*by, mean.alias("mean_recall"), right.alias("from_auroc"), F.abs(mean - right).alias("discrepancy"))


def check_routing_identity(df: DataFrame, by: list[str], fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """The oracle's curve by ordering the items against its closed form: the largest discrepancy."""
    a = oracle_curve(df, by, fractions)
    b = routing_baselines(df, by, fractions=fractions).select(*by, "fraction", "oracle_accuracy")
    return a.join(b, [*by, "fraction"]).groupBy(*by).agg(F.max(F.abs(F.col("accuracy") - F.col("oracle_accuracy"))).alias("max_discrepancy"))


def sweep_spans(rows: DataFrame, values: tuple[str, ...], default: str = "default", by: tuple[str, ...] = ("run",)) -> DataFrame:
    """For each run and axis: the least and largest of each value over the axis's rows and the default row, and whether the gap is positive in all."""
    axes = rows.filter(F.col("axis") != default).select(*by, "axis").distinct()
    base = rows.filter(F.col("axis") == default).drop("axis").join(axes, list(by))
    every = rows.filter(F.col("axis") != default).unionByName(base)
    aggs = [f(v).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("max", F.max))]
    return every.groupBy(*by, "axis").agg(*aggs, F.bool_and(F.col(values[-1]) > 0).alias("all_positive"))


def merge_sweeps(parts: DataFrame, expected: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Runs whose result files conflict (two different gap sets for one cell), and expected runs that none has: (run, state)."""
    cells = parts.groupBy(*by, "axis", "cell").agg(F.count_distinct("value").alias("n"))
    states = cells.groupBy(*by).agg(F.when(F.max("n") > 1, "conflict").otherwise("ok").alias("state"))
    return expected.join(states, list(by), "full_outer").select(*by, F.coalesce("state", F.lit("missing")).alias("state"))
