"""Confusion matrices, rates and majority votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positive(c: str, marker: str = "YES") -> Column:
    """Whether a column says yes: booleans as they are, strings by comparing with `marker` in any case; null is no."""
    return F.coalesce(F.upper(F.col(c).cast("string")).isin(marker.upper(), "TRUE"), F.lit(False))


def confusion_matrix(df: DataFrame, truth: str, pred: str, by: tuple[str, ...] = ("run",), marker: str = "YES") -> DataFrame:
    t, p = positive(truth, marker), positive(pred, marker)
    return df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"))


def all_confusions(df: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """The judge and the majority against gold and the judge against the majority, in one pass; the last two only over rows of two samples or more."""
    gold, judge, major = positive("solve_correct"), positive("judge_verdict"), positive("majority_correct")
    several = F.size("k_answers") >= 2
    cells = []
    for name, t, p, use in (("judge_gold", gold, judge, F.lit(True)), ("majority_gold", gold, major, several), ("judge_majority", major, judge, several)):
        cells += [F.count_if(use & a & b).alias(f"{name}_{x}") for x, a, b in (("tp", t, p), ("fn", t, ~p), ("fp", ~t, p), ("tn", ~t, ~p))]
    return df.groupBy(*by).agg(*cells)


def confusion_metrics(cm: DataFrame) -> DataFrame:
    """`cm` with accuracy, precision, recall, f1 and the shares of its rows; an empty denominator gives 0."""
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return cm.withColumns(
        {
            "accuracy": share(tp + tn, tp + fn + fp + tn),
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "f1": share(2 * tp, 2 * tp + fp + fn),
            "truth_yes_pct": share(100 * tp, tp + fn),
            "truth_no_pct": share(100 * tn, fp + tn),
        }
    )


def base_rates(df: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    n = F.count(F.lit(1))
    nulls = F.size(F.filter("k_answers", lambda a: a.isNull()))
    return df.groupBy(*by).agg(
        n.alias("n_loaded"),
        F.count_if("labelable").alias("n_evaluated"),
        F.try_divide(F.count_if(F.col("labelable") & F.col("solve_correct")), F.count_if("labelable")).alias("correct_rate"),
        F.try_divide(F.count_if(F.col("labelable") & (F.col("judge_verdict") == "YES")), F.count_if("labelable")).alias("judge_yes_rate"),
        F.try_divide(F.count_if(F.col("labelable") & F.col("majority_correct")), F.count_if("labelable")).alias("majority_correct_rate"),
        (F.count_if(F.col("phase1_answer").isNull()) / n).alias("parse_failure_rate"),
        F.try_divide(F.sum(nulls), F.sum(F.size("k_answers"))).alias("k_parse_failure_rate"),
    )


def truncation_rate(df: DataFrame, by: tuple[str, ...] = ("run",), warn_above: float = 0.02) -> DataFrame:
    """Truncated among those that report it (null is unknown), the share that reports it, and whether the rate is above `warn_above`."""
    rate = F.try_divide(F.count_if("truncated"), F.count("truncated"))
    return df.groupBy(*by).agg(F.count_if("truncated").alias("n_truncated"), rate.alias("rate"), (F.count("truncated") / F.count(F.lit(1))).alias("coverage"), F.coalesce(rate > warn_above, F.lit(False)).alias("warn"))


def majority_vote(samples: DataFrame, canonical: str = "canonical", by: tuple[str, ...] = ("run", "idx"), pos: str = "pos") -> DataFrame:
    """The most frequent canonical answer of each problem, of equals the one seen first; null without votes. Two aggregations, no window."""
    votes = samples.groupBy(*by, canonical).agg(F.count(F.lit(1)).alias("votes"), F.min(pos).alias("first"))
    said = F.col(canonical).isNotNull()
    best = F.max_by(F.struct(F.col(canonical).alias("answer"), F.col("votes")), F.when(said, F.struct(F.col("votes"), -F.col("first"))))
    out = votes.groupBy(*by).agg(best.alias("best"), F.sum(F.when(said, F.col("votes"))).alias("n_votes"))
    return out.select(*by, F.col("best.answer").alias("majority_answer"), F.col("best.votes").alias("majority_votes"), F.coalesce("n_votes", F.lit(0)).alias("n_votes"))


def compare_metric_tables(new: DataFrame, old: DataFrame, tolerance: float = 1e-10, exact: tuple[str, ...] = ("n",), keys: tuple[str, ...] = ("run", "metric")) -> DataFrame:
    """Metric by metric both values, their difference, and a status: ok, differs, only_new or only_old. Those in `exact` must be equal."""
    j = new.withColumnRenamed("value", "new_value").join(old.withColumnRenamed("value", "old_value"), list(keys), "full_outer")
    d = F.col("new_value") - F.col("old_value")
    close = F.when(F.col("metric").isin(*exact), d == 0).otherwise(F.abs(d) <= tolerance)
    status = F.when(F.col("old_value").isNull() & F.col("new_value").isNull(), "ok").when(F.col("old_value").isNull(), "only_new").when(F.col("new_value").isNull(), "only_old").when(close, "ok").otherwise("differs")
    return j.select(*keys, "new_value", "old_value", d.alias("difference"), status.alias("status"))
