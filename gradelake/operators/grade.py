"""Grading records, and what is excluded from analysis and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions.answers import canonical_answer
from gradelake.schemas import LATEX_DATASETS

#: The policy names that records carry.
NUMERIC_POLICY, LATEX_POLICY = "numeric_equivalence_v2", "latex_numeric_equivalence_v1"


def grade_records(df: DataFrame, latex: bool = True) -> DataFrame:
    """`df` with solve_correct, majority_correct, labelable, label_policy and label worked out anew; what it stored of these is replaced.

    label is solve_correct, or null where the gold answer is unusable. A missing answer is wrong.
    """
    made = {f"_{c}": canonical_answer(c, "dataset", latex) for c in ("gold_answer", "phase1_answer", "majority_answer")}
    out = df.withColumns(made)
    same = lambda c: F.coalesce(F.col(f"_{c}") == F.col("_gold_answer"), F.lit(False))
    labelable = F.col("_gold_answer").isNotNull()
    out = out.withColumns(
        {
            "solve_correct": same("phase1_answer"),
            "majority_correct": same("majority_answer"),
            "labelable": labelable,
            "label_policy": F.when(F.col("dataset").isin(*LATEX_DATASETS), LATEX_POLICY).otherwise(NUMERIC_POLICY),
            "label": F.when(labelable, same("phase1_answer")),
        }
    )
    return out.drop(*made)


def exclusion_reason(labelable: str | Column = "labelable") -> Column:
    """error, else truncated (only a known true), else no_gold, else null: the row is kept."""
    usable = F.col(labelable) if isinstance(labelable, str) else labelable
    return F.when(F.col("error").isNotNull(), "error").when(F.col("truncated").eqNullSafe(True), "truncated").when(~F.coalesce(usable, F.lit(False)), "no_gold")


def exclusion_columns(y: str = "label") -> list[Column]:
    reason = F.col("reason")
    kept = reason.isNull()
    right = F.col(y).cast("int")
    return [
        F.count(F.lit(1)).alias("generated"),
        F.count_if(kept).alias("analysed"),
        F.count_if(reason == "error").alias("errors"),
        F.count_if(reason == "truncated").alias("truncated_rows"),
        F.count_if(reason == "no_gold").alias("no_gold"),
        F.count_if((reason == "truncated") & (right == 0)).alias("truncated_wrong"),
        F.try_divide(F.count_if(kept & (right == 0)), F.count_if(kept)).alias("prevalence"),
        F.try_divide(F.count_if(F.coalesce(right, F.lit(0)) == 0), F.count(F.lit(1))).alias("prevalence_included"),
    ]


def exclusion_summary(df: DataFrame, by: tuple[str, ...] = ("run", "split"), y: str = "label") -> DataFrame:
    """Rows generated, analysed and excluded by reason (df.reason), and the share of wrong answers without and with the excluded."""
    return df.groupBy(*by).agg(*exclusion_columns(y))


def population_table(df: DataFrame, y: str = "label") -> DataFrame:
    """`exclusion_summary` for each run and split, each run, and all: one pass of grouping sets; null stands for all."""
    return df.rollup("run", "split").agg(F.grouping_id().cast("int").alias("depth"), *exclusion_columns(y))


def labelable_audit(df: DataFrame, stored: str = "stored_labelable", by: tuple[str, ...] = ("run",)) -> DataFrame:
    """How stored `labelable` differs from the one worked out: counts by direction and the first 10 idx (comma-joined)."""
    differs = F.col(stored).isNotNull() & (F.col(stored) != F.col("labelable"))
    counts = df.groupBy(*by).agg(
        F.count(stored).alias("n_with_field"),
        F.count_if(differs & F.col(stored)).alias("n_stored_only"),
        F.count_if(differs & ~F.col(stored)).alias("n_computed_only"),
    )
    # Spark keeps 10 rows a group in each task before it shuffles them
    first = df.filter(differs).select(*by, "idx").withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("idx"))).filter("_nth <= 10")
    first = first.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("idx")), ",").alias("first_idx"))
    return counts.join(first, list(by), "left")


def label_disagreements(df: DataFrame, stored: str = "stored_correct", by: tuple[str, ...] = ("run",)) -> DataFrame:
    """How many labels worked out differ from those stored."""
    return df.groupBy(*by).agg(F.count_if(F.col(stored) != F.col("solve_correct")).alias("n_differ"))


def run_health(df: DataFrame, by: tuple[str, ...] = ("run", "split"), y: str = "y", score: str = "score") -> DataFrame:
    """Rows, classes, datasets and scores that are not finite; unusable where fewer than two classes are left."""
    bad = F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(y).alias("n_classes"),
        F.count_distinct("dataset").alias("n_datasets"),
        F.count_if(bad).alias("n_not_finite"),
        (F.count_distinct(y) < 2).alias("unusable"),
    )


def truncated_records(df: DataFrame, budget: int, length: str = "length", sample: int | None = None, seed: int = 0) -> DataFrame:
    """Rows cut off by the budget: those flagged, or, if no row is, those within 4 of it. With `sample`, so many of them in a seeded order."""
    flags = df.agg(F.coalesce(F.max("truncated"), F.lit(False)).alias("_flagged"))  # one row
    cut = F.when(F.col("_flagged"), F.col("truncated").eqNullSafe(True)).otherwise(F.col(length) >= budget - 4)
    out = df.join(F.broadcast(flags)).filter(cut).drop("_flagged")
    return out if sample is None else out.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("idx").cast("string"))), "idx").limit(sample)
