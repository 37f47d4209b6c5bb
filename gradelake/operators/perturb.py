"""Perturbed problems and the originals they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def template_map(df: DataFrame) -> DataFrame:
    """question (trimmed) to original_question and original_id, with n_originals and n_ids; more than one of either is a violation."""
    return (
        df.groupBy(F.trim("question").alias("question"))
        .agg(F.min("original_question").alias("original_question"), F.min("original_id").alias("original_id"), F.count_distinct("original_question").alias("n_originals"), F.count_distinct("original_id").alias("n_ids"))
        .withColumn("violation", (F.col("n_originals") > 1) | (F.col("n_ids") > 1))
    )


def match_originals(perturbed: DataFrame, reference: DataFrame, mapping: DataFrame) -> DataFrame:
    """For each original of the perturbed set: how many perturbed items it has and its state in the reference: matched, duplicated, missing or unlabelable."""
    p = perturbed.select(F.trim("question").alias("question")).join(mapping.select("question", "original_question"), "question")
    wanted = p.groupBy("original_question").agg(F.count(F.lit(1)).alias("n_perturbed"))
    found = reference.groupBy(F.trim("question").alias("original_question")).agg(F.count(F.lit(1)).alias("n_reference"), F.bool_and("labelable").alias("usable"))
    n = F.coalesce("n_reference", F.lit(0))
    state = F.when(n == 0, "missing").when(n > 1, "duplicated").when(~F.col("usable"), "unlabelable").otherwise("matched")
    return wanted.join(found, "original_question", "left").select("original_question", "n_perturbed", n.alias("n_reference"), state.alias("state"))


def template_accuracy(perturbed: DataFrame, originals: DataFrame, template: str = "template") -> DataFrame:
    """Mean accuracy of a template's perturbed items beside its original's, and the difference; templates without both are left out."""
    a = perturbed.groupBy(template).agg(F.avg("y").alias("perturbed_accuracy"), F.count(F.lit(1)).alias("n_items"))
    b = originals.groupBy(template).agg(F.avg("y").alias("original_accuracy"))
    return a.join(b, template).withColumn("delta", F.col("perturbed_accuracy") - F.col("original_accuracy"))


def mean_delta(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_templates"), F.avg("delta").alias("mean_delta"))
