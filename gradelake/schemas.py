"""Fixed schemas of the tables that jobs start from, and the equality policy of each dataset."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt"

JUDGED_RECORD = T.StructType(
    [
        T.StructField("idx", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("run", "split", "dataset", "problem", "gold_answer", "phase1_solution", "phase1_answer")],
        T.StructField("truncated", T.BooleanType()),
        T.StructField("solve_correct", T.BooleanType()),
        T.StructField("judge_verdict", T.StringType()),
        T.StructField("k_solutions", T.ArrayType(T.StringType())),
        T.StructField("k_answers", T.ArrayType(T.StringType())),
        T.StructField("majority_answer", T.StringType()),
        T.StructField("k_truncated", T.ArrayType(T.BooleanType())),
        T.StructField("majority_correct", T.BooleanType()),
        T.StructField("labelable", T.BooleanType()),
        T.StructField("label_policy", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

DEFAULT_DATASET = "gsm8k"
#: Datasets whose answers are compared as canonical LaTeX; all others are compared as exact numbers.
LATEX_DATASETS = ("math",)
