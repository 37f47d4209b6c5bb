"""Joining scores to records, and checking that tables describe the same thing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Run properties that only inform, and those that may grow but not shrink.
ADVISORY, MONOTONIC = ("label_policy",), ("n_problems", "problems_fingerprint_n")


def align_scores(scores: DataFrame, records: DataFrame, keys: tuple[str, ...] = ("run", "idx")) -> DataFrame:
    """Scores with the columns of their labelable record. Both sides are dealt by the same keys once; digests travel, texts need not."""
    return scores.join(records.filter("labelable"), list(keys)).drop(records["digest"]) if "digest" in scores.columns and "digest" in records.columns else scores.join(records.filter("labelable"), list(keys))


def alignment_audit(scores: DataFrame, records: DataFrame, keys: tuple[str, ...] = ("run", "idx"), by: tuple[str, ...] = ("run",)) -> DataFrame:
    """n_scores, n_missing (no record), n_mismatch (another digest), n_kept (labelable) of each run."""
    r = records.select(*keys, F.col("digest").alias("_digest"), "labelable", F.lit(True).alias("_there"))
    j = scores.join(r, list(keys), "left")
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_scores"),
        F.count_if(F.col("_there").isNull()).alias("n_missing"),
        F.count_if(F.col("digest") != F.col("_digest")).alias("n_mismatch"),
        F.count_if("labelable").alias("n_kept"),
    )


def crosscheck_scores(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("run",), keys: tuple[str, ...] = ("run", "idx"), tol: float = 0.01, noise: float = 1e-3, gross: float = 0.1) -> DataFrame:
    """One quantity from two sources: how many of a are in b, digest mismatches, deltas above tol, the largest, the share above noise,
    how many are gross, and a status: disagrees, else partial_coverage, else agrees."""
    other = b.select(*keys, F.col("score").alias("_other"), F.col("digest").alias("_digest"))
    delta = F.abs(F.col("score") - F.col("_other"))
    n = F.count(F.lit(1))
    out = a.join(other, list(keys), "left").groupBy(*by).agg(
        n.alias("n"),
        F.count("_other").alias("n_covered"),
        F.count_if(F.col("digest") != F.col("_digest")).alias("n_mismatch"),
        F.count_if(delta > tol).alias("n_over"),
        F.max(delta).alias("max_delta"),
        F.try_divide(F.count_if(delta > noise), F.count("_other")).alias("over_noise"),
        F.count_if(delta > gross).alias("n_gross"),
    )
    bad = (F.col("n_over") > 0) | (F.col("n_mismatch") > 0)
    return out.withColumn("status", F.when(bad, "disagrees").when(F.col("n_covered") < F.col("n"), "partial_coverage").otherwise("agrees"))


def attach_level(items: DataFrame, levels: DataFrame, text: str = "problem") -> DataFrame:
    """`items` with level, by equal trimmed problem text; UNMATCHED where there is none. Joined by the text's hash, then by the text itself."""
    lv = levels.select(F.trim(text).alias("_text"), "level").groupBy("_text").agg(F.min("level").alias("level")).withColumn("_hash", F.xxhash64("_text"))
    it = items.drop("level").withColumn("_hash", F.xxhash64(F.trim(text)))
    j = it.join(lv, (it["_hash"] == lv["_hash"]) & (F.trim(it[text]) == lv["_text"]), "left")
    return j.select(*[it[c] for c in it.columns if c != "_hash"], F.coalesce(lv["level"], F.lit("UNMATCHED")).alias("level"))


def split_overlap(train: DataFrame, test: DataFrame, text: str = "problem", by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Distinct problems in both splits of a run."""
    key = [*by, F.xxhash64(F.trim(text)).alias("_hash"), F.trim(text).alias(text)]
    return train.select(*key).intersect(test.select(*key)).drop("_hash")


def compare_run_metadata(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Key by key of two property tables (run, key, value): equal, drift, missing, shrunk, grew or advisory; a is stored, b is now."""
    j = a.withColumnRenamed("value", "stored").join(b.withColumnRenamed("value", "now"), [*by, "key"], "full_outer")
    x, y = F.col("stored").try_cast("double"), F.col("now").try_cast("double")
    sized = F.col("key").isin(*MONOTONIC)
    status = (
        F.when(F.col("stored").eqNullSafe(F.col("now")), "equal")
        .when(F.col("key").isin(*ADVISORY), "advisory")
        .when(sized & (x > y), "shrunk")
        .when(sized & (x < y), "grew")
        .when(F.col("stored").isNull() | F.col("now").isNull(), "missing")
        .otherwise("drift")
    )
    return j.select(*by, "key", "stored", "now", status.alias("status"))


def absent_provenance(meta: DataFrame, fields: tuple[str, ...] = ("rec_sha", "gen_run", "prompt_identity"), by: tuple[str, ...] = ("run",)) -> DataFrame:
    """The provenance fields a run lacks; a field all of whose values (keys field or field.name) are null is lacking."""
    has = [F.coalesce(F.bool_or((F.split_part("key", F.lit("."), F.lit(1)) == f) & F.col("value").isNotNull()), F.lit(False)).alias(f"_{f}") for f in fields]
    out = meta.groupBy(*by).agg(*has)
    return out.select(*by, F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"_{f}"), f) for f in fields])), ",").alias("absent"))
