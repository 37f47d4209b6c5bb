"""Mixing sources to target weights.

Every row gets a hash-random key. Within each source the rows are ordered by that key: key ranges (leading bits)
are summed in parallel, a prefix sum over the range totals finds the range in which the source's budget ends, and only
the rows of that one range are ordered row by row to find the exact cut. Budgets beyond the source's size repeat
it for whole epochs first. No step gathers a source in one task: a source's ranges are few and its cut range is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.common import KEY_BITS, range_bits, small, stored, unit_key, word_count

#: Rows that a key range holds on average.
ROWS_PER_RANGE = 4096
#: Above this many sources their table is joined by shuffle.
MAX_BROADCAST_SOURCES = 100_000


def mixing_key(seed: str) -> Column:
    """The hash-random key of a row; a row without doc_id takes its text's."""
    return unit_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """Adds target to (source, source_size): weighted shares of `share` of the total, none above max_epochs sizes.

    The excess of capped sources is shared again by weight. The fixed point is min(cap, level * weight), and the capped
    sources are those with the least cap per weight, so running sums over the sources in that order give it directly.
    """
    everyone = Window.partitionBy(F.lit(1))
    by_source = everyone.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("pos", F.row_number().over(by_source) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("pos") % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    by_need = everyone.orderBy(F.col("cap") / F.col("weight"), "pos")
    so_far = by_need.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.floor(F.sum("source_size").over(everyone) * F.lit(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(so_far), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("left", F.col("total") - F.col("cap_before"))
        .withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("weight") * F.col("left"))
    )
    free_total = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everyone), F.lit(0))
    free_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everyone)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * free_total).cast("double") / free_weight)
    return ranked.select("source", "source_size", target.alias("target"))


def mixing_plan(docs: DataFrame, *, weights=(5, 2, 1), share=1.0, max_epochs=3, seed="mix-1") -> tuple[DataFrame, DataFrame]:
    """(rows, cuts) for `docs` (doc_id, text, source).

    rows: doc_id, source, key, size. cuts, one row a source: source, source_size, target, epochs (whole repeats), cut_key,
    cut_left and cut_size: rows below cut_key are taken once more; those at it (one, unless a doc_id repeats) share
    cut_left words in proportion to size.
    Null text has size 0. Null source is a source of its own, last in order. Rows that repeat a doc_id share its key. No rows: no cuts.
    """
    rows = stored(docs.select("doc_id", "source", mixing_key(seed).alias("key"), word_count("text").alias("size")), "mix_rows")
    bits = range_bits(rows.count(), ROWS_PER_RANGE)
    rows = rows.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    sums = stored(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix_ranges")
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    budget = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    targets = stored(targets.withColumn("epochs", full.cast("long")).withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long")), "mix_targets")

    in_order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("before", F.coalesce(F.sum("range_size").over(in_order), F.lit(0)))
    t = targets.select(F.col("source").alias("t_source"), "rest")
    cut_range = ranges.join(small(t, MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("t_source")))
    cut_range = cut_range.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("range_size")))
    cut_range = stored(cut_range.select("t_source", F.col("range").alias("t_range"), "before", "rest"), "mix_cut_ranges")

    near = rows.join(small(cut_range, MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("t_source")) & (F.col("range") == F.col("t_range")))
    ties = near.groupBy("source", "key", "before", "rest").agg(F.sum("size").alias("cut_size"))
    in_range = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("cut_left", F.col("rest") - F.col("before") - F.coalesce(F.sum("cut_size").over(in_range), F.lit(0)))
    ties = ties.filter((F.col("cut_left") >= 0) & (F.col("cut_left") < F.col("cut_size")))
    ties = ties.select(F.col("source").alias("t_source"), F.col("key").alias("cut_key"), "cut_left", "cut_size")
    cuts = targets.join(ties, F.col("source").eqNullSafe(F.col("t_source")), "left")
    cuts = stored(cuts.select("source", "source_size", "target", "epochs", "cut_key", "cut_left", "cut_size"), "mix_cuts")
    return rows.drop("range"), cuts


def with_taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """`rows` (source, key, size and others) with source_size, target, epochs and part: the words taken after the whole epochs."""
    c = small(cuts.withColumnRenamed("source", "t_source"), MAX_BROADCAST_SOURCES)
    part = F.when(F.col("key") < F.col("cut_key"), F.col("size"))
    part = part.when(F.col("key") == F.col("cut_key"), F.floor(F.col("size") * F.col("cut_left") / F.col("cut_size"))).otherwise(0)
    joined = rows.join(c, F.col("source").eqNullSafe(F.col("t_source")))
    return joined.withColumn("part", part.cast("long")).drop("t_source", "cut_key", "cut_left", "cut_size")


def mix_table(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of the row, repeats counted)."""
    rows, cuts = mixing_plan(docs, **how)
    out = with_taken(rows, cuts)
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mix_documents(docs: DataFrame, *, seed="mix-1", **how) -> DataFrame:
    """The mixed documents: each row once per epoch taken, and at its source's cut a row with the text's first words.

    Other columns pass through; n_chars, where present, is that of the cut text. Rows from which nothing is taken go;
    rows without words follow their key as all others do. Texts never move: the cuts (one row a source) come to them.
    """
    _, cuts = mixing_plan(docs, seed=seed, **how)
    keep = [c for c in docs.columns]
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    named = named.select("row", F.col("row.source").alias("source"), F.col("row.text").alias("text"), F.col("row.doc_id").alias("doc_id"))
    named = named.select("row", "source", mixing_key(seed).alias("key"), word_count("text").alias("size"))
    out = with_taken(named.withColumn("empty", F.col("size") == 0), cuts.withColumn("below", F.col("cut_key")))
    once_more = (F.col("part") > 0) | (F.col("empty") & F.coalesce(F.col("key") < F.col("below"), F.lit(False)))
    copies = F.col("epochs") + once_more.cast("long")
    out = out.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut = (F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size"))
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")
    out = out.withColumn("head", F.when(cut, head))
    made = {"text": F.coalesce("head", F.col("row.text"))}
    if "n_chars" in keep:
        made["n_chars"] = F.when(cut, F.length("head")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in keep])


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
             sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weight_left FROM w),
c AS (SELECT *, cap::HUGEINT * weight_left <= weight::HUGEINT * (total - cap_before) AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
        (weight * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)))::DOUBLE
        / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target FROM c),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT d.*, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
"""
