"""Sharding through fixed virtual slots.

A record's slot is a hash of its id and text, one of a few thousand for good. What is decided is only which shard a slot
belongs to: the slots' bytes are summed, and a versioned map (version, virtual_slot, shard) is stored. Rebalancing reads the last
version, edits it and stores the next: slots stay where they are unless their shard is above its share, and only those move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gradelake.llm.common import new_path, stored

N_SLOTS = 4096
LARGE = 8
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


def sized(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32 (null text: that of the empty text) and virtual_slot of each row.

    Rows equal in id and text share a slot, unless they repeat and together hold more than LARGE average slots: then each goes by its place in the table too.
    """
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    d = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"), crc)
    d = d.withColumn("record", F.xxhash64("doc_id", "text_crc32"))
    total = d.agg(F.sum("size")).first()[0] or 0
    # fewer than n_slots / LARGE records
    large = d.groupBy("record").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).filter((F.col("rows") > 1) & (F.col("bytes") * n_slots > LARGE * total))
    large = large.select("record", F.lit(True).alias("large"))
    d = d.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(large), "record", "left")
    slot = F.pmod(F.when(F.col("large"), F.xxhash64("record", "place")).otherwise(F.col("record")), F.lit(n_slots))
    return d.select("doc_id", "size", "text_crc32", slot.cast("int").alias("virtual_slot"))


def place_slots(slot_bytes: DataFrame, n_shards: int, old: DataFrame | None = None, version: int = 1, n_slots: int = N_SLOTS) -> DataFrame:
    """The slot-to-shard map of `version`: version, virtual_slot, shard, for every slot from 0 to n_slots - 1.

    slot_bytes: virtual_slot, slot_bytes (slots not in it are empty). Slots go, largest first, to the shard with the fewest
    bytes so far (the lowest of equals). With `old`, a shard keeps its largest slots up to an equal share of all bytes and the
    rest are placed anew; shards from n_shards on give up all. The work is over n_slots rows, a fixed number, whatever the corpus.
    """
    spark = slot_bytes.sparkSession
    slots = spark.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot")).join(slot_bytes, "virtual_slot", "left")
    slots = slots.select("virtual_slot", F.coalesce("slot_bytes", F.lit(0)).cast("long").alias("bytes"))
    if old is None:
        slots = slots.withColumn("kept", F.lit(None).cast("int"))
    else:
        slots = slots.join(old.select("virtual_slot", F.col("shard").alias("was")), "virtual_slot", "left")
        shard_order = Window.partitionBy("was").orderBy(F.desc("bytes"), "virtual_slot")
        share = F.sum("bytes").over(Window.partitionBy(F.lit(1))) / n_shards
        stays = (F.col("was") < n_shards) & (F.sum("bytes").over(shard_order) <= share)
        slots = slots.withColumn("kept", F.when(stays, F.col("was"))).drop("was")
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda s: F.aggregate("queue", F.lit(0).cast("long"), lambda a, x: a + F.when(x["kept"] == s, x["bytes"]).otherwise(0)),
    )
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))

    def place(acc, x):
        least = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.when(x["kept"].isNotNull(), F.struct(acc["loads"].alias("loads"), F.concat(acc["to"], F.array(x["kept"])).alias("to"))).otherwise(
            F.struct(F.transform(acc["loads"], lambda v, i: F.when(i == least, v + x["bytes"]).otherwise(v)).alias("loads"), F.concat(acc["to"], F.array(least)).alias("to"))
        )

    item = F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "bytes", "kept")
    one = slots.agg(F.array_sort(F.collect_list(item)).alias("queue"))
    one = one.select("queue", F.aggregate("queue", start, place)["to"].alias("to"))
    pairs = one.select(F.explode(F.arrays_zip(F.col("queue.virtual_slot").alias("virtual_slot"), F.col("to").alias("shard"))).alias("p"))
    return pairs.select(F.lit(version).alias("version"), "p.virtual_slot", "p.shard")


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The slot-to-shard map of a version, or of the last one; None if `path` has none. One row a slot: where writers that ran at once stored a version twice, the lower shard holds."""
    try:
        every = spark.read.parquet(path)
    except AnalysisException:
        return None
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == version).groupBy("version", "virtual_slot").agg(F.min("shard").alias("shard"))


def store_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Adds a version of the map to those under `path`, and reads it from there. A version that is there is refused."""
    version = slot_map.first().version
    old = stored_map(slot_map.sparkSession, path, version)
    if old is not None and not old.isEmpty():
        raise ValueError(f"version {version} of the map is already stored")
    slot_map.write.mode("append").parquet(path)
    return stored_map(slot_map.sparkSession, path)


def rebalance(slot_bytes: DataFrame, n_shards: int, path: str, n_slots: int = N_SLOTS) -> DataFrame:
    """The next version of the map under `path`, edited from its last one for `n_shards` shards of about equal bytes, and stored beside it."""
    old = stored_map(slot_bytes.sparkSession, path)
    version = old.first().version + 1 if old is not None else 1
    return store_map(place_slots(slot_bytes, n_shards, old, version, n_slots), path)


def assign_shards(docs: DataFrame, n_shards: int = 40, maps: str | None = None, n_slots: int = N_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(rows, slot_map): doc_id, size, text_crc32, virtual_slot, shard and slot of each row, and the map they follow.

    maps: the path of the stored versions of the map. The last one is followed as it is; where there is none, or no path is given, the
    first is made for `n_shards` and stored. slot numbers a shard's rows from 0 without gaps, by virtual slot, then doc_id. Copies of a text with
    other ids are records of their own and spread over shards, so that one text that makes up a third of the table fills no shard. Null
    ids and texts are hashed like others. No rows: a map of empty slots and no rows.
    """
    narrow = stored(sized(docs, n_slots), "shard_rows")
    per_slot = narrow.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))
    per_slot = stored(per_slot, "shard_slots")
    maps = maps or new_path(docs.sparkSession, "shard_map")
    slot_map = stored_map(docs.sparkSession, maps)
    if slot_map is None:
        slot_map = rebalance(per_slot, n_shards, maps, n_slots)
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_slot.join(slot_map.select("virtual_slot", "shard"), "virtual_slot")
    placed = placed.select("virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(in_shard), F.lit(0)).alias("first"))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    rows = narrow.withColumn("nth", F.row_number().over(order) - 1)
    # placed holds at most n_slots rows
    rows = rows.join(F.broadcast(placed), "virtual_slot")
    return rows.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot")), slot_map


def shard_table(docs: DataFrame, n_shards: int = 40, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes': the shards' sizes are near equal), shard, slot, grown_shard (null), virtual_slot and the map's version."""
    rows, slot_map = assign_shards(docs, n_shards, maps)
    version = F.lit(slot_map.first().version).alias("map_version")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", version)
