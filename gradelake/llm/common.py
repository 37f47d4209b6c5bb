"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: A word of the white-space contracts: everything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which spark.checkpoint.dir names. Where it is unset, a local session (tests) gets one of its own and a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="gradelake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Bytes of an Arrow batch that goes to a Python worker at most (or one row).
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of Arrow batches to BATCH_BYTES if it is higher, so that long texts don't add up in workers.

    For jobs that own their session (the queries and the pipeline); operators leave the session as it is.
    """
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(_BATCH).strip().lower()).groups()
    if int(number) <= 0 or int(number) * _UNITS[unit] > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/gradelake/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the shared folder and read again: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path.rpartition("/")[0]
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that `stored` made, once nothing that is still to run reads them."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` with a broadcast hint if it is counted to hold at most `max_rows` rows; else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def quoted(columns: list[str]) -> list[Column]:
    """The columns by name, whatever characters the names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """`docs` with its columns named by position (c0, c1, ...) except those an operator reads, and the columns that select them all back under their own names.

    names: the columns that the operator reads. Whatever it adds may then have any name but c and a number.
    """
    short = {c: c if c in names else f"c{i}" for i, c in enumerate(docs.columns)}
    back = [F.col(short[c]).alias(c) for c in docs.columns]
    return docs.select(*[c.alias(short[n]) for c, n in zip(quoted(docs.columns), docs.columns, strict=True)]), back


#: Bits of a Bloom filter (a fixed size: 8 MB), places a key sets, and tasks that fill parts of it at most.
BLOOM_BITS = 1 << 26
BLOOM_PLACES = 4
BLOOM_TASKS = 64
_SLOT = 1 << 16


def _places(keys: np.ndarray) -> np.ndarray:
    h = keys.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.concatenate([(h + np.uint64(i) * step) % np.uint64(BLOOM_BITS) for i in range(BLOOM_PLACES)]).astype(np.int64)


def bloom_filter(keys: DataFrame):
    """A test column -> Column of whether a long may be in the one column of `keys`: false only for those that are not.

    The filter has a fixed size, so what is broadcast does not grow; with very many keys it rules out less, never wrongly.
    """
    spark = keys.sparkSession
    name = keys.columns[0]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for b in batches:
            at = _places(b.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        slots = bits.reshape(-1, _SLOT)
        some = np.flatnonzero(slots.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([slots[i].tobytes() for i in some], pa.binary())], names=["slot", "bits"])

    def unite(t: pa.Table) -> pa.Table:
        every = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("bits")])
        return pa.table({"slot": t.column("slot").slice(0, 1), "bits": pa.array([every.tobytes()], pa.binary())})

    parts = keys.select(F.xxhash64(F.col(f"`{name}`")).alias("h")).coalesce(BLOOM_TASKS).mapInArrow(fill, "slot int, bits binary")
    whole = np.zeros((BLOOM_BITS // 8 // _SLOT, _SLOT), np.uint8)
    for r in parts.groupBy("slot").applyInArrow(unite, "slot int, bits binary").collect():  # at most 128 slots of 64 KB
        whole[r.slot] = np.frombuffer(r.bits, np.uint8)
    sent = spark.sparkContext.broadcast(whole.tobytes())

    @pandas_udf("boolean")
    def may_hold(h: pd.Series) -> pd.Series:
        bits = np.frombuffer(sent.value, np.uint8)
        at = _places(h.to_numpy())
        return pd.Series(((bits[at >> 3] >> (at & 7)) & 1).astype(bool).reshape(BLOOM_PLACES, -1).all(0))

    return lambda key: may_hold(F.xxhash64(key))


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def unit_key(seed: str, *parts: Column) -> Column:
    """A 60-bit key, uniform over what `parts` (strings) hold; the same in every run and engine that has md5."""
    text = F.concat(F.lit(f"{seed}:"), *parts)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


KEY_BITS = 60


def range_bits(n_rows: int, per_range: int) -> int:
    """Leading key bits that cut uniform keys of `n_rows` rows into ranges of about `per_range`."""
    return min(40, max(0, math.ceil(math.log2(max(1, n_rows) / per_range))))

#: A key with more than one in HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """`rows` left-joined with `table` on the long column `key`, without one task getting all rows of a hot key.

    table has one row a key, with `weight` rows of `rows` on it (an upper bound does), `total` in all. The hot keys, fewer than HOT_SHARE, are
    broadcast. The other rows are joined by shuffle; rows that found a hot key, or have none, are
    spread over that shuffle by the hash of what they hold.
    """
    values = [c for c in table.columns if c not in (key, weight)]
    as_one = F.struct(*values)
    hot = table.filter(F.col(weight) * HOT_SHARE > total).select(F.col(key).alias("_hot_key"), as_one.alias("_hot"))
    cold = table.filter(F.col(weight) * HOT_SHARE <= total).select(F.col(key).alias("_cold_key"), as_one.alias("_cold"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    spread = F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.xxhash64(*[F.col(c) for c in rows.columns]))
    marked = marked.withColumn("_route", spread)
    out = marked.join(cold, (F.col("_route") == F.col("_cold_key")) & F.col("_hot_key").isNull() & F.col(key).isNotNull(), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in values])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node that can be reached.

    Nodes are hung under ever smaller ones, first those above a node, then those below it, until nothing moves; every round at least about
    halves the ways left. Each round is written to the shared folder. Only minima per node are kept, no neighbour lists.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        up = up.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        up, last = stored(up, "edges_up"), now
        below = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(below.select("a", F.col("m").alias("b")))
        now = stored(down.filter("a <> b").distinct(), "edges_down")
        discard(last, up)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    # every edge now goes from a node to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
