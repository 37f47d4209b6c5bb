"""Reading and writing judged records."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.schemas import CORRUPT, JUDGED_RECORD


def parse_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines (value, and other columns that stay) parsed by the fixed schema; malformed: no JSON, no object, or no idx."""
    text = F.btrim("value", F.lit(" \t\r"))
    parsed = lines.filter(F.length(text) > 0).withColumn("_r", F.from_json("value", JUDGED_RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull() | F.col("_r.idx").isNull() | ~text.startswith("{")
    names = [f.name for f in JUDGED_RECORD.fields if f.name != CORRUPT]
    return parsed.select(*[F.col(f"_r.{n}").alias(n) for n in names], bad.alias("malformed"), *[c for c in lines.columns if c != "value"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every non-blank line of JSONL files, parsed or not, with seq: the place of the line (file, then offset of its part of the file)."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("nth")).alias("seq"))
    return parse_lines(lines)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The well-formed records of JSONL files, with seq."""
    return read_lines(spark, path).filter(~F.col("malformed")).drop("malformed")


def dedupe_records(df: DataFrame, keys: tuple[str, ...] = ("run", "idx"), seq: str = "seq") -> DataFrame:
    """One row a key: a record without error beats one with, and the later of equals wins."""
    best = Window.partitionBy(*keys).orderBy(F.col("error").isNull().desc(), F.col(seq).desc())
    return df.withColumn("_nth", F.row_number().over(best)).filter("_nth = 1").drop("_nth")


def ingest_stats(lines: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """n_lines, n_malformed and n_duplicate (rows beyond the first of an idx) of the lines read."""
    well = ~F.col("malformed")
    return lines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("malformed").alias("n_malformed"),
        (F.count_if(well) - F.count_distinct(F.when(well, F.col("idx")))).alias("n_duplicate"),
    )


def write_records(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), format: str = "parquet") -> None:
    """Writes the record set at `path`, in idx order within and across files, over what is there. A job that dies while it writes over an old set loses that;
    `replace_records` doesn't."""
    w = df.repartitionByRange("idx").sortWithinPartitions(*partition_by, "idx").write.mode("overwrite").format(format)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


#: The file that names the current version of a record set.
POINTER = "CURRENT"


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path class for `path`."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return paths(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), paths


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the versions that were published, by their pointer files."""
    files, paths = _file_system(spark, path)
    if not files.exists(paths(path)):
        return []
    names = [f.getPath().getName() for f in files.listStatus(paths(path))]
    return sorted((int(n.split("-")[1]), n.split("-", 2)[2]) for n in names if n.startswith(f"{POINTER}-"))


def replace_records(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), format: str = "parquet", keep: int = 2) -> None:
    """Replaces the record set at `path` whole or not at all; `current_records` reads it.

    The rows go to a fresh folder. Once all of it is there an empty pointer file with the next number and the folder's name is created, which is one step; readers follow
    the highest. A job that dies before leaves the old set as it was. Jobs that find another's pointer with their number withdraw theirs and fail. The last `keep` versions stay, since readers may
    still be at them. `df` may be made from the set itself.
    """
    spark = df.sparkSession
    folder = f"v{uuid.uuid4().hex}"
    before = _versions(spark, path)
    write_records(df, f"{path}/{folder}", partition_by, format)
    files, paths = _file_system(spark, path)
    number = before[-1][0] + 1 if before else 0
    if not files.createNewFile(paths(f"{path}/{POINTER}-{number:012d}-{folder}")) or [v for n, v in _versions(spark, path) if n == number] != [folder]:
        files.delete(paths(f"{path}/{POINTER}-{number:012d}-{folder}"), False)
        raise RuntimeError(f"another job has replaced the records at {path} meanwhile")
    for old, name in before[: len(before) + 1 - max(1, keep)]:
        files.delete(paths(f"{path}/{POINTER}-{old:012d}-{name}"), False)
        files.delete(paths(f"{path}/{name}"), True)


def current_records(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """The record set that was last published at `path` by `replace_records`."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no record set at {path}")
    return spark.read.format(format).load(f"{path}/{versions[-1][1]}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that spark.checkpoint.dir names, which all executors share; only a local session may leave it unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="gradelake-")
    return f"{where.rstrip('/')}/gradelake/{uuid.uuid4().hex}/{name}"


def pending_problems(problems: DataFrame, done: DataFrame, retry_failed: bool = False, keys: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Problems that have no record yet; with retry_failed a record with an error is none."""
    finished = done.filter(F.col("error").isNull()) if retry_failed else done
    return problems.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def out_of_range_records(records: DataFrame, problems: DataFrame) -> DataFrame:
    """Records whose idx lies beyond the problems at hand."""
    n = problems.agg(F.count(F.lit(1)).alias("n_problems"))  # one row
    return records.join(F.broadcast(n), F.col("idx") >= F.col("n_problems")).drop("n_problems")


def level_number(level: str) -> str:
    """3 for 3, Level 3 and level3; anything else is refused."""
    digits = level.strip().lower().removeprefix("level").strip()
    if digits not in {"1", "2", "3", "4", "5"}:
        raise ValueError(f"unknown level {level!r}")
    return digits


def sample_problems(df: DataFrame, n: int, seed: int, subjects: list[str] | None = None, levels: list[str] | None = None, key: str = "problem") -> DataFrame:
    """n rows in a seeded order with their place there as idx; fewer rows are the beginning of more. Levels may be spelled 3, level3, Level 3."""
    if subjects:
        known = {r.subject for r in df.select("subject").distinct().collect()}
        if unknown := set(subjects) - known:
            raise ValueError(f"unknown subjects {sorted(unknown)}")
        df = df.filter(F.col("subject").isin(subjects))
    if levels:
        df = df.filter(F.regexp_extract("level", r"([0-9]+)\s*$", 1).isin([level_number(x) for x in levels]))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    top = df.withColumn("_order", order).orderBy("_order", key).limit(n)
    # n rows at most are numbered
    return top.withColumn("idx", (F.row_number().over(Window.orderBy("_order", key)) - 1).cast("long")).drop("_order")


def problems_digest(df: DataFrame, k: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """problems_sha256 over the first k questions in idx order, each with a NUL after it, and how many those are."""
    first = df.filter(F.col("idx") < k).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("question", F.lit("")).alias("q")))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: F.concat(r["q"], F.chr(F.lit(0)))), "")
    return first.select(*by, F.sha2(text, 256).alias("problems_sha256"), F.size("x").cast("long").alias("n_questions"))


DIGEST_FIELDS = ("idx", "problem", "phase1_solution", "phase1_answer", "gold_answer", "majority_answer", "judge_verdict")


def record_digest() -> Column:
    """16 hexadecimal digits over the version, the dataset and DIGEST_FIELDS, each with a NUL after it; a missing one reads None."""
    nul = F.chr(F.lit(0))
    parts = [F.lit("v2"), nul, F.coalesce(F.nullif("dataset", F.lit("")), F.lit("gsm8k")), nul]
    for f in DIGEST_FIELDS:
        parts += [F.coalesce(F.col(f).cast("string"), F.lit("None")), nul]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)
