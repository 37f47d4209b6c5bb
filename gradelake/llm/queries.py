"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm import align_tokens, conversations, decontam, html_extract, jaccard, langid, line_dedup, mixing, neighbours, secret_scan, sharding, tokens, warc
from gradelake.llm.common import small_batches, table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; the session, which is the job's own, passes small batches to Python from here on."""
    small_batches(spark)
    return table(spark, sf_dir, name)


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file: in the folder GRADELAKE_TOKENIZERS names, else where the package of such files has it."""
    if folder := os.environ.get("GRADELAKE_TOKENIZERS"):
        return os.path.join(folder, name)
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return str(public_tokenizers.path(name))
    return f"/opt/tokenizers/{name}"


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring lines of every document. A null or empty text has no lines; rows of one doc_id are one document."""
    return line_dedup.line_table(read(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates of every document. Documents without words, null ones too, are linked with nothing."""
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every document. A null text has no words; items without words never occur."""
    return decontam.contamination_table(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page. A null or empty html gives an empty text of 0 characters."""
    text = html_extract.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector among all others. Null, empty, zero and not finite vectors take no part."""
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document. A null text has size 0; a null source is a source, the last."""
    return mixing.mix_table(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every whole text. A null text counts as empty."""
    return tokens.token_table(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret-like spans of every whole text. A null text counts as empty and has none."""
    return secret_scan.find_secrets(read(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and place of every document. A null text has no bytes; null ids are hashed like others."""
    return sharding.shard_table(read(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; `und` for one that is null or has no letters."""
    return langid.language_table(read(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation. Nulls are one space; conversations without rows have zeros."""
    return conversations.repair_table(read(spark, sf_dir, "conversations"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive without repeated payloads, read back. A null html is an empty payload."""
    return warc.archive_table(read(spark, sf_dir, "pages"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every whole text by two tokenizers, linked. Null, empty and not reproducible texts have none."""
    return align_tokens.align_table(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_line_templates, op2_ngram_jaccard, op3_decontaminate, op4_main_text, op5_nearest, op6_mix, op7_token_counts, op8_secrets, op9_shards, op10_language, op11_conversations, op12_warc, op13_alignment)}
ORACLE = {"op1_line_templates": line_dedup.LINE_SQL, "op5_nearest": neighbours.NEAREST_SQL, "op6_mix": mixing.MIX_SQL, "op11_conversations": conversations.REPAIR_SQL, "op12_warc": warc.ARCHIVE_SQL}
