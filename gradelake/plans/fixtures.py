"""Views in the shapes that operators take, made from the given tables by SQL that both engines read."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each view's SQL; {name} stands for a table or an earlier view.
VIEWS = {
    "items": """
SELECT d.doc_id AS idx, CASE WHEN d.lang = 'en' THEN 'math' ELSE 'gsm8k' END AS dataset, d.lang AS run, 'Level ' || CAST(d.doc_id % 5 + 1 AS STRING) AS level, d.source AS template,
       CASE WHEN d.doc_id % 10 < 6 THEN 'train' ELSE 'test' END AS split, l.quality AS y, CASE WHEN l.toxic = 1 THEN 'NO' ELSE 'YES' END AS verdict, 1 - l.toxic AS verdict_yes,
       CAST((d.n_chars * 7919) % 1000 AS DOUBLE) / 1000 AS score_a, CAST(d.n_chars % 11 AS DOUBLE) / 10 AS score_b,
       CASE WHEN d.doc_id % 53 = 0 THEN 'failed' END AS error, CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE d.n_chars > 6000 END AS truncated,
       CASE WHEN d.doc_id % 29 = 0 THEN FALSE ELSE TRUE END AS labelable, d.n_chars AS length, d.text AS problem
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "scores": """
SELECT idx, run, level, template, split, y, 'probe' AS detector, score_a AS score FROM {items} UNION ALL
SELECT idx, run, level, template, split, y, 'judge' AS detector, score_b AS score FROM {items}""",
    "records": """
SELECT event_id AS idx, 'run' || CAST(event_id % 3 AS STRING) AS run, CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, 'gsm8k' AS dataset, event_id AS seq,
       'Problem ' || CAST(event_id AS STRING) || ' of ' || event_type AS problem,
       CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN 'none' ELSE CAST(event_id % 50 + 1000 AS STRING) END AS gold_answer,
       CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 4 = 0 THEN CAST(event_id % 50 + 1000 AS STRING) WHEN event_id % 4 = 1 THEN '$1,' || lpad(CAST(event_id % 50 AS STRING), 3, '0')
            WHEN event_id % 4 = 2 THEN CAST(event_id % 50 + 1000 AS STRING) || '.00' ELSE CAST(event_id % 49 + 1000 AS STRING) END AS phase1_answer,
       'work = ' || CAST(event_id % 7 AS STRING) || ' + 1' || chr(10) || '#### ' || CAST(event_id % 50 + 1000 AS STRING) AS phase1_solution,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 48 + 1000 AS STRING) END AS majority_answer,
       CASE WHEN event_id % 6 = 1 THEN 'NO' WHEN event_id % 31 = 0 THEN NULL ELSE 'YES' END AS judge_verdict,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_id % 23 = 0 END AS truncated,
       CASE WHEN event_id % 61 = 0 THEN 'timeout' END AS error, event_id % 2 = 0 AS stored_correct, event_id % 11 <> 0 AS stored_labelable
FROM {events}""",
    "with_repeats": """
SELECT run, idx, gold_answer, error, seq FROM {records} UNION ALL
SELECT run, idx, 'again' AS gold_answer, CASE WHEN idx % 2 = 0 THEN 'failed' END AS error, seq + 10000000 AS seq FROM {records} WHERE idx % 9 = 0""",
    "samples": """
SELECT user_id AS idx, 'run' || CAST(user_id % 3 AS STRING) AS run, event_id AS pos,
       CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN CAST(event_id % 5 AS STRING) || '.0' ELSE CAST(event_id % 5 AS STRING) END AS answer FROM {events}""",
    "routing": """
SELECT idx, run, template, CAST(y AS INT) AS greedy_ok, CASE WHEN (idx * 31) % 7 < 2 THEN 1 - CAST(y AS INT) ELSE CAST(y AS INT) END AS major_ok, score_b AS score FROM {items}""",
}
#: Views whose SQL differs between the engines: words of a turn with their place.
TOKENS_SQL = """
SELECT conv_id * 1000 + turn AS idx, w.rank AS rank, w.word AS text, CAST(1.0 AS DOUBLE) / (w.rank * (w.rank + 1)) AS prob FROM (
  SELECT conv_id, turn, unnest(list_zip(string_split(text, ' '), range(1, len(string_split(text, ' ')) + 1))) AS p FROM conversations) q,
  LATERAL (SELECT CASE WHEN p[2] % 5 = 1 THEN ['Yes', 'no', 'NOTE', ' yes*', 'Y', 'N', 'YESTERDAY'][(conv_id % 7 + 1)::INT] ELSE p[1] END AS word, p[2] AS rank) w"""
HEADS_SQL = """
SELECT e.vec_id AS idx, h.h AS flat_head, CASE WHEN e.label < 5 THEN 1 ELSE 0 END AS y, e.embedding[(h.h * 8 + 1):(h.h * 8 + 8)] AS vec FROM embeddings e, (SELECT unnest(range(0, 8)) AS h) h"""


def view_sql(name: str, seen: dict[str, str]) -> None:
    """Adds DuckDB's SQL for a view and those below it to `seen`, in order."""
    if name in seen or name in ("tokens", "heads"):
        if name == "tokens":
            seen[name] = TOKENS_SQL
        if name == "heads":
            seen[name] = HEADS_SQL
        return
    if name in VIEWS:
        for other in VIEWS:
            if "{" + other + "}" in VIEWS[name]:
                view_sql(other, seen)
        seen[name] = VIEWS[name].replace("{", "").replace("}", "")


def with_views(names: str, body: str) -> str:
    """DuckDB's SQL for `body` with the named views before it."""
    seen: dict[str, str] = {}
    for n in names.split():
        view_sql(n, seen)
    if not seen:
        return body
    ctes = ",\n".join(f"{n} AS ({q})" for n, q in seen.items())
    body = body.strip()
    return f"WITH {ctes}" + (",\n" + body[5:] if body.upper().startswith("WITH ") else f"\n{body}")


class Views:
    """Tables and views of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in VIEWS:
            text = VIEWS[name]
            used = [n for n in [*VIEWS, "documents", "labels", "events"] if "{" + n + "}" in text]
            return self.spark.sql(text, **{n: getattr(self, n) for n in used})
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tokens(self) -> DataFrame:
        words = self.conversations.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
        said = F.array(*map(F.lit, ("Yes", "no", "NOTE", " yes*", "Y", "N", "YESTERDAY")))
        rank = (F.col("pos") + 1).cast("long")
        word = F.when(rank % 5 == 1, F.element_at(said, (F.col("conv_id") % 7 + 1).cast("int"))).otherwise(F.col("word"))
        return words.select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), rank.alias("rank"), word.alias("text"), (F.lit(1.0) / (rank * (rank + 1))).alias("prob"))

    @cached_property
    def layers(self) -> DataFrame:
        """idx, layer (two of four heads), y, vec (32 numbers). Embeddings of another width are refused."""
        width = F.when(F.size("embedding") == 64, True).otherwise(F.raise_error(F.lit("an embedding of another width than 64")).cast("boolean"))
        e = self.embeddings.filter(F.col("embedding").isNotNull()).filter(width)
        parts = F.array(*[F.struct(F.lit(i).alias("layer"), F.slice("embedding", 32 * i + 1, 32).alias("vec")) for i in (0, 1)])
        return e.select(F.col("vec_id").alias("idx"), (F.col("label") < 5).cast("int").alias("y"), F.explode(parts).alias("p")).select("idx", "y", "p.layer", "p.vec")
