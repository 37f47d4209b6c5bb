"""Queries over records: ingest, parsing, grading, exclusions, reports and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.functions import answers
from gradelake.functions.prompts import KINDS, render_every_kind, template
from gradelake.functions.text import FEATURES, classify_token, shallow_features
from gradelake.operators import align, grade, perturb, report
from gradelake.plans.registry import query
from gradelake.sources import records as src


def lines(v):
    return v.with_repeats.withColumn("malformed", F.col("idx") % 101 == 0)


@query("read_records", "idx:l run:s gold_answer:s error:s seq:l", "records", "SELECT idx, run, gold_answer, error, seq FROM records WHERE idx % 5 > 1")
def _(v):
    line = F.to_json(F.struct("idx", "run", "gold_answer", "error"))
    broken = F.when(F.col("idx") % 10 == 0, F.lit("[1, 2]")).when(F.col("idx") % 10 == 5, F.lit("  ")).when(F.col("idx") % 10 == 1, F.substring(line, 1, 9)).when(F.col("idx") % 10 == 6, F.to_json(F.struct("run")))
    return src.parse_lines(v.records.select(F.coalesce(broken, line).alias("value"), "seq")).filter(~F.col("malformed"))


@query("ingest_stats", "run:s n_lines:l n_malformed:l n_duplicate:l", "with_repeats", """
SELECT run, count(*) AS n_lines, count(*) FILTER (WHERE idx % 101 = 0) AS n_malformed,
       count(*) FILTER (WHERE idx % 101 <> 0) - count(DISTINCT CASE WHEN idx % 101 <> 0 THEN idx END) AS n_duplicate FROM with_repeats GROUP BY run""")  # fmt: skip
def _(v):
    return src.ingest_stats(lines(v))


@query("dedupe_records", "run:s idx:l gold_answer:s error:s seq:l", "with_repeats", """
SELECT run, idx, gold_answer, error, seq FROM (SELECT *, row_number() OVER (PARTITION BY run, idx ORDER BY (error IS NULL) DESC, seq DESC) AS n FROM with_repeats) t WHERE n = 1""")  # fmt: skip
def _(v):
    return src.dedupe_records(v.with_repeats)


@query("pending_problems", "idx:l problem:s", "records", """
SELECT idx, problem FROM records p WHERE NOT EXISTS (SELECT 1 FROM records d WHERE d.idx = p.idx AND d.split = 'train' AND d.error IS NULL)""")  # fmt: skip
def _(v):
    return src.pending_problems(v.records.select("idx", "problem"), v.records.filter("split = 'train'"), retry_failed=True)


@query("out_of_range_records", "idx:l run:s", "records items", "SELECT idx, run FROM records WHERE idx >= (SELECT count(*) FROM items)")
def _(v):
    return src.out_of_range_records(v.records, v.items)


@query("sample_problems", "idx:l key:l level:s", "items", """
SELECT row_number() OVER (ORDER BY md5('7:' || CAST(idx AS VARCHAR)), idx) - 1 AS idx, idx AS key, level FROM items WHERE level IN ('Level 2', 'Level 3') AND run IN ('en', 'fr')
ORDER BY md5('7:' || CAST(idx AS VARCHAR)), key LIMIT 200""")  # fmt: skip
def _(v):
    rows = v.items.select(F.col("idx").alias("key"), "level", F.col("run").alias("subject"))
    return src.sample_problems(rows, 200, 7, ["en", "fr"], ["2", "level3"], key="key")


@query("problems_digest", "problems_sha256:s n_questions:l", "records", """
SELECT sha256(string_agg(problem || chr(0), '' ORDER BY idx)) AS problems_sha256, count(*) AS n_questions FROM records WHERE idx < 64""")  # fmt: skip
def _(v):
    return src.problems_digest(v.records.withColumnRenamed("problem", "question"))


@query("record_digest", "idx:l digest:s", "records", """
SELECT idx, substr(sha256('v2' || chr(0) || 'gsm8k' || chr(0) || CAST(idx AS VARCHAR) || chr(0) || problem || chr(0) || phase1_solution || chr(0) || coalesce(phase1_answer, 'None') || chr(0)
       || coalesce(gold_answer, 'None') || chr(0) || coalesce(majority_answer, 'None') || chr(0) || coalesce(judge_verdict, 'None') || chr(0)), 1, 16) AS digest FROM records""")  # fmt: skip
def _(v):
    return v.records.select("idx", src.record_digest().alias("digest"))


def _sql_text(t: str) -> str:
    body = t.replace("'", "''")
    return "'" + body.replace("{problem}", "' || problem || '").replace("{solution}", "' || phase1_solution || '") + "'"


def prompts_sql() -> str:
    return " UNION ALL ".join(f"SELECT idx, '{k}' AS kind, CASE WHEN dataset = 'math' THEN {_sql_text(template('math', k))} ELSE {_sql_text(template('gsm8k', k))} END AS prompt FROM p" for k in KINDS)


@query("render_prompts", "idx:l kind:s prompt:s", "records", f"WITH p AS (SELECT * REPLACE (CASE WHEN idx % 2 = 0 THEN 'math' ELSE dataset END AS dataset) FROM records) {prompts_sql()}")
def _(v):
    r = v.records.withColumn("dataset", F.when(F.col("idx") % 2 == 0, "math").otherwise(F.col("dataset")))
    return r.select("*", F.explode(F.array(*map(F.lit, KINDS))).alias("kind")).transform(render_every_kind)


@query("write_records", "run:s split:s n:l first_idx:l last_idx:l n_missing_gold:l digest:s", "records", """
SELECT run, split, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, count(*) FILTER (WHERE gold_answer IS NULL) AS n_missing_gold,
  md5(string_agg(CAST(idx AS VARCHAR) || ':' || coalesce(phase1_answer, ''), ',' ORDER BY idx)) AS digest FROM records GROUP BY run, split""")  # fmt: skip
def _(v):
    # written in partitions and read back
    path = src.scratch_path(v.spark, "records")
    src.write_records(v.records.select("idx", "run", "split", "gold_answer", "phase1_answer"), path, ("run", "split"))
    one = F.struct("idx", F.concat(F.col("idx").cast("string"), F.lit(":"), F.coalesce("phase1_answer", F.lit(""))).alias("t"))
    back = v.spark.read.schema("idx long, gold_answer string, phase1_answer string, run string, split string").parquet(path)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), ",")
    return back.groupBy("run", "split").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count_if(F.col("gold_answer").isNull()).alias("n_missing_gold"), F.md5(text).alias("digest"))


NUMBER = r"([-0-9,]+(?:\.[0-9]+)?)"


@query("parse_gold_marker", "idx:l gold:s", "records", r"""
SELECT idx, nullif(replace(regexp_extract(phase1_solution, '####\s*\$?\s*([+-]?[0-9,]+(?:\.[0-9]+)?)', 1), ',', ''), '') AS gold FROM records""")  # fmt: skip
def _(v):
    return v.records.select("idx", answers.parse_gold_marker("phase1_solution").alias("gold"))


REPLY = """CASE idx % 6 WHEN 0 THEN 'so the answer is: 1,' || lpad(CAST(idx % 90 AS STRING), 3, '0') || ' units' WHEN 1 THEN 'Answer: -' || CAST(idx % 9 AS STRING) || '.5' WHEN 2 THEN 'thus **' || CAST(idx AS STRING) || '** done'
  WHEN 3 THEN 'x = ' || CAST(idx % 77 AS STRING) WHEN 4 THEN 'about ' || CAST(idx % 7 AS STRING) || ' or maybe ' || CAST(idx % 11 AS STRING) || ' in all' ELSE 'no digits at all' END"""


@query("parse_final_number", "idx:l number:s", "records", f"""
WITH t AS (SELECT idx, {REPLY} AS reply FROM records)
SELECT idx, CASE idx % 6 WHEN 0 THEN '1' || lpad(CAST(idx % 90 AS VARCHAR), 3, '0') WHEN 1 THEN regexp_extract(reply, '-[0-9.]+$') WHEN 2 THEN regexp_extract(reply, '\\*\\*([0-9]+)', 1)
  WHEN 3 THEN regexp_extract(reply, '= ([0-9]+)', 1) WHEN 4 THEN regexp_extract(reply, 'maybe ([0-9]+)', 1) END AS number FROM t""")  # fmt: skip
def _(v):
    return v.records.select("idx", F.expr(REPLY).alias("reply")).select("idx", answers.parse_final_number("reply").alias("number"))


#: Replies in many spellings, with what they hold; {n} is a number of the record's own.
BOXED = [
    ("\\boxed{{n}}", "{n}"), ("so \\boxed{\\frac{1}{{n}}}.", "\\frac{1}{{n}}"), ("first \\boxed{3}, then \\boxed{{n}} end", "{n}"), ("\\fbox{{n}} it is", "{n}"), ("\\boxed{3} then \\fbox{{n}}", "{n}"),
    ("\\fbox{3} then \\boxed{{n}}", "{n}"), ("\\boxed {n} ok", "{n}"), ("\\boxed{-{n}}", "-{n}"), ("\\boxed{\\frac{\\sqrt{{n}}}{2}}", "\\frac{\\sqrt{{n}}}{2}"), ("\\boxed{\\text{even {n}}}", "\\text{even {n}}"),
    ("\\boxed{\\boxed{{n}}}", "\\boxed{{n}}"), ("\\boxed{a \\fbox{{n}}}", "{n}"), ("\\boxed{{{n}}}", "{{n}}"), ("\\boxed   {{n}}", "{n}"), ("\\boxed\\pi and {n}", "\\pi"), ("\\boxed{open {n}", None), ("the answer is {n}", None),
    ("\\boxed{{n}} and \\boxed{open", "{n}"), ("\\boxed{}", ""), ("box {n}", None), ("\\boxed{x_{1} = {n}}", "x_{1} = {n}"), ("\\boxed{({n},\\infty)}", "({n},\\infty)"),
]
MATH = [
    ("so \\boxed{{n}}.", "{n}"), ("The final answer is ${n}.5$. Done", "{n}.5"), ("the answer is: {n}. Then more", "{n}"), ("I say {n}", None), ("\\boxed{} the answer is {n}", "{n}"), ("ANSWER IS {n}\nand 7", "{n}"),
    ("The final answer is: $\\frac{1}{{n}}$", "\\frac{1}{{n}}"), ("answer is 4, final answer is {n}", "{n}"), ("answer is . then {n}", None), ("\\boxed{\\text{}} final answer is {n} cm", "{n} cm"), ("answer is {n}.25.", "{n}.25"), ("\\boxed{open {n} the answer is 9", "9"),
]
LATEX = [
    ("${n}$", "{n}"), ("x = {n}.00\\text{ cm}", "{n}"), ("1, {n}", "1,{n}"), ("\\text{even}.", "even"), ("\\dfrac{{n}}{2}", "\\frac{{n}}{2}"), ("\\tfrac{1}{{n}}", "\\frac{1}{{n}}"), ("\\frac1{{n}}", "\\frac{1}{{n}}"), ("\\frac{{n}}2", "\\frac{{n}}{2}"),
    ("\\frac12", "\\frac{1}{2}"), ("\\left(1,{n}\\right)", "(1,{n})"), ("\\(x+{n}\\)", "x+{n}"), ("\\!{n}\\,", "{n}"), ("{n}\\%", "{n}"), ("{n}^\\circ", "{n}"), ("{n}^{\\circ}", "{n}"), ("\\textbf{{n}}", "{n}"), ("{n}\\text{ inches}", "{n}"),
    ("\\text{ odd}", "odd"), ("\\${n}", "{n}"), ("2\\cdot{n}", "2\\cdot{n}"), ("{n}{,}000", "{n}000"), ("{n},000", "{n}000"), (".5", "0.5"), ("-.5", "-0.5"), ("{n}\\sqrt3", "{n}\\sqrt{3}"), ("y = -{n}.50", "-{n}.5"), ("({n},2)", "({n},2)"), ("x<{n}", "x<{n}"),
    ("-0.0", "0"), ("{n}.", "{n}"), ("\\frac{\\sqrt{{n}}}2", "\\frac{\\sqrt{{n}}}{2}"), ("\\mathbf{\\text{no}}", "no"), ("{n}e2", "{n}00"), ("$$", None), ("\\text{}", None), ("\\frac{{n}", "\\frac{{n}"), ("{n}}", "{n}}"), ("-1,{n}", "-1,{n}"),
]


def spelled_out(cases, side: int):
    """The text or the answer of each record, by its place among `cases`."""
    texts = F.array(*[F.lit(case[side]).cast("string") for case in cases])
    return F.replace(F.element_at(texts, (F.col("idx") % len(cases) + 1).cast("int")), F.lit("{n}"), (F.col("idx") % 8 + 2).cast("string"))


def spelled_sql(cases, name: str) -> str:
    """SQL of the answers."""
    values = ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for _, x in cases)
    return f"SELECT idx, replace(([{values}]::VARCHAR[])[idx % {len(cases)} + 1], '{{n}}', CAST(idx % 8 + 2 AS VARCHAR)) AS {name} FROM records"


@query("extract_boxed", "idx:l boxed:s", "records", spelled_sql(BOXED, "boxed"))
def _(v):
    return v.records.select("idx", answers.extract_boxed(spelled_out(BOXED, 0)).alias("boxed"))


@query("parse_math_answer", "idx:l answer:s", "records", spelled_sql(MATH, "answer"))
def _(v):
    return v.records.select("idx", answers.parse_math_answer(spelled_out(MATH, 0)).alias("answer"))


@query("canonical_number", "idx:l canonical:s", "records", """
SELECT idx, CASE WHEN phase1_answer IS NULL THEN NULL ELSE CAST(CAST(CAST(replace(replace(phase1_answer, ',', ''), '$', '') AS DOUBLE) AS BIGINT) AS VARCHAR) END AS canonical FROM records""")  # fmt: skip
def _(v):
    return v.records.select("idx", answers.canonical_number("phase1_answer").alias("canonical"))


@query("canonical_latex", "idx:l canonical:s", "records", spelled_sql(LATEX, "canonical"))
def _(v):
    return v.records.select("idx", answers.canonical_latex(spelled_out(LATEX, 0)).alias("canonical"))


@query("latex_answers_equal", "idx:l equal:b", "records", f"""
WITH a AS ({spelled_sql(LATEX, "a")}), b AS (SELECT idx, CASE idx % 3 WHEN 0 THEN a WHEN 1 THEN a || 'x' END AS b FROM a) SELECT idx, coalesce(a = b, FALSE) AS equal FROM a JOIN b USING (idx)""")  # fmt: skip
def _(v):
    other = F.when(F.col("idx") % 3 == 0, spelled_out(LATEX, 1)).when(F.col("idx") % 3 == 1, F.concat(spelled_out(LATEX, 1), F.lit("x")))
    return v.records.select("idx", answers.answers_equal(spelled_out(LATEX, 0), other, F.lit("math")).alias("equal"))


VALUE = "CAST(replace(replace({c}, ',', ''), '$', '') AS DOUBLE)"
SAME = f"coalesce({VALUE.format(c='phase1_answer')} = CASE WHEN gold_answer <> 'none' THEN {VALUE.format(c='gold_answer')} END, FALSE)".replace("CAST(replace(replace(gold_answer", "TRY_CAST(replace(replace(gold_answer")
GRADED = f"""g AS (SELECT *, gold_answer IS NOT NULL AND gold_answer <> 'none' AS labelable, {SAME} AS solve_correct,
  coalesce(CAST(majority_answer AS DOUBLE) = TRY_CAST(gold_answer AS DOUBLE), FALSE) AS majority_correct FROM records),
x AS (SELECT *, CASE WHEN labelable THEN solve_correct END AS label,
  CASE WHEN error IS NOT NULL THEN 'error' WHEN truncated IS TRUE THEN 'truncated' WHEN NOT labelable THEN 'no_gold' END AS reason FROM g)"""


@query("answers_equal", "idx:l equal:b", "records", f"SELECT idx, {SAME} AS equal FROM records")
def _(v):
    return v.records.select("idx", answers.answers_equal("phase1_answer", "gold_answer", "dataset", latex=False).alias("equal"))


def graded(v):
    return grade.grade_records(v.records, latex=False).withColumn("reason", grade.exclusion_reason())


@query("grade_records", "idx:l solve_correct:b majority_correct:b labelable:b label_policy:s label:b", "records", f"""
WITH {GRADED} SELECT idx, solve_correct, majority_correct, labelable, 'numeric_equivalence_v2' AS label_policy, label FROM x""")  # fmt: skip
def _(v):
    return graded(v)


@query("exclusion_reason", "idx:l reason:s", "records", f"WITH {GRADED} SELECT idx, reason FROM x")
def _(v):
    return graded(v)


@query("parse_verdict", "idx:l verdict:s", "", r"""
WITH t AS (SELECT conv_id * 1000 + turn AS idx, upper(trim(CASE WHEN turn % 3 = 0 THEN 'no errors here, so yes ' || conv_id WHEN turn % 3 = 1 THEN text || ' - YES, but NO!' ELSE text END, ' ' || chr(9) || chr(10))) AS u FROM conversations),
s AS (SELECT idx, u, list_filter(string_split_regex(u, '[^\p{L}\p{N}_]+'), lambda w: w IN ('YES', 'NO')) AS w FROM t)
SELECT idx, CASE WHEN u LIKE 'YES%' THEN 'YES' WHEN u LIKE 'NO%' THEN 'NO' ELSE coalesce(w[len(w)], 'NO') END AS verdict FROM s""")  # fmt: skip
def _(v):
    c = v.conversations
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("no errors here, so yes "), "conv_id")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" - YES, but NO!"))).otherwise(F.col("text"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), answers.parse_verdict(text).alias("verdict"))


@query("shallow_features", "idx:l " + " ".join(f"{f}:d" for f in FEATURES), "", r"""
WITH t AS (SELECT doc_id AS idx, text || chr(10) || '#### $1,2' || CAST(doc_id % 10 AS VARCHAR) AS t FROM documents)
SELECT idx, length(t) AS n_chars_f, len(string_split_regex(trim(t, ' ' || chr(9) || chr(10)), '\s+')) AS n_words_f, length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines_f,
       length(t) - length(translate(t, '0123456789', '')) AS n_digits_f, length(t) - length(translate(t, '+-*/=', '')) AS n_operators_f, 1 AS has_marker_f, ln(1 + 120 // 10 + idx % 10 + 108) AS log_number_f FROM t""")  # fmt: skip
def _(v):
    d = v.documents.select(F.col("doc_id").alias("idx"), F.concat("text", F.lit("\n#### $1,2"), F.col("doc_id") % 10).alias("t"))
    return d.select("idx", *[c.alias(n) for n, c in shallow_features("t").items()])


TOKEN_CLASS = "upper(trim(trim(text, ' ' || chr(9) || chr(10)), '\":*'))"
PREFIX = f"CASE WHEN {TOKEN_CLASS} LIKE 'YES%' OR {TOKEN_CLASS} IN ('Y', 'YE') THEN 'yes' WHEN {TOKEN_CLASS} LIKE 'NO%' OR {TOKEN_CLASS} = 'N' THEN 'no' END"
EXACT = f"CASE WHEN {TOKEN_CLASS} IN ('YES', 'Y', 'YE') THEN 'yes' WHEN {TOKEN_CLASS} IN ('NO', 'N') THEN 'no' END"


@query("classify_token", "text:s prefix_class:s exact_class:s", "tokens", f"SELECT DISTINCT text, {PREFIX} AS prefix_class, {EXACT} AS exact_class FROM tokens")
def _(v):
    return v.tokens.select("text").distinct().select("text", classify_token("text").alias("prefix_class"), classify_token("text", "exact").alias("exact_class"))


def scored(v):
    """Scores of records, some of them of other records' digests, and some without one."""
    r = v.records.select("run", "idx", src.record_digest().alias("digest"))
    return r.withColumns({"digest": F.when(F.col("idx") % 97 == 0, "other").otherwise(F.col("digest")), "score": (F.col("idx") % 100) / 100.0, "idx": F.when(F.col("idx") % 89 == 0, -F.col("idx")).otherwise(F.col("idx"))})


@query("align_scores", "run:s idx:l score:d label:b", "records", f"""
WITH {GRADED} SELECT x.run, x.idx, (x.idx % 100) / 100.0 AS score, label FROM x WHERE labelable AND (idx % 89 <> 0 OR idx = 0)""")  # fmt: skip
def _(v):
    return align.align_scores(scored(v).drop("digest"), graded(v))


@query("alignment_audit", "run:s n_scores:l n_missing:l n_mismatch:l n_kept:l", "records", f"""
WITH {GRADED} SELECT run, count(*) AS n_scores, count(*) FILTER (WHERE idx % 89 = 0 AND idx <> 0) AS n_missing, count(*) FILTER (WHERE idx % 97 = 0 AND (idx % 89 <> 0 OR idx = 0)) AS n_mismatch,
  count(*) FILTER (WHERE labelable AND (idx % 89 <> 0 OR idx = 0)) AS n_kept FROM x GROUP BY run""")  # fmt: skip
def _(v):
    r = graded(v).withColumn("digest", src.record_digest())
    return align.alignment_audit(scored(v), r)


@query("crosscheck_scores", "run:s n:l n_covered:l n_mismatch:l n_over:l max_delta:d over_noise:d n_gross:l status:s", "items", """
WITH p AS (SELECT run, idx, score_a AS a, CASE WHEN idx % 5 <> 0 THEN score_a + CASE WHEN idx % 7 = 0 THEN 0.2 ELSE 0.002 END END AS b, idx % 31 = 0 AND idx % 5 <> 0 AS m FROM items),
q AS (SELECT run, count(*) AS n, count(b) AS n_covered, count(*) FILTER (WHERE m) AS n_mismatch, count(*) FILTER (WHERE abs(a - b) > 0.01) AS n_over, max(abs(a - b)) AS max_delta,
  count(*) FILTER (WHERE abs(a - b) > 0.001) / count(b)::DOUBLE AS over_noise, count(*) FILTER (WHERE abs(a - b) > 0.1) AS n_gross FROM p GROUP BY run)
SELECT *, CASE WHEN n_over > 0 OR n_mismatch > 0 THEN 'disagrees' WHEN n_covered < n THEN 'partial_coverage' ELSE 'agrees' END AS status FROM q""")  # fmt: skip
def _(v):
    a = v.items.select("run", "idx", F.col("score_a").alias("score"), F.lit("x").alias("digest"))
    b = a.filter("idx % 5 <> 0").withColumns({"score": F.col("score") + F.when(F.col("idx") % 7 == 0, 0.2).otherwise(0.002), "digest": F.when(F.col("idx") % 31 == 0, "y").otherwise("x")})
    return align.crosscheck_scores(a, b)


@query("attach_level", "idx:l level:s", "items", """
WITH lv AS (SELECT trim(problem) AS p, min(level) AS level FROM items WHERE split = 'train' GROUP BY trim(problem)) SELECT idx, coalesce(lv.level, 'UNMATCHED') AS level FROM items LEFT JOIN lv ON trim(items.problem) = lv.p""")  # fmt: skip
def _(v):
    return align.attach_level(v.items.drop("level"), v.items.filter("split = 'train'").select("problem", "level"))


#: Every document is a perturbed item, known by its length as its original; every judged item, known the same way, is a reference.
PERTURBED = "SELECT doc_id, text AS question, CAST(n_chars AS VARCHAR) AS original_question, doc_id % 20 AS original_id FROM documents"


@query("template_map", "question:s original_question:s original_id:l n_originals:l n_ids:l violation:b", "", f"""
SELECT *, n_originals > 1 OR n_ids > 1 AS violation FROM (SELECT trim(question) AS question, min(original_question) AS original_question, min(original_id) AS original_id,
  count(DISTINCT original_question) AS n_originals, count(DISTINCT original_id) AS n_ids FROM ({PERTURBED}) p GROUP BY trim(question)) t""")  # fmt: skip
def _(v):
    return perturb.template_map(perturbed(v))


def perturbed(v):
    return v.documents.select("doc_id", F.col("text").alias("question"), F.col("n_chars").cast("string").alias("original_question"), (F.col("doc_id") % 20).alias("original_id"))


@query("match_originals", "original_question:s n_perturbed:l n_reference:l state:s", "items", f"""
WITH m AS (SELECT trim(question) AS question, min(original_question) AS original_question FROM ({PERTURBED}) p GROUP BY 1),
w AS (SELECT m.original_question, count(*) AS n_perturbed FROM ({PERTURBED}) p JOIN m ON trim(p.question) = m.question GROUP BY 1),
f AS (SELECT CAST(length AS VARCHAR) AS original_question, count(*) AS n, bool_and(labelable) AS usable FROM items GROUP BY 1)
SELECT w.original_question, n_perturbed, coalesce(n, 0) AS n_reference, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicated' WHEN NOT usable THEN 'unlabelable' ELSE 'matched' END AS state FROM w LEFT JOIN f USING (original_question)""")  # fmt: skip
def _(v):
    ref = v.items.select(F.col("length").cast("string").alias("question"), "labelable")
    return perturb.match_originals(perturbed(v), ref, perturb.template_map(perturbed(v)))


@query("split_overlap", "run:s problem:s", "items", """
SELECT DISTINCT a.run, trim(a.problem) AS problem FROM items a JOIN items b ON a.run = b.run AND trim(a.problem) = trim(b.problem) WHERE a.split = 'train' AND b.split = 'test'""")  # fmt: skip
def _(v):
    return align.split_overlap(v.items.filter("split = 'train'"), v.items.filter("split = 'test'"))


@query("compare_run_metadata", "run:s key:s stored:s now:s status:s", "items", """
WITH p AS (SELECT run, unnest(['n_problems', 'model', 'label_policy', 'seed', 'backend']) AS key, count(*) AS n FROM items GROUP BY run),
q AS (SELECT run, key, CASE key WHEN 'n_problems' THEN CAST(n AS VARCHAR) WHEN 'seed' THEN NULL ELSE 'a' END AS stored,
  CASE key WHEN 'n_problems' THEN CAST(n + CASE run WHEN 'en' THEN 5 WHEN 'fr' THEN -1 ELSE 0 END AS VARCHAR) WHEN 'model' THEN CASE run WHEN 'de' THEN 'b' ELSE 'a' END WHEN 'label_policy' THEN 'v2' WHEN 'seed' THEN '7' ELSE 'a' END AS now FROM p)
SELECT *, CASE WHEN stored = now THEN 'equal' WHEN key = 'label_policy' THEN 'advisory' WHEN key = 'n_problems' THEN CASE run WHEN 'en' THEN 'grew' ELSE 'shrunk' END WHEN stored IS NULL THEN 'missing' ELSE 'drift' END AS status FROM q""")  # fmt: skip
def _(v):
    n = v.items.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    pair = lambda k, x: F.struct(F.lit(k).alias("key"), x.cast("string").alias("value"))
    a = n.select("run", F.explode(F.array(pair("n_problems", F.col("n")), pair("model", F.lit("a")), pair("label_policy", F.lit("a")), pair("backend", F.lit("a")))).alias("x")).select("run", "x.*")
    step = F.when(F.col("run") == "en", 5).when(F.col("run") == "fr", -1).otherwise(0)
    model = F.when(F.col("run") == "de", "b").otherwise("a")
    b = n.select("run", F.explode(F.array(pair("n_problems", F.col("n") + step), pair("model", model), pair("label_policy", F.lit("v2")), pair("backend", F.lit("a")), pair("seed", F.lit(7)))).alias("x")).select("run", "x.*")
    return align.compare_run_metadata(a, b)


@query("confusion_matrix", "run:s tp:l fn:l fp:l tn:l", "records", f"""
WITH {GRADED} SELECT run, count(*) FILTER (WHERE solve_correct AND judge_verdict IS NOT DISTINCT FROM 'YES') AS tp, count(*) FILTER (WHERE solve_correct AND judge_verdict IS DISTINCT FROM 'YES') AS fn,
  count(*) FILTER (WHERE NOT solve_correct AND judge_verdict IS NOT DISTINCT FROM 'YES') AS fp, count(*) FILTER (WHERE NOT solve_correct AND judge_verdict IS DISTINCT FROM 'YES') AS tn FROM x WHERE reason IS NULL GROUP BY run""")  # fmt: skip
def _(v):
    return report.confusion_matrix(graded(v).filter("reason is null"), "solve_correct", "judge_verdict")


@query("confusion_metrics", "run:s accuracy:d precision:d recall:d f1:d truth_yes_pct:d truth_no_pct:d", "records", f"""
WITH {GRADED}, c AS (SELECT run, count(*) FILTER (WHERE solve_correct AND judge_verdict IS NOT DISTINCT FROM 'YES')::DOUBLE AS tp, count(*) FILTER (WHERE solve_correct AND judge_verdict IS DISTINCT FROM 'YES') AS fn,
  count(*) FILTER (WHERE NOT solve_correct AND judge_verdict IS NOT DISTINCT FROM 'YES') AS fp, count(*) FILTER (WHERE NOT solve_correct AND judge_verdict IS DISTINCT FROM 'YES')::DOUBLE AS tn FROM x WHERE reason IS NULL GROUP BY run)
SELECT run, (tp + tn) / (tp + fn + fp + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, 100 * tp / (tp + fn) AS truth_yes_pct, 100 * tn / (fp + tn) AS truth_no_pct FROM c""")  # fmt: skip
def _(v):
    return report.confusion_metrics(report.confusion_matrix(graded(v).filter("reason is null"), "solve_correct", "judge_verdict"))


def with_k(v):
    return graded(v).withColumn("k_answers", F.array("phase1_answer", "majority_answer", F.lit("1")))


@query("all_confusions", "run:s majority_gold_tp:l majority_gold_tn:l judge_majority_fp:l judge_majority_fn:l", "records", f"""
WITH {GRADED}, z AS (SELECT *, judge_verdict IS NOT DISTINCT FROM 'YES' AS j FROM x WHERE reason IS NULL) SELECT run, count(*) FILTER (WHERE solve_correct AND majority_correct) AS majority_gold_tp, count(*) FILTER (WHERE NOT solve_correct AND NOT majority_correct) AS majority_gold_tn,
  count(*) FILTER (WHERE NOT majority_correct AND j) AS judge_majority_fp, count(*) FILTER (WHERE majority_correct AND NOT j) AS judge_majority_fn FROM z GROUP BY run""")  # fmt: skip
def _(v):
    return report.all_confusions(with_k(v).filter("reason is null"))


@query("base_rates", "run:s n_loaded:l n_evaluated:l correct_rate:d judge_yes_rate:d majority_correct_rate:d parse_failure_rate:d k_parse_failure_rate:d", "records", f"""
WITH {GRADED} SELECT run, count(*) AS n_loaded, count(*) FILTER (WHERE labelable) AS n_evaluated, avg(CASE WHEN labelable THEN solve_correct::INT END) AS correct_rate,
  avg(CASE WHEN labelable THEN coalesce(judge_verdict = 'YES', FALSE)::INT END) AS judge_yes_rate, avg(CASE WHEN labelable THEN majority_correct::INT END) AS majority_correct_rate,
  avg((phase1_answer IS NULL)::INT) AS parse_failure_rate, sum((phase1_answer IS NULL)::INT + (majority_answer IS NULL)::INT) / (3.0 * count(*)) AS k_parse_failure_rate FROM x GROUP BY run""")  # fmt: skip
def _(v):
    return report.base_rates(with_k(v))


@query("truncation_rate", "run:s n_truncated:l rate:d coverage:d warn:b", "items", """
SELECT run, count(*) FILTER (WHERE truncated) AS n_truncated, avg(truncated::INT) AS rate, count(truncated) / count(*)::DOUBLE AS coverage, coalesce(avg(truncated::INT) > 0.02, FALSE) AS warn FROM items GROUP BY run""")  # fmt: skip
def _(v):
    return report.truncation_rate(v.items)


EXCLUDED = """count(*) AS generated, count(*) FILTER (WHERE reason IS NULL) AS analysed, count(*) FILTER (WHERE reason = 'error') AS errors, count(*) FILTER (WHERE reason = 'truncated') AS truncated_rows,
  count(*) FILTER (WHERE reason = 'no_gold') AS no_gold, count(*) FILTER (WHERE reason = 'truncated' AND NOT label) AS truncated_wrong, avg(CASE WHEN reason IS NULL THEN (NOT label)::INT END) AS prevalence,
  avg((NOT coalesce(label, FALSE))::INT) AS prevalence_included"""
EXCLUDED_SPEC = "generated:l analysed:l errors:l truncated_rows:l no_gold:l truncated_wrong:l prevalence:d prevalence_included:d"


@query("exclusion_summary", f"run:s split:s {EXCLUDED_SPEC}", "records", f"WITH {GRADED} SELECT run, split, {EXCLUDED} FROM x GROUP BY run, split")
def _(v):
    return grade.exclusion_summary(graded(v))


@query("population_table", f"run:s split:s depth:l {EXCLUDED_SPEC}", "records", f"WITH {GRADED} SELECT run, split, grouping(run) * 2 + grouping(split) AS depth, {EXCLUDED} FROM x GROUP BY ROLLUP (run, split)")
def _(v):
    return grade.population_table(graded(v))


@query("labelable_audit", "run:s n_with_field:l n_stored_only:l n_computed_only:l first_idx:s", "records", f"""
WITH {GRADED}, d AS (SELECT *, row_number() OVER (PARTITION BY run, stored_labelable <> labelable ORDER BY idx) AS n FROM x)
SELECT run, count(*) AS n_with_field, count(*) FILTER (WHERE stored_labelable AND NOT labelable) AS n_stored_only, count(*) FILTER (WHERE NOT stored_labelable AND labelable) AS n_computed_only,
  string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (WHERE stored_labelable <> labelable AND n <= 10) AS first_idx FROM d GROUP BY run""")  # fmt: skip
def _(v):
    return grade.labelable_audit(graded(v))


@query("label_disagreements", "run:s n_differ:l", "records", f"WITH {GRADED} SELECT run, count(*) FILTER (WHERE stored_correct <> solve_correct) AS n_differ FROM x GROUP BY run")
def _(v):
    return grade.label_disagreements(graded(v))


@query("majority_vote", "run:s idx:l majority_answer:s majority_votes:l n_votes:l", "samples", """
WITH c AS (SELECT run, idx, pos, replace(answer, '.0', '') AS a FROM samples), g AS (SELECT run, idx, a, count(*) AS n, min(pos) AS f FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY run, idx ORDER BY a IS NULL, n DESC, f) AS k, sum(CASE WHEN a IS NOT NULL THEN n ELSE 0 END) OVER (PARTITION BY run, idx) AS n_votes FROM g)
SELECT run, idx, a AS majority_answer, CASE WHEN a IS NOT NULL THEN n END AS majority_votes, n_votes FROM r WHERE k = 1""")  # fmt: skip
def _(v):
    return report.majority_vote(v.samples.withColumn("canonical", answers.canonical_number("answer")))


@query("run_health", "run:s split:s n_rows:l n_classes:l n_datasets:l n_not_finite:l unusable:b", "items", """
SELECT run, split, count(*) AS n_rows, count(DISTINCT y) AS n_classes, count(DISTINCT dataset) AS n_datasets, count(*) FILTER (WHERE idx % 13 = 0) AS n_not_finite, count(DISTINCT y) < 2 AS unusable FROM items GROUP BY run, split""")  # fmt: skip
def _(v):
    bad = F.when(F.col("idx") % 26 == 0, float("inf")).otherwise(float("nan"))
    return grade.run_health(v.items.withColumn("score", F.when(F.col("idx") % 13 == 0, bad).otherwise(F.col("score_a"))))


@query("truncated_records", "idx:l length:l", "items", "SELECT idx, length FROM items WHERE length >= 2996")
def _(v):
    return grade.truncated_records(v.items.withColumn("truncated", F.lit(None).cast("boolean")), 3000)


@query("truncated_sample", "idx:l length:l", "items", "SELECT idx, length FROM items WHERE truncated ORDER BY md5('5:' || CAST(idx AS VARCHAR)), idx LIMIT 100")
def _(v):
    return grade.truncated_records(v.items, 3000, sample=100, seed=5)


@query("template_accuracy", "template:s perturbed_accuracy:d n_items:l original_accuracy:d delta:d", "items", """
SELECT *, perturbed_accuracy - original_accuracy AS delta FROM (SELECT template, avg(y) AS perturbed_accuracy, count(*) AS n_items FROM items WHERE dataset = 'math' GROUP BY template) a
JOIN (SELECT template, avg(y) AS original_accuracy FROM items WHERE dataset = 'gsm8k' GROUP BY template) b USING (template)""")  # fmt: skip
def _(v):
    return perturb.template_accuracy(v.items.filter("dataset = 'math'"), v.items.filter("dataset = 'gsm8k'"))


@query("absent_provenance", "run:s absent:s", "items", """
SELECT run, CASE run WHEN 'en' THEN 'prompt_identity' WHEN 'fr' THEN 'rec_sha,prompt_identity' ELSE 'gen_run,prompt_identity' END AS absent FROM items GROUP BY run""")  # fmt: skip
def _(v):
    runs = v.items.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    pair = lambda k, c: F.struct(F.lit(k).alias("key"), F.when(c, F.col("n").cast("string")).alias("value"))
    keys = F.array(pair("rec_sha", F.col("run") != "fr"), pair("gen_run.model", F.col("run").isin("en", "fr")), pair("prompt_identity.model", F.lit(False)))
    return align.absent_provenance(runs.select("run", F.explode(keys).alias("x")).select("run", "x.*"))
