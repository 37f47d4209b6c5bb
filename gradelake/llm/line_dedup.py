"""Line dedup by a log-template tree.

A line becomes tokens; those that hold a digit, an @ or :// are variable fields from the start. Its place in the tree is fixed by its token count, its
leading token and, below that, by one of its thirds, so that it stands at three nodes. The first line of a node (least document, then line)
is its template. A line joins it if enough of its tokens are equal, position by position, wherever the others are; those become variable fields.
A template that occurs in two documents or more recurs. Its lines are dropped in every document but its first.

Lines that are equal after masking are one form, which is all that goes through the tree. So two lines find each other if they are of one
length, begin alike, agree in LEAST tenths of their tokens and in one whole third of them.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import lookup, quoted, stored

#: Nodes a line stands at: its tokens are cut in so many parts.
PARTS = 3
#: Tenths of a line's tokens that must equal the template's.
LEAST = 7
#: A token with a digit, an @ or ://, from its first character on.
_VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@:]*+(?::(?!//)[^\x20\x09-\x0D0-9@:]*+)*+(?:[0-9@]|://)[^\x20\x09-\x0D]*+"
#: Any white space that is not one space between two tokens.
_ODD_SPACE = ("  ", "\t", "\x0b", "\x0c", "\r")
#: Words of 64 bits of a filter of keys: 4 MB.
WORDS = 1 << 19
#: Stands for a missing doc_id: such rows are one document, the last.
_LAST = (1 << 63) - 1


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def document(docs: DataFrame) -> Column:
    """What orders and tells apart documents: doc_id, or a hash of it where it is no whole number."""
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.lit(_LAST))


def raw_lines(docs: DataFrame) -> DataFrame:
    """doc, row_key, line_no (from 0) and line (as it stands) of every line that has a token."""
    one = docs.select(document(docs).alias("doc"), row_key().alias("row_key"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return one.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def masked_lines(raw: DataFrame) -> DataFrame:
    """`raw` with its lines masked, one space between tokens, and form (60 bits of the line's md5). What most lines lack is looked for before it is replaced."""
    line = F.col("line")
    one = raw.withColumn("line", F.when(line.rlike("[0-9@:]") & line.rlike("[0-9@]|://"), F.regexp_replace(line, _VARIABLE, "<*>")).otherwise(line))
    odd = functools.reduce(operator.or_, [line.contains(x) for x in _ODD_SPACE])
    one = one.withColumn("line", F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)))
    return one.withColumn("form", F.conv(F.substring(F.md5("line"), 1, 15), 16, 10).cast("long"))


def lines(docs: DataFrame) -> DataFrame:
    """doc, row_key, line_no (from 0), line (masked, one space between tokens) and form of every line that has a token."""
    return masked_lines(raw_lines(docs))


def nodes(tokens: str) -> Column:
    """From the column `tokens`, an array that is made once: the keys of the line's nodes, for lines in which a token may differ."""
    t = F.col(tokens)
    n = F.size(t)
    bound = [F.floor(n * i / PARTS).cast("int") for i in range(PARTS + 1)]
    keys = [F.xxhash64(n, t[0], F.lit(i), F.slice(t, bound[i] + 1, bound[i + 1] - bound[i])) for i in range(PARTS)]
    return F.when(10 * (n - 1) >= LEAST * n, F.array(*keys)).otherwise(F.array().cast("array<bigint>"))


def joins(a: str, b: str) -> Column:
    """Whether two lines of one length are alike enough."""
    x, y = F.split(a, " ", -1), F.split(b, " ", -1)
    return 10 * F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same)) >= LEAST * F.size(x)


def among(keys: DataFrame):
    """A test of whether a long, spread like a hash, may be in the one column of `keys`, false only for those that are not: one bit a key, in WORDS 64-bit words, whatever the number of keys."""
    word = lambda key: F.pmod(F.shiftright(key, 6), F.lit(WORDS))
    bit = lambda key: F.pmod(key, F.lit(64)).cast("int")
    key = F.col(keys.columns[0])
    set_bits = keys.groupBy(word(key).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(key))).alias("bits"))
    every = keys.sparkSession.range(WORDS).join(set_bits, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    one = stored(every.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("w")).select(F.col("w.bits").alias("w")), "line_filter")  # WORDS numbers
    return lambda c: F.call_function("shiftright", F.get(one.scalar(), word(c).cast("int")), bit(c)).bitwiseAND(F.lit(1)) == 1


def recurring_forms(docs: DataFrame, every: DataFrame) -> DataFrame:
    """form, rows, low, high of each form in a template that recurs: the least and greatest of the first documents of its templates.

    every: doc, line_no, form and nodes of the lines of `docs`. Their texts are not in it; those to be compared are read from `docs` again.
    """
    place = F.struct("doc", "line_no", "form")
    forms = every.groupBy("form").agg(F.min(place).alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("rows"), F.min("nodes").alias("nodes"))
    forms = stored(forms, "line_forms")
    at_node = forms.select("form", "first", "last", F.explode("nodes").alias("node"))
    tops = stored(at_node.groupBy("node").agg(F.min("first").alias("top"), F.count(F.lit(1)).alias("forms")).filter("forms > 1"), "line_nodes")
    shared = among(tops.select("node"))  # only forms at nodes with others are moved, and few more
    pairs = lookup(at_node.filter(shared(F.col("node"))), tops, "node", "forms", at_node.count()).filter(F.col("top").isNotNull() & (F.col("top.form") != F.col("form")))
    pairs = stored(pairs.select("form", "first", "last", "top").distinct(), "line_pairs")
    # of the lines only those that are to be compared, and few others, are moved
    own, top = (pairs.select(f"{c}.form", f"{c}.doc", f"{c}.line_no", F.lit(c == "top").alias("top")) for c in ("first", "top"))
    wanted = own.union(top).groupBy("form", "doc", "line_no").agg(F.bool_or(~F.col("top")).alias("member"), F.bool_or("top").alias("head"))
    place = F.xxhash64("doc", "line_no")
    compared = among(wanted.select(place.alias("place")))
    read = masked_lines(raw_lines(docs).filter(compared(place))).select("form", "doc", "line_no", "line").dropDuplicates(["form", "doc", "line_no"])
    texts = stored(read.join(wanted, ["form", "doc", "line_no"]).select("form", "line", "member", "head"), "line_texts")
    total = pairs.count()
    sizes = pairs.groupBy(F.col("top.form").alias("template")).agg(F.count(F.lit(1)).alias("n"))
    heads = texts.filter("head").select(F.col("form").alias("template"), "line").join(sizes, "template")
    weighed = pairs.select("form", "last", F.col("top.form").alias("template")).join(texts.filter("member").select("form", F.col("line").alias("own")), "form")
    joined = stored(lookup(weighed, heads, "template", "n", total).filter(joins("own", "line")).select("form", "last", "template"), "line_joined")

    others = joined.groupBy("template").agg(F.max("last").alias("others"), F.count(F.lit(1)).alias("n"))
    heads = forms.join(others.withColumnRenamed("template", "form"), "form", "left").select("form", "n", F.col("first.doc").alias("doc"), F.greatest("last", F.coalesce("others", "last")).alias("last"))
    templates = stored(heads.filter("doc <> last").select(F.col("form").alias("template"), "doc", F.coalesce("n", F.lit(0)).alias("n")), "line_heads")
    members = lookup(joined.select("form", "template"), templates, "template", "n", total).filter("doc is not null").select("form", "doc")
    firsts = members.union(templates.select("template", "doc")).groupBy("form").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    return forms.select("form", "rows").join(firsts, "form")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """row_key, recurring and dropped (line numbers in order) of each distinct row that has a recurring line."""
    every = lines(docs).withColumn("tokens", F.split("line", " ", -1)).select("doc", "row_key", "line_no", "form", nodes("tokens").alias("nodes"))
    every = stored(every, "line_forms_of_rows")
    recurring = stored(recurring_forms(docs, every), "line_templates")
    rows = every.select("doc", "row_key", "line_no", "form")
    found = lookup(rows, recurring, "form", "rows", rows.count()).filter(F.col("low").isNotNull())
    line_drop = F.when((F.col("low") != F.col("doc")) | (F.col("high") != F.col("doc")), F.col("line_no"))
    per_row = found.groupBy("row_key").agg(F.collect_set("line_no").alias("recurring"), F.collect_set(line_drop).alias("dropped"))
    return per_row.select("row_key", F.array_sort("recurring").alias("recurring"), F.array_sort("dropped").alias("dropped"))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with tokens), n_recurring, n_dropped, dropped_lines (numbers from 0, comma-joined) of each row.

    Null and empty texts have no lines. Rows of one doc_id are one document, and so are rows without one, which come last. Rows equal in
    doc_id and text get the same result, no rows none; other columns play no part.
    """
    n_lines = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*+"))
    rows = docs.select("doc_id", row_key().alias("row_key"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"))
    out = rows.join(dropped_lines(docs), "row_key", "left")
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(f"n_{c}")
    return out.select("doc_id", "n_lines", n("recurring"), n("dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped_lines"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` without the dropped lines; a text all of whose lines go becomes empty. Other columns pass through as they are, whatever their names."""
    kept = docs.columns
    keyed = docs.select(F.struct(*quoted(kept)).alias("row")).withColumn("row_key", F.xxhash64("row.doc_id", "row.text"))
    out = keyed.join(dropped_lines(docs).select("row_key", "dropped"), "row_key", "left").withColumn("all", F.split("row.text", "\n", -1))
    left = F.transform(F.array_except(F.sequence(F.lit(1), F.size("all")), F.transform("dropped", lambda i: i + 1)), lambda i: F.element_at("all", i))
    text = F.when(F.size("dropped") > 0, F.array_join(left, "\n")).otherwise(F.col("row.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in kept])


LINE_SQL = r"""
WITH raw AS (SELECT coalesce(doc_id, 9223372036854775807) AS doc, doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc, doc_id, text, line_no, array_to_string(list_transform(string_split_regex(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+'),
        lambda t: CASE WHEN regexp_matches(t, '[0-9@]|://') THEN '<*>' ELSE t END), ' ') AS line
      FROM raw WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
l AS (SELECT *, ('0x' || substr(md5(line), 1, 15))::BIGINT AS form FROM m),
f AS (SELECT form, any_value(string_split(line, ' ')) AS t, min({'doc': doc, 'line_no': line_no, 'form': form}) AS first, max(doc) AS last FROM l GROUP BY form),
k AS (SELECT f.*, concat_ws('|', len(t), t[1], i, array_to_string(t[(len(t) * i // 3 + 1):(len(t) * (i + 1) // 3)], ' ')) AS node FROM f, range(0, 3) x(i) WHERE 10 * (len(t) - 1) >= 7 * len(t)),
n AS (SELECT node, min(first) AS top FROM k GROUP BY node HAVING count(*) > 1),
p AS (SELECT DISTINCT k.form, k.t, k.last, n.top FROM k JOIN n USING (node) WHERE n.top.form <> k.form),
j AS (SELECT p.form, p.last, p.top, f.form AS template FROM p JOIN f ON f.form = p.top.form WHERE 10 * len(list_filter(list_zip(p.t, f.t), lambda z: z[1] = z[2])) >= 7 * len(p.t)),
s AS (SELECT f.form, f.first.doc AS doc FROM f LEFT JOIN (SELECT template, max(last) AS others FROM j GROUP BY template) o ON o.template = f.form WHERE f.first.doc <> greatest(f.last, coalesce(others, f.last))),
r AS (SELECT form, min(doc) AS low, max(doc) AS high FROM (SELECT form, doc FROM s UNION ALL SELECT j.form, s.doc FROM j JOIN s ON s.form = j.template) a GROUP BY form),
g AS (SELECT l.doc_id, l.text, line_no, low <> doc OR high <> doc AS goes FROM l JOIN r USING (form)),
b AS (SELECT DISTINCT * FROM g),
c AS (SELECT doc_id, text, count(*) AS n_recurring, count(*) FILTER (WHERE goes) AS n_dropped, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (WHERE goes) AS dropped_lines FROM b GROUP BY doc_id, text),
h AS (SELECT doc_id, text, count(DISTINCT line_no) AS n_lines FROM l GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_recurring, 0)::BIGINT AS n_recurring, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       coalesce(dropped_lines, '') AS dropped_lines
FROM documents d LEFT JOIN h ON h.doc_id IS NOT DISTINCT FROM d.doc_id AND h.text = d.text LEFT JOIN c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.text = d.text
"""
