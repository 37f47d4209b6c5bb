"""Word hashes, the Jaccard join and line dedup against brute force."""

import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import gradelake.llm.jaccard as jaccard
import gradelake.llm.words as words
from gradelake.llm import common, line_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
@pytest.mark.parametrize("one", [r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[^\x20\x09-\x0D]"])
def test_word_hashes(monkeypatch, chunk, one):
    monkeypatch.setattr(words, "CHUNK", chunk)
    w, r, seen = words.Words(one), random.Random(chunk), {}
    for _ in range(30):
        texts = [None if r.random() < 0.1 else "".join(r.choice("abAB é\n.9 x~-_ß") for _ in range(r.choice([0, 1, 3, 60]))) for _ in range(9)]
        hashes, bounds = w.of_arrow(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            found = re.findall(one + "+", low(t))
            assert bounds[i + 1] - bounds[i] == len(found)
            for x, h in zip(found, hashes[bounds[i] : bounds[i + 1]].tolist(), strict=True):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(groups[find(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed, n=160):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(40)]
    base = [r.choice(voc) for _ in range(60)]
    rows = []
    for i in range(n):
        k = r.random()
        if k < 0.4:
            b = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                b[r.randrange(60)] = r.choice(voc)
            t = " ".join(b)
        elif k < 0.5:
            t = r.choice(["", None, "a", "a b", "A  b", "a b c d", "  ", "a b c d e", "a b c d e f"])
        else:
            t = " ".join(r.choice(voc) for _ in range(r.choice([5, 8, 30]))) + " " + " ".join(base[: r.choice([0, 20, 50])])
        rows.append((i * 3 % (n + 1) + 1, t))
    return rows


@pytest.mark.parametrize("seed,bounds", [(4, None), (5, (50, 50, 300, 5)), (6, (900, 90, 120, 3))])
def test_jaccard_join_is_exact(spark, monkeypatch, bounds, seed):
    if bounds:
        for name, v in zip(("BLOCK_TOKENS", "RANGE_TOKENS", "GROUP_TOKENS", "ROW_TOKENS"), bounds, strict=True):
            monkeypatch.setattr(jaccard, name, v)
    rows = corpus(seed)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_group_join_finds_every_component():
    r = random.Random(1)
    for _ in range(40):
        base = [sorted(r.sample(range(300), 40)) for _ in range(2)]
        sets = []
        for _ in range(25):
            s = set(r.choice(base))
            for _ in range(r.choice([0, 2, 4, 6])):
                s.discard(r.choice(sorted(s)))
                s.add(r.randrange(300))
            sets.append(sorted(s))
        rows = [(i, len(s), pa.array(s, pa.uint64()).buffers()[1].to_pybytes()[: 8 * len(s)], i) for i, s in enumerate(sets)]
        root = dict(enumerate(range(len(sets)))) | dict(jaccard.join_group(rows))
        up = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(set(sets[i]) & set(sets[j]))
                if 100 * both >= 80 * (80 - both if len(sets[i]) == len(sets[j]) == 40 else len(sets[i]) + len(sets[j]) - both):
                    a, b = up[i], up[j]
                    up = [min(a, b) if x in (a, b) else x for x in up]
        assert [root[i] for i in range(len(sets))] == up


def test_blocks_of_the_same_texts_in_another_order(spark):
    texts = ["one two three four five", " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40)), "six seven eight nine ten"]
    rows = list(enumerate(texts + texts[::-1]))
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    assert docs.rdd.glom().map(len).collect() == [4, 4]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: min(i, 7 - i) for i in range(8)}
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == [0, 1, 2, 3]


def test_pack_round_trip():
    import numpy as np

    tokens, counts, sets = np.array([0, 5, 1 << 40, (1 << 56) - 1], np.uint64), np.array([2, 1, 32768, 1]), np.array([1, 2, 65535, 0])
    got = jaccard.unpack(jaccard.pack(tokens, counts, sets))
    assert [x.tolist() for x in got] == [tokens.tolist(), counts.tolist(), sets.tolist()]
    assert [len(x) for x in jaccard.unpack(jaccard.pack(tokens[:0], counts[:0], sets[:0]))] == [0, 0, 0]


def test_ranges_grow_where_rows_would_be_small():
    assert [jaccard.n_ranges_for(n) for n in (0, 1 << 18, 1 << 30, 1 << 34, 1 << 40)] == [1, 1, 1 << 12, 1 << 14, 1 << 18]


def test_shingles_in_very_many_sets(spark, monkeypatch):
    common_words = " ".join(f"c{i}" for i in range(12))
    rows = [(i, f"{common_words} " + " ".join(f"u{i}x{j}" for j in range(8 if i % 3 else 1))) for i in range(90)]
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 300)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_one_of_each_decides_rows_and_not_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a + " x"), (2, b), (3, b + " y"), (4, b), (None, a), (None, a), (5, " "), (5, " ")] + [(6, "same row here")] * 3
    docs = spark.createDataFrame(rows, "`doc_id` long, `text` string").withColumns({"a.b": F.lit(1), "row_key": F.lit("k"), "held": F.lit(2)})
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("1", a), ("2", b), ("None", a), ("None", a), ("5", " "), ("5", " "), ("6", "same row here")])


def test_bloom_filter_holds_what_it_was_given(spark):
    held = common.bloom_filter(spark.range(2000).select(F.col("id").alias("a.b")))
    got = spark.range(40000).filter(held(F.col("id"))).agg(F.count_if(F.col("id") < 2000), F.count(F.lit(1))).first()
    assert got[0] == 2000 and got[1] < 2020
    assert spark.range(9).filter(common.bloom_filter(spark.range(0))(F.col("id"))).count() == 0


def test_one_of_each_keeps_rows_without_partners(spark):
    long = " ".join(f"x{i}" for i in range(3000))
    rows = [(5, long, "en", "a", 1), (3, long + " y", "en", None, 2), (9, None, None, "b", None), (9, None, None, "b", None), (None, "", "en", "b", 0), (7, "one two", "en", "a", 1), (7, "one two", "en", "a", 1)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted([("3", long + " y"), ("9", ""), ("9", ""), ("None", ""), ("7", "one two")])
    assert jaccard.one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_long_way_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(50)}


def test_lookup_with_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(1, i) for i in range(5000)] + [(2, 1), (3, 2), (None, 7)], "k long, v long")
    table = spark.createDataFrame([(1, "hot", 5000), (2, "cold", 1)], "k long, name string, n long")
    got = common.lookup(rows, table, "k", "n", 5003).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in got} == {"hot": 5000, "cold": 1, None: 2}


LINES = [
    (1, "Posted on 3 May by user1 in the news section today\nunique first line of the first\n"),
    (2, "Posted on 4 May by user2 in the news section today\nAll rights reserved."),
    (3, "  All   rights reserved.  \n\nquite another thing here"),
    (4, "one two three four five six seven eight nine X Y Z"),
    (5, "one two three four five six seven eight nine A B C"),
    (6, None),
    (7, ""),
    (8, "word"),
]


def test_line_templates(spark):
    rows = [(*r, "e", 1) for r in LINES] + [(8, "word", "e", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string, n_lines int")
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.line_table(docs).collect()}
    assert got[1] == (2, 1, 0, "") and got[2] == (2, 2, 1, "0") and got[3] == (2, 1, 1, "0")
    assert got[4] == (1, 1, 0, "") and got[5] == (1, 1, 1, "0")
    assert got[6] == got[7] == (0, 0, 0, "") and got[8] == (1, 0, 0, "")
    text = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert text[2] == "All rights reserved." and text[3] == "\nquite another thing here" and text[5] == "" and text[6] is None
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.line_table(docs.limit(0)).count() == 0


def test_templates_merge_lines_with_fields_anywhere(spark):
    texts = {
        1: "user alice logged in from paris today\nPosted by Alice in News", 2: "user bobby logged in from berlin today\nPosted by Bob in News", 3: "user carol logged out of paris at noon",
        4: "report filed by alice from host bravo at noon today", 5: "report filed by bob from host tango at noon today", 6: "The cat sat", 7: "The cat ran",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_recurring, r.dropped_lines) for r in line_dedup.line_table(docs).collect()}
    assert got == {1: (2, ""), 2: (2, "0,1"), 3: (0, ""), 4: (1, ""), 5: (1, "0"), 6: (0, ""), 7: (0, "")}


def brute_lines(rows):
    """The tree by its definition, over all pairs."""
    space = " \t\n\x0b\x0c\r"
    last = (1 << 63) - 1
    every = []
    for row, (d, t) in enumerate(rows):
        for k, line in enumerate((t if t is not None else "").split("\n")):
            tokens = [("<*>" if re.search("[0-9@]|://", x) else x) for x in re.split(r"[\x20\x09-\x0D]+", line.strip(space)) if x]
            if tokens:
                every.append((last if d is None else d, k, " ".join(tokens), row))
    code = lambda line: int(hashlib.md5(line.encode()).hexdigest()[:15], 16)
    forms = {}
    for d, k, line, _ in every:
        first, end = forms.get(line, ((d, k, code(line)), d))
        forms[line] = min(first, (d, k, code(line))), max(end, d)
    nodes = {}
    for line in forms:
        t = line.split(" ")
        if 10 * (len(t) - 1) >= 7 * len(t):
            for i in range(3):
                nodes.setdefault((len(t), t[0], i, tuple(t[len(t) * i // 3 : len(t) * (i + 1) // 3])), []).append(line)
    members = {}
    for own in nodes.values():
        top = min(own, key=lambda x: forms[x][0])
        for line in own:
            x, y = line.split(" "), top.split(" ")
            if line != top and 10 * sum(a == b for a, b in zip(x, y, strict=True)) >= 7 * len(x):
                members.setdefault(top, set()).add(line)
    firsts = {}
    for line, (first, end) in forms.items():
        if first[0] != max([end, *(forms[m][1] for m in members.get(line, ()))]):
            for m in {line, *members.get(line, ())}:
                firsts.setdefault(m, set()).add(first[0])
    out = []
    for row, (d, _) in enumerate(rows):
        own = sorted((k, x, line) for x, k, line, r in every if r == row)
        drop = [k for k, x, line in own if firsts.get(line, {x}) != {x}]
        out.append((d, len(own), sum(line in firsts for _, _, line in own), len(drop), ",".join(map(str, drop))))
    return sorted(out, key=str)


def test_line_templates_by_definition_and_in_sql(spark):
    r = random.Random(11)
    words = ["a", "b", "c", "x1", "d@e", "f:g", "h://i", ":", "j"]
    rows = []
    for i in range(70):
        text = "\n".join(r.choice(["", " ", "  "]) + r.choice([" ", "\t"]).join(r.choice(words[: r.choice([2, 9])]) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 7, 10, 13]))) for _ in range(r.choice([1, 3, 9])))
        rows.append((r.choice([i, i, i, 5, None]), r.choice([text] * 9 + ["", None])))
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    assert sorted(map(tuple, line_dedup.line_table(docs).collect()), key=str) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(line_dedup.LINE_SQL).fetchall(), key=str) == want


def test_lines_with_odd_white_space_and_marks_by_definition(spark):
    r = random.Random(23)
    spaces = [" ", "  ", "\t", "\x0b", "\x0c", "\r", " \r", "\t\t"]
    words = ["a", "b", "c", ":", "a:b", ":/", "://", "b://c", "::", "@", "c7", "7", "\u0664", "\xa0", "\u3000", "a\x85", "\U0001f600", "\u00e9"]
    line = lambda: r.choice(["", *spaces]) + "".join(r.choice(words[: r.choice([3, 18])]) + r.choice(spaces[: r.choice([1, 1, 8])]) for _ in range(r.choice([0, 1, 4, 5, 8])))
    rows = [(i // 2, "\n".join(line() for _ in range(r.choice([1, 4, 9])))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.line_table(docs).collect()), key=str) == brute_lines(rows)


def test_of_lines_only_those_to_be_compared_are_kept_or_moved(spark, monkeypatch):
    r = random.Random(29)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    other = [" ".join(word() for _ in range(12)) for _ in range(600)]
    alike = "report filed by {} from the old north gate at noon today"
    rows = [(i, "\n".join([*other[3 * i : 3 * i + 3], *([alike.format(word())] if i < 5 else [])])) for i in range(200)]
    texts, moved, stored, lookup = [], [], line_dedup.stored, line_dedup.lookup

    def seen(df, name):
        out = stored(df, name)
        if "line" in df.columns:
            texts.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", seen)
    monkeypatch.setattr(line_dedup, "lookup", lambda rows, table, key, *a: (moved.append(rows.count()) if key == "node" else None) or lookup(rows, table, key, *a))
    got = sorted(map(tuple, line_dedup.line_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(i, 3 + (i < 5), int(i < 5), int(0 < i < 5), "3" if 0 < i < 5 else "") for i in range(200)]
    # the five lines stand at nodes of their own and at two common ones; the 600 others meet no line
    assert texts == [5] and len(moved) == 1 and 10 <= moved[0] < 30


def test_line_dedup_keeps_one_copy_of_every_line(spark):
    r = random.Random(3)
    lines = [" ".join(f"{r.choice('abcdefgh')}{r.randrange(9)}x" for _ in range(r.choice([2, 9, 30]))) for _ in range(25)]
    docs = spark.createDataFrame([(i, "\n".join(r.choices(lines, k=4))) for i in range(40)], "doc_id long, text string")
    kept = {line for x in line_dedup.dedup_lines(docs).collect() for line in x.text.split("\n") if line}
    masked = lambda x: re.sub(r"\S*[0-9]\S*", "<*>", x)
    assert {masked(x) for x in kept} == {masked(x) for d in docs.collect() for x in d.text.split("\n")}
    assert docs.filter(F.col("text").isNull()).count() == 0


def test_batches_are_bounded_but_never_raised(spark):
    key = common._BATCH
    old = spark.conf.get(key)
    for given, want in (("64m", str(common.BATCH_BYTES)), ("1m", "1m"), ("67108864b", str(common.BATCH_BYTES))):
        spark.conf.set(key, given)
        common.small_batches(spark)
        assert spark.conf.get(key).rstrip("b") == want.rstrip("b")
    spark.conf.set(key, old)
