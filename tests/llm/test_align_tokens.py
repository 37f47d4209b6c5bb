"""Alignment of two tokenizers against whole texts, one by one."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gradelake.llm import align_tokens
from gradelake.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def whole(texts):
    """Each text encoded whole; byte ends compared directly; links counted one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = align_tokens.byte_letters()
    names = {i: t for t, i in a.get_vocab().items()}
    docs, counts = [], Counter()
    for t in texts:
        groups = []
        if t:
            x = a.encode(" " + t, add_special_tokens=False).ids
            z = b.encode(t)
            bx = [bytes(letters[c] for c in names[i]) for i in x]
            bz = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in z)]
            if b"".join(bx) == b"".join(bz) == (" " + t).encode():
                ends = set(np.cumsum([len(v) for v in bx]).tolist()) & set(np.cumsum([len(v) for v in bz]).tolist())
                at = [0, 0]
                cur = ([], [])
                parts = {}
                for k, (ids, data) in enumerate(((x, bx), (z, bz))):
                    pos, g = 0, 0
                    for i, v in zip(ids, data, strict=True):
                        pos += len(v)
                        parts.setdefault(g, ([], []))[k].append(i)
                        g += pos in ends
                groups = [parts[g] for g in sorted(parts)]
        docs.append(groups)
        counts.update({(p, q) for x, z in groups for p in x for q in z})
    best = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for groups in docs:
        links = [(p, q) for x, z in groups for p in x for q in z]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, z)) for x, z in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(z) for _, z in groups), len(groups), len(links), sum(counts[v] == best[v[0]] for v in links), sum(counts[v] for v in links), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out, counts


def texts():
    r = random.Random(3)
    odd = [None, "", " ", "  two  spaces ", "a▁b", "x ▁ y", "<|endoftext|> and <s>x</s>", "日本語です 漢字", "tab\tnew\n\nline \r\n end ", "\x00\x01 \x7f", "é fi ﬁ", "🎉🎉 emoji🎉", "a" * 5000, "don't I'll we've", " lead", "1234 5678.90", " nbsp　wide", "ß ² ½ x²y", "word " * 3000]
    words = ["the", "The", "größer", "über", "naïve", "running", "12", "a-b", "(x)", "data,", "\n", "Zürich.", "été", "queue"]
    return odd + [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(200)] + ["the same text"] * 30


def test_table_by_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(align_tokens, "SEGMENT", 40)
    monkeypatch.setattr(align_tokens, "PART_ROWS", 10)
    monkeypatch.setattr(align_tokens, "FAN", 3)
    rows = list(enumerate(texts())) + [(None, "the same text"), (0, "again 0")]
    want, counts = whole([t for _, t in rows])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "'x' as keys").repartition(3)
        got = align_tokens.align_table(docs, A, B).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((i, *w)) for (i, _), w in zip(rows, want, strict=True))
        blocks = align_tokens.stored(align_tokens.blocks_of(docs, A, B), "test_blocks")
        pairs = align_tokens.pair_rows(align_tokens.pair_counts(blocks)[1]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["first"], r["second"]): r.docs for r in pairs} == counts


def test_empty_and_token_free_tables(spark):
    assert align_tokens.align_table(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    got = align_tokens.align_table(spark.createDataFrame([(1, None), (1, None), (2, "")], "doc_id long, text string"), A, B).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, "")] * 2 + [(2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40000])
def test_hash_is_minimal_perfect_and_verified(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 60, n))
    f = align_tokens.PerfectHash.of(keys)
    for g in (f, align_tokens.PerfectHash.unpacked(f.packed())):
        assert sorted(g.index(keys).tolist()) == list(range(len(keys)))
    if n:
        slots = np.empty(len(keys), np.int64)
        slots[f.index(keys)] = keys
        assert (align_tokens.found(f, slots, keys) == f.index(keys)).all()
        with pytest.raises(ValueError, match="doesn't hold"):
            align_tokens.found(f, slots, keys + (1 << 60))


def test_pairs_of_slices_are_those_of_the_whole(monkeypatch):
    own = align_tokens.Aligned(align_tokens.encoders(A, B), align_tokens.cut_up(texts()))
    monkeypatch.setattr(align_tokens, "PAIR_ROWS", 1 << 40)
    want = dict(zip(*map(np.ndarray.tolist, own.pairs()), strict=True))
    counts = whole(texts())[1]
    assert {divmod(k, align_tokens.BASE): n for k, n in want.items()} == counts
    for rows in (1, 50, 3000):
        monkeypatch.setattr(align_tokens, "PAIR_ROWS", rows)
        assert dict(zip(*map(np.ndarray.tolist, own.pairs()), strict=True)) == want


def test_groups_are_written(spark):
    docs = spark.createDataFrame([(1, "the same text")], "doc_id long, text string")
    got, digest = align_tokens.aligned(docs, A, B).first(), align_tokens.align_table(docs, A, B).first()
    assert got.groups.count("|") == got.n_groups > 0 and digest.groups_sha256 == hashlib.sha256(got.groups.encode()).hexdigest()


def test_long_groups_link_all_pairs():
    """Groups of very many links are counted by distinct ids."""
    own = object.__new__(align_tokens.Aligned)
    own.a, own.b = np.array([1, *range(70), *range(70), 2]), np.array([9, *[5, 6] * 40, 9])
    own.n_a, own.n_b, own.owner = np.array([1, 140, 1]), np.array([1, 80, 1]), np.array([0, 1, 1])
    own.link()
    got = Counter()
    for p, k, n in zip(own.piece.tolist(), own.keys.tolist(), own.times.tolist(), strict=True):
        got[p, *divmod(k, align_tokens.BASE)] += n
    want = Counter((1, p, q) for p in [*range(70)] * 2 for q in [5, 6] * 40)
    want.update([(0, 1, 9), (1, 2, 9)])
    assert got == want


def test_pieces_that_do_not_come_back_spoil_only_their_texts():
    own = align_tokens.Aligned(align_tokens.encoders(A, B), align_tokens.cut_up(["some words here", "some words a▁b", "words here"]))
    assert [bool(c) for c in own.codes] == [True, False, True] and list(own.written())[1] == "" and own.totals(own.sizes)[:, 1].tolist() == [0] * 4
