"""Two tokenizers' tokens of the same texts laid side by side, and how many documents link each pair of ids.

Where tokens of both end at one byte, the text is cut into groups; the tokens of a group are linked with one another. Texts are cut at safe boundaries into short pieces,
and each distinct piece of a batch is encoded and aligned once, many of them as one text.

First pass: documents are taken in blocks, each of which gives its distinct pairs with its own document counts. Distinct pairs are dealt by
hash into segments of about SEGMENT pairs, and each segment gets a minimal perfect hash function (levels of bit arrays: a key's place is the rank of its bit
in the first level where it stood alone). Blocks' counts are added up in dense vectors by that hash, parts of blocks side by side, and the vectors are summed as a tree.
Then blocks look their pairs up, in vectors whose slots hold the key itself and so verify it. Second pass: each block's documents are aligned again beside the
block's counts. The texts themselves are read once: a block is kept as the tokens and byte lengths of its distinct pieces and the pieces of each text by number.
Nothing whole is sent to tasks or to the driver but the best count of each id of the first vocabulary.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import stored
from gradelake.llm.tokens import balanced, pieces
from gradelake.llm.words import mix

#: Distinct pairs of a segment, about; blocks' counts that one task adds up or looks up at once, about; vectors that one task sums.
SEGMENT, PART_ROWS, FAN = 1 << 15, 1 << 20, 16
#: Characters of a block's texts, and of its distinct pieces, at most (or one Arrow batch).
BLOCK_CHARS, DISTINCT_CHARS = 6 << 20, 2 << 20
#: Links of texts that are counted at once, about.
PAIR_ROWS = 1 << 19
#: Distinct pieces that are encoded as one text.
CHUNK = 2048
#: A pair of ids is first * BASE + second.
BASE = 1 << 31


def byte_letters() -> dict[str, int]:
    """The byte that each letter of byte-level vocabularies stands for: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """ids of texts by a byte-level .json (first) and a sentencepiece .model (second), and the bytes each id stands for."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in t)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:-1], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in v]) for v in (self.a_bytes, self.b_bytes))
        # a piece may begin wherever a space comes after another character only if no entry has a space after another one
        if any("▁" in t.lstrip("▁") for t in names):
            raise ValueError("the second vocabulary has entries that reach over a space")

    def encode(self, alone: list[str], together: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids, bad) of pieces in order, those of `together` many as one text. bad: the numbers of pieces that a tokenizer doesn't give back byte by byte; they have no ids.

        Every piece begins with a space; the second tokenizer adds the first space itself.
        """
        a: list[list[int]] = []
        b: list[list[int]] = []
        bad: list[int] = []
        chunks = [(i, [p]) for i, p in enumerate(alone)]
        chunks += [(len(alone) + at, together[at : at + CHUNK]) for at in range(0, len(together), CHUNK)]
        todo = iter(chunks)
        for batch in balanced(["".join(c) for _, c in chunks]):
            first = self.a.encode_batch_fast(batch, add_special_tokens=False)
            second = self.b.encode([t[1:] for t in batch], num_threads=1)
            for text, x, z in zip(batch, (e.ids for e in first), second, strict=True):
                at, c = next(todo)
                if not self.whole(text, x, z):
                    x, z, off = self.one_by_one(c)
                    bad += [at + i for i in off]
                a.append(x)
                b.append(z)
        none = np.empty(0, np.int64)
        return *(np.concatenate([np.array(x, np.int64) for x in v]) if v else none for v in (a, b)), np.array(bad, np.int64)

    def whole(self, text: str, x: list[int], z: list[int]) -> bool:
        data = text.encode()
        return b"".join(map(self.a_bytes.__getitem__, x)) == data and b"".join(map(self.b_bytes.__getitem__, z)) == data

    def one_by_one(self, c: list[str]) -> tuple[list[int], list[int], list[int]]:
        """The ids of the pieces of a text that didn't come back, and the places of those that are to blame."""
        a, b, off = [], [], []
        for i, t in enumerate(c):
            x, z = self.a.encode(t, add_special_tokens=False).ids, self.b.encode(t[1:])
            if self.whole(t, x, z):
                a += x
                b += z
            else:
                off.append(i)
        return a, b, off


#: Pieces of this form may stand side by side in one text and are encoded as they are alone.
_PLAIN = re.compile(r" [^\W\d_](?:.*\S)?\Z", re.DOTALL)


def arranged(cut: list[list[str]]) -> tuple[list[str], list[str]]:
    """The distinct pieces of texts in order: those that may not stand beside others (first or last ones of a text), and the rest."""
    odd = dict.fromkeys(p for c in cut if c for p in (c[0], c[-1]) if not _PLAIN.match(p))
    plain = list(dict.fromkeys(itertools.chain.from_iterable(cut)))
    return list(odd), [p for p in plain if p not in odd] if odd else plain


def cut_up(texts: list[str | None]) -> list[list[str]]:
    """Each text, a space before it, in pieces; none of a null or empty one."""
    return [pieces(" " + t) if t else [] for t in texts]


def packed(v: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in the narrowest type that holds them, compressed."""
    kind = np.min_scalar_type(int(v.max(initial=0)))
    data = v.astype(kind).tobytes()
    return kind.char.encode() + len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[1:9], "little")
    return np.frombuffer(pa.decompress(data[9:], size, "zstd", asbytes=True), np.dtype(data[:1].decode())).astype(np.int64)


class Aligned:
    """The distinct pieces of texts, given as their pieces, aligned at once.

    per_text, placed: how many pieces each text has and their numbers, text by text (none of a text with a piece that can't be aligned). sizes: tokens, tokens, groups and
    links of each piece. piece, keys, times: a row for each pair of ids that a group of a piece links.
    """

    def __init__(self, encoders: Encoders, cut: list[list[str]]):
        alone, together = arranged(cut)
        a, b, bad = encoders.encode(alone, together)
        made = alone + together
        if len(bad):
            off = set(bad.tolist())
            made = [p for i, p in enumerate(made) if i not in off]
        number = {p: i for i, p in enumerate(made)}
        codes = [list(map(number.get, c)) for c in cut]
        codes = [[] if None in c else c for c in codes]
        per_text = np.array([len(c) for c in codes], np.int64)
        widths = np.array([len(p) if p.isascii() else len(p.encode()) for p in made], np.int64)
        self.build(encoders, a, b, widths, per_text, np.fromiter(itertools.chain.from_iterable(codes), np.int64, per_text.sum()))

    @classmethod
    def kept(cls, encoders: Encoders, *parts: bytes) -> Aligned:
        """The same again from what `parts` gave."""
        own = object.__new__(cls)
        own.build(encoders, *map(unpacked, parts))
        return own

    def parts(self) -> list[bytes]:
        """What the alignment is made of, by the names of PARTS."""
        return [packed(v) for v in (self.a, self.b, self.widths, self.per_text, self.placed)]

    def build(self, encoders: Encoders, a: np.ndarray, b: np.ndarray, widths: np.ndarray, per_text: np.ndarray, placed: np.ndarray) -> None:
        self.a, self.b, self.widths, self.per_text, self.placed = a, b, widths, per_text, placed
        ends = np.cumsum(widths)
        at_a, at_b = np.cumsum(encoders.a_sizes[a]), np.cumsum(encoders.b_sizes[b])
        cuts = np.intersect1d(at_a, at_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, at_a), np.searchsorted(cuts, at_b)
        self.owner = np.searchsorted(ends, cuts)
        self.n_a, self.n_b = (np.bincount(g, minlength=len(cuts)) for g in (self.group_a, self.group_b))
        self.n_pieces = len(widths)
        self.sizes = np.stack([np.bincount(self.owner, w, self.n_pieces).astype(np.int64) for w in (self.n_a, self.n_b, np.ones(len(cuts)), self.n_a * self.n_b)])
        self.link()

    def link(self) -> None:
        from_a, from_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        links = self.n_a * self.n_b
        few = np.flatnonzero(links <= 4096)
        k = links[few]
        g = np.repeat(few, k)
        r = np.arange(len(g)) - np.repeat(np.cumsum(k) - k, k)
        keys = [self.a[from_a[g] + r // self.n_b[g]] * BASE + self.b[from_b[g] + r % self.n_b[g]]]
        piece, times = [self.owner[g]], [np.ones(len(g), np.int64)]
        for i in np.flatnonzero(links > 4096):  # by distinct ids at once
            (x, nx), (z, nz) = (np.unique(v[f : f + n], return_counts=True) for v, f, n in ((self.a, from_a[i], self.n_a[i]), (self.b, from_b[i], self.n_b[i])))
            keys.append((x[:, None] * BASE + z).ravel())
            times.append(np.outer(nx, nz).ravel())
            piece.append(np.full(len(keys[-1]), self.owner[i]))
        self.keys, self.times, self.piece = (np.concatenate(v) for v in (keys, times, piece))

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, piece) of every occurrence."""
        return np.repeat(np.arange(len(self.per_text)), self.per_text), self.placed

    @property
    def codes(self) -> list[list[int]]:
        """The pieces of each text by number."""
        flat, ends = self.placed.tolist(), np.cumsum(self.per_text).tolist()
        return [flat[a:z] for a, z in zip([0, *ends], ends)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, texts that link each) of the distinct pairs that the texts link."""
        doc, piece = self.flat()
        doc, piece = np.divmod(pd.unique(doc * self.n_pieces + piece), max(1, self.n_pieces))
        place, keys = pd.factorize(self.keys)
        order = np.argsort(self.piece, kind="stable")
        k = np.bincount(self.piece, minlength=self.n_pieces)
        starts = (np.cumsum(k) - k)[piece]
        links = k[piece]
        n = np.zeros(len(keys), np.int64)
        # whole texts at a time, of about PAIR_ROWS links
        part = np.cumsum(np.bincount(doc, links, len(self.per_text))) // PAIR_ROWS
        ends = np.searchsorted(doc, np.append(np.flatnonzero(np.diff(part)) + 1, len(self.per_text)))
        for a, z in zip(np.append(0, ends[:-1]), ends, strict=True):
            m = links[a:z]
            rows = np.repeat(np.arange(a, z), m)
            at = order[np.arange(len(rows)) - np.repeat(np.cumsum(m) - m, m) + starts[rows]]
            both = pd.unique(doc[rows] * len(keys) + place[at])
            n += np.bincount(both % max(1, len(keys)), minlength=len(keys))
        return keys[n > 0], n[n > 0]

    def totals(self, by_piece: np.ndarray) -> np.ndarray:
        """Numbers of pieces (rows of values) summed over each text."""
        doc, piece = self.flat()
        return np.stack([np.bincount(doc, v[piece], len(self.per_text)).astype(np.int64) for v in by_piece])

    def by_piece(self, values: np.ndarray) -> np.ndarray:
        """Numbers of links' pairs, times how often they are linked, summed over each piece."""
        return np.bincount(self.piece, values * self.times, self.n_pieces)

    def written(self) -> Iterator[str]:
        """The groups of each text."""
        if not len(self.a):
            return iter([""] * len(self.per_text))
        last = lambda g: np.append(g[1:] != g[:-1], True)
        out = np.empty(len(self.a) + len(self.b), object)
        ends_a, ends_b = last(self.group_a), last(self.group_b)
        ends_piece = ends_b & np.append(self.owner[self.group_b[1:]] != self.owner[self.group_b[:-1]], True)
        upto_a, upto_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        out[np.arange(len(self.a)) + (upto_b - self.n_b)[self.group_a]] = _numbers(self.a, [ends_a], ",|")
        out[np.arange(len(self.b)) + upto_a[self.group_b]] = _numbers(self.b, [ends_b, ends_piece], ",;\n")
        lines = "".join(out.tolist()).split("\n")
        return (";".join([lines[i] for i in c]) for c in self.codes)


def _numbers(ids: np.ndarray, marks: list[np.ndarray], ends: str) -> np.ndarray:
    """Each id in decimal with one of `ends` after it: the first, or that of the last of `marks` that holds."""
    distinct, place = np.unique(ids, return_inverse=True)
    table = np.array([[f"{i}{e}" for e in ends] for i in distinct.tolist()], object)
    return table[place, sum(m.astype(np.int64) for m in marks)]


@functools.cache
def encoders(first: str, second: str) -> Encoders:
    """One for each worker process."""
    return Encoders(first, second)


class PerfectHash:
    """A minimal perfect hash function of distinct 64-bit keys: (bits of all levels, where levels begin)."""

    def __init__(self, bits: np.ndarray, starts: np.ndarray):
        self.bits, self.starts = bits, starts
        self.before = np.concatenate([[0], np.cumsum(bits)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        bits, starts, left = [], [0], keys
        while len(left):
            at = cls.places(left, len(starts), 2 * len(left) + 1)
            alone = np.bincount(at, minlength=2 * len(left) + 1) == 1
            bits.append(alone)
            starts.append(starts[-1] + len(alone))
            left = left[~alone[at]]
        return cls(np.concatenate(bits) if bits else np.empty(0, bool), np.array(starts))

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key from 0; any place, or -1, for others."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for level in range(1, len(self.starts)):
            size = self.starts[level] - self.starts[level - 1]
            at = self.starts[level - 1] + self.places(keys[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.before[at[hit]]
            open_ = open_[~hit]
        return out

    def packed(self) -> bytes:
        return np.concatenate([[len(self.starts)], self.starts]).astype(np.int64).tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        starts = np.frombuffer(data, np.int64, n, 8)
        return cls(np.unpackbits(np.frombuffer(data, np.uint8, -1, 8 * (n + 1)))[: starts[-1]].astype(bool), starts)


def found(f: PerfectHash, slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of `keys`, each verified by the key in its slot."""
    at = f.index(keys)
    if len(keys) and (at.min() < 0 or (slots[at] != keys).any()):
        raise ValueError("a pair that the hash function doesn't hold")
    return at


def hashed(pairs: DataFrame) -> DataFrame:
    """seg, hash (the function's bytes) and slots (keys in its order) of each segment of the distinct pairs (seg, key)."""

    def build(t: pa.Table) -> pa.Table:
        keys = t.column("key").to_numpy()
        f = PerfectHash.of(keys)
        slots = np.empty(len(keys), np.int64)
        slots[f.index(keys)] = keys
        found(f, slots, keys)
        return pa.table({"seg": t.column("seg").slice(0, 1), "hash": pa.array([f.packed()], pa.binary()), "slots": pa.array([slots.tobytes()], pa.binary())})

    return pairs.groupBy("seg").applyInArrow(build, "seg long, hash binary, slots binary")


def in_parts(segments: DataFrame, n_parts: int) -> DataFrame:
    """A row of each segment for each part of the blocks."""
    return segments.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))))


def counted(blocks: DataFrame, segments: DataFrame, n_parts: int) -> DataFrame:
    """`segments` with counts: the dense vector of document counts of its pairs, from the blocks' own (seg, part, key, docs)."""

    def add(key, left: pa.Table, right: pa.Table) -> pa.Table:
        data = right.slice(0, 1).to_pylist()[0]
        slots = np.frombuffer(data["slots"], np.int64)
        at = found(PerfectHash.unpacked(data["hash"]), slots, left.column("key").to_numpy())
        v = np.bincount(at, left.column("docs").to_numpy(), len(slots)).astype(np.int64)
        return pa.table({"seg": [data["seg"]], "part": [data["part"]], "counts": pa.array([v.tobytes()], pa.binary())})

    def unite(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("counts").combine_chunks())
        return pa.table({"seg": t.column("seg").slice(0, 1), "part": t.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    shape = "seg long, part long, counts binary"
    sums = blocks.groupBy("seg", "part").cogroup(in_parts(segments, n_parts).groupBy("seg", "part")).applyInArrow(add, shape)
    while n_parts > 1:
        n_parts = -(-n_parts // FAN)
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("seg", "part").applyInArrow(unite, shape)
    return segments.join(sums.select("seg", "counts"), "seg")


def looked_up(blocks: DataFrame, vectors: DataFrame, n_parts: int) -> DataFrame:
    """block, keys, counts (arrays): what the vectors hold for each block's pairs, in rows by segment."""

    def look(key, left: pa.Table, right: pa.Table) -> pa.Table:
        data = right.slice(0, 1).to_pylist()[0]
        block, keys = left.column("block").to_numpy(), left.column("key").to_numpy()
        at = found(PerfectHash.unpacked(data["hash"]), np.frombuffer(data["slots"], np.int64), keys)
        order = np.argsort(block, kind="stable")
        own, first = np.unique(block[order], return_index=True)
        ends = pa.array(np.append(first, len(order)), pa.int32())
        counts = np.frombuffer(data["counts"], np.int64)[at]
        return pa.table({"block": own, "keys": pa.ListArray.from_arrays(ends, pa.array(keys[order])), "counts": pa.ListArray.from_arrays(ends, pa.array(counts[order]))})

    return blocks.groupBy("seg", "part").cogroup(in_parts(vectors, n_parts).groupBy("seg", "part")).applyInArrow(look, "block long, keys array<long>, counts array<long>")


def pair_rows(vectors: DataFrame) -> DataFrame:
    """first, second, docs: every linked pair of ids and the number of documents that link it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for slots, counts in zip(b.column("slots"), b.column("counts"), strict=True):
                a, z = np.divmod(np.frombuffer(slots.as_buffer(), np.int64), BASE)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z), pa.array(np.frombuffer(counts.as_buffer(), np.int64))], names=["first", "second", "docs"])

    return vectors.select("slots", "counts").mapInArrow(rows, "first long, second long, docs long")


#: What an alignment is made of (`Aligned.parts`).
PARTS = ["a", "b", "widths", "per_text", "placed"]


def blocks_of(docs: DataFrame, first: str, second: str) -> DataFrame:
    """A row for each block of documents: block, doc_id (an array), keys and docs (arrays: its distinct pairs and how many of its documents link each) and PARTS."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        cut: list[list[str]] = []
        distinct: set[str] = set()
        chars = own_chars = 0

        def closed() -> pa.RecordBatch:
            own = Aligned(encoders(first, second), cut)
            row = [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(cut)], pa.int32()), pa.concat_arrays(ids))]
            row += [pa.array([x], pa.list_(pa.int64())) for x in own.pairs()]
            row += [pa.array([x], pa.binary()) for x in own.parts()]
            return pa.RecordBatch.from_arrays(row, names=["block", "doc_id", "keys", "docs", *PARTS])

        for b in batches:
            texts = b.column("text").to_pylist()
            more = cut_up(texts)
            new = set(itertools.chain.from_iterable(more)) - distinct
            size, own_size = sum(len(t or "") for t in texts), sum(map(len, new))
            if cut and (chars + size > BLOCK_CHARS or own_chars + own_size > DISTINCT_CHARS):
                yield closed()
                block, ids, cut, distinct, chars, own_chars = block + 1, [], [], set(), 0, 0
                new = set(itertools.chain.from_iterable(more))
                own_size = sum(map(len, new))
            ids.append(b.column("doc_id").take(pa.array(range(b.num_rows), pa.int64())))  # a copy, so that the batch's texts can go
            cut += more
            distinct |= new
            chars, own_chars = chars + size, own_chars + own_size
        if cut:
            yield closed()

    shape = f"block long, doc_id array<{kind}>, keys array<long>, docs array<long>, {', '.join(f'{c} binary' for c in PARTS)}"
    return docs.select("doc_id", "text").mapInArrow(run, shape)


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(blocks' pairs: seg, part, block, key, docs; vectors: seg, hash, slots, counts; number of parts) of a stored table of `blocks_of`."""
    own = blocks.select("block", F.explode(F.arrays_zip("keys", "docs")).alias("x")).select("block", F.col("x.keys").alias("key"), F.col("x.docs").alias("docs"))
    pairs = stored(own.select("key").distinct(), "align_pairs")
    n_segments = max(1, pairs.count() // SEGMENT)
    n_rows = blocks.agg(F.sum(F.size("keys"))).first()[0] or 0
    n_parts = max(1, -(-n_rows // (n_segments * PART_ROWS)))
    seg = F.pmod(F.xxhash64("key"), F.lit(n_segments)).alias("seg")
    dealt = own.select(seg, F.pmod(F.xxhash64("block"), F.lit(n_parts)).alias("part"), "block", "key", "docs")
    segments = stored(hashed(pairs.select(seg, "key")), "align_hashes")
    return dealt, stored(counted(dealt, segments, n_parts), "align_counts"), n_parts


def aligned(docs: DataFrame, first: str, second: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row of `docs` (doc_id, text).

    first: a byte-level tokenizer file (.json), second: a sentencepiece file (.model), both where every executor can read them. groups is written `a1,a2|b1;a3|b2,b3`,
    with digest it is the lower-case hex SHA-256 of that, empty without tokens. A pair's count is the number of rows that link it, copies included; n_best counts links whose pair has the highest count of its first id, count_sum adds the counts of all links.
    Texts that are null or empty, or that a tokenizer doesn't give back byte by byte (as with U+2581), have zeros and no groups. Other columns are not read.
    """
    blocks = stored(blocks_of(docs, first, second), "align_blocks")
    dealt, vectors, n_parts = pair_counts(blocks)
    top = pair_rows(vectors).groupBy("first").agg(F.max("docs").alias("best")).collect()  # a row for each id of the first vocabulary at most
    best = np.zeros(max((r["first"] for r in top), default=0) + 1, np.int64)
    for r in top:
        best[r["first"]] = r["best"]
    sent = docs.sparkSession.sparkContext.broadcast(best)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def best_of(ids: np.ndarray) -> np.ndarray:
        return np.append(sent.value, 0)[np.minimum(ids, len(sent.value))]

    def again(key, left: pa.Table, right: pa.Table) -> pa.Table:
        own = Aligned.kept(encoders(first, second), *(left.column(c)[0].as_py() for c in PARTS))
        flat = lambda c: right.column(c).combine_chunks().flatten().to_numpy()
        known = flat("keys")
        order = np.argsort(known)
        known, counts = np.append(known[order], -1), np.append(flat("counts")[order], 0)
        at = np.searchsorted(known[:-1], own.keys)
        counts = np.where(known[at] == own.keys, counts[at], 0)  # 0: pairs of pieces that only texts without tokens hold
        linked = [own.by_piece(v) for v in (counts == best_of(own.keys // BASE), counts)]
        sums = own.totals(np.stack([*own.sizes, *linked]))
        ids = left.column("doc_id").combine_chunks().flatten()
        return pa.table({"doc_id": ids, **dict(zip(names, sums, strict=True)), "groups": pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in own.written()] if digest else list(own.written()), pa.string())})

    shape = f"doc_id {kind}, {', '.join(f'{c} long' for c in names)}, groups string"
    own = blocks.select("block", "doc_id", *PARTS)
    return own.groupBy("block").cogroup(looked_up(dealt, vectors, n_parts).groupBy("block")).applyInArrow(again, shape)


def align_table(docs: DataFrame, first: str, second: str) -> DataFrame:
    """`aligned` with groups_sha256 in place of groups: lowercase hex, empty without tokens."""
    return aligned(docs, first, second, digest=True).withColumnRenamed("groups", "groups_sha256")
