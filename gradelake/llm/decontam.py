"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of documents. Their words become numbers: a word of the test phrases its own, any other word a separator,
since no phrase holds it. Stretches shorter than the shortest phrase go, and what is left is indexed once: suffix order, its
Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. In that one index the phrases of all blocks of the benchmark are
searched backwards, many at a time; those with a word that the shard lacks are left out before. Occurrences are located from the samples,
and the spans of words that they cover are merged. No document text is shuffled. Words are known by 64 bits of hash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import aside, quoted
from gradelake.llm.words import Words

WINDOW = 13
#: A word: after lower-casing A-Z, a run of anything but ASCII that is neither digit nor letter.
CHARACTER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of text that one index is built over (or one longer text), of phrases that are broadcast as one block, and of all blocks of one pass over the documents.
SHARD_BYTES = 4 << 20
PHRASE_BYTES = 4 << 20
PASS_BYTES = 256 << 20
#: Phrases searched at a time.
PHRASES_AT_ONCE = 1 << 17
#: Every so many text positions the suffix order keeps a sample.
SAMPLE = 4


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of `text` by suffix, by prefix doubling. Separators (0) differ from each other, in order of position, so a suffix ends at one."""
    stop = text == 0
    rank = np.where(stop, np.cumsum(stop), text.astype(np.int64) + int(stop.sum()))
    reach = 1
    while True:
        ahead = np.zeros(len(rank), np.int64)
        ahead[: max(0, len(rank) - reach)] = rank[reach:]
        key = rank * (int(rank.max()) + 1) + np.where(stop, 0, ahead)
        order = np.argsort(key)
        new = np.empty(len(rank), np.int64)
        sorted_key = key[order]
        new[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
        if new.max() == len(rank) or reach >= len(rank):
            return order
        rank, reach = new, 2 * reach


class FMIndex:
    """Finds all occurrences of phrases in a text of symbols 1 to sigma - 1 with separators 0; the last symbol must be one."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.n = len(text)
        order = suffix_order(text)
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]
        self.bits = max(1, math.ceil(math.log2(sigma)))
        self.ones: list[np.ndarray] = []
        seq = bwt
        for level in reversed(range(self.bits)):
            bit = (seq >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.zeros = [self.n - int(o[-1]) for o in self.ones]
        self.base = self._down(np.arange(sigma), np.zeros(sigma, np.int64))
        self.sampled = (order % SAMPLE == 0) | (bwt == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            ones = self.ones[k][at]
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place `at` of the transform."""
        return self._down(symbol, at) - self.base[symbol]

    def back(self, at: np.ndarray) -> np.ndarray:
        """The place of the suffix that begins one symbol earlier."""
        symbol = np.zeros(len(at), np.int64)
        place = at
        for k in range(self.bits):
            ones = self.ones[k]
            before = ones[place]
            bit = ones[place + 1] - before
            symbol = 2 * symbol + bit
            place = np.where(bit, self.zeros[k] + before, place - before)
        return self.first[symbol] + place - self.base[symbol]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of `phrases` (equal lengths) that occur, low, high): their ranges in the suffix order."""
        rows = np.arange(len(phrases))
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            c = phrases[rows, j]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            alive = low < high
            rows, low, high = rows[alive], low[alive], high[alive]
        return rows, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The text positions of places in the suffix order."""
        out = np.zeros(len(at), np.int64)
        todo, place, steps = np.arange(len(at)), at, 0
        while len(todo):
            here = self.sampled[place]
            out[todo[here]] = self.samples[self.sample_rank[place[here]]] + steps
            todo, place, steps = todo[~here], place[~here], steps + 1
            place = self.back(place)
        return out


class Phrases:
    """The different windows of some benchmark items by length: where one of each begins in `numbers` (places in `vocabulary`), and which items have it."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        words = Words(CHARACTER)
        hashes, bounds = words.of_arrow(pa.array([t for _, t in items], pa.string()))
        self.names = sorted({i for i, _ in items})
        place = {x: k for k, x in enumerate(self.names)}
        name = np.array([place[i] for i, _ in items], np.int32)
        self.vocabulary = np.unique(hashes)
        self.numbers = np.searchsorted(self.vocabulary, hashes).astype(np.int32)
        size = np.diff(bounds)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for length in sorted({min(int(n), window) for n in size if n}):
            own = np.flatnonzero(size == length) if length < window else np.flatnonzero(size >= window)
            many = size[own] - length + 1
            item = np.repeat(own, many)
            start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + bounds[item]
            rows = np.ascontiguousarray(self.numbers[start[:, None] + np.arange(length)])
            _, first, which = np.unique(rows.view(f"V{4 * length}").ravel(), return_index=True, return_inverse=True)
            pairs = np.unique(which.astype(np.int64) * max(1, len(self.names)) + name[item])
            which, names = pairs // max(1, len(self.names)), (pairs % max(1, len(self.names))).astype(np.int32)
            self.groups.append((length, start[first].astype(np.int32), np.searchsorted(which, np.arange(len(first) + 1)).astype(np.int32), names))


class Finder:
    """Searches texts for the phrases of all blocks. vocabulary: the hashes of the words of all blocks, in order."""

    def __init__(self, blocks: list[Phrases], vocabulary: np.ndarray):
        self.words, self.vocabulary = Words(CHARACTER), vocabulary
        self.blocks = [(p, np.searchsorted(vocabulary, p.vocabulary)) for p in blocks]
        self.shortest = min((g[0] for p in blocks for g in p.groups), default=0)

    def search(self, text: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """Of each text: the number of words, the merged spans of hit words, and the items that occur."""
        hashes, bounds = self.words.of_arrow(text)
        n = len(bounds) - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[list[str]] = [[] for _ in range(n)]
        if not self.shortest or not len(hashes):
            return np.diff(bounds), spans, items
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        # stretches of known words within a text
        begins = np.zeros(len(hashes) + 1, bool)
        begins[bounds] = True
        start = np.flatnonzero(known & (begins[:-1] | ~np.concatenate([[False], known[:-1]])))
        stop = np.flatnonzero(known & (begins[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        long = stop - start >= self.shortest
        start, stop = start[long], stop[long]
        if not len(start):
            return np.diff(bounds), spans, items
        size = stop - start + 1  # and a separator
        ends = np.cumsum(size)
        place = np.arange(ends[-1])
        origin = place - np.repeat(ends - size, size) + np.repeat(start, size)
        is_end = np.zeros(len(place), bool)
        is_end[ends - 1] = True
        here = at[np.minimum(origin, len(at) - 1)]
        local = np.unique(here[~is_end])
        number = np.where(is_end, 0, np.searchsorted(local, here) + 1)
        number_of = np.zeros(len(self.vocabulary), np.int64)
        number_of[local] = np.arange(1, len(local) + 1)
        index = FMIndex(number, len(local) + 1)
        cover = np.zeros(len(hashes) + 1, np.int64)
        for block, places in self.blocks:
            for d, name in self.occurrences(block, number_of[places], index, origin, bounds, cover):
                items[d].append(block.names[name])
        hit = np.cumsum(cover[:-1]) > 0
        edge = begins[:-1]
        first = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
        last = np.flatnonzero(hit & (begins[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
        doc = np.searchsorted(bounds, first, "right") - 1
        for d, a, b in zip(doc.tolist(), (first - bounds[doc]).tolist(), (last - bounds[doc]).tolist(), strict=True):
            spans[d].append((a, b))
        return np.diff(bounds), spans, [sorted(set(x)) for x in items]

    def occurrences(self, block: Phrases, number_of: np.ndarray, index: FMIndex, origin: np.ndarray, bounds: np.ndarray, cover: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) of all phrases of a block that occur; the words they cover are counted in `cover`, one up where one begins, one down where it ends."""
        numbers = number_of[block.numbers]
        missing = np.concatenate([[0], np.cumsum(numbers == 0)])
        pairs: list[np.ndarray] = []
        n_names = max(1, len(block.names))
        for length, starts, lists, names in block.groups:
            possible = np.flatnonzero(missing[starts + length] == missing[starts])
            for a in range(0, len(possible), PHRASES_AT_ONCE):
                some = possible[a : a + PHRASES_AT_ONCE]
                found, low, high = index.ranges(numbers[starts[some][:, None] + np.arange(length)])
                found = some[found]
                for c in range(0, len(found), 256):
                    f, lo, hi = found[c : c + 256], low[c : c + 256], high[c : c + 256]
                    counts = hi - lo
                    which = np.repeat(np.arange(len(f)), counts)
                    places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
                    for b in range(0, len(places), 1 << 20):
                        word = origin[index.locate(places[b : b + (1 << 20)])]
                        np.add.at(cover, word, 1)
                        np.add.at(cover, word + length, -1)
                        doc = np.searchsorted(bounds, word, "right") - 1
                        hit = np.unique(doc * len(f) + which[b : b + (1 << 20)])
                        for d, w in zip((hit // len(f)).tolist(), (hit % len(f)).tolist(), strict=True):
                            pairs.append(d * n_names + names[lists[f[w]] : lists[f[w] + 1]].astype(np.int64))
        if pairs:
            both = np.unique(np.concatenate(pairs))
            yield from zip((both // n_names).tolist(), (both % n_names).tolist(), strict=True)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the characters from the first to the last word of each span of words."""
    words = [m.span() for m in _WORD.finditer(text)]
    for a, b in reversed(spans):
        text = text[: words[a][0]] + text[words[b - 1][1] :]
    return text


def shards(text: pa.Array) -> Iterator[pa.Array]:
    """The column in slices of about SHARD_BYTES."""
    sizes = np.cumsum([0, *(len(t.as_buffer()) if t.is_valid else 0 for t in text)])
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SHARD_BYTES, "right")) - 1)
        yield text.slice(at, to - at)
        at = to


#: Columns that `find_benchmark` adds; old ones of these names are replaced.
MADE = ("n_words", "spans", "items")
_SPANS = "array<struct<start:int,end:int>>"


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The items as (item_id as text, text) in blocks of about PHRASE_BYTES; items without text are left out, a null id is ''.

    A block is what the driver holds at a time; an item has all its windows in one block.
    """
    b = benchmark.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / PHRASE_BYTES))
    for k in range(blocks):
        own = b if blocks == 1 else b.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield [(r.item, r.text) for r in own.collect()]


def passes(benchmark: DataFrame) -> Iterator[list[Phrases]]:
    """The blocks of each pass over the documents: up to PASS_BYTES of benchmark together."""
    held: list[Phrases] = []
    for block in benchmark_blocks(benchmark):
        held.append(Phrases(block))
        if len(held) * PHRASE_BYTES >= PASS_BYTES:
            yield held
            held = []
    if held:
        yield held


def find_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with n_words, spans (merged spans of hit words, counted from 0, end exclusive) and items (ids that occur, as strings).

    A null text has no words. An item of fewer words than a window is one window; one without words never occurs. Items of one id count
    once, equal rows give equal rows, old columns of the added names are replaced. A shard is indexed once for up to PASS_BYTES of
    benchmark, which lie in blocks, each a broadcast of bounded size; what is beyond takes another pass over the rows in the same stage.
    """
    own, back = aside(docs.select(*quoted([c for c in docs.columns if c not in MADE])), ("text",))
    kept, context = own.columns, docs.sparkSession.sparkContext
    out = own.select(*kept, F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    for blocks in passes(benchmark):
        sent = [context.broadcast(p) for p in blocks]
        words = context.broadcast(np.unique(np.concatenate([p.vocabulary for p in blocks])))

        def search(batches: Iterator[pa.RecordBatch], sent=sent, words=words) -> Iterator[pa.RecordBatch]:
            finder = Finder([x.value for x in sent], words.value)
            for b in batches:
                n_words, spans, items = [], [], []
                for shard in shards(b.column("text")):
                    n, s, i = finder.search(shard)
                    n_words.append(n)
                    spans += s
                    items += i
                old_spans, old_items = b.column("spans").to_pylist(), b.column("items").to_pylist()
                spans = [merged([*s, *((x["start"], x["end"]) for x in o)]) if o else s for s, o in zip(spans, old_spans, strict=True)]
                items = [sorted({*i, *o}) if o else i for i, o in zip(items, old_items, strict=True)]
                kind = b.schema.field("spans").type
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in kept] + [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], kind), pa.array(items, pa.list_(pa.string()))],
                    names=[*kept, *MADE],
                )

        out = out.mapInArrow(search, out.schema)
    return out.select(*back, *MADE)


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated() -> Column:
    """The rule: words are hit, and they are at least a twentieth of the document's."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the contaminated ones; all others stay as they are."""
    own, back = aside(docs, ("text",))
    return find_benchmark(own, benchmark).filter(~contaminated()).select(*back)


def cut_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with the hit spans cut out of their texts: from the first to the last word of each merged span."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans").to_pylist()
            text = [without(t.as_py(), [(x["start"], x["end"]) for x in s]) if s else t.as_py() for t, s in zip(b.column("text"), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if c == "text" else b.column(c) for c in kept], names=kept)

    own, back = aside(docs, ("text",))
    kept = own.columns
    return find_benchmark(own, benchmark).mapInArrow(cut, own.schema).select(*back)


def contamination_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row."""
    found = find_benchmark(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> dict:
    """The contract for one document, by trying every place. For tests."""
    low = lambda t: _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = low(text)
    hit, names = set(), set()
    for name, item in items:
        own = low(item)
        for j in range(max(0, len(own) - window) + 1 if own else 0):
            w = own[j : j + window]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    names.add(name)
    sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return {"n_words": len(words), "n_hit": len(hit), "n_items": len(names), "items_sha256": sha, "contaminated": bool(hit) and 20 * len(hit) >= len(words)}
