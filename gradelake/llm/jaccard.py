"""N-gram Jaccard join: which documents are linked by a Jaccard similarity of word shingles of at least 0.8, and their components.

1. Sets. Texts become sets of 64-bit shingle hashes, once. A block of documents keeps what it knows of its rows and sends each distinct shingle,
   with the number of its sets that have it, to a range of the hash space. A shingle that stands everywhere comes once a block.
2. Counts. A range learns how many sets share each of its shingles, and blocks get the shared ones back. A link needs four fifths of a
   set to be shared, so sets with fewer shared shingles are done: they have no link. For the others only shared shingles matter.
3. Global order. Shingles are ordered by the class of that count (an eighth of a power of two), rarest first, then by 56 bits of their hash. Linked
   sets share one of their first n - ceil(0.8 n) + 1. Sets that share such a one are brought together (components of stars, no pairs).
4. Trie. Within a group sets go into a prefix tree in the global order. Each set traverses it, sharing the overlap of common beginnings, and leaves
   subtrees whose remaining lengths cannot reach the overlap a link needs, or whose sets it is linked with already.
   A component above the bound of a group is split: links within parts, then between their representatives. Where that does not join it whole, the lists
   of sets of those prefix shingles that still hold two components or more are searched, one by one, in parts of bounded size. A link that
   is missing lies in such a list, so none between different components is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import WORD, bloom_filter, components, lookup, quoted, stored
from gradelake.llm.words import Words, mix

CHARACTER = r"[^\x20\x09-\x0D]"
N = 5
#: The link: NUM * union <= 100 * intersection.
PERCENT = 80
#: Shingles of a block, and of a group that one task joins, about; sets and rows of a block at most.
BLOCK_TOKENS = 1 << 20
GROUP_TOKENS = 1 << 20
BLOCK_SETS = 1 << 15
BLOCK_ROWS = 1 << 18
#: Bytes of text that stand for one shingle in estimates, and shingles of a hash range: the least, and the most that one task takes.
TOKEN_BYTES = 6
RANGE_TOKENS = 1 << 18
MAX_RANGE_TOKENS = 1 << 22
#: Shingles that a block sends to a range at least, while ranges are below MAX_RANGE_TOKENS.
ROW_TOKENS = 64
#: A shingle in more sets of a block than this sends no set numbers to its range.
LIGHT = 8
#: Bits of a shingle's hash that are kept once sets are known by theirs; the 8 bits above them hold its count's class.
BITS = 56
_FACTORS = [int(x) | 1 for x in mix(np.arange(1, N + 1))]


def shingles(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, in order. A text of 1 to N - 1 words has one, of all its words; one without words none."""
    size = len(hashes) - N + 1
    rolled = np.zeros(max(0, size), np.uint64)
    for j, f in enumerate(_FACTORS):
        rolled += hashes[j : j + len(rolled)] * np.uint64(f)
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= N:
            yield np.unique(rolled[a : b - N + 1])
        elif b > a:
            short = sum(int(h) * f for h, f in zip(hashes[a:b], _FACTORS, strict=False)) + b - a
            yield mix(np.array([short & (1 << 64) - 1], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def fingerprint(s: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number."""
    total = mix(np.array([int(mix(s).sum()) + len(s) & (1 << 64) - 1], np.uint64))
    return int(total.view(np.int64)[0])


def text_sets(text: pa.Array, words: Words) -> Iterator[np.ndarray]:
    """The sets of a column's texts, a few megabytes of text at a time."""
    step = max(1, int(len(text) * (4 << 20) / max(1, text.nbytes)))
    for at in range(0, len(text), step):
        yield from shingles(*words.of_arrow(text.slice(at, step)))


def planes(x: np.ndarray, width: int) -> bytes:
    """Numbers in `width` bytes each, lowest bytes first and all together: small numbers compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def pack(tokens: np.ndarray, counts: np.ndarray, sets: np.ndarray) -> bytes:
    """Ascending tokens as steps in as few bytes as the largest needs, their counts, and set numbers."""
    steps = np.diff(tokens, prepend=np.uint64(0))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    steps = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    return np.array([len(tokens)], "<u4").tobytes() + bytes([width]) + steps + planes(counts, 2) + sets.astype("<u2").tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = int(np.frombuffer(blob, "<u4", 1)[0]), blob[4]
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(blob, np.uint8, n * width, 5).reshape(n, width)
    at = 5 + n * width
    counts = np.zeros((n, 8), np.uint8)
    counts[:, :2] = np.frombuffer(blob, np.uint8, 2 * n, at).reshape(2, n).T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64), counts.reshape(-1).view("<u8").astype(np.int64), np.frombuffer(blob, "<u2", offset=at + 2 * n)


def n_ranges_for(total: int) -> int:
    """Hash ranges for `total` shingles: of RANGE_TOKENS each, or larger where blocks would send rows of under ROW_TOKENS, up to MAX_RANGE_TOKENS."""
    return max(1, math.ceil(total / MAX_RANGE_TOKENS), min(math.ceil(total / RANGE_TOKENS), BLOCK_TOKENS // ROW_TOKENS))


def blocks_of(docs: DataFrame, n_ranges: int) -> DataFrame:
    """range, block, body and, in the one row of a block's own (with a range below 0), what is known of its rows.

    body: a range's tokens of the block, how many of its sets have each, and which, for those in up to LIGHT sets. Own row: head (the sets'
    fingerprints, sizes, and which have the other tokens), and of each row of `docs` its doc_id, its row_key and the place of its set (-1: empty).
    """
    edge = np.array([(k << BITS) // n_ranges + (1 if (k << BITS) % n_ranges else 0) for k in range(1, n_ranges)], np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = Words(CHARACTER), TaskContext.get().partitionId()
        held: dict[int, np.ndarray] = {}
        place: dict[int, int] = {}
        ids, row_keys, which = [], [], []
        size = n_blocks = 0

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            sets = list(held.values())
            sizes = np.array([len(s) for s in sets], np.int64)
            tokens = (np.concatenate(sets) if sets else np.empty(0, np.uint64)) >> np.uint64(64 - BITS)
            order = np.argsort(tokens)
            tokens, owner = tokens[order], np.repeat(np.arange(len(sets)), sizes)[order]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, np.int64)
            counts, tokens = np.diff(np.append(first, len(tokens))), tokens[first]
            light = np.repeat(counts <= LIGHT, counts)
            known = np.concatenate([[0], np.cumsum(np.where(counts <= LIGHT, counts, 0))])
            light, heavy = owner[light], owner[~light]
            at = [0, *np.searchsorted(tokens, edge).tolist(), len(tokens)]
            used = [k for k in range(n_ranges) if at[k] < at[k + 1]]
            bodies = [pack(tokens[a:b], counts[a:b], light[known[a] : known[b]]) for a, b in ((at[k], at[k + 1]) for k in used)]
            prints = np.array(list(held), np.int64)
            # the same block, whatever task attempt makes it, and no other one
            block = fingerprint(np.concatenate([prints, [part, n_blocks]]).view(np.uint64))
            head = np.array([len(sets)], np.int64).tobytes() + prints.tobytes() + sizes.tobytes() + heavy.astype("<u2").tobytes()
            none = [None] * len(used)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*used, -1 - (block & 0x3FFFFFFF)], pa.int32()),
                    pa.array([block] * (len(used) + 1), pa.int64()),
                    pa.array([*bodies, None], pa.binary()),
                    pa.array([*none, head], pa.binary()),
                    pa.array([*none, [x for a in ids for x in a.to_pylist()]], pa.list_(kind)),
                    pa.array([*none, np.concatenate(row_keys)], pa.list_(pa.int64())),
                    pa.array([*none, which], pa.list_(pa.int32())),
                ],
                names=["range", "block", "body", "head", "ids", "row_keys", "which"],
            )

        kind = None
        for b in batches:
            kind = b.column("doc_id").type
            start = 0
            for i, s in enumerate(text_sets(b.column("text"), words)):
                fp = fingerprint(s) if len(s) else None
                if fp is not None and fp not in held:
                    place[fp] = len(held)
                    held[fp] = s
                    size += len(s)
                which.append(-1 if fp is None else place[fp])
                if size >= BLOCK_TOKENS or len(held) == BLOCK_SETS or len(which) == BLOCK_ROWS:
                    ids.append(b.column("doc_id").slice(start, i + 1 - start))
                    row_keys.append(b.column("row_key").slice(start, i + 1 - start).to_numpy(zero_copy_only=False))
                    yield flush(kind)
                    held, place, ids, row_keys, which = {}, {}, [], [], []
                    size, start, n_blocks = 0, i + 1, n_blocks + 1
            if start < len(b):
                ids.append(b.column("doc_id").slice(start))
                row_keys.append(b.column("row_key").slice(start).to_numpy(zero_copy_only=False))
        if which:
            yield flush(kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    return keyed.mapInArrow(cut, f"range int, block long, body binary, head binary, ids array<{kind}>, row_keys array<long>, which array<int>")


def count_range(t: pa.Table) -> pa.Table:
    """One range: for each block its tokens that two sets or more have, with the class of their count in the top bits. A block's own row passes."""
    if t.column("range")[0].as_py() < 0:
        return t
    parts = [unpack(x.as_py()) for x in t.column("body")]
    tokens, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(tokens)
    ranked = tokens[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    shares = np.add.reduceat(counts[order], first)
    kind = np.minimum(255, np.floor(8 * np.log2(shares))).astype(np.uint64)
    times = np.diff(np.append(first, len(ranked)))
    keys, shared = np.empty(len(tokens), np.uint64), np.empty(len(tokens), bool)
    keys[order] = ranked | (np.repeat(kind, times) << np.uint64(BITS))
    shared[order] = np.repeat(shares > 1, times)
    bodies, at = [], 0
    for own, n, sets in parts:
        some = shared[at : at + len(own)]
        left = np.repeat(some, np.where(n <= LIGHT, n, 0))
        bodies.append(np.array([some.sum()], "<u4").tobytes() + keys[at : at + len(own)][some].tobytes() + planes(n[some], 2) + sets[left].tobytes())
        at += len(own)
    return t.set_column(t.schema.get_field_index("body"), "body", pa.array(bodies, pa.binary()))


def block_sets(t: pa.Table) -> pa.Table:
    """One block: a row of its rows (ids, row_keys, sizes, prints), and fp, n and the shared tokens, in global order, of the sets that may have a link."""
    own = t.filter(pc.is_valid(t.column("head")))
    head = own.column("head")[0].as_py()
    n_sets = int(np.frombuffer(head, np.int64, 1)[0])
    fps, sizes = np.frombuffer(head, np.int64, n_sets, 8), np.frombuffer(head, np.int64, n_sets, 8 + 8 * n_sets)
    heavy_sets = np.frombuffer(head, "<u2", offset=8 + 16 * n_sets)
    keys, counts, light_sets = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, "<u2")]
    for blob in t.filter(pc.is_valid(t.column("body"))).sort_by("range").column("body").to_pylist():
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        keys.append(np.frombuffer(blob, np.uint64, n, 4))
        counts.append(np.frombuffer(blob, np.uint8, 2 * n, 4 + 8 * n).reshape(2, n).T.astype(np.int64) @ np.array([1, 256]))
        light_sets.append(np.frombuffer(blob, "<u2", offset=4 + 10 * n))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    is_heavy = np.repeat(counts > LIGHT, counts)
    owner = np.empty(len(is_heavy), "<u2")
    owner[is_heavy], owner[~is_heavy] = heavy_sets, np.concatenate(light_sets)
    keys = np.repeat(keys, counts)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    if len(keys):  # hashes that are equal in their first BITS bits
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
        keys, owner = keys[new], owner[new]
    at = np.searchsorted(owner, np.arange(n_sets + 1))
    shared = np.diff(at)
    some = np.flatnonzero((100 * shared >= PERCENT * sizes) & (shared > 0)).tolist()
    which = own.column("which")[0].values.to_numpy(zero_copy_only=False)
    none = [None] * len(some)
    row_sizes = np.append(sizes, 0)[which]
    row_prints = pa.array(np.append(fps, 0)[which], pa.int64(), mask=which < 0)
    return pa.table(
        {
            "ids": pa.array([own.column("ids")[0].as_py(), *none], own.schema.field("ids").type),
            "row_keys": pa.array([own.column("row_keys")[0].as_py(), *none], pa.list_(pa.int64())),
            "sizes": pa.array([row_sizes, *none], pa.list_(pa.int64())),
            "prints": pa.array([row_prints.to_pylist(), *none], pa.list_(pa.int64())),
            "fp": pa.array([None, *fps[some].tolist()], pa.int64()),
            "n": pa.array([None, *sizes[some].tolist()], pa.int64()),
            "keys": pa.array([None, *(keys[at[i] : at[i + 1]].tobytes() for i in some)], pa.binary()),
        }
    )


def rows_and_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, sets) of `docs`. rows: doc_id, row_key (hash of doc_id and text), n_shingles and fp (null where the set is empty) of every row.
    sets: fp, n and keys (the shared tokens in global order) of the sets that may have a link; a set comes once for each block that has it."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = blocks_of(docs, n_ranges_for(size // TOKEN_BYTES))
    counted = found.groupBy("range").applyInArrow(count_range, found.schema)
    made = f"ids array<{kind}>, row_keys array<long>, sizes array<long>, prints array<long>, fp long, n long, keys binary"
    both = stored(counted.groupBy("block").applyInArrow(block_sets, made), "jaccard_sets")
    zipped = F.arrays_zip(F.col("ids"), F.col("row_keys"), F.col("sizes"), F.col("prints"))
    rows = both.filter("ids is not null").select(F.explode(zipped).alias("r"))
    rows = rows.select(F.col("r.ids").alias("doc_id"), F.col("r.row_keys").alias("row_key"), F.col("r.sizes").alias("n_shingles"), F.col("r.prints").alias("fp"))
    return rows, both.filter("fp is not null").select("fp", "n", "keys")


def prefixes(sets: DataFrame) -> DataFrame:
    """(key, fp, n): the shared tokens among the first n - ceil(0.8 n) + 1 of each set in global order; unshared ones come before them."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, fps, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for fp, n, raw in zip(b.column("fp").to_pylist(), b.column("n").to_pylist(), b.column("keys").to_pylist(), strict=True):
                own = np.frombuffer(raw, np.int64)
                take = n - -(-PERCENT * n // 100) + 1 - (n - len(own))
                keys.append(own[: max(0, take)])
                fps.append(np.full(len(keys[-1]), fp))
                sizes.append(np.full(len(keys[-1]), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, fps, sizes)], names=["key", "fp", "n"])

    return sets.mapInArrow(first, "key long, fp long, n long")


class Node:
    """A stretch of tokens below a branch of the trie. low, high: sizes of the sets below; deep: most tokens after the stretch."""

    __slots__ = ("any", "deep", "ends", "high", "kids", "low", "seg", "whole")

    def __init__(self, seg, doc, n):
        self.seg, self.kids, self.ends = seg, {}, []
        self.low = self.high = n
        self.deep, self.any, self.whole = 0, doc, True


class Trie:
    """Sets of a group in global order, and which of them are connected by links found so far."""

    def __init__(self, sizes: list[int], keys: list[np.ndarray], labels: list[int]):
        self.n, self.keys, self.up = sizes, keys, list(range(len(sizes)))
        first: dict[int, int] = {}
        for i, x in enumerate(labels):
            self.up[i] = first.setdefault(x, i)
        self.root: Node | None = None

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def same(self, node: Node, x: int) -> bool:
        return node.whole and self.find(node.any) == self.find(x)

    def linked(self, x: int, y: int, overlap: int) -> bool:
        return 100 * overlap >= PERCENT * (self.n[x] + self.n[y] - overlap)

    def probe(self, x: int) -> None:
        """Connects x with every component, among the sets inserted, that holds a set it is linked with."""
        own, nx = self.keys[x], self.n[x]
        least = -(-PERCENT * nx // 100)
        stack = [(self.root, 0, 0, False)]
        while stack:
            node, overlap, at, seen = stack.pop()
            if seen:  # all below it was visited
                r = self.find(node.any)
                node.whole = all(self.find(d) == r for d in node.ends) and all(k.whole and self.find(k.any) == r for k in node.kids.values())
                continue
            if self.same(node, x):
                if node is self.root:
                    return
                continue
            if 100 * node.high < PERCENT * nx or PERCENT * node.low > 100 * nx:
                continue
            need = -(-PERCENT * (nx + max(node.low, least)) // (100 + PERCENT))
            if len(node.seg):
                at = max(at, int(np.searchsorted(own, node.seg[0])))
                if overlap + min(len(own) - at, len(node.seg) + node.deep) < need:
                    continue
                place = np.searchsorted(own, node.seg)
                inside = place < len(own)
                overlap += int((own[place[inside]] == node.seg[inside]).sum())
                at = int(place[-1]) + int(at < len(own) and place[-1] < len(own) and own[place[-1]] == node.seg[-1])
            if overlap + min(len(own) - at, node.deep) < need:
                continue
            for y in node.ends:
                if self.linked(x, y, overlap):
                    self.join(x, y)
            if self.same(self.root, x):
                return
            stack.append((node, 0, 0, True))
            near = node.kids.get(int(own[at])) if at < len(own) else None
            stack += [(k, overlap, at, False) for k in node.kids.values() if k is not near]
            if near is not None:
                stack.append((near, overlap, at, False))

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        self.up[max(a, b)] = min(a, b)

    def insert(self, x: int) -> None:
        own, n = self.keys[x], self.n[x]
        if self.root is None:
            self.root = Node(own[:0], x, n)
        node, at = self.root, 0
        while True:
            node.whole = node.whole and self.find(node.any) == self.find(x)
            node.low, node.high = min(node.low, n), max(node.high, n)
            node.deep = max(node.deep, len(own) - at)
            if at == len(own):
                node.ends.append(x)
                return
            kid = node.kids.get(int(own[at]))
            if kid is None:
                kid = node.kids[int(own[at])] = Node(own[at:], x, n)
                kid.ends.append(x)
                return
            m = min(len(kid.seg), len(own) - at)
            differ = np.flatnonzero(kid.seg[:m] != own[at : at + m])
            k = int(differ[0]) if len(differ) else m
            if k < len(kid.seg):  # the stretch is split
                top = Node(kid.seg[:k], kid.any, kid.low)
                top.high, top.whole, top.deep = kid.high, kid.whole, len(kid.seg) - k + kid.deep
                kid.seg = kid.seg[k:]
                top.kids[int(kid.seg[0])] = kid
                node.kids[int(own[at])] = kid = top
            node, at = kid, at + k

    def run(self) -> list[int]:
        for x in sorted(range(len(self.n)), key=lambda i: self.n[i]):
            if self.root is not None:
                self.probe(x)
            self.insert(x)
        return [self.find(i) for i in range(len(self.n))]


def join_group(rows: list[tuple[int, int, bytes, int]]) -> list[tuple[int, int]]:
    """(fp, root): for rows (fp, n, keys, label) of one group, the least fp that each is connected with, where that isn't itself."""
    distinct = sorted({fp: (n, raw, label) for fp, n, raw, label in rows}.items())
    roots = Trie([v[0] for _, v in distinct], [np.frombuffer(v[1], np.uint64) for _, v in distinct], [v[2] for _, v in distinct]).run()
    return [(fp, distinct[r][0]) for (fp, _), r in zip(distinct, roots, strict=True) if distinct[r][0] != fp]


def join_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(fp, root) by `join_group` of every group of rows (fp, n, keys, label) equal in `keys`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group):
            found = join_group(group) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["fp", "root"])

        now, group = None, []
        for b in batches:
            ids = zip(*[b.column(k).to_pylist() for k in keys], strict=True)
            for key, *row in zip(ids, *[b.column(c).to_pylist() for c in ("fp", "n", "keys", "label")], strict=True):
                if key != now:
                    if len(group) > 1:
                        yield out(group)
                    now, group = key, []
                group.append(tuple(row))
        yield out(group)

    dealt = rows.select(*keys, "fp", "n", "keys", "label").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "fp long, root long")


def dealt(sets: DataFrame, group: str = "comp") -> DataFrame:
    """`sets` (group, fp, n) with block and n_blocks: groups above GROUP_TOKENS are dealt to several blocks."""
    sizes = sets.groupBy(group).agg(F.sum("n").alias("size"))
    sizes = sizes.select(group, F.ceil(F.col("size") / GROUP_TOKENS).cast("int").alias("n_blocks"))
    return sets.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int"))


def united(links: DataFrame) -> DataFrame:
    """(fp, label): the components of `links` (fp, root)."""
    found = components(links.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    return stored(found.select(F.col("node").alias("fp"), F.col("root").alias("label")), "jaccard_labels")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` with label: that of `labels` (fp, label), else fp."""
    return rows.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def with_keys(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """`groups` (fp and others) with n and keys of its sets: one plan at every size, which moves the sets that `groups` names and few others."""
    named = bloom_filter(groups.select("fp").distinct())
    own = sets.filter(named(F.col("fp"))).dropDuplicates(["fp"])
    return own.join(groups.hint("merge"), "fp")


def mixed_lists(firsts: DataFrame, large: DataFrame) -> DataFrame:
    """(key, fp, label, n): for sets of `large` (fp, label), the lists of prefix shingles that hold sets of two labels or more. Of equal lists one stays."""
    posts = stored(firsts.join(large.select("fp", "label").hint("merge"), "fp").distinct(), "jaccard_posts")
    mark = F.sum(F.xxhash64("fp").cast("decimal(38,0)"))
    lists = posts.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("fp").alias("low"), F.max("fp").alias("high"), mark.alias("mark"), F.count(F.lit(1)).alias("rows"))
    lists = lists.filter("x <> y").groupBy("low", "high", "mark", "rows").agg(F.min("key").alias("key"))
    lists = stored(lists.select("key", "rows", F.lit(True).alias("stays")), "jaccard_lists")
    return lookup(posts, lists, "key", "rows", posts.count()).filter("stays").select("key", "fp", "label", "n")


def linked_sets(sets: DataFrame) -> DataFrame:
    """(fp, label): for every set of `sets` (fp, n, keys) that is linked with another, the least fp of its component."""
    firsts = stored(prefixes(sets), "jaccard_prefixes")
    stars = firsts.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), F.count(F.lit(1)).alias("rows"))
    stars = stored(stars.filter("least <> most").select("key", "least", "rows"), "jaccard_stars")
    near = lookup(firsts, stars, "key", "rows", firsts.count()).filter(F.col("least").isNotNull() & (F.col("least") != F.col("fp")))
    comps = components(near.select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct())
    # which group a set belongs to is settled without its shingles; they are moved once, to their group
    groups = sets.select("fp", "n").distinct().join(comps.select(F.col("node").alias("fp"), F.col("root").alias("comp")), "fp")
    groups = stored(dealt(groups), "jaccard_groups")
    rows = with_keys(sets, groups.drop("n")).withColumn("label", F.col("fp"))
    links = stored(join_groups(rows, ["comp", "block"]), "jaccard_links")
    labels = united(links)
    large = groups.filter("n_blocks > 1").select("fp", "comp", "n")
    if large.isEmpty():
        return labels

    # representatives of what is connected within the parts of a large component
    reps = dealt(labelled(large, labels).filter("fp = label"))
    links = links.union(stored(join_groups(with_keys(sets, reps.drop("n")), ["comp", "block"]), "jaccard_rep_links"))
    labels = united(links)
    large = stored(labelled(large, labels), "jaccard_large")
    apart = large.groupBy("comp").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("comp")
    rest = large.join(apart, "comp", "left_semi")
    if rest.isEmpty():
        return labels
    parts = dealt(mixed_lists(firsts, rest), "key")
    others = F.filter(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda x: (x != F.col("block")) | (F.col("n_blocks") == 1))
    tiles = parts.withColumn("other", F.explode(others)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    tiles = stored(tiles.select("key", "i", "j", "fp", "label"), "jaccard_tiles")
    return united(links.union(stored(join_groups(with_keys(sets, tiles), ["key", "i", "j"]), "jaccard_tile_links")))


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sets' labels, rows of each linked or repeated set: fp, root, first (doc_id, row_key), rows)."""
    rows, sets = rows_and_sets(docs)
    labels = linked_sets(sets)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row_key")))
    classes = rows.filter(F.col("fp").isNotNull()).groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = classes.join(labels, "fp", "left").filter((F.col("rows") > 1) | F.col("label").isNotNull())
    classes = stored(classes.withColumn("root", F.coalesce("label", "fp")).drop("label"), "jaccard_classes")
    ids = classes.groupBy("root").agg(F.min("first").alias("found"))
    named = stored(classes.join(ids, "root").select("fp", "found", "rows"), "jaccard_named")
    return rows, labels, named


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links lead to, itself included) of every row of `docs`.

    Documents without words (null, empty, white space) are linked with nothing. Rows with equal sets are linked; a repeated doc_id is
    no error. Of rows with null doc_id the component's id is the least one there is, or null. Sets are told apart by 64 bits of hash, the
    shingles within them by 56: a link could be mistaken where two different shingles agree in 56 bits and its overlap is at the threshold.
    """
    rows, _, named = joined(docs)
    out = lookup(rows, named, "fp", "rows", rows.count())
    return out.select("doc_id", "n_shingles", F.coalesce("found.doc_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` without near duplicates: of each component the row with the least doc_id stays (of equal ids, one). Rows without words or doc_id all stay, repeated ones too.

    Of rows with words that are equal in doc_id and text one stays. The same plan at every size: a Bloom filter of the rows that go lets nearly all others pass
    where they are; the few rows that it holds back are shuffled and looked up exactly.
    """
    rows, _, named = joined(docs)
    found = lookup(rows, named, "fp", "rows", rows.count()).filter(F.col("doc_id").isNotNull() & F.col("fp").isNotNull())
    stays = F.col("found").isNull() | (F.col("found.row_key") == F.col("row_key"))
    marked = found.groupBy("row_key").agg(F.count(F.lit(1)).alias("times"), F.bool_and(stays).alias("stays")).filter("times > 1 or not stays")
    marked = stored(marked, "jaccard_marked")
    held = bloom_filter(marked.select("row_key"))
    kept = docs.columns
    named_row = docs.select(F.struct(*quoted(kept)).alias("row"))
    named_row = named_row.withColumn("row_key", F.xxhash64("row.doc_id", "row.text"))
    back = [F.col("row").getField(c).alias(c) for c in kept]
    has_set = F.col("row.doc_id").isNotNull() & F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    tried = named_row.withColumn("held", F.when(has_set, held(F.col("row_key"))).otherwise(F.lit(False)))
    passed = tried.filter(~F.col("held")).select(*back)
    exact = tried.filter("held").select("row", "row_key").dropDuplicates(["row_key"])
    exact = exact.join(marked.filter(~F.col("stays")).select("row_key").hint("merge"), "row_key", "left_anti")
    return passed.union(exact.select(*back))
