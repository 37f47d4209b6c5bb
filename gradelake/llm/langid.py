"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams, in order. A document's own most frequent n-grams are ranked the
same way, and the distance to a language is the sum over them of how far each is out of place in that language's order; an
n-gram that the profile lacks counts as one place beyond its end. The nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import aside, quoted

#: n-grams of 1 to N characters, words padded by one space on either side.
N = 3
#: Places of a profile.
PLACES = 400
#: Labelled documents that a language's profile is learned from, about; chosen by hash. The only bound here.
TRAIN_PER_LANGUAGE = 4000
#: Labels that lang may hold at most: it bounds the table of profiles that is broadcast.
MAX_LANGUAGES = 1000
#: Code points up to 0xFFFF have an id of their own after lower-casing; letters above share ids by their low bits.
_BITS = 16
#: Characters counted in one go.
CHUNK = 1 << 20


def _letter_table() -> np.ndarray:
    """For each code point below 2**16: that of its lower case if it is a letter, else a space."""
    out = np.full(1 << _BITS, 32, np.uint16)
    for c in range(1 << _BITS):
        if (ch := chr(c)).isalpha() and len(low := ch.lower()) == 1 and ord(low) < 1 << _BITS:
            out[c] = ord(low)
        elif ch.isalpha():
            out[c] = c
    return out


LETTERS = _letter_table()


def letters(text: str) -> np.ndarray:
    """The text's letters in lower case as 16-bit ids, each run of anything else as one space, with one at either end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if (high := points >= 1 << _BITS).any():
        alpha = np.array([chr(c).isalpha() for c in points[high]], bool)
        points = points.copy()
        points[high] = np.where(alpha, 0xE000 + (points[high] & 0xFFF), 32)
        ids = np.where(points >= 0xE000, points, LETTERS[points & 0xFFFF]).astype(np.uint16) if alpha.any() else LETTERS[points]
    else:
        ids = LETTERS[points]
    space = ids == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(keep):
        keep[0] = True
    out = ids[keep]
    edge = np.array([32], np.uint16)
    return np.concatenate([edge[: int(not len(out) or out[0] != 32)], out, edge[: int(len(out) > 0 and out[-1] != 32)]])


def grams(ids: np.ndarray) -> np.ndarray:
    """The keys of all 1- to N-grams of `ids` that are more than spaces; none holds a space inside."""
    a = ids.astype(np.uint64)
    space = a == 32
    keys = [a[~space]]
    key, inner = a, np.zeros(len(a), bool)
    for n in range(2, N + 1):
        key = (key[:-1] << np.uint64(_BITS)) | a[n - 1 :]
        if n > 2:
            inner = inner[:-1] | space[n - 2 : -1]
        else:
            inner = inner[:-1]
        keys.append(key[~inner])
    return np.concatenate(keys)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the n-grams of the whole text, counted in chunks that overlap by what an n-gram needs."""
    ids = letters(text)
    if len(ids) <= CHUNK:
        return np.unique(grams(ids), return_counts=True)
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for at in range(0, len(ids), CHUNK):
        k, c = np.unique(grams(ids[at : at + CHUNK + N - 1]), return_counts=True)
        if at + CHUNK < len(ids):  # what lies wholly in the overlap belongs to the next chunk
            ko, co = np.unique(grams(ids[at + CHUNK : at + CHUNK + N - 1]), return_counts=True)
            c[np.searchsorted(k, ko)] -= co
        k, where = np.unique(np.concatenate([keys, k]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, c]), len(k)).astype(np.int64)
        keys = k
    return keys[counts > 0], counts[counts > 0]


def top(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys of the PLACES most frequent, most frequent first, equals by key. `keys` must be in order."""
    if len(keys) > PLACES:
        least = np.partition(counts, len(counts) - PLACES)[len(counts) - PLACES]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.argsort(-counts, kind="stable")][:PLACES]


class Profiles:
    """Languages with their profiles, as one table from n-gram to its place in each."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], np.uint64))
        self.place = np.full((len(self.languages), len(self.keys) + 1), PLACES, np.int16)
        for i, name in enumerate(self.languages):
            p = np.array(profiles[name], np.uint64)
            self.place[i, np.searchsorted(self.keys, p)] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); score is 1 less the distance over the greatest one possible. `und`, 0 if there is no letter."""
        keys = top(*counted(text)) if text else ()
        if not len(keys) or not self.languages:
            return "und", 0.0
        at = np.searchsorted(self.keys, keys)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys)] = len(self.keys)
        places = self.place[:, at].astype(np.int64)
        away = np.where(places == PLACES, PLACES, np.abs(places - np.arange(len(keys)))).sum(1)
        best = int(np.argmin(away))
        return self.languages[best], 1.0 - float(away[best]) / (PLACES * len(keys))


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; false without a doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Profiles:
    """Profiles from documents with text and lang that are not held out, about `per_language` of each language, by hash.

    Languages of fewer documents use them all. The n-gram counts are summed by Spark; the profiles, PLACES n-grams of
    each language, come to the driver. Languages are the distinct labels, so the table of profiles is as small as their number.
    """
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different labels in lang")
    if not sizes:
        return Profiles({})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                parts = [counted(t) for t in texts]
                keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)
                yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": n})

    sums = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the PLACES most frequent of each language, by way of the most frequent within each of a few parts of its n-grams
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "gram"))), 1, PLACES)
    parts = sums.groupBy("lang", F.pmod("gram", F.lit(64)).alias("part")).agg(best.alias("best"))
    rows = parts.groupBy("lang").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, PLACES).alias("best")).collect()
    return Profiles({r.lang: [x.gram for x in r.best] for r in rows})


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """`docs` with lang_pred and score added, from the whole text alone.

    `und` and 0 if the text is null or has no letter. Old columns of these names are replaced, others pass through.
    """
    own, back = aside(docs.select(*quoted([c for c in docs.columns if c not in ("lang_pred", "score")])), ("text",))
    names = own.columns
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.predict(t.as_py()) for t in b.column("text")]
            made = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], names=[*names, "lang_pred", "score"])

    return own.mapInArrow(guess, own.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema).select(*back, "lang_pred", "score")


#: Documents farther than this from every profile are in no known language. Prose scores 0.4 and more, random letters less than 0.2.
LEAST_SCORE = 0.25


def in_known_language(docs: DataFrame) -> DataFrame:
    """`docs` without those of no known language: no letters, or a score below LEAST_SCORE. Their columns stay as they are."""
    own, back = aside(docs, ("text",))
    found = identify(own, learn(docs))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*back)


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, by profiles learned from the rows not held out."""
    d = docs.select("doc_id", "text")
    return identify(d, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
