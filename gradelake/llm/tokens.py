"""Token counts by a tokenizer file, in Arrow batches that return lengths only.

Texts are cut at safe boundaries into short pieces. A task encodes each distinct piece once, in batches of about equal bytes that are filled
from all texts of an Arrow batch, and a text's count is the sum over its pieces, so a very long text costs no more memory than its pieces.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import aside, quoted


#: UTF-8 bytes that one call to the tokenizer holds at most (a longer piece is a call of its own).
BATCH_BYTES = 1 << 18
#: Characters of distinct pieces whose counts each of the two generations holds at most.
CACHE_CHARS = 3 << 20
#: A space after a character that is no white space and before a letter begins a token, or is dropped, in every .json tokenizer served.
_BOUNDARY = re.compile(r"(?<=\S)(?= [^\W\d_])")


def pieces(text: str, spaces_dropped: bool = False) -> list[str]:
    """`text` cut at safe boundaries. With spaces_dropped (the tokenizer drops white space) the spaces and newlines go."""
    if spaces_dropped:
        return text.replace("\n", " ").split(" ")
    return _BOUNDARY.split(text)


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of texts: no begin, end or added special tokens, no truncation, no padding.

    .json is for tokenizers (special strings in texts as its default has them), .model for sentencepiece.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def balanced(texts: list[str]) -> Iterator[list[str]]:
    """`texts` in order, in batches of at most BATCH_BYTES bytes (or one text)."""
    batch: list[str] = []
    held = 0
    for t in texts:
        n = len(t) if t.isascii() else len(t.encode(errors="replace"))
        if batch and held + n > BATCH_BYTES:
            yield batch
            batch, held = [], 0
        batch.append(t)
        held += n
    if batch:
        yield batch


class PieceCounts:
    """Counts of pieces seen, filled by batches. Two generations bound its memory: when the younger is full, the older goes."""

    def __init__(self, count: Callable[[list[str]], list[int]]):
        self.count, self.young, self.old, self.chars = count, {}, {}, 0

    def totals(self, texts: list[list[str]]) -> list[int]:
        """The counts of texts, given as their pieces; new pieces of all of them are encoded together."""
        young = self.young
        every = set().union(*texts)
        if missing := every.difference(young):
            known = {p: self.old[p] for p in missing if p in self.old}
            new = [p for p in missing if p not in known]
            more = sum(map(len, missing))
            if self.chars and self.chars + more > CACHE_CHARS:
                self.old, self.chars = young, 0
                young = self.young = {p: young[p] for p in every if p in young}
            self.chars += more
            young.update(known)
            for batch in balanced(new):
                young.update(zip(batch, self.count(batch), strict=True))
        return [sum(map(young.__getitem__, parts)) for parts in texts]


@functools.cache
def drops_spaces(path: str) -> bool:
    """Whether the tokenizer file says that spaces only part its tokens: it keeps what a pattern without white space matches and nothing else.

    Steps before that may change letters but not spaces, and no special string may hold one.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    before, normal = t.get("pre_tokenizer") or {}, t.get("normalizer") or {}
    first = before.get("pretokenizers", [before])[0]
    pattern = first.get("pattern", {}).get("Regex") if isinstance(first.get("pattern"), dict) else None
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or not pattern or "(?" in pattern:
        return False
    keeps = regex.compile(pattern)
    if any(keeps.fullmatch(x) for c in map(chr, range(256)) for x in (" ", c + " ", " " + c)):
        return False
    calm = all(x.get("type") in (None, "NFC", "NFD", "NFKC", "NFKD", "Lowercase") or (x.get("pattern"), x.get("content")) == ({"Regex": r"\s+"}, " ") for x in normal.get("normalizers", [normal]))
    return calm and not any(any(map(str.isspace, x["content"])) or x.get("lstrip") or x.get("rstrip") for x in t.get("added_tokens", []))


@functools.cache
def seen_by(path: str) -> PieceCounts:
    """One memory of counts for each tokenizer and worker process: later tasks of the process start with it."""
    return PieceCounts(counter(path))


def count_tokens(docs: DataFrame, tokenizer: str, out: str = "n_tokens") -> DataFrame:
    """`docs` without text, with `out` (long) added: the tokens of the whole text. A null text counts as empty: 0.

    Other columns pass through, an old column named `out` is replaced. Equal rows give equal rows, no rows none. The tokenizer is a file that
    every executor can read. Where its own definition says that it drops white space, texts are cut at every space. A .model's texts are
    not cut, nor is a text without a safe boundary, however long.
    """
    kept = [c for c in docs.columns if c not in ("text", out)]
    own, back = aside(docs.select(*quoted(kept), "text"), ("text",))
    names = own.columns[:-1]
    cut, dropped = tokenizer.endswith(".json"), drops_spaces(tokenizer)

    def lengths(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = seen_by(tokenizer)
        for b in arrow:
            texts = [t.as_py() for t in pc.fill_null(b.column("text"), "")]
            n = seen.totals([pieces(t, dropped) if cut else [t] for t in texts])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64())], names=[*names, "n"])

    return own.mapInArrow(lengths, own.drop("text").withColumn("n", F.lit(0).cast("long")).schema).select(*back[:-1], F.col("n").alias(out))


def token_table(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8; null text 0), n_tokens, over_limit (n_tokens > limit) of every row."""
    d = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    d = count_tokens(d, tokenizer)
    return d.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
