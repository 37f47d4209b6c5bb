"""Secret scans: fixed patterns, and high-entropy strings found by a sliding window."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


#: Base patterns: kind, pattern, group whose length counts, least length. A match below it is dropped.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: The same matches of `hex` and `access`: a maximal run reaches its least length or none of it does.
_FAST = {"access": re.compile(r"AKIA[A-Z0-9]{16,}"), "hex": re.compile(r"[0-9a-f]{24,}")}


@dataclass(frozen=True)
class CharacterClass:
    """Candidate strings of one alphabet: runs of at least `window` characters; windows of `window` with `bits` or more are secret-like."""

    name: str
    run: str
    window: int
    bits: float


#: Base-64-like strings must mix lower case, upper case and digits in the window; hexadecimal ones need letters and digits.
CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]{24,}", 24, 3.0),
    CharacterClass("entropy_b64", r"[A-Za-z0-9+/_=-]{24,}", 24, 3.9),
)
KINDS = ("assign", "access", "hex", *(c.name for c in CLASSES))
#: Strings that look random and are none: UUIDs, runs of the alphabets in order (anywhere; the others are whole candidates), and pure words or numbers.
ALLOW = (
    re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"),
    re.compile(r"(?i)abcdefghijklm|nopqrstuvwxyz|0123456789abcdef|23456789"),
    re.compile(r"[A-Za-z]+(?:[-_/=+][A-Za-z]+)*[=+/_-]*"),
    re.compile(r"[0-9+/_=-]+"),
)
_IN_ORDER = re.compile(f"(?=({ALLOW[1].pattern.removeprefix('(?i)')}))", re.IGNORECASE)


def allowed(candidate: str) -> bool:
    """Whether the allow-list suppresses a whole candidate string."""
    return any(p.fullmatch(candidate) for p in (ALLOW[0], ALLOW[2], ALLOW[3]))


def stretches(candidate: str) -> Iterator[tuple[int, int]]:
    """What lies between the alphabets in order: a window that overlaps none of them lies in one of these."""
    at = 0
    for m in _IN_ORDER.finditer(candidate):
        if at < m.start():
            yield at, m.start()
        at = max(at, m.end(1))
    yield at, len(candidate)


def mixed(name: str, kinds: list[int]) -> bool:
    lower, upper, digit = kinds
    return bool(digit and (lower or upper)) if name == "entropy_hex" else bool(lower and upper and digit)


def hot_windows(s: str, c: CharacterClass) -> Iterator[tuple[int, int]]:
    """Merged spans of `s` whose windows reach c.bits of Shannon entropy; counts are kept up to date step by step.

    With counts n of a window of w characters the entropy is log2 w - sum(n log2 n) / w; one step changes two terms of the sum.
    """
    w = c.window
    term = [0.0, *(n * math.log2(n) for n in range(1, w + 1))]
    counts: dict[str, int] = {}
    total, kinds, begun, end = 0.0, [0, 0, 0], -1, -1
    kind = lambda ch: 0 if "a" <= ch <= "z" else 1 if "A" <= ch <= "Z" else 2 if "0" <= ch <= "9" else None
    for i, ch in enumerate(s):
        if i >= w:
            old = s[i - w]
            n = counts[old]
            total += term[n - 1] - term[n]
            counts[old] = n - 1
            if (k := kind(old)) is not None:
                kinds[k] -= 1
        n = counts.get(ch, 0)
        total += term[n + 1] - term[n]
        counts[ch] = n + 1
        if (k := kind(ch)) is not None:
            kinds[k] += 1
        if i >= w - 1 and math.log2(w) - total / w >= c.bits and mixed(c.name, kinds):
            if i - w + 1 > end:
                if begun >= 0:
                    yield begun, end
                begun = i - w + 1
            end = i + 1
    if begun >= 0:
        yield begun, end


_CANDIDATE = [(c, re.compile(c.run)) for c in CLASSES]


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every span of `text`, in order; code points, end exclusive."""
    found = []
    for k, (name, pattern, group, least) in enumerate(BASE):
        for m in _FAST.get(name, pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end()))
    for k, (c, pattern) in enumerate(_CANDIDATE, len(BASE)):
        for m in pattern.finditer(text):
            if not allowed(m[0]):
                for at, end in stretches(m[0]):
                    found += [(m.start() + at + a, k, m.start() + at + b) for a, b in hot_windows(m[0][at:end], c)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row's whole text. A null text is an empty one.

    base_sha256 is of the base spans alone; spans holds all, kind:start:end, by start, then kind in the order of KINDS.
    """
    schema = "doc_id {}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string".format(docs.schema["doc_id"].dataType.simpleString())

    def spans(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            found = [scan(t or "") for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(k == i for _, k, _ in f) for f in found], pa.int64()) for i in range(len(BASE))]
            sha = [hashlib.sha256(joined([x for x in f if x[1] < len(BASE)]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array([joined(f) for f in found], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(spans, schema)
