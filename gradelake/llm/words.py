"""Hashes of all words of a batch of texts, in a few numpy passes over their UTF-8 bytes.

A word's hash is a polynomial of its bytes modulo 2**64, mixed. ASCII capitals count as small letters. Bytes are read in chunks of
CHUNK, words that cross a chunk are put together, so memory follows the number of words and not the bytes of one text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words are runs of bytes that the pattern (of one character, for words) matches; bytes of 128 and more always do."""

    def __init__(self, character: str):
        fits = re.compile(character)
        self.word = np.array([b >= 128 or bool(fits.fullmatch(chr(b).lower() if chr(b).isupper() else chr(b))) for b in range(256)])
        lower = np.arange(256)
        lower[65:91] += 32
        self.value = np.where(self.word, mix(lower.astype(np.uint64) + np.uint64(1)), np.uint64(0))
        self.up, self.down = _powers(_BASE, CHUNK + 1), _powers(_INVERSE, CHUNK + 1)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, bounds): text i, data[offsets[i]:offsets[i + 1]], has hashes[bounds[i]:bounds[i + 1]]."""
        first, last = int(offsets[0]), int(offsets[-1])
        begins = np.zeros(last - first + 1, bool)
        begins[offsets - first] = True  # a text begins (or ends) at this byte
        hashes: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        carry, carried = 0, 0
        for at in range(first, last, CHUNK):
            b = data[at : min(at + CHUNK, last)]
            n = len(b)
            is_word = self.word[b]
            cut = begins[at - first : at - first + n]
            before = np.empty(n, bool)
            before[0] = carried > 0
            before[1:] = is_word[:-1]
            start = np.flatnonzero(is_word & (~before | cut))
            if carried and not (is_word[0] and not cut[0]):  # the word of the last chunk ended with it
                hashes.append(np.array([carry], np.uint64))
                ends.append(np.array([at - 1]))
                carry, carried = 0, 0
            if carried:
                start = np.concatenate([[0], start])
            stop = np.flatnonzero(is_word & np.concatenate([~is_word[1:] | cut[1:], [True]])) + 1
            if not len(start):
                continue
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.value[b] * self.up[:n], out=sums[1:])
            raw = (sums[stop] - sums[start]) * self.down[start]
            if carried:
                raw[0] = (carry + int(raw[0]) * pow(_BASE, carried, 1 << 64)) & _MASK
                length = carried + int(stop[0])
            else:
                length = int(stop[0] - start[0])
            carry, carried = 0, 0
            if stop[-1] == n and at + n < last and not begins[at + n - first]:
                carry = int(raw[-1])
                carried = length if len(start) == 1 else int(stop[-1] - start[-1])
                raw, stop = raw[:-1], stop[:-1]
            hashes.append(raw)
            ends.append(at + stop - 1)
        if carried:
            hashes.append(np.array([carry], np.uint64))
            ends.append(np.array([last - 1]))
        every = mix(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        return every, np.searchsorted(np.concatenate(ends) if ends else np.empty(0, int), offsets)

    def of_arrow(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of a string column; a null is an empty text."""
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        text = text.fill_null("").cast(pa.large_string())
        if not len(text):
            return np.empty(0, np.uint64), np.zeros(1, int)
        _, offsets, data = text.buffers()
        at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
        return self.of(np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at)
