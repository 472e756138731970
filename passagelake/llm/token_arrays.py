"""Words of many texts as numpy arrays: boundaries and 64-bit hashes straight from the UTF-8 bytes of an Arrow column.

No Python object is made per word. Texts are handled in slices of bounded bytes (at least one text each), so memory follows
the slice and the longest text. Words are identified by 64-bit hashes; two different words or shingles of one comparison share
a hash with a probability of about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Word bytes: everything but the ASCII blanks; ASCII letters, digits and everything beyond ASCII; all but the line end.
NOT_BLANK = ~_bytes_in((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = _bytes_in((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NOT_LINE_END = ~_bytes_in((0x0A, 0x0A))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _length(n: int) -> int:
    """Length of a table that holds 0 to ``n``: every worker keeps its tables, so they are little longer than the longest slice."""
    return 1 << n.bit_length()


def _powers_up_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) <= n:
        steps = np.full(_length(n), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


@dataclass
class Words:
    """Words of a run of texts: ``doc`` is the text's number in the run, ``first`` the index of each text's first word."""

    texts: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def of(self, d: int) -> slice:
        return slice(self.first[d], self.first[d + 1])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return offsets, np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)


def find_words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool) -> Words:
    """Words of the texts that lie in ``data`` between consecutive ``offsets``; no word spans two texts."""
    n, texts = len(data), len(offsets) - 1
    inside = word_bytes[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads], ends[tails] = inside[heads], inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if lower:
        data = _LOWER[data]
    power = _powers_up_to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    # multiplied up to one common power, so a word has the same hash wherever it stands; the length tells apart zero sums
    hashed = mix((total[end] - total[start]) * _powers_of(n, start) + (end - start).astype(np.uint64))
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets, "left")
    return Words(texts, data, start, end, doc, first, hashed)


_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_inverses = np.ones(1, np.uint64)


def _powers_of(n: int, start: np.ndarray) -> np.ndarray:
    global _inverses
    if len(_inverses) <= n:
        steps = np.full(_length(n), _INVERSE, np.uint64)
        steps[0] = 1
        _inverses = np.multiply.accumulate(steps)
    return _inverses[start]


def word_slices(column: pa.Array, word_bytes: np.ndarray = NOT_BLANK, lower: bool = True, most: int = SLICE_BYTES) -> Iterator[tuple[int, Words]]:
    """``(number of the first text, its Words)`` for consecutive slices of ``column``; a null text has no words."""
    offsets, data = _buffers(column)
    at, last = 0, len(offsets) - 1
    while at < last:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        base = offsets[at]
        yield at, find_words(data[base : offsets[to]], offsets[at : to + 1] - base, word_bytes, lower)
        at = to


def windows(words: Words, n: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, text, first word)`` of every run of ``n`` words inside one text.

    With ``whole_if_short`` a text of 1 to n-1 words gives its whole sequence as one run, kept apart from full runs.
    """
    total = len(words.hash)
    rng = np.random.default_rng(77 + n)
    factors = rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
    if total >= n:
        last = total - n + 1
        ok = np.flatnonzero(words.doc[:last] == words.doc[n - 1 :])
        combined = words.hash[:last] * factors[0]
        for j in range(1, n):
            combined += words.hash[j : last + j] * factors[j]
        hashes, texts, at = mix(combined[ok]), words.doc[ok], ok
    else:
        hashes, texts, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < n)) if whole_if_short else ()
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k, d in enumerate(short):
            own = words.hash[words.of(d)]
            extra[k] = (own * factors[: len(own)]).sum(dtype=np.uint64) ^ (np.uint64(len(own)) << np.uint64(56))
        hashes = np.concatenate([hashes, mix(mix(extra))])
        texts = np.concatenate([texts, short])
        at = np.concatenate([at, words.first[short]])
        order = np.argsort(texts, kind="stable")
        hashes, texts, at = hashes[order], texts[order], at[order]
    return hashes, texts, at


def distinct_per_text(hashes: np.ndarray, texts: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, texts in order, and where each text's share begins (length ``n_texts + 1``).

    ``texts`` must be non-decreasing.
    """
    bounds = np.searchsorted(texts, np.arange(n_texts + 1))
    out = hashes.copy()
    for d in range(n_texts):
        out[bounds[d] : bounds[d + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (texts[1:] != texts[:-1])
    before = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], before[bounds]


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary cell per text from a flat array and the bounds of each text's share."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])
