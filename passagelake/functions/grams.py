"""Word 3-grams of whole texts as 64-bit hashes, made from the UTF-8 bytes of an Arrow column.

The words are those of ``match_words``; no object is made per word. Texts are handled in slices of bounded bytes, at least one each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2_000_000
GRAM = 3

_rng = np.random.default_rng(20251203)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FACTORS = _rng.integers(1, 2**63, GRAM, dtype=np.uint64) | np.uint64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_tables: dict[int, np.ndarray] = {}

#: 1: letters and digits in lower case, $ and @; 2: characters of a word that are cut off at its ends.
_KIND = np.zeros(256, np.uint8)
_KIND[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789$@", np.uint8)] = 1
_KIND[np.frombuffer(b"._-", np.uint8)] = 2


def _powers(base: int, n: int) -> np.ndarray:
    if len(_tables.get(base, ())) <= n:
        steps = np.full(2 * n + 1, base, np.uint64)
        steps[0] = 1
        _tables[base] = np.multiply.accumulate(steps)
    return _tables[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, text)`` of the words of texts in lower case that lie in ``data`` between consecutive ``offsets``."""
    kind = _KIND[data]
    inside = kind > 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads], ends[tails] = inside[heads], inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # from the first to the last character that is not cut off
    solid = np.flatnonzero(kind == 1)
    low, high = np.searchsorted(solid, start), np.searchsorted(solid, end)
    low, high = low[high > low], high[high > low]
    start, end = solid[low], solid[high - 1] + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data))[: len(data)], out=total[1:])
    hashes = _mix((total[end] - total[start]) * _powers(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(offsets, start, "right") - 1


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, text by text, and the number of each text; a text of fewer words is one gram."""
    words, text = _word_hashes(data, offsets)
    n, texts = len(words), len(offsets) - 1
    last = max(n - GRAM + 1, 0)
    runs = sum((words[j : last + j] * _FACTORS[j] for j in range(GRAM)), np.zeros(last, np.uint64))
    whole = text[:last] == text[GRAM - 1 :] if last else np.zeros(0, bool)
    hashes, own = [_mix(runs[whole])], [text[:last][whole]]
    first = np.searchsorted(text, np.arange(texts + 1))
    for held in range(1, GRAM):
        short = np.flatnonzero(np.diff(first) == held)
        joined = sum((words[first[short] + j] * _FACTORS[j] for j in range(held)), np.zeros(len(short), np.uint64))
        hashes.append(_mix(_mix(joined) ^ np.uint64(held)))
        own.append(short)
    hashes, own = np.concatenate(hashes), np.concatenate(own)
    order = np.lexsort((hashes, own))
    hashes, own = hashes[order], own[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
    return hashes[new], own[new]


def gram_lists(df: DataFrame, key: Column, text: Column, name: str) -> DataFrame:
    """``key`` and ``name``: the distinct word 3-grams of each row's text, as ``word_grams(match_words(text))`` has them."""
    rows = df.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("_words"))
    own = rows.columns[0]

    def run(batches):
        for b in batches:
            column = b.column("_words").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = column.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
                hashes, texts = _grams(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                bounds = np.searchsorted(texts, np.arange(to - at + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes.view(np.int64)))
                yield pa.record_batch([b.column(own).slice(at, to - at), lists], [own, name])
                at = to

    return rows.mapInArrow(run, f"{own} {rows.schema[0].dataType.simpleString()}, {name} array<long>")
