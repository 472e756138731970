"""Operator 13: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints link at ``radius`` or fewer differing bits, that is, when some value lies within half the radius of both. Every
distinct fingerprint stands for all its variants, the values within ``radius // 2`` flipped bits (2 081 for radius 4), and
fingerprints that share a variant link: they are within twice half the radius, so all that share one variant are one group and
link to its smallest, never pair by pair.

Variants are shuffled by their leading bits. A fingerprint goes once to every cell, a value of the leading bits, in which it has
variants, with the flips it has left; the rest of the variants are made from it inside the cell's task. A row so carries up to
thousands of variants. A cell with more than ``CELL`` rows is split by further bits, up to all 64, where a cell is one variant;
so neither a dense region of near copies nor any other hot cell reaches one task whole. Inside a task cells are split in the same
way, bit by bit, until their variants fit in bounded arrays, and cells with one fingerprint are left out.

Colliding pairs are deduplicated and verified on all bits in the task, merged to one row for each fingerprint of the cell that
links, and joined to components over all cells.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.llm.components import components
from passagelake.sources.stores import materialise

BITS = 64
SEED = 42
#: Rows that a cell may hold before it is split in Spark, and variants that a task makes at a time.
CELL, VARIANTS = 60_000, 2_000_000
#: Bits by which a cell that is too large is split.
STEP = 6

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_COUNTED = 1 << 15


def _fingerprint(text: str | None, n: int) -> int:
    """Majority bits of the shingles' hashes, repeats included; zero without words."""
    words = _WORD.findall((text or "").encode().lower())  # bytes: lower() changes A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > n:
        starts, ends = starts[: len(words) - n + 1], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    total, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), _COUNTED):  # bounded memory for a text of any length
        spans = zip(starts[k : k + _COUNTED].tolist(), ends[k : k + _COUNTED].tolist())
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each row's whole text as a signed 64-bit number."""

    def run(batches):
        for b in batches:
            found = np.array([_fingerprint(t.as_py(), words) for t in b.column("text")], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _ball(bits: int, flips: int) -> int:
    return sum(comb(bits, k) for k in range(flips + 1))


@lru_cache(maxsize=512)
def _masks(bits: int, flips: int) -> np.ndarray:
    """All masks of at most ``flips`` of the lowest ``bits`` bits."""
    return np.array([sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(bits), k)], np.uint64)


def _deeper(rows: DataFrame, bits: int, by: int, half: int) -> DataFrame:
    """``cell, fp, flips`` with cells of ``bits`` leading bits longer by ``by``: a row for each longer cell that the flips reach."""
    masks = F.array(*[F.lit(int(m)).cast("long") for m in _masks(by, half)])
    own = F.shiftrightunsigned("fp", BITS - bits - by).bitwiseAND(F.lit((1 << by) - 1))
    reached = F.filter(masks, lambda m: F.bit_count(m) <= F.col("flips"))
    longer = F.shiftleft("cell", by).bitwiseOR(own.bitwiseXOR(F.col("mask")))
    out = rows.select("cell", "fp", "flips", F.explode(reached).alias("mask"))
    return out.select(longer.alias("cell"), "fp", (F.col("flips") - F.bit_count("mask")).cast("int").alias("flips"))


def _first_bits(n: int, half: int, cell: int) -> int:
    """Leading bits for ``n`` fingerprints, so that cells of evenly spread ones hold about half of what a cell may."""
    return next(b for b in range(BITS) if 2 * n * _ball(b, half) <= cell << b)


def _cells(fps: DataFrame, half: int, cell: int) -> DataFrame:
    """``bits, cell, fp, flips``: every fingerprint in every cell where it has variants, no cell with more than ``cell`` rows.

    At most 2 ** (rest of the bits) times a ball's size different fingerprints have variants in a cell, so splitting ends.
    """
    bits, done = 0, []
    rows, by = fps.select(F.lit(0).cast("long").alias("cell"), "fp", F.lit(half).alias("flips")), _first_bits(fps.count(), half, cell)
    while True:
        rows = materialise(_deeper(rows, bits, by, half), "cells")
        bits += by
        large = materialise(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("cell"), "large-cells")
        done.append(rows.join(large, "cell", "left_anti").withColumn("bits", F.lit(bits)))
        if bits == BITS or large.isEmpty():
            break
        rows, by = rows.join(large, "cell", "left_semi"), min(STEP, BITS - bits)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _shared_variants(fp: np.ndarray, flips: np.ndarray, bits: int, most: int):
    """Pairs ``(first, other)`` of positions in ``fp`` that share a variant, rows of one cell of ``bits`` leading bits; at most ``most`` variants at a time."""
    todo = [(np.arange(len(fp)), flips, bits)]
    while todo:
        rows, left, depth = todo.pop()
        if len(rows) < 2:
            continue
        rest = BITS - depth
        sizes = np.array([_ball(rest, k) for k in range(int(left.max()) + 1)])
        if depth < BITS and int(sizes[left].sum()) > most:
            bit = (fp[rows] >> np.uint64(rest - 1)) & np.uint64(1)
            for value in (0, 1):
                after = left - (bit != value)
                stay = after >= 0
                todo.append((rows[stay], after[stay], depth + 1))
            continue
        low = np.uint64((1 << rest) - 1)
        made, owner = [], []
        for k in np.unique(left).tolist():
            own, masks = rows[left == k], _masks(rest, k)
            made.append(((fp[own] & low)[:, None] ^ masks[None, :]).ravel())
            owner.append(np.repeat(own, len(masks)))
        variants, owners = np.concatenate(made), np.concatenate(owner)
        ordered = np.sort(variants)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(shared):
            continue
        hit = shared[np.minimum(np.searchsorted(shared, variants), len(shared) - 1)] == variants
        variants, owners = variants[hit], owners[hit]
        order = np.lexsort((fp[owners], variants))
        variants, owners = variants[order], owners[order]
        heads = np.concatenate([[True], variants[1:] != variants[:-1]])
        first = owners[np.flatnonzero(heads)[np.cumsum(heads) - 1]]
        both = np.unique(np.stack([first[~heads], owners[~heads]]), axis=1)
        yield both[0], both[1]


def _groups(n: int, pairs) -> np.ndarray:
    """The smallest position that each of ``n`` positions reaches by ``pairs``."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
    return label


def links(fps: DataFrame, radius: int = 4, cell: int = CELL, variants: int = VARIANTS) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints ``fp`` that join all that link at ``radius`` or fewer bits, directly or by others.

    Linear in the fingerprints' cells: a fingerprint gives at most one row for each cell where it links. ``radius`` must be even.
    """
    if radius % 2:
        raise ValueError("the radius must be even: variants at half of it on both sides")
    half = radius // 2

    def run(key, table):
        fp = table.column("fp").to_numpy().view(np.uint64)
        flips = table.column("flips").to_numpy().astype(np.int64)

        def verified():
            for a, b in _shared_variants(fp, flips, key[0].as_py(), variants):
                near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
                yield a[near], b[near]

        label = _groups(len(fp), verified())
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"a": fp[moved].view(np.int64), "b": fp[label[moved]].view(np.int64)})

    return _cells(fps, half, cell).groupBy("bits", "cell").applyInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, cell: int = CELL) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs`` (``doc_id``, ``text``); ``fp`` is a signed 64-bit number.

    Words lie between ASCII blanks, A-Z in lower case; shingles are ``words`` words with a space between, repeats included; a text
    with fewer words is one shingle. A null or empty text and one without words has fingerprint zero and is linked like any other.
    ``component_id`` is the smallest doc_id that links reach. Repeated rows and equal fingerprints are compared once. A row without
    doc_id links like any other but never names a component; a component without any doc_id has a null id. A table without rows
    gives none. Other columns are not read.
    """
    rows = materialise(fingerprints(docs, words), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct-fingerprints")
    label = components(links(fps.select("fp"), radius, cell), "links")
    named = fps.join(label, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_fp = named.join(smallest, "component").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """``fp`` of ``simhash_components`` as 16 lower-case hex digits, ``fingerprint``."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
