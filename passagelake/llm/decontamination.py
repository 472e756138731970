"""Operator 9: benchmark decontamination by greedy string tiling.

Seeds are runs of ``seed`` words that a document shares with a benchmark text. They are found by hash in two steps: a bitmap of
fixed size, built from all benchmark runs, drops document runs that cannot match before anything is shuffled; the rest is joined
exactly. A pair (document, item) goes on if its shared runs could cover enough of the item. Pairs are then tiled: the longest
common runs that do not overlap earlier tiles are marked first (found by running Karp-Rabin, checked word by word), down to runs of
``seed`` words. A document is contaminated if the tiles cover ``coverage`` of an item's words, whatever their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.llm.token_arrays import ALPHANUMERIC, distinct_per_text, windows, word_slices
from passagelake.sources.stores import materialise

SEED = 4
COVERAGE = 0.8
BITMAP_BITS = 1 << 24


def _runs(column: pa.Array, seed: int, bitmap: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, hash, words of the text)`` of every run; with a bitmap, only of runs in it, and one per distinct run of a text."""
    for at, words in word_slices(column, ALPHANUMERIC):
        hashes, texts, _ = windows(words, seed, False)
        if bitmap is not None:
            hit = (bitmap[(hashes & np.uint64(BITMAP_BITS - 1)) >> np.uint64(3)] >> (hashes & np.uint64(7)).astype(np.uint8)) & 1 == 1
            hashes, bounds = distinct_per_text(hashes[hit], texts[hit], words.texts)
            texts = np.repeat(np.arange(words.texts), np.diff(bounds))
        yield at + texts, hashes.view(np.int64), words.counts[texts]


def _item_runs(items: DataFrame, seed: int) -> DataFrame:
    """``item_id, run, item_words, times``: how often each run stands in an item."""

    def run(batches):
        for b in batches:
            for rows, hashes, counts in _runs(b.column("text"), seed, None):
                yield pa.record_batch([b.column("item_id").take(pa.array(rows)), pa.array(hashes), pa.array(counts)], ["item_id", "run", "item_words"])

    runs = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    runs = runs.mapInArrow(run, "item_id long, run long, item_words long")
    return runs.groupBy("item_id", "run", "item_words").agg(F.count("*").alias("times"))


def _bitmap(runs: DataFrame) -> np.ndarray:
    """All benchmark runs in a bitmap of fixed size, merged from one bitmap per task in tasks of one block each."""
    blocks, size = 64, BITMAP_BITS // 8

    def local(batches):
        bits = np.zeros(size, np.uint8)
        for b in batches:
            h = b.column("run").to_numpy(zero_copy_only=False).view(np.uint64)
            np.bitwise_or.at(bits, ((h & np.uint64(BITMAP_BITS - 1)) >> np.uint64(3)).astype(np.int64), (1 << (h & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        parts = bits.reshape(blocks, -1)
        full = [i for i in range(blocks) if parts[i].any()]
        yield pa.record_batch([pa.array(full, pa.int32()), pa.array([parts[i].tobytes() for i in full], pa.binary())], ["block", "bits"])

    def merged(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column("block").to_pylist(), b.column("bits").to_pylist()):
                got = np.frombuffer(raw, np.uint8)
                held[i] = held[i] | got if i in held else got
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "bits"])

    parts = runs.select("run").mapInArrow(local, "block int, bits binary").repartition(8, "block").mapInArrow(merged, "block int, bits binary")
    out = np.zeros((blocks, size // blocks), np.uint8)
    for row in parts.toLocalIterator():  # at most 64 rows, 2 MB together
        out[row["block"]] |= np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def candidate_pairs(docs: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, row, item_id`` of pairs that share enough runs.

    A tile of n >= ``seed`` words holds n - seed + 1 of the item's runs, which is at least n / seed; so a pair whose shared
    runs, each as often as it stands in the item, stay below coverage / seed of the item's words cannot reach the coverage.
    """
    own = materialise(_item_runs(items, seed), "benchmark-runs")
    bitmap = _bitmap(own)

    def run(batches):
        for b in batches:
            for rows, hashes, _ in _runs(b.column("text"), seed, bitmap):
                at = pa.array(rows)
                yield pa.record_batch([b.column("doc_id").take(at), b.column("row").take(at), pa.array(hashes)], ["doc_id", "row", "run"])

    hits = docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, run long")
    return (
        hits.join(own, "run")
        .groupBy("doc_id", "row", "item_id", "item_words")
        .agg(F.sum("times").alias("runs"))
        .where(F.col("runs") * seed >= F.lit(coverage) * F.col("item_words"))
        .select("doc_id", "row", "item_id")
    )


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class _Free:
    """Words of a text of which some are marked, and the running Karp-Rabin hashes of the windows that hold no marked word."""

    def __init__(self, words: np.ndarray, marked: np.ndarray):
        self.words, self.marked = words, marked
        self.sums = np.append(np.uint64(0), np.cumsum(words.astype(np.uint64) * _powers(_BASE, len(words))[:-1], dtype=np.uint64))
        self.inverse = _powers(_INVERSE, len(words))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """``(start, hash)`` of the unmarked windows of ``length`` words."""
        if length > len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        before = np.append(0, np.cumsum(self.marked))
        at = np.flatnonzero(before[length:] == before[:-length])
        return at, (self.sums[at + length] - self.sums[at]) * self.inverse[at]


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(doc start, item start, length)`` of greedy string tiling, longest first; ties go to the earliest item, then doc start.

    The longest unmarked common run is found by halving: of each length tried, the hashes of all unmarked windows of both texts
    are compared. All tiles of that length are marked, words compared one by one, before a shorter length is looked for. An item
    of n words has tiles of at most about sqrt(2 n) lengths, so repetitive texts cost no more than that many passes.
    """
    foreign = ~np.isin(doc, item)
    # of words that the item lacks one is left between the stretches of others
    kept = np.flatnonzero(~foreign | np.append(False, ~foreign[:-1])[: len(doc)])
    own, other = _Free(doc[kept], foreign[kept]), _Free(item, ~np.isin(item, doc))
    out: list[tuple[int, int, int]] = []
    longest = min(len(kept), len(item))
    while longest >= least:
        low, high = least - 1, longest
        while low < high:
            middle = (low + high + 1) // 2
            if np.isin(other.windows(middle)[1], own.windows(middle)[1]).any():
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        places, hashes = own.windows(low)
        order = np.argsort(hashes, kind="stable")
        places, hashes = places[order], hashes[order]
        starts, wanted = other.windows(low)
        firsts, lasts = np.searchsorted(hashes, wanted), np.searchsorted(hashes, wanted, "right")
        passed: dict[int, int] = {}
        for j, first, last in zip(starts.tolist(), firsts.tolist(), lasts.tolist()):
            if first == last or other.marked[j : j + low].any():
                continue
            k = passed.get(first, first)
            while k < last and own.marked[places[k] : places[k] + low].any():
                k += 1
            passed[first] = k  # a window once marked stays so
            while k < last:
                p = int(places[k])
                if not own.marked[p : p + low].any() and (own.words[p : p + low] == item[j : j + low]).all():
                    own.marked[p : p + low] = other.marked[j : j + low] = True
                    out.append((int(kept[p]), j, low))
                    break
                k += 1
        longest = low - 1
    return out


def tiled(docs: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, row, item_id, covered, item_words, tiles`` of the pairs that reach ``coverage``."""
    pairs = materialise(candidate_pairs(docs, items, seed, coverage), "benchmark-pairs")
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"))
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r"))
    wanted = pairs.join(texts, "item_id").select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "item_id", "item_text")
    full = docs.select("doc_id", "row", "text").join(wanted, on)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                d_words = [w.hash[w.of(k)] for _, w in word_slices(part.column("text"), ALPHANUMERIC) for k in range(w.texts)]
                i_words = [w.hash[w.of(k)] for _, w in word_slices(part.column("item_text"), ALPHANUMERIC) for k in range(w.texts)]
                found = [tiles(d, i, seed) for d, i in zip(d_words, i_words)]
                covered = [sum(t[2] for t in x) for x in found]
                keep = [k for k in range(part.num_rows) if covered[k] >= coverage * len(i_words[k])]
                pick = lambda name: [part.column(name)[k].as_py() for k in keep]
                yield pa.record_batch(
                    [pa.array(pick("doc_id"), pa.int64()), pa.array(pick("row"), pa.int64()), pa.array(pick("item_id"), pa.int64()), pa.array([covered[k] for k in keep], pa.int64()), pa.array([len(i_words[k]) for k in keep], pa.int64()), pa.array([[{"doc_start": t[0], "item_start": t[1], "length": t[2]} for t in found[k]] for k in keep], _TILES)],
                    ["doc_id", "row", "item_id", "covered", "item_words", "tiles"],
                )

    schema = "doc_id long, row long, item_id long, covered long, item_words long, tiles array<struct<doc_start:int,item_start:int,length:int>>"
    done = full.select("doc_id", "row", "item_id", "text", "item_text").mapInArrow(run, schema)
    return materialise(done, "benchmark-tiles").dropDuplicates(["doc_id", "row", "item_id"])


_TILES = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))


def _with_row(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))


def decontaminate(docs: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """Per row of ``docs``: ``doc_id, contaminated, n_items, item_id, covered, item_words`` of the best covered item.

    Words are runs of letters and digits in lower case. Null, empty and short texts are clean, and an item of fewer than
    ``seed`` words cannot be found. Ties between items go to the smaller ``item_id``. Repeated rows get equal results. Other
    columns are not read.
    """
    own = _with_row(docs)
    best = F.max(F.struct((F.col("covered") / F.col("item_words")).alias("share"), (-F.col("item_id")).alias("key"), "covered", "item_words"))
    found = tiled(own, items, seed, coverage).groupBy("doc_id", "row").agg(F.count("*").alias("n"), best.alias("best"))
    found = found.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "n", "best")
    return (
        own.select("doc_id", "row")
        .join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left")
        .select(
            "doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).alias("n_items"),
            (-F.col("best.key")).alias("item_id"), F.col("best.covered").alias("covered"), F.col("best.item_words").alias("item_words"),
        )
    )


def without_benchmark(docs: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text, with all their columns."""
    found = tiled(_with_row(docs), items, seed, coverage).select(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).distinct()
    own = docs.select(F.struct("*").alias("_all"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_row"))
    kept = own.join(materialise(found, "contaminated"), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")), "left_anti")
    return kept.select("_all.*")
