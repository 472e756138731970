"""Operator 1: exact Jaccard join of word n-gram sets in metric space, up to connected components.

Documents with equal sets are one class. The Jaccard distance d = 1 - |a & b| / |a | b| is a metric, and classes link when
d <= r. The join runs in these steps:

1. First Voronoi split. The pivots are the single n-grams, ordered by a count sketch of the whole corpus (rare first). A class
   belongs to the regions of its first ``n - ceil(s n) + 1`` n-grams, its window: two sets that link share one of them. Frequent
   n-grams come last in every set, so a passage that many documents share makes no region of its own. Only the window is
   shuffled. A member leaves a region where its rank shows that no partner can be near, and regions with the same members are
   one region. Sets also meet in the region of their smallest n-gram in two random orders; these are tried first, once.
2. Recursion. Each region that holds more than one component picks pivot documents, those with the fewest n-grams of their own
   first, as they lie in the middle of a group of near copies; more in each round. Distances to the pivots are
   computed once for each different pair: bounded from below by parities of the sets, exactly where the bound leaves a link open. A pivot is done after its round. A member x in the middle pivot's component stays
   only if the triangle inequality leaves a link open: if some member y outside that component has d(y, p) <= d(x, p) + r. Such
   boundary members are carried into the next round with the members outside.
3. Links are joined to components; every row gets its class's component.

All steps are exact for every order, sketch and choice of pivots, which only decide how much work is done. Members of one
component are never compared with each other again, so a group of n near copies costs a few times n distances, not n * n.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.llm.components import components
from passagelake.llm.token_arrays import NOT_BLANK, binaries, distinct_per_text, mix, windows, word_slices
from passagelake.sources.stores import materialise

SLOT_BITS = 20
_BLOCKS = 128
#: Text whose n-grams a task makes at a time: sets of it take about forty times as much memory for a moment.
SLICE_BYTES = 1_000_000


def _sets(column: pa.Array, n: int):
    """``(first row, sorted distinct hashes, bounds)`` of slices of texts."""
    for at, words in word_slices(column, NOT_BLANK, most=SLICE_BYTES):
        hashes, texts, _ = windows(words, n, True)
        yield at, *distinct_per_text(hashes, texts, words.texts)


def _class_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set (0 for the empty one): equal sets have equal ids."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0xA24BAED4963EE407)), dtype=np.uint64)])
    size = np.diff(bounds).astype(np.uint64)
    return np.where(size == 0, 0, mix(total[bounds[1:]] - total[bounds[:-1]] + size)).view(np.int64)


def _parities(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each set, one bit for every remainder of its hashes: whether an odd number of them have it; at least two bits a hash."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        bits = 1 << max(6, (2 * (b - a) - 1).bit_length())
        slots = (hashes[a:b] & np.uint64(bits - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(slots, minlength=bits) & 1).astype(np.uint8)).tobytes())
    return pa.array(out, pa.binary())


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """One pass over the texts: a row ``doc_id, key, n, cls, parity`` for each document and, per task, rows ``block, counts`` of the sketch."""

    names = ["doc_id", "key", "n", "cls", "parity", "block", "counts"]

    def run(batches):
        counts = np.zeros(1 << SLOT_BITS, np.int32)
        for b in batches:
            for at, hashes, bounds in _sets(b.column("text"), n):
                counts += np.bincount((hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS).astype(np.int32)
                rows = len(bounds) - 1
                yield pa.record_batch(
                    [b.column("doc_id").slice(at, rows), b.column("key").slice(at, rows), pa.array(np.diff(bounds)), pa.array(_class_ids(hashes, bounds)), _parities(hashes, bounds), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                    names,
                )
        parts = counts.reshape(_BLOCKS, -1)
        full = [i for i in range(_BLOCKS) if parts[i].any()]
        none = pa.nulls(len(full), pa.int64())
        sums = pa.array([parts[i].tobytes() for i in full], pa.binary())
        yield pa.record_batch([none, none, none, none, pa.nulls(len(full), pa.binary()), pa.array(full, pa.int32()), sums], names)

    return docs.mapInArrow(run, "doc_id long, key long, n long, cls long, parity binary, block int, counts binary")


def _levels(scanned: DataFrame) -> np.ndarray:
    """The sketch as one byte per slot (eight steps per doubling); its size does not depend on the corpus."""

    def merged(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
        level = lambda c: np.minimum(255, np.round(8 * np.log2(1 + c))).astype(np.uint8).tobytes()
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([level(c) for c in held.values()], pa.binary())], ["block", "levels"])

    parts = scanned.where("block is not null").select("block", "counts").repartition(8, "block").mapInArrow(merged, "block int, levels binary")
    out = np.zeros((_BLOCKS, (1 << SLOT_BITS) // _BLOCKS), np.uint8)
    for row in parts.toLocalIterator():  # 128 rows, 1 MB together
        out[row["block"]] = np.frombuffer(row["levels"], np.uint8)
    return out.reshape(-1)


#: Orders of all n-grams whose smallest member gives a set its first regions, before the windows.
_EARLY = (np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC2B2AE3D27D4EB4F))


def _window_rows(docs: DataFrame, n: int, levels: np.ndarray, top: int, bottom: int) -> DataFrame:
    """``region, cls, n, rank, early``: the n-grams of each set's window, and its smallest n-grams in other orders (early).

    Sets that repeat inside a batch are written once. ``rank`` counts the n-grams that come before in the set.
    """

    def run(batches):
        for b in batches:
            done: set[int] = set()
            for _, hashes, bounds in _sets(b.column("text"), n):
                ids, sizes = _class_ids(hashes, bounds), np.diff(bounds)
                key = (levels[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))
                picked, owners, ranks, smallest = [], [], [], []
                for d in np.flatnonzero(sizes).tolist():
                    if (cls := int(ids[d])) in done:
                        continue
                    done.add(cls)
                    size = int(sizes[d])
                    window = size - -(-size * top // bottom) + 1
                    # equal keys keep the order of the hashes, so every set orders any two n-grams alike
                    picked.append(bounds[d] + np.argsort(key[bounds[d] : bounds[d + 1]], kind="stable")[:window])
                    owners.append(np.full(window, d))
                    ranks.append(np.arange(window))
                    smallest.append([int((hashes[bounds[d] : bounds[d + 1]] * f).min()) for f in _EARLY])
                if not picked:
                    continue
                own, heads = np.concatenate(owners), np.array([int(o[0]) for o in owners])
                early = mix(np.array(smallest, np.uint64) + np.arange(1, len(_EARLY) + 1, dtype=np.uint64)).T.ravel()
                regions = np.concatenate([hashes[np.concatenate(picked)], early])
                cls = np.concatenate([ids[own], np.tile(ids[heads], len(_EARLY))])
                size = np.concatenate([sizes[own], np.tile(sizes[heads], len(_EARLY))]).astype(np.int32)
                rank = np.concatenate([*ranks, np.zeros(len(early), np.int64)]).astype(np.int32)
                yield pa.record_batch([pa.array(regions.view(np.int64)), pa.array(cls), pa.array(size), pa.array(rank), pa.array(np.arange(len(regions)) >= len(own))], ["region", "cls", "n", "rank", "early"])

    return docs.select("text").mapInArrow(run, "region long, cls long, n int, rank int, early boolean")


def _shared(members: DataFrame) -> DataFrame:
    """The members of regions that hold two classes or more."""
    two = members.groupBy("region").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("region")
    return members.join(two, "region", "left_semi")


def _regions(rows: DataFrame, top: int, bottom: int) -> DataFrame:
    """``region, cls, n, rank, early, depth``: regions of two or more classes; of regions with equal members, one with the smallest ranks.

    If an n-gram at rank i of a and j of b is their first common one, they share at most min(n(a) - i, n(b) - j). A member whose
    n - rank is too little for the region's smallest set therefore finds no partner there and leaves.
    """
    members = materialise(_shared(rows).groupBy("region", "cls").agg(F.min("n").alias("n"), F.min("rank").alias("rank"), F.max("early").alias("early")), "regions")
    least = members.groupBy("region").agg(F.min("n").alias("least"))
    able = F.lit(top + bottom) * (F.col("n") - F.col("rank")) >= F.lit(top) * (F.col("n") + F.col("least"))
    members = materialise(_shared(members.join(least, "region").where(able).drop("least")), "regions")
    same = members.groupBy("region", "early").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    kept = materialise(same.groupBy("early", "k", "x", "y").agg(F.min("region").alias("kept")).join(same, ["early", "k", "x", "y"]).select("region", "kept"), "kept")
    joined = members.join(kept, "region").groupBy(F.col("kept").alias("region"), "cls")
    members = materialise(joined.agg(F.min("n").alias("n"), F.min("rank").alias("rank"), F.max("early").alias("early")), "regions")
    # a class that no window shares has no link; few n-grams of its own before the first shared one put a class near the middle
    depth = members.where("not early").groupBy("cls").agg(F.min("rank").alias("depth"))
    return materialise(members.join(depth, "cls"), "regions")


def _differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits that differ, the longer row folded to the shorter: two sets differ in at least so many members."""
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets_of(docs: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """``cls, n, content`` of the given classes (``cls``, and ``_d, _k``: id and text hash of one document): the sorted 64-bit hashes as bytes."""

    def run(batches):
        done: set[int] = set()  # repeated rows bring a set again
        for b in batches:
            for at, hashes, bounds in _sets(b.column("text"), n):
                cls = b.column("cls").slice(at, len(bounds) - 1)
                fresh = [c not in done and not done.add(c) for c in cls.to_pylist()]
                yield pa.record_batch([cls, pa.array(np.diff(bounds)), binaries(hashes, bounds)], ["cls", "n", "content"]).filter(pa.array(fresh, pa.bool_()))

    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))
    return docs.join(places, same).select("cls", "text").mapInArrow(run, "cls long, n long, content binary").dropDuplicates(["cls"])


def _with_sides(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with content and size of both of their sets."""
    side = lambda cls, name: sets.select(F.col("cls").alias(cls), F.col("content").alias(name), F.col("n").alias(f"n_{cls}"))
    return pairs.join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right", "n_a", "n_b")


def _bounds(pairs: DataFrame, parities: DataFrame, top: int, bottom: int) -> DataFrame:
    """``a, b, most, near``: what two classes share at most by the parities of their sets, and whether they may link at that."""

    def run(batches):
        for b in batches:
            left, right = b.column("left"), b.column("right")
            sizes = np.asarray(b.column("n_a")) + np.asarray(b.column("n_b"))
            apart = [_differing(np.frombuffer(left[i].as_buffer(), np.uint8), np.frombuffer(right[i].as_buffer(), np.uint8)) for i in range(b.num_rows)]
            most = (sizes - np.array(apart, np.int64)) // 2
            yield pa.record_batch([b.column("a"), b.column("b"), pa.array(most), pa.array(bottom * most >= top * (sizes - most))], ["a", "b", "most", "near"])

    return _with_sides(pairs, parities).mapInArrow(run, "a long, b long, most long, near boolean")


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, common`` of pairs of classes by their whole sets."""

    def run(batches):
        for b in batches:
            left, right = b.column("left"), b.column("right")
            common = []
            for i in range(b.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                common.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()))
            yield pa.record_batch([b.column("a"), b.column("b"), pa.array(common, pa.int64())], ["a", "b", "common"])

    return _with_sides(pairs, sets).mapInArrow(run, "a long, b long, common long")


#: Pivots of a region in the early round, in the first round of the windows, and how many times more in each next one.
EARLY_PIVOTS, PIVOTS, MORE = 2, 1, 8


def _merged(label: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``cls, component`` after ``links`` joined components of ``label``; classes without a row are their own component.

    With ``rounds`` some links may stay open: equal labels are one component, but not the other way round.
    """
    name = lambda side: F.coalesce(F.col(f"{side}.component"), F.col(side[1:]))
    ends = links.join(label.alias("_a"), F.col("a") == F.col("_a.cls"), "left").join(label.alias("_b"), F.col("b") == F.col("_b.cls"), "left")
    edges = materialise(ends.select(name("_a").alias("a"), name("_b").alias("b")).where("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return label
    moved = components(edges, "labels", rounds)
    old = label.join(moved.withColumnRenamed("component", "moved"), F.col("component") == F.col("node"), "left")
    new = moved.join(label, F.col("node") == F.col("cls"), "left_anti").select(F.col("node").alias("cls"), "component")
    return materialise(old.select("cls", F.coalesce("moved", "component").alias("component")).unionByName(new), "labels")


def _labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members with their component, of regions that hold more than one."""
    named = members.drop("component").join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = named.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("region")
    return named.join(mixed, "region", "left_semi")


class _Join:
    """State of the recursion: computed distances and the components so far."""

    def __init__(self, docs: DataFrame, scanned: DataFrame, places: DataFrame, n: int, top: int, bottom: int):
        spark = docs.sparkSession
        self.docs, self.places, self.n, self.top, self.bottom = docs, places, n, top, bottom
        at = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))
        # by the document too: a class of many copies is no join key
        own = scanned.join(places.withColumnRenamed("cls", "_c"), (F.col("cls") == F.col("_c")) & at).select("cls", "n", F.col("parity").alias("content"))
        self.parities = materialise(own.select("cls", "n", "content").dropDuplicates(["cls"]), "parities")
        self.label = spark.createDataFrame([], "cls long, component long")
        self.known: DataFrame | None = None
        self.links = spark.createDataFrame([], "a long, b long")

    def components(self) -> DataFrame:
        """``cls, component`` of all links."""
        return _merged(self.label, self.links)

    def _distances(self, pairs: DataFrame) -> DataFrame:
        """``a, b, common, exact``. Parities, a thirtieth of the sets, tell most pairs that cannot link: these get their bound as ``common``.

        Whole sets are made again from the texts, of the classes of the other pairs only; they are never stored for all.
        """
        bounds = materialise(_bounds(pairs, self.parities, self.top, self.bottom), "bounds")
        near = bounds.where("near").select("a", "b")
        ends = materialise(self.places.join(near.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls"), "ends")
        exact = _common(near, materialise(_sets_of(self.docs, ends, self.n), "sets")).withColumn("exact", F.lit(True))
        return exact.unionByName(bounds.where("not near").select("a", "b", F.col("most").alias("common"), F.lit(False).alias("exact")))

    def round(self, active: DataFrame, pivots: int) -> DataFrame | None:
        """Measure ``active`` members against up to ``pivots`` pivots per region; returns what stays, None if nothing is active."""
        # of each of so many slots of a region, the class nearest the middle; which classes share a slot changes with every round
        slot = F.pmod(F.xxhash64("cls", F.lit(pivots)), F.lit(pivots))
        best = F.min(F.struct("depth", "cls", "n", "rank", "component"))
        centres = active.groupBy("region").agg(best.alias("c")).select("region", F.col("c.cls").alias("middle"))
        chosen = active.groupBy("region", slot.alias("slot")).agg(best.alias("p")).join(centres, "region").select("region", "p", (F.col("p.cls") == F.col("middle")).alias("centre"))
        top, bottom = F.lit(self.top), F.lit(self.bottom)
        near_sizes = bottom * F.least("n", "pivot_n") >= top * F.greatest("n", "pivot_n")
        near_ranks = (top + bottom) * F.least(F.col("n") - F.col("rank"), F.col("pivot_n") - F.col("pivot_rank")) >= top * (F.col("n") + F.col("pivot_n"))
        open_ = (F.col("component") != F.col("pivot_component")) & near_sizes & near_ranks
        paired = active.join(chosen, "region").select(
            "region", "cls", "n", "rank", "depth", "component", "centre", F.col("p.cls").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.rank").alias("pivot_rank"),
            F.col("p.component").alias("pivot_component"), F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b"),
        )
        # all members meet the middle pivot; the other pivots meet only those that they may link to another component
        met = materialise(paired.where(F.col("centre") | (F.col("cls") == F.col("pivot")) | open_), "pivots")
        if met.isEmpty():
            return None
        asked = met.where(open_).select("a", "b").distinct()
        if self.known is not None:
            asked = asked.join(self.known, ["a", "b"], "left_anti")
        found = materialise(self._distances(asked), "distances")
        self.known = found if self.known is None else self.known.unionByName(found)
        joined = met.join(self.known, ["a", "b"], "left")
        union = F.col("n") + F.col("pivot_n") - F.col("common")
        measured = materialise(joined.withColumns({"low": 1 - F.col("common") / union, "linked": F.col("exact") & (bottom * F.col("common") >= top * union)}), "measured")
        links = materialise(measured.where("linked").select("a", "b").distinct(), "links")
        self.links = self.links.unionByName(links)
        # labels only save work here, so one round of merging is enough until the end
        self.label = _merged(self.label, links, 1)
        return self._left(measured)

    def _left(self, measured: DataFrame) -> DataFrame:
        """Without the pivots, and without members of the middle pivot's component that no member outside can reach."""
        radius, label = 1 - self.top / self.bottom, self.label
        named = (
            measured.drop("component", "pivot_component")
            .join(label, "cls", "left")
            .join(label.select(F.col("cls").alias("pivot"), F.col("component").alias("pivot_component")), "pivot", "left")
        )
        inside = F.coalesce("component", "cls") == F.coalesce("pivot_component", "pivot")
        judged = named.select("region", "cls", "n", "rank", "depth", "centre", "pivot", "low", F.when(F.col("exact"), F.col("low")).alias("d"), inside.alias("inside"))
        # a pair that was not measured does not link, so its distance is over the radius; a bounded one is at least at its bound
        outside = judged.where("centre and not inside").groupBy("region").agg(F.min(F.coalesce("low", F.lit(radius))).alias("out"))
        gone = (F.col("cls") == F.col("pivot")) | (F.col("centre") & F.col("inside") & (F.col("out").isNull() | F.coalesce(F.col("out") > F.col("d") + radius + 1e-9, F.lit(False))))
        left = judged.join(outside, "region", "left").withColumn("gone", gone)
        left = left.groupBy("region", "cls").agg(F.min("n").alias("n"), F.min("rank").alias("rank"), F.min("depth").alias("depth"), F.max("gone").alias("gone")).where("not gone")
        return materialise(left.drop("gone"), "left")


def _class_components(docs: DataFrame, scanned: DataFrame, n: int, top: int, bottom: int) -> DataFrame:
    """``cls, component`` of all classes that link with another."""
    members = _regions(_window_rows(docs, n, _levels(scanned), top, bottom), top, bottom)
    first = scanned.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "key")).alias("at"))
    places = members.select("cls").distinct().join(first, "cls").select("cls", F.col("at.doc_id").alias("_d"), F.col("at.key").alias("_k"))
    join, pivots = _Join(docs, scanned.where("block is null"), materialise(places, "places"), n, top, bottom), PIVOTS
    join.round(_labelled(members.where("early"), join.label), EARLY_PIVOTS)
    left = members.where("not early")
    while left is not None:
        left = join.round(_labelled(left, join.label), pivots)
        pivots *= MORE
    return join.components()


def _with_components(docs: DataFrame, words: int, top: int, bottom: int) -> DataFrame:
    """``doc_id, key, n, component, component_id`` of every row; ``key`` is the hash of the text, ``component`` null for empty sets."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("key"))
    scanned = materialise(_scan(docs, words), "scan")
    rows = scanned.where("block is null").select("doc_id", "key", "n", "cls")
    label = _class_components(docs, scanned, words, top, bottom)
    first = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    named = first.join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(smallest, "component").select("cls", "component", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(of_class, "cls", "left").select("doc_id", "key", "n", F.when(F.col("n") > 0, F.col("component")).alias("component"), own.alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = 4, top: int = 85, bottom: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Words lie between ASCII blanks, A-Z in lower case. Two rows link when ``bottom * common >= top * union`` of their sets of
    ``words``-word shingles; a text with fewer words is one shingle. A null text or one without words has an empty set, links
    with nothing and is its own component. Repeated rows and equal texts are one class. A row without doc_id is compared like
    any other but never names a component; a component without any doc_id has a null id. Other columns are not read.
    """
    return _with_components(docs, words, top, bottom).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_per_group(docs: DataFrame, words: int, top: int, bottom: int) -> DataFrame:
    """One row of ``docs`` for each component: of its smallest doc_id and, should texts share that, of the smallest hash of the text.

    Of rows repeated in doc_id and text one stays. Texts without words are groups of their own. Rows without doc_id stay.
    """
    found = _with_components(docs, words, top, bottom).where("doc_id is not null")
    # a text without words: its own group by id and text
    group = [F.col("component"), F.when(F.col("component").isNull(), F.struct("doc_id", "key")).alias("empty")]
    least = found.groupBy(*group).agg(F.min(F.struct("doc_id", "key")).alias("p")).select(F.col("p.doc_id").alias("_d"), F.col("p.key").alias("_k"))
    copies = found.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.count("*").alias("_copies"))
    kept = materialise(copies.join(least.distinct(), ["_d", "_k"], "left_semi"), "kept")
    own = docs.select(F.struct("*").alias("_all"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_key"))
    known = own.join(kept, (F.col("_doc") == F.col("_d")) & (F.col("_key") == F.col("_k")))
    repeated = known.where("_copies > 1").groupBy("_d", "_k").agg(F.min_by("_all", F.hash("_all")).alias("_all"))
    return known.where("_copies = 1").select("_all").unionByName(repeated.select("_all")).unionByName(own.where("_doc is null").select("_all")).select("_all.*")
