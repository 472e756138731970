"""Operators on pairs and groups of documents against brute force."""

import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagelake.llm import decontamination, jaccard_join, line_dedup, substring_dedup, token_arrays
from passagelake.llm.components import components


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, top, bottom):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and bottom * len(sets[a] & sets[b]) >= top * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    least = lambda k: min((i for i in ids[find(k)] if i is not None), default=None)
    return sorted(((i, len(sets[k]), least(k) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def corpus(prose, seed=5):
    """Families of near copies, some on either side of the limit, around a passage that everything shares."""
    rng, rows = random.Random(seed), []
    shared = prose(30, 99)
    for family in range(12):
        base = prose(rng.choice([5, 12, 60, 150]), 1000 + family).split()
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = prose(1, rng.random())
            rows.append((len(rows), " ".join(words) + (" " + shared if family % 3 == 0 else "")))
    return rows


def test_sets_take_bounded_memory_for_any_number_of_texts():
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(map(str, rng.integers(0, 5000, 400))) for _ in range(4000)])  # 7.6 MB
    token_arrays._powers = token_arrays._inverses = np.ones(1, np.uint64)
    tracemalloc.start()
    try:
        sets = {at + d: bounds[d + 1] - bounds[d] for at, _, bounds in jaccard_join._sets(texts, 4) for d in range(len(bounds) - 1)}
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert sorted(sets) == list(range(4000)) and all(390 < n <= 397 for n in sets.values())
    assert kept < 30e6 and peak < 80e6


@pytest.mark.parametrize("n,top,bottom", [(4, 85, 100), (5, 4, 5)])
def test_jaccard_components(make, prose, odd, n, top, bottom):
    rows = corpus(prose) + [(100 + (i or 0), t) if i is not None else (None, t) for i, t in odd]
    got = jaccard_join.jaccard_components(make(rows), n, top, bottom)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows, n, top, bottom)


def test_jaccard_stage_and_empty_table(make, prose):
    rows = corpus(prose)
    kept = jaccard_join.one_per_group(make(rows), 5, 4, 5)
    assert kept.columns == make([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows, 5, 4, 5)})
    text = prose(20, 4)
    again = [(1, text), (1, text), (2, text), (3, None), (3, None), (3, ""), (None, text), (None, text), (4, prose(20, 8))]
    left = sorted((str(r.doc_id), r.text or "") for r in jaccard_join.one_per_group(make(again), 5, 4, 5).collect())
    assert left == sorted([("1", text), ("3", ""), ("3", ""), ("4", prose(20, 8)), ("None", text), ("None", text)])
    assert jaccard_join.jaccard_components(make([])).count() == 0


def test_parities_bound_the_difference():
    rng = random.Random(9)
    for _ in range(300):
        draw = lambda: sorted({rng.randrange(40) * 0x9E3779B97F4A7C15 % 2**64 for _ in range(rng.choice([1, 3, 30, 200]))})
        x, y = draw(), draw()
        both = np.array(x + y, np.uint64)
        rows = jaccard_join._parities(both, np.array([0, len(x), len(x) + len(y)]))
        least = jaccard_join._differing(*[np.frombuffer(r.as_buffer(), np.uint8) for r in rows])
        assert least <= len(set(x) ^ set(y)) and (x != y or least == 0)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(60))


def brute_lines(rows):
    seen, first, out = Counter(), {}, []
    windows = {}
    for k, (i, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])):
        lines = (t or "").split("\n")
        held = [p for p, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        windows[k] = [(at, tuple(lines[p] for p in held[at : at + 3]), held[at : at + 3]) for at in range(len(held) - 2)]
        for at, w, _ in windows[k]:
            seen[w] += 1
            first.setdefault(w, (k, at))
    for k, (i, t) in enumerate(rows):
        gone = {p for at, w, places in windows[k] if seen[w] > 1 and first[w] != (k, at) and (first[w][0] != k or at >= first[w][1] + 3) for p in places}
        out.append((i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone), len(gone)))
    return sorted(out, key=str)


def test_line_dedup(make, odd):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " \t", "d e"]) for _ in range(rng.randint(0, 14)))) for i in range(40)] + [(50, "x\nx\nx\nx\nx\nx\nx"), (51, None), (52, "")]
    got = line_dedup.dedup_lines(make(rows))
    assert sorted(((r.doc_id, r.text, r._n_removed) for r in got.collect()), key=str) == brute_lines(rows)
    stage = line_dedup.without_repeated_lines(make(rows))
    assert stage.columns == make([]).columns
    assert all(r.n_chars == len(r.text) for r in stage.where("text is not null").collect())
    assert line_dedup.dedup_lines(make(odd)).count() == len(odd) and line_dedup.dedup_lines(make([])).count() == 0


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


def brute_tiles(d, item, least):
    """Greedy string tiling from its definition: all maximal matches, every round."""
    free_d, free_i, out = [True] * len(d), [True] * len(item), 0
    while True:
        best, found = least - 1, []
        for j in range(len(item)):
            for p in range(len(d)):
                k = 0
                while j + k < len(item) and p + k < len(d) and free_i[j + k] and free_d[p + k] and item[j + k] == d[p + k]:
                    k += 1
                if k > best:
                    best, found = k, [(j, p)]
                elif k == best and k >= least:
                    found.append((j, p))
        if not found:
            return out
        for j, p in found:
            if all(free_i[j : j + best]) and all(free_d[p : p + best]):
                free_i[j : j + best] = free_d[p : p + best] = [False] * best
                out += best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=14))
def test_tiling(d, item):
    tiles = decontamination.tiles(np.array(d, np.uint64), np.array(item, np.uint64), 3)
    assert sum(t[2] for t in tiles) == brute_tiles(d, item, 3)
    assert all(d[p : p + n] == item[j : j + n] for p, j, n in tiles)


def test_decontamination(spark, make, prose, odd):
    items = [(k, prose(30, 500 + k)) for k in range(4)] + [(9, None), (10, ""), (11, "too short")]
    one = items[1][1].split()
    moved = " ".join(one[15:] + ["between"] + one[:15])
    half = " ".join(one[:15])
    rows = [(200, prose(50, 1)), (201, "before " + items[0][1].upper().replace(" ", ", ") + " after"), (202, moved), (203, half), (203, half), (204, items[0][1] + " " + items[2][1])]
    table = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, run string")
    got = {r.doc_id: r for r in decontamination.decontaminate(make(rows + odd), table).collect()}
    for i, t in rows:
        covered = {k: brute_tiles(words(t), words(x), 4) for k, x in items}
        hits = [k for k, x in items if words(x) and covered[k] >= 0.8 * len(words(x)) and len(words(x)) >= 4]
        assert (got[i].contaminated, got[i].n_items) == (bool(hits), len(hits)), i
    kept = decontamination.without_benchmark(make(rows + odd), table)
    assert kept.columns == make([]).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted([200, 203, 203] + [i or 0 for i, _ in odd])
    assert decontamination.decontaminate(make([]), table).count() == 0
    assert decontamination.without_benchmark(make(rows), table.limit(0)).count() == len(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=14))
def test_chains_are_collinear_and_best(matches):
    found = substring_dedup.chains(matches)
    assert all(x < u and y < v for c in found for (x, y), (u, v) in zip(c, c[1:]))
    used = [m for c in found for m in c]
    assert len(used) == len(set(used)) and set(used) <= set(matches)


def test_repeated_passages(make, prose, odd):
    passage = prose(70, 7)
    changed = passage.split()
    changed[35] = "other"
    rows = [(k, f"{prose(80, 300 + k)} {passage} {prose(40, 400 + k)}") for k in range(8)]
    rows += [(20, f"{prose(30, 50)} {' '.join(changed)} {prose(30, 51)}"), (21, prose(200, 52)), (22, prose(200, 52)), (23, prose(200, 53))]
    got = substring_dedup.repeated_passages(make(rows + [(1000 + (i or 0), t) for i, t in odd])).collect()
    pairs = {(r.doc_id, r.source_id) for r in got}
    ids = {i for p in pairs for i in p}
    assert set(range(8)) | {20, 21, 22} <= ids and 23 not in ids
    assert (22, 21) in pairs and (1006, 1005) in pairs
    texts = {i: words(t) for i, t in rows}
    for r in got:
        if r.doc_id < 10 and r.source_id < 10:
            assert texts[r.doc_id][r.start : r.stop] == texts[r.source_id][r.source_start : r.source_stop] == words(passage)
    assert len(got) < 20  # pairs with a source, not all pairs
    assert substring_dedup.repeated_passages(make([])).count() == 0


def covered(got):
    """Words of each document that lie in a passage, as the passage or as its source."""
    out = defaultdict(set)
    for r in got:
        out[r.doc_id] |= set(range(r.start, r.stop))
        out[r.source_id] |= set(range(r.source_start, r.source_stop))
    return out


def test_two_passages_of_one_pair(make, prose):
    rows, places = [], {}
    for case, (length, between) in enumerate([(60, 3), (60, 20), (60, 50), (60, 150), (60, 250), (150, 600)]):
        for _ in range(3):
            k = len(rows)
            head, foot = prose(length, f"head {k}"), prose(length, f"foot {k}")
            for side in (0, 1):
                rows.append((k + side, f"{head} {prose(between, f'body {k} {side}')} {foot}"))
                places[k + side] = (length, between)
    got = substring_dedup.repeated_passages(make(rows)).collect()
    assert all(r.identity >= 0.8 and r.matched >= 40 for r in got)
    words_in = covered(got)
    for k, (length, between) in places.items():
        own = {*range(length), *range(length + between, 2 * length + between)}
        assert own <= words_in[k], (k, length, between)
        assert between < 50 or len(words_in[k] - own) < 8, (k, between)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 9), st.integers(0, 9)), min_size=2, max_size=7))
def test_pieces_hold_most_matching_words(blocks):
    a, b, chain = [], [], []
    for k, (extra, gap, other) in enumerate(blocks):
        chain.append((len(a), len(b)))
        same = [1000 * k + i for i in range(8 + extra)]
        a += same + [100_000 + 100 * k + i for i in range(gap)]
        b += same + [200_000 + 100 * k + i for i in range(other)]
    parts = [(8 + e, g, o) for e, g, o in blocks]

    def best(i):  # most matching words in blocks from i on, from all ways to cut
        out = best(i + 1) if i < len(parts) else 0
        for j in range(i, len(parts)):
            same = sum(p[0] for p in parts[i : j + 1])
            if same >= 20 and same >= 0.8 * (same + max(sum(p[s] for p in parts[i:j]) for s in (1, 2))):
                out = max(out, same + best(j + 1))
        return out

    found = substring_dedup.pieces(np.array(a), np.array(b), chain, 20, 0.8, 8)
    assert sum(f[4] for f in found) == best(0)
    assert all(x[1] <= y[0] and x[3] <= y[2] for x, y in zip(found, found[1:]))
    assert all(f[4] >= 20 and f[4] >= 0.8 * max(f[1] - f[0], f[3] - f[2]) for f in found)


def test_changed_passages(make, prose):
    rows, places, rng = [], {}, random.Random(9)
    for n, every in [(60, 20), (60, 15), (60, 12), (60, 10), (60, 8), (200, 10), (200, 8), (40, 1000), (46, 1000)]:
        for trial in range(8):
            k, passage = len(rows), prose(n, f"{n} {every} {trial}").split()
            off = rng.randrange(every)
            other = [f"z{rng.randrange(10**6)}" if i % every == off and n > 46 else w for i, w in enumerate(passage)]
            for side, p in enumerate((passage, other)):
                rows.append((k + side, f"{prose(70, f'before {k} {side}')} {' '.join(p)} {prose(70, f'after {k} {side}')}"))
                places[k + side] = (n, every)
    got = covered(substring_dedup.repeated_passages(make(rows)).collect())
    found = Counter(places[k] for k in places if len(got[k] & set(range(70, 70 + places[k][0]))) >= 0.9 * places[k][0])
    assert all(found[p] == 16 for p in places.values()), found


def test_a_third_text_does_not_hide_a_passage(make, prose):
    rows = []
    for trial in range(30):
        passage = prose(60, f"p {trial}").split()
        rows += [(3 * trial + side, f"{prose(50, f'b {trial} {side}')} {' '.join(passage)} {prose(50, f'a {trial} {side}')}") for side in (0, 1)]
        parts = [f"{' '.join(passage[k : k + 9])} {prose(60, f'o {trial} {k}')}" for k in range(0, 60, 10)]
        rows.append((3 * trial + 2, " ".join(parts)))
    got = substring_dedup.repeated_passages(make(rows)).collect()
    pairs = {frozenset((r.doc_id, r.source_id)) for r in got if r.matched >= 60}
    assert all(frozenset((3 * t, 3 * t + 1)) in pairs for t in range(30))


def test_texts_that_hold_every_seed_do_not_hide_a_passage(make, prose):
    rows = []
    for trial in range(3):
        passage = prose(60, f"p {trial}").split()
        rows += [(20 * trial + side, f"{prose(50, f'b {trial} {side}')} {' '.join(passage)} {prose(50, f'a {trial} {side}')}") for side in (0, 1)]
        # each of twelve texts holds all seeds, in no order that makes a passage
        for k in range(2, 14):
            parts = [f"{' '.join(passage[i : i + 8])} {prose(12, f'o {trial} {k} {i}')}" for i in reversed(range(0, 53))]
            rows.append((20 * trial + k, " ".join(parts)))
    got = substring_dedup.repeated_passages(make(rows)).collect()
    pairs = {frozenset((r.doc_id, r.source_id)) for r in got if r.matched >= 60}
    assert pairs >= {frozenset((20 * t, 20 * t + 1)) for t in range(3)}


def test_seeds_of_many_texts_meet_in_ranges(spark):
    rows = [(7, (k * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63, k, k) for k in range(1, 1500)] + [(8, 5, 1, 1), (9, 5, 2, 2), (9, 6, 3, 3)]
    seeds = spark.createDataFrame(rows + rows[:700], "seed long, key long, pos int, main int")

    def packed(batches):  # few rows at a time, as of many tasks
        for b in batches:
            for at in range(0, b.num_rows, 300):
                seed, key, pos, main = (b.column(c).slice(at, 300).to_numpy() for c in ("seed", "key", "pos", "main"))
                names, texts = np.unique(key, return_inverse=True)
                yield substring_dedup.blocks(seed.astype(np.uint64), texts, pos, main, names, 3)

    blocks = seeds.mapInArrow(packed, "bucket long, block binary")
    met = substring_dedup._met(substring_dedup._shared(blocks, 3)).collect()
    keys = sorted(k for s, k, _, _ in rows if s == 7)
    hot = [r for r in met if r.key not in (5, 6)]
    assert sorted(r.key for r in hot) == keys[1:]
    place = {k: i for i, k in enumerate(keys)}
    near = [r for r in hot if place[r.key] - place[r.source] == 1]
    assert all(r.source == keys[0] for r in hot if r not in near) and len(hot) - len(near) < 16
    assert [(r.key, r.source, r.pos, r.source_pos) for r in met if r.key in (5, 6)] == [(6, 5, 3, 2)]


def test_a_common_phrase_alone_brings_no_pairs(make, prose, monkeypatch):
    """Ninety texts share nine words; of all their pairs only those that can hold a passage are chained, and none of these is lost."""
    phrase, rows = prose(9, "phrase"), []
    for k in range(90):
        # three passages whose every seventh word is changed, so that the phrase is most of what the two texts have in common
        passage = prose(60, f"p {min(k // 2, 3) if k < 6 else k}").split()
        if k < 6 and k % 2:
            passage = [f"z{k}{i}" if i % 7 == 3 and not 20 <= i < 32 else w for i, w in enumerate(passage)]
        rows.append((k, f"{prose(50, f'b {k}')} {' '.join(passage[:21])} {phrase} {' '.join(passage[21:])} {prose(50, f'a {k}')}"))
    chained, keep = [], substring_dedup._passages
    monkeypatch.setattr(substring_dedup, "_passages", lambda docs, pairs, *limits: chained.append(pairs.count()) or keep(docs, pairs, *limits))
    got = substring_dedup.repeated_passages(make(rows)).collect()
    assert {frozenset((r.doc_id, r.source_id)) for r in got} == {frozenset((k, k + 1)) for k in (0, 2, 4)}
    assert len(chained) == 2 and chained[1] < 200  # 4005 pairs share the phrase


def test_common_seeds_leave_out_no_passage(make, prose, monkeypatch):
    """The same rows as from all pairs of the texts of a seed, in cells of any size."""
    rng = random.Random(5)
    lines = [prose(n, f"line {n} {i}") for i, n in enumerate((7, 9, 12, 16, 20, 26, 33, 38))]
    rows = []
    for k in range(60):
        parts = rng.sample(lines, 5) + [prose(rng.randrange(3, 12), f"o {k} {j}") for j in range(5)]
        rng.shuffle(parts)
        changed = [f"x{rng.randrange(10**6)}" if rng.random() < 0.04 else w for w in " ".join(parts).split()]
        rows.append((k, f"{prose(30, f'b {k}')} {' '.join(changed)}"))
    found = lambda: {tuple(r) for r in substring_dedup.repeated_passages(make(rows)).collect()}
    got = found()
    monkeypatch.setattr(substring_dedup, "CELL", 20)
    monkeypatch.setattr(substring_dedup, "HELD", 40)
    assert found() == got

    def all_pairs(docs, held, left, met, least):
        other = held.select("seed", F.col("key").alias("other"), F.col("at").alias("other_at"), F.col("main").alias("other_main"))
        both = left.join(other, "seed").where("key <> other").select("key", "other", F.explode(substring_dedup._matches("other_at", "other_main")).alias("m"))
        ahead = F.col("key") > F.col("other")
        first, second = F.when(ahead, F.col("m.pos")).otherwise(F.col("m.source_pos")), F.when(ahead, F.col("m.source_pos")).otherwise(F.col("m.pos"))
        return both.select(F.greatest("key", "other").alias("key"), F.least("key", "other").alias("source"), first.alias("pos"), second.alias("source_pos"))

    monkeypatch.setattr(substring_dedup, "_rest", all_pairs)
    assert got and found() == got


def test_passages_that_repeat_themselves(make, prose):
    rows, places = [], {}
    for trial in range(4):
        ten, six = prose(10, f"ten {trial}"), prose(6, f"six {trial}")
        listed = " ".join(f"{six} {prose(1, f'item {trial} {k}')}" for k in range(12))
        for case, passage in enumerate([" ".join([prose(1, f"one {trial}")] * 80), " ".join([ten] * 8), listed, f"{prose(30, trial)} {' '.join([six] * 9)}"]):
            for side in (0, 1, 2):
                # the third text has the passage three times, far apart
                if side == 2:
                    rows.append((len(rows), " ".join(f"{prose(60, f'c {len(rows)} {j}')} {passage}" for j in range(3))))
                    places[len(rows) - 1] = [60 * (j + 1) + j * n + i for j in range(3) for i in range(n)]
                    break
                k, n = len(rows), len(passage.split())
                # one text also holds the repeated run once, before the passage
                alone = ten + " " if case == 1 and side else ""
                rows.append((k, f"{alone}{prose(60, f'b {k}')} {passage} {prose(50, f'a {k}')}"))
                places[k] = range(60 + len(alone.split()), 60 + len(alone.split()) + n)
    got = covered(substring_dedup.repeated_passages(make(rows)).collect())
    short = {k: len(set(p) - got[k]) for k, p in places.items() if len(set(p) - got[k]) > 10}
    assert not short, short


def test_winnowing_keeps_a_seed_of_every_window(prose):
    import pyarrow as pa

    from passagelake.llm.token_arrays import ALPHANUMERIC, windows, word_slices

    texts = [prose(n, n) for n in (0, 3, 9, 20, 27, 28, 120)] + [prose(60, 1)] * 2
    for _, w in word_slices(pa.array(texts), ALPHANUMERIC):
        hashes, owner, at = windows(w, 8, False)
        _, text, pos = substring_dedup.winnow(w)
        for d in range(len(texts)):
            own, kept = hashes[owner == d], set(pos[text == d].tolist())
            expected = {int(k + np.argmin(own[k : k + 20])) for k in range(max(1, len(own) - 19))} if len(own) else set()
            assert kept == expected


def brute_tiling(doc, item, least):
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best, longest = [], least
        for j in range(len(item)):
            for p in range(len(doc)):
                k = 0
                while j + k < len(item) and p + k < len(doc) and free_i[j + k] and free_d[p + k] and item[j + k] == doc[p + k]:
                    k += 1
                if k > longest:
                    best, longest = [], k
                if k == longest:
                    best.append((p, j))
        if not best:
            return out
        for p, j in best:
            if all(free_d[p : p + longest]) and all(free_i[j : j + longest]):
                free_d[p : p + longest] = free_i[j : j + longest] = [False] * longest
                out.append((p, j, longest))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=24), st.integers(1, 4))
def test_tiles_are_those_of_greedy_string_tiling(doc, item, least):
    assert decontamination.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), least) == brute_tiling(doc, item, least)


def test_tiles_of_repetitive_texts_end():
    start = time.perf_counter()
    same = np.full(200_000, 7, np.uint64)
    assert decontamination.tiles(same, np.full(400, 7, np.uint64), 4) == [(0, 0, 400)]
    rng = np.random.default_rng(1)
    two = rng.integers(0, 2, 200_000).astype(np.uint64)
    found = decontamination.tiles(two, rng.integers(0, 2, 400).astype(np.uint64), 4)
    assert sum(n for _, _, n in found) > 390
    # few lengths, many tiles
    assert len(decontamination.tiles(np.tile(np.array([1, 2, 3, 4, 9], np.uint64), 40_000), np.tile(np.array([1, 2, 3, 4, 8], np.uint64), 80), 4)) == 80
    assert time.perf_counter() - start < 10
