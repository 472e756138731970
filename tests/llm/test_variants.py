"""Spelling variants, Merkle manifest and SimHash against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from passagelake.llm import merkle_manifest, simhash, spelling_variants


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def brute_variants(rows, divisor):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[a-zÀ-ÿ]+", lower(t)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % divisor == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: {v for v in words if v != w and one_apart(w, v)} for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.fixture(scope="module")
def misspelt():
    """Few letters, repeated letters and long words, so that words are near in many ways; accented letters at both ends."""
    rng = random.Random(8)
    stems = ["aabaa", "aaaaaa", "élèves", "banana", "ÿabcÀ", "abcdefghijklmnopqrstuvwxyz", "mississippi", "÷×÷×÷"]
    words = []
    for s in stems:
        for _ in range(40):
            k, c = rng.randrange(len(s) + 1), rng.choice("absé")
            v = rng.choice([s, s, s[:k] + c + s[k:], s[:k] + s[k + 1 :], s[:k] + c + s[k + 1 :]])
            words += [v.upper() if rng.random() < 0.2 else v] * rng.choice([1, 1, 2, 4])
    rng.shuffle(words)
    return [(i, rng.choice([" ", "-", "\n", "1"]).join(words[i::30])) for i in range(30)]


@pytest.mark.parametrize("divisor", [97, 3])
def test_spelling_variants(make, odd, misspelt, divisor):
    rows = misspelt + [(i, t) for i, t in odd if len(t or "") < 10_000] + [(50, "x" * 20_000)] * 3 + [(51, "x" * 20_001)] * 4
    got = spelling_variants.spelling_variants(make(rows), divisor)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == brute_variants(rows, divisor)


def test_spelling_variants_of_nothing(make):
    assert spelling_variants.spelling_variants(make([])).count() == 0
    assert spelling_variants.spelling_variants(make([(1, "few words"), (2, None), (3, "")])).count() == 0


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_tree(hashes):
    """The root and, for each leaf, its siblings before and after, level by level."""
    paths, owners, level = [[] for _ in hashes], [[i] for i in range(len(hashes))], list(hashes)
    while len(level) > 1:
        runs = [range(k, min(k + 3, len(level))) for k in range(0, len(level), 3)]
        for run in runs:
            for j in run:
                for i in owners[j]:
                    paths[i].append(("".join(level[x] for x in run if x < j), "".join(level[x] for x in run if x > j)))
        owners = [[i for j in run for i in owners[j]] for run in runs]
        level = [sha(*[level[j] for j in run]) for run in runs]
    return level[0], paths


def brute_manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append((r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.text), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        sources[s].sort(key=lambda x: x[:3])
        trees.append(brute_tree([x[2] for x in sources[s]]))
    root, above = brute_tree([t[0] for t in trees]) if trees else ("", [])
    out = []
    for s, (subroot, paths), up in zip(names, trees, above):
        for (_, _, leaf, r), path in zip(sources[s], paths):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            folded = brute_leaf(r, r.text.replace("\n", "") if hit and r.text is not None else r.text)
            proof = ""
            for before, after in path + up:
                folded, proof = sha(before, folded, after), proof + before + after
            out.append((r.doc_id, leaf, subroot, root, sha(proof), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_levels", [1, 2, merkle_manifest.LEVELS])
def test_merkle_manifest(spark, make, odd, monkeypatch, block_levels):
    monkeypatch.setattr(merkle_manifest, "LEVELS", block_levels)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 3**block_levels)
    rng = random.Random(3)
    rows = [(i, rng.choice(["a\nb", "a b", "\n", "", None, "é\n\U0001f600"])) for i in range(330)] + [(i, t) for i, t in odd] + [(7, "a")] * 5
    source = F.when(F.col("doc_id") < 280, "hot").when(F.col("doc_id") == 281, F.lit(None)).when(F.col("doc_id") == 282, "").when(F.col("doc_id") % 3 == 0, "z\U0001f600").otherwise("z￮")
    docs = make(rows).withColumn("source", source).withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.col("lang"))).withColumn("pos", F.lit(4)).withColumn("tree", F.lit("t"))
    got = merkle_manifest.manifest_check(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(docs.collect())


def test_merkle_of_one_and_of_nothing(make):
    one = make([(4, "x\ny")])
    assert [tuple(r) for r in merkle_manifest.manifest_check(one).collect()] == brute_manifest(one.collect())
    assert merkle_manifest.manifest_check(make([])).count() == 0


def test_merkle_paths_prove_their_row(make, prose):
    rows = merkle_manifest.verified(merkle_manifest.manifest(make([(i, prose(5, i)) for i in range(40)])))
    assert rows.where("not verified").isEmpty() and rows.select("root").distinct().count() == 1
    assert rows.where("size(sides) <> 4").isEmpty()


def brute_simhash(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    pieces = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    values = np.array(fps, np.uint64)
    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(values[:a] ^ values[a]) <= radius).tolist():
            label[find(a)] = find(b)
    return [find(x) for x in range(len(fps))]


def least_ids(ids, roots):
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in roots]


def test_simhash_of_texts(make, prose, odd):
    rng, rows = random.Random(6), list(odd)
    for family in range(15):
        base = prose(rng.choice([3, 30, 200]), 500 + family).split()
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            words[rng.randrange(len(words))] = "changed"
            rows.append((100 + len(rows), rng.choice([" ", "  \n"]).join(words)))
    fps = [brute_simhash(t) for _, t in rows]
    least = least_ids([i for i, _ in rows], brute_components(fps, 4))
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, least)), key=str)
    got = simhash.digest(simhash.simhash_components(make(rows)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert simhash.digest(simhash.simhash_components(make([]))).count() == 0


@pytest.mark.parametrize("radius,cell,variants", [(4, 60_000, 2_000_000), (4, 150, 3_000), (2, 40, 500)])
def test_simhash_links_at_the_limit(spark, radius, cell, variants):
    """Chains and balls of fingerprints at and just over the radius, small cells so that hot ones are split in Spark and in the task."""
    rng, fps = random.Random(radius), set()
    for family in range(30):
        base = fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 60])):
            if rng.random() < 0.3:
                base = fp
            fp = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                fp ^= 1 << b
            fps.add(fp)
    fps = sorted(fps | {0, 1, 3, 31, 2**64 - 1, 2**63})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, cell, variants).collect()
    at = {f: k for k, f in enumerate(signed)}
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in found:
        label[find(at[r.a])] = find(at[r.b])
    groups = lambda roots: {frozenset(k for k, r in enumerate(roots) if r == x) for x in set(roots)}
    assert groups([find(x) for x in range(len(fps))]) == groups(brute_components(fps, radius))
    with pytest.raises(ValueError):
        simhash.links(spark.range(1).selectExpr("id as fp"), 3)
