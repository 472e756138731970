"""Operators that judge each document: measures, tokens, scores and spans against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagelake.llm import hmm, license_scan, lm_scoring, packing, pii, quality, toxicity
from passagelake.llm.queries import tokenizer_path


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---- quality


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(make, odd):
    rng = random.Random(2)
    rows = [(100 + k, " ".join(rng.choice(["a", "b", "the", "x#y", "é", "\n", "- p\n", "😀"]) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    got = quality.quality(make(rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    texts = dict(rows)
    for r in got:
        if r.doc_id in texts:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.quality(make([])).count() == 0


# ---- packing


def test_binary_pieces():
    for n in [*range(1, 300), 2047, 2048, 2049, 4096, 5000]:
        pieces = packing.binary_pieces(n)
        assert [p for p, _ in pieces] == [sum(x for _, x in pieces[:k]) for k in range(len(pieces))]
        assert sum(x for _, x in pieces) == n and all(x & (x - 1) == 0 and x <= 2048 for _, x in pieces)


def test_packing_round_trip(make, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rows = odd + [(20, "It's 12 o'clock, ISN'T it?  ﬁn İstanbul Ωmega　wide"), (21, "<|endoftext|> a<|startoftext|>b"), (22, "été naïve ÀÉ ß × ÷ ¿qué?"), (23, "they'll we've I'd 'tis 'RE"), (24, "a\x00b\x07c d\x85e"), (25, "don't" * 900)]
    got = packing.pack(make(rows), tokenizer_path()).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for i, own in texts.items():
        expected = Counter(np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for t in own)
        pieces, built, held = sorted((r for r in got if r.doc_id == i), key=lambda r: r.sequence_id), Counter(), b""
        for r in pieces:
            assert len(r.tokens) == 4 * r.length == 4 << r.bucket and r.offset == 0
            held = bytes(r.tokens) if r.start == 0 else held + bytes(r.tokens)
            if r.start + r.length == r.doc_tokens:
                built[held] += 1
        assert built == expected, i
    assert packing.pack(make([]), tokenizer_path()).count() == 0
    first = packing.digest(packing.pack(make(rows[3:4]), tokenizer_path())).first()
    assert first.ids_crc32 == zlib.crc32(np.array((whole.encode("one", add_special_tokens=False).ids + [1])[: first.length], "<u4").tobytes())


# ---- toxicity


def test_toxicity_texts_are_not_shuffled_to_meet_the_labels(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "concat('words of text ', id) text")
    labels = spark.range(3000).selectExpr("id doc_id", "1 quality", "cast(id % 4 = 0 as int) toxic")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16KB")  # above the sampled labels, below all of them
    try:
        rows = toxicity.training_rows(docs, labels, 100)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = {(r.doc_id, r.text, r.toxic) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan
    assert 50 < len(got) < 200 and all(zlib.crc32(str(i).encode()) % 3 != 1 and t == f"words of text {i}" and y == (i % 4 == 0) for i, t, y in got)


@pytest.mark.parametrize("most", [100, 100_000])
def test_toxicity_texts_stay_in_place_whatever_spark_takes_the_labels_for(spark, most):
    docs = spark.range(3000).selectExpr("id doc_id", "concat('words of text ', id) text").unionByName(spark.createDataFrame([(None, "x"), (6, "again")], "doc_id long, text string"))
    labels = spark.range(2000).selectExpr("id doc_id", "1 quality", "cast(id % 4 = 0 as int) toxic")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # below the sampled labels
    try:
        rows = toxicity.training_rows(docs, labels, most)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = sorted(r.doc_id for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan
    if most > 2000:
        assert got == sorted([i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1] + [6] * (zlib.crc32(b"6") % 3 != 1))


def test_toxicity_on_held_out_rows(spark, make, prose, odd):
    rng = random.Random(1)
    rows, marks = [], []
    for k in range(600):
        words = prose(60, k).split()
        toxic = k % 4 == 0
        for _ in range(6 * toxic):
            words[rng.randrange(60)] = rng.choice(["idiot", "zabrofel", "zabroki"])
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    shifted = [(1000 + (i or 0) if i is not None else None, t) for i, t in odd]
    got = toxicity.toxicity(make(rows + shifted), labels).collect()
    assert len(got) == 600 + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    kept = toxicity.reject_toxic(make(rows + shifted), labels)
    assert kept.columns == make([]).columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.score < 0.7)


def test_dense_features(spark, make, odd):
    texts = ["you a b c idiot", "you a b idiot", "a b c d e f g h you i idiot", "idiot a b c d you YOUR x! ID1OT", None, "", "ABC learnt learning?"] + [t for _, t in odd]
    features = toxicity.Features(("learnt",), ("lear",))
    got = features.columns(make(list(enumerate(texts))).select("doc_id", "text")).select("doc_id", "features").collect()
    for i, f in got:
        text = texts[i] or ""
        w = [x for x in re.split("[^\\w]|_", text.lower()) if x]
        size, chars = max(1, len(w)), max(1, len(text))
        bad = [x in [*toxicity.INSULTS, "learnt"] for x in w]
        second = [k for k, x in enumerate(w) if x in toxicity.SECOND_PERSON]
        near = sum(any(bad[max(0, k - 3) : k + 4]) for k in second)
        started = sum(len(x) > 4 and x.startswith("lear") for x in w)
        expected = [sum(x in toxicity.INSULTS for x in w) / size, sum(bad) / size, started / size, min(20, sum(bad)), min(20, started), len(second) / size, near / size, sum(c.isupper() for c in text) / chars]
        assert np.allclose(f.toArray()[:8], expected), text[:40]


def test_toxicity_without_labels(spark, make, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == 0 for r in toxicity.toxicity(make(odd), none).collect())
    assert toxicity.toxicity(make([]), none).count() == 0


# ---- licences


def brute_base(t):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(make, odd):
    rng = random.Random(4)
    parts = ["MIT", "license", "the", "gnu", "General", "public", "apache", "cc", "by", "é", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "x-y"]
    rows = [(100 + k, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for k in range(80)]
    whole = dict(license_scan.TEMPLATES)["bsd"]
    rows += [(300, f"Intro. {whole.upper()}."), (301, whole[: len(whole) // 3]), (302, whole.replace("and binary forms", "and in other binary forms"))]
    got = license_scan.license_scan(make(rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    for i, t in rows:
        r = next(x for x in got if x.doc_id == i)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    found = {r.doc_id: r for r in got}
    assert (found[300].labels, found[300].score) == ("bsd", 1.0) and found[301].labels == "" and "bsd" in found[302].labels
    assert license_scan.license_scan(make([])).count() == 0


def test_matching_statistics():
    rng = random.Random(6)
    for _ in range(60):
        lists = [[rng.randrange(3) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        text = [rng.randrange(4) for _ in range(25)]
        runs = {tuple(x[a:b]) for x in lists for a in range(len(x)) for b in range(a + 1, len(x) + 1)}
        automaton = license_scan.SuffixAutomaton.of(lists)
        for i, (state, n) in enumerate(automaton.statistics(text)):
            assert n == max(k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in runs)
            for t, end in automaton.places[state].items():
                assert n == 0 or lists[t][end - n : end] == text[i + 1 - n : i + 1]
            assert n == 0 or set(automaton.places[state]) == {t for t, x in enumerate(lists) if any(x[a : a + n] == text[i + 1 - n : i + 1] for a in range(len(x)))}


# ---- language model


def plain_forward(model, symbols):
    state, total = None, 0.0
    for s in symbols:
        state = (model.start if state is None else state @ model.move) * model.emit[s]
        total += math.log(state.sum())
        state = state / state.sum()
    return total


def plain_counts(model, sequences):
    counts = hmm.Counts.zero(model)
    for seq in sequences:
        n, k = len(seq), len(model.start)
        a, b = np.zeros((n, k)), np.ones((n, k))
        for t, s in enumerate(seq):
            a[t] = (model.start if t == 0 else a[t - 1] @ model.move) * model.emit[s]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = model.move @ (model.emit[seq[t + 1]] * b[t + 1])
            b[t] /= b[t].sum()
        for t, s in enumerate(seq):
            g = a[t] * b[t]
            counts.emit[s] += g / g.sum()
            if t == 0:
                counts.start += g / g.sum()
            else:
                x = a[t - 1][:, None] * model.move * (model.emit[s] * b[t])
                counts.move += x / x.sum()
    return counts


def test_segmented_recursions_are_exact():
    rng = np.random.default_rng(0)
    model = hmm.Model.initial(3, rng.random(20))
    sequences = [rng.integers(0, 20, n) for n in (1, 2, 31, 32, 33, 64, 65, 200)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sequences])])
    chains = hmm.Chains(np.concatenate(sequences), bounds)
    assert np.allclose(chains.log_likelihood(model), [plain_forward(model, s) for s in sequences])
    counts, plain = hmm.Counts.zero(model), plain_counts(model, sequences)
    chains.expect(model, counts)
    assert all(np.allclose(getattr(counts, f), getattr(plain, f)) for f in ("start", "move", "emit"))


def test_lm_scores(make, odd):
    rng = random.Random(8)
    kinds = [["aa", "ab", "Ac", "rare"], ["xx", "xy", "xz", "odd"]]
    rows = [(k, " ".join(rng.choice(kinds[k % 2]) if rng.random() < 0.95 else f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 120)))) for k in range(200)]
    rows += [(500 + (i or 0) if i is not None else None, t) for i, t in odd]
    got = lm_scoring.lm_scores(make(rows)).collect()
    assert len(got) == len(rows)
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, x in tokens if not held(i) for w in x)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(i), held(i), len(x), sum(counts[w] > 0 for w in x), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), 5)) for i, x in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    own = [r for r in got if r.held_out and r.doc_id < 200]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert all(r.score <= 0 for r in got)
    assert lm_scoring.lm_scores(make([])).count() == 0


def test_baum_welch_gains(make, spark):
    rows = [(k, " ".join(random.Random(k).choice(["a", "b", "c"] if k % 2 else ["d", "e", "f"]) for _ in range(60))) for k in range(60)]
    encoded = spark.createDataFrame([(bytearray(np.array([ord(w) - 97 for w in t.split()], np.uint16).tobytes()),) for _, t in rows], "symbols binary")
    frequencies = np.full(6, 1 / 6)
    model = hmm.Model.initial(2, frequencies)
    seen = []
    for _ in range(4):
        model, before = lm_scoring.baum_welch_round(encoded, model, frequencies)
        seen.append(before)
    assert seen == sorted(seen) and seen[-1] > seen[0]


# ---- personal data

FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def brute_spans(t):
    out = []
    for k, (name, pattern) in enumerate(FORMATS.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if name == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[name]
            if good:
                out.append((m.start(), k, m.end(), name))
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(out)]


@pytest.fixture(scope="module")
def personal(odd):
    rng = random.Random(12)
    parts = ["a@b.co", "x.y@z-1.example.com", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (523) 555-1055", "+12", "é😀", "word", "..", "@", "-", "5-5", "%+a@b.c_d@e.f"]
    rows = [(100 + k, rng.choice([" ", ""]).join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(120)]
    return rows + [(300, "9" * 20000), (301, "a@" + "b" + ".a" * 20000), (302, "+1" + " " * 500), (303, "é 4111 1111 1111 1111")] + odd


def test_personal_data(make, personal):
    got = pii.digest(pii.personal_data(make(personal))).collect()
    assert len(got) == len(personal)
    texts = {i: t for i, t in personal if i is not None}
    for r in got:
        if r.doc_id is None:
            continue
        spans = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in pii.KINDS]
        assert set(spans) <= set(r.spans.split(",")) | set([""] if not spans else [])
    assert pii.personal_data(make([])).count() == 0


def test_patterns_discover_unseen_identifiers(make):
    rng = random.Random(3)
    number = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(k, f"some words then hotline {number()} ends") for k in range(12)]
    rows += [(50, "some words then hotline 555-1234567 ends"), (51, "other part 777-7654321 number")]
    got = by_id(pii.digest(pii.personal_data(make(rows))))
    assert got[50].spans == "phone:24:35" and got[50].n_phone == 0 and got[51].spans == ""


def brute_chained(matches, gap):
    matches = sorted(set(matches))
    best, back = [], []
    for i, (x, y, n) in enumerate(matches):
        fits = [(best[j], j) for j in range(i) if 0 <= x - matches[j][0] - matches[j][2] <= gap and 0 <= y - matches[j][1] - matches[j][2] <= gap]
        top, via = max(fits, default=(0, -1))
        best.append(top + n)
        back.append(via)
    out, used = [], set()
    for i in sorted(range(len(matches)), key=lambda k: (-best[k], k)):
        if i not in used:
            chain, k = [], i
            while k != -1 and k not in used:
                used.add(k)
                chain.append(matches[k])
                k = back[k]
            out.append((chain[-1][0], matches[i][0] + matches[i][2], sum(m[2] for m in chain)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(1, 6)), max_size=20), st.integers(0, 8))
def test_licence_chains(matches, gap):
    assert license_scan.chained(matches, gap) == brute_chained(matches, gap)


def test_licence_chains_of_a_repetitive_text_end():
    start = time.perf_counter()
    found = license_scan.chained([(5 * i, 0, 5) for i in range(200_000)], 8)
    assert len(found) == 200_000 and time.perf_counter() - start < 15
