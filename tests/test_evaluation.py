import math
import random
import re

import pytest
from pyspark.sql import functions as F

from passagelake.functions import grams
from passagelake.functions.ranks import floor_percentiles, ordinals
from passagelake.functions.text import match_words, word_grams
from passagelake.operators import evaluation as ev

RANKED = "experiment string, qid string, rank int, source string, text string, signal double, signal_kind string"
SPAN = "alpha beta gamma delta epsilon"


def cover(spark, span, text):
    return spark.range(1).select(ev.coverage(F.lit(span), F.lit(text)).alias("v")).first().v


def test_coverage(spark):
    span = "The event loop drains the entire microtask queue."
    assert cover(spark, span, "the EVENT loop\ndrains the entire   microtask queue") == 1
    assert cover(spark, span, "Totally unrelated words here about databases.") < 0.2
    assert cover(spark, "one two three four five six seven eight nine ten", "one two three four five six") < 0.8
    assert cover(spark, "", "x") == 0


def metrics(spark, ranked, gold):
    rows = spark.createDataFrame([("e", "q", i, s, t, 1.0, "dense") for i, (s, t) in enumerate(ranked, 1)], RANKED)
    g = spark.createDataFrame([("q", i, s, t) for i, (s, t) in enumerate(gold)], "qid string, gold_no int, source string, span string")
    return ev.ranking_metrics(rows, g).first()


def test_metrics_single_span(spark):
    m = metrics(spark, [("a", "filler text here"), ("a", SPAN + " zeta"), ("b", SPAN)], [("a", SPAN)])
    assert (m.hit1, m.hit3, m.recall5, m.mrr) == (0, 1, 1, 0.5)
    assert abs(m.ndcg5 - 1 / math.log2(3)) < 1e-9 and abs(m.precision5 - 1 / 3) < 1e-9


def test_metrics_duplicates_and_two_spans(spark):
    assert metrics(spark, [("a", SPAN)] * 5, [("a", SPAN)]).ndcg5 == 1
    gold = [("a", SPAN), ("b", "one two three four five")]
    half = metrics(spark, [("a", SPAN)], gold)
    assert half.recall5 == 0.5 and half.ndcg5 < 1
    both = metrics(spark, [("a", SPAN), ("b", "one two three four five")], gold)
    assert both.recall5 == 1 and abs(both.ndcg5 - 1) < 1e-12


def sequential(seed):
    a = seed
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield (t ^ (t >> 14)) / 4294967296


def test_resamples_by_ranges_of_positions_equal_a_sequential_run(spark):
    rows = [(k, p, None if p % 7 == 3 else p / 4, float(p % 3)) for k, n in (("k", 50), ("l", 1), (None, 9)) for p in range(1, n + 1)]
    values = spark.createDataFrame(rows + [("m", 1, None, 2.0)], "key string, _pos long, a double, b double")
    want = set()
    for key in "klm":
        of_key = [r[2:] for r in rows + [("m", 1, None, 2.0)] if r[0] == key]
        draw = sequential(5)
        for r in range(13):
            drawn = [of_key[int(next(draw) * len(of_key))] for _ in of_key]
            known = [a for a, _ in drawn if a is not None]
            want.add((key, r, sum(known) if known else None, sum(b for _, b in drawn), len(drawn)))
    for held in (8, 1000):  # a key in several ranges of positions and in one
        got = ev._resampled(values, ["key"], {"_sa": "a", "_sb": "b"}, 13, 5, slices=3, held=held)
        assert {tuple(r) for r in got.select("key", "_r", "_sa", "_sb", "_n").collect()} == want


def test_draws_on_arrays_equal_those_of_columns(spark):
    from passagelake.functions.random_draws import uniform_draws, with_uniform_draw

    first = 2**32 - 50  # the number of a draw wraps
    rows = with_uniform_draw(spark.range(first, first + 100, 1, 1), F.col("id"), 11, "u").orderBy("id").collect()
    assert [r.u for r in rows] == uniform_draws(first, 100, 11).tolist()


def test_bootstrap_equals_a_sequential_run(spark):
    a, b = [float(i % 2) for i in range(40)], [1.0] * 40
    pairs = spark.createDataFrame([("k", i, x, y) for i, (x, y) in enumerate(zip(a, b))], "key string, n long, a double, b double")
    got = ev.paired_bootstrap(pairs, ["key"], "a", "b", "n", resamples=200).first()
    draws, diffs = sequential(11), []
    for _ in range(200):
        picks = [int(next(draws) * 40) for _ in range(40)]
        diffs.append((sum(b[i] for i in picks) - sum(a[i] for i in picks)) / 40)
    diffs.sort()
    assert got.mean_a == 0.5 and got.mean_b == 1 and got.diff_lo > 0
    assert abs(got.diff_lo - diffs[5]) < 1e-9 and abs(got.diff_hi - diffs[195]) < 1e-9


def test_threshold_sweep_against_brute_force(spark):
    import random

    rng = random.Random(9)
    items = [("k", rng.random() < 0.6, round(rng.random(), 2) if rng.random() > 0.1 else None) for _ in range(120)]
    got = ev.sweep_thresholds(spark.createDataFrame(items, "key string, answerable boolean, best double"), ["key"]).first()
    values = sorted({v for _, _, v in items if v is not None})
    candidates = [values[0] - 1e-3] + [(x + y) / 2 for x, y in zip(values, values[1:])] + [values[-1] + 1e-3]
    low = lambda v: -math.inf if v is None else v
    pos, neg = [low(v) for _, a, v in items if a], [low(v) for _, a, v in items if not a]
    scored = [(t, sum(v >= t for v in pos) / len(pos) + sum(v < t for v in neg) / len(neg) - 1) for t in candidates]
    top = max(j for _, j in scored)
    tied = [t for t, j in scored if abs(j - top) < 1e-9]
    assert abs(got.threshold - tied[(len(tied) - 1) // 2]) < 1e-12 and abs(got.j - top) < 1e-12


def test_evaluate_and_summarise(spark):
    data = spark.createDataFrame([("a", "direct", "test", True), ("u", "unanswerable", "test", False)], "qid string, category string, split string, answerable boolean")
    gold = spark.createDataFrame([("a", 0, "s", SPAN)], "qid string, gold_no int, source string, span string")
    ranked = spark.createDataFrame([("e", "a", 1, "s", SPAN, 0.8, "dense"), ("e", "u", 1, "s", "nothing", 0.55, "dense")], RANKED)
    records = spark.createDataFrame([("e", q, "dense", 0, 1.0, None) for q in "au"], "experiment string, qid string, signal_kind string, model_calls int, latency_ms double, error string")

    def run(threshold):
        t = spark.createDataFrame([("e", "dense", threshold, None)], "experiment string, kind string, threshold double, drop_below double")
        return ev.summarise(ev.score_runs(records, ranked, data, gold, t), ["experiment"]).first()

    loose, tuned = run(0.15), run(0.7)
    assert (loose.false_answer, loose.false_refusal) == (1, 0)
    assert (tuned.false_answer, tuned.false_refusal, tuned.decision_accuracy) == (0, 0, 1)


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_ordinals_and_percentiles_in_buckets(spark, width):
    df = spark.createDataFrame([("h" if i % 3 else "x", i * 2) for i in range(50)], "key string, v long")
    placed = ordinals(df, ["key"], [F.col("v")], F.floor(F.col("v") / width)).collect()
    for key in "hx":
        ordered = sorted((r.v, r.ordinal) for r in placed if r.key == key)
        assert [o for _, o in ordered] == list(range(1, len(ordered) + 1))
    got = floor_percentiles(df, ["key"], "v", {"p": 0.95}, F.floor(F.col("v") / width))
    for r in got.collect():
        values = sorted(i * 2 for i in range(50) if (i % 3 != 0) == (r.key == "h"))
        assert r.p == values[min(len(values) - 1, int(0.95 * len(values)))]


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_covering_pairs_against_brute_force(spark, threshold):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    line = "this licence line stands in every single text"
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) + " . " + line) for i in range(80)] + [(80, ""), (81, None), (82, "two words")]
    spans = [(i, " ".join(texts[i][1].split()[:12])) for i in range(30)] + [(30, line), (31, ""), (32, None), (33, "Two Words."), (34, "w1 w2 w3 w4 w5")]
    spans += [(40 + i, " ".join(w if rng.random() > 0.1 else "changed" for w in texts[i][1].split())) for i in range(30)]

    def grams(t):
        w = [x.strip("._-") for x in re.sub("[^a-z0-9$@._-]+", " ", (t or "").lower()).split()]
        w = [x for x in w if x]
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())

    want = {}
    for s, a in spans:
        for t, b in texts:
            if grams(a) and len(grams(a) & grams(b)) / len(grams(a)) >= threshold:
                want[s, t] = len(grams(a) & grams(b)) / len(grams(a))
    found = ev.covering_pairs(spark.createDataFrame(spans, "s long, span string"), spark.createDataFrame(texts, "t long, text string"), ["s"], ["t"], threshold)
    assert {(r.s, r.t): r.coverage for r in found.collect()} == want and any(s == 30 for s, _ in want)


def test_dataset_problems_from_nested_and_flat_gold(spark):
    names = "id string, category string, question string, answerable boolean, history array<struct<question:string,answer:string>>, gold array<struct<lesson:string,span:string>>"
    rows = [
        ("1", "direct", "q?", True, [], [("l", "the event loop drains the queue")]),
        ("2", "direct", " ", True, [], []),
        ("3", "followup", "q?", False, [], [("l", "timers run first")]),
        ("4", "direct", "q?", True, None, [("l", "timers never run first"), ("none", "x"), ("l", "...")]),
        ("5", "direct", "q?", False, [], None),
        ("5", "direct", "q?", False, [], None),
    ]
    questions = spark.createDataFrame(rows, names)
    sources = spark.createDataFrame([("l", "Timers run first. Then the event loop drains the queue.")], "source string, text string")
    want = sorted([
        ("2", "empty question"), ("2", "answerable question has no gold spans"), ("3", "unanswerable question must not have gold spans"),
        ("3", "follow-up has no history"), ("4", "gold span not found verbatim"), ("4", "gold span not found verbatim"), ("4", "unknown lesson"), ("5", "duplicate id"),
    ])
    flat = questions.select("id", F.explode("gold").alias("g")).select("id", F.col("g.lesson").alias("source"), F.col("g.span").alias("span"))
    assert sorted(map(tuple, ev.dataset_problems(questions, sources).collect())) == want
    assert sorted(map(tuple, ev.dataset_problems(questions.drop("gold"), sources, flat).collect())) == want


def test_gram_lists_against_word_grams(spark):
    r = random.Random(11)
    parts = list("ab.-_ $@9\n\té") + ["İ", "K", "one", "two ", " three ", "中", " ", " "]
    rows = [(i, None if i % 50 == 7 else "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(400)] + [(400, "one two three " * 300_000)]
    texts = spark.createDataFrame(rows, "i long, text string")
    hashed = grams.gram_lists(texts, F.struct("i").alias("_t"), F.col("text"), "g")
    assert "MapInArrow" in hashed._jdf.queryExecution().optimizedPlan().toString()
    both = texts.join(hashed, texts.i == hashed["_t.i"]).select("i", word_grams(match_words(F.col("text"))).alias("w"), "g").collect()
    assert len(both) == len(rows) and all(len(b.w) == len(b.g) == len(set(b.g)) for b in both)
    for a in both:
        for b in both[::3]:
            assert len(set(a.w) & set(b.w)) == len(set(a.g) & set(b.g))
