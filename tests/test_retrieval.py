import math
import os
import random

import pytest
from pyspark.sql import functions as F

from passagelake.config import LADDER, index_signature, preset
from passagelake.functions import text as tx
from passagelake.operators import dense, fusion, inverted_file, lexical, passages, posting_blocks
from passagelake.operators import model_stages as ms


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_terms(spark):
    assert one(spark, tx.terms(F.lit("process.nextTick"))) == ["process", "next", "tick"]
    assert one(spark, tx.terms(F.lit("The indexes and indexing"))) == ["index", "index"]
    assert "201" in one(spark, tx.terms(F.lit("HTTP 201 Created")))
    assert one(spark, tx.terms(F.lit(""))) == []


@pytest.mark.parametrize(
    "word,stem",
    [("closures", "closur"), ("relational", "relat"), ("running", "run"), ("happily", "happili"), ("generously", "generous"),
     ("national", "nation"), ("hopping", "hop"), ("hoped", "hope"), ("ties", "tie"), ("cries", "cri"), ("skies", "sky"),
     ("consignment", "consign"), ("knightly", "knight"), ("sensational", "sensat"), ("employment", "employ"), ("succeed", "succeed")],
)
def test_porter2(word, stem):
    from passagelake.functions.stemming import porter2

    assert porter2(word) == stem


def corpus(spark, texts):
    return spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "course string, chunk_id long, text string")


def ask(spark, *texts):
    return spark.createDataFrame([("c", f"q{i}", t) for i, t in enumerate(texts)], "course string, qid string, question string")


def test_bm25_rare_and_unknown_terms(spark):
    chunks = corpus(spark, ["closures keep variables alive", "the event loop drains microtasks before macrotasks", "express middleware calls next to continue"])
    hits = lexical.bm25_top_k(chunks, ask(spark, "microtasks", "nonexistentterm"), 3).collect()
    assert [(h.qid, h.chunk_id) for h in hits] == [("q0", 1)]


def test_idf_of_all_terms_cuts_and_tokenises_documents_once(spark, tmp_path):
    from passagelake.catalog import retrieval
    from passagelake.sources.tables import Lake

    rows = [(1, "alpha beta alpha", "en"), (2, "beta gamma", "en"), (3, "alpha", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = retrieval.idf(Lake(spark, str(tmp_path)))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # both sides read stored postings
    assert {(r.course, r.term): r.df for r in found.collect()} == {("en", "alpha"): 1, ("en", "beta"): 2, ("en", "gamma"): 1, ("de", "alpha"): 1}


def test_bm25_against_brute_force_with_small_blocks(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(60)]
    questions = [" ".join(rng.choices(words, k=4)) for _ in range(5)]
    got = lexical.bm25_top_k(corpus(spark, texts), ask(spark, *questions), 7, stem=False, chunk_block=13, question_block=2).collect()
    docs = [t.split() for t in texts]
    avg = sum(map(len, docs)) / len(docs)
    for n, q in enumerate(questions):
        scores = {}
        for term in set(q.split()):
            df = sum(term in d for d in docs)
            for i, d in enumerate(docs):
                if term in d:
                    tf = d.count(term)
                    weight = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
                    scores[i] = scores.get(i, 0) + weight
        expected = sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))[:7]
        mine = sorted((h.rank, h.chunk_id, h.score) for h in got if h.qid == f"q{n}")
        assert [m[1] for m in mine] == [e[0] for e in expected]
        assert all(abs(m[2] - e[1]) < 1e-9 for m, e in zip(mine, expected))


def test_dense_against_brute_force_with_small_blocks(spark):
    rng = random.Random(4)
    vec = lambda n: [round(rng.uniform(-1, 1), 3) for _ in range(n)]
    stored = [("c", i, vec(4)) for i in range(40)] + [("c", 40, [0.0] * 4), ("c", 41, vec(3)), ("d", 42, vec(4))]
    asked = [("c", f"q{i}", vec(4)) for i in range(6)]
    chunks = spark.createDataFrame(stored, "course string, chunk_id long, embedding array<float>")
    questions = spark.createDataFrame(asked, "course string, qid string, embedding array<float>")
    got = dense.dense_top_k(chunks, questions, 41, chunk_block=11, question_block=4).collect()

    def cos(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return 0.0 if len(a) != len(b) or not na or not nb else sum(x * y for x, y in zip(a, b)) / na / nb

    for _, q, v in asked:
        mine = [h.chunk_id for h in sorted((h for h in got if h.qid == q), key=lambda h: h.rank)]
        expected = sorted(((-round(cos(v, s[2]), 6), s[1]) for s in stored if s[0] == "c"))[:41]
        assert set(mine) == {c for _, c in expected} and len(mine) == 41


def test_cosine_edge_cases(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, tx.cosine(arr(1, 0), arr(1, 0))) == 1
    assert one(spark, tx.cosine(arr(1, 0), arr(0, 1))) == 0
    assert one(spark, tx.cosine(arr(1, 2), arr(1, 2, 3))) == 0
    assert one(spark, tx.cosine(arr(0, 0), arr(1, 1))) == 0


def ranked_lists(spark, *lists):
    rows = [("q", c, n, r, float(w)) for n, (ids, w) in enumerate(lists) for r, c in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "qid string, chunk_id long, list_no int, rank int, weight double")


def test_rank_fusion(spark):
    fused = fusion.reciprocal_rank_fusion(ranked_lists(spark, ([1], 1))).first()
    assert abs(fused.rrf - 1 / 61) < 1e-12
    order = [r.chunk_id for r in fusion.reciprocal_rank_fusion(ranked_lists(spark, ([1, 2, 3], 0), ([4, 2], 5))).orderBy("rank").collect()]
    assert order == [4, 2, 1, 3]
    ties = [r.chunk_id for r in fusion.reciprocal_rank_fusion(ranked_lists(spark, ([9, 5], 1), ([3, 7], 1))).orderBy("rank").collect()]
    assert ties == [9, 3, 5, 7]


def test_mmr_prefers_the_distinct_item(spark):
    tokens = {1: ["closure", "variable", "scope", "function"], 2: ["closure", "variable", "scope", "function"], 3: ["promise", "async"]}
    rows = [("q", 1, 1, 10.0), ("q", 2, 2, 9.5), ("q", 3, 3, 7.0)]
    candidates = spark.createDataFrame(rows, "qid string, chunk_id long, rank int, rerank double").withColumn("rrf", F.lit(0.1))
    words = spark.createDataFrame(list(tokens.items()), "chunk_id long, tokens array<string>")
    assert [r.chunk_id for r in fusion.diversify(candidates, words, 2, 0.5).orderBy("rank").collect()] == [1, 3]


def decide(spark, signals, threshold, floor=None):
    df = spark.createDataFrame([("q", i, s) for i, s in enumerate(signals)], "qid string, n int, signal double")
    return fusion.decide(df, F.lit(float(threshold)), F.lit(floor).cast("double")).orderBy("n").collect()


def test_decision(spark):
    rows = decide(spark, [8.0, 5.0, 2.0], 4, 3.0)
    assert [r.signal for r in rows if r.in_context] == [8.0, 5.0]
    assert decide(spark, [3.0], 4)[0].abstain
    assert decide(spark, [None], 0)[0].abstain
    assert sum(r.in_context for r in decide(spark, [0.2, 0.1], 0.15)) == 1


def pool(spark, n):
    return spark.createDataFrame([("q", i, i, 1 / (60 + i)) for i in range(1, n + 1)], "qid string, chunk_id long, rank int, rrf double").withColumn("rerank", F.lit(None))


@pytest.mark.parametrize(
    "n,text,expected",
    [
        (3, '{"scores":[{"id":1,"score":9},{"id":2,"score":15},{"id":3,"score":-4}]}', {1: 9.0, 2: 10.0, 3: 0.0}),
        (5, '[{"id":1,"score":8},{"id":2,"score":6},{"id":3,"score":5}]', {1: 8.0, 2: 6.0, 3: 5.0, 4: 0.0, 5: 0.0}),
        (5, '{"scores":[{"id":1,"score":8}]}', None),
        (3, '{"scores":[{"id":99,"score":8},{"id":"x","score":1}]}', None),
        (3, "{}", None),
        (2, '[{"id":1,"score":2},{"id":1,"score":7},{"id":2,"score":1}]', {1: 7.0, 2: 1.0}),
        (4, '[{"id":1,"score":null},{"id":2,"score":5}]', {1: 0.0, 2: 5.0, 3: 0.0, 4: 0.0}),
        (4, '[{"id":1,"score":7},"junk",{"id":2,"score":5}]', {1: 7.0, 2: 5.0, 3: 0.0, 4: 0.0}),
        (4, '{"scores":[{"id":1,"score":7},null,[3],{"id":2}]}', None),
    ],
)
def test_rerank_merge(spark, n, text, expected):
    rows = fusion.merge_rerank(pool(spark, n), spark.createDataFrame([("q", text)], "qid string, json string")).collect()
    if expected is None:
        assert not any(r.rerank_ok for r in rows) and [r.chunk_id for r in sorted(rows, key=lambda r: r.rank)] == list(range(1, n + 1))
    else:
        assert {r.chunk_id: r.rerank for r in rows} == expected


CHUNK = (
    "chunk_id long, lesson string, chunk_index int, text string, overlap_len int, lesson_title string, source string, source_label string, "
    "page int, context_header string, group_key string"
)


def table(spark, rows):
    return spark.createDataFrame([(i, le, n, t, 0, le, "content", "", None, "", f"{le}:content") for i, (le, n, t) in enumerate(rows)], CHUNK)


def hits(spark, *rows):
    return spark.createDataFrame([("q", c, r, float(s)) for r, (c, s) in enumerate(rows, 1)], "qid string, chunk_id long, rank int, signal double")


def test_passages_merge_neighbours(spark):
    chunks = table(spark, [("A", i, f"A{i} text.") for i in range(4)] + [("B", 0, "B0 text.")])
    rows = passages.build_passages(hits(spark, (3, 9), (4, 7), (1, 5)), chunks, 1, 6000).orderBy("position").collect()
    assert [r.lesson for r in rows] == ["A", "B"] and rows[0].rank == 1 and rows[0].primary_chunk_ids == [1, 3]
    assert rows[0].text == "A0 text.\n\nA1 text.\n\nA2 text.\n\nA3 text."


def test_passage_budget(spark):
    chunks = table(spark, [("A", 0, "x" * 50), ("A", 5, "y" * 50), ("B", 0, "z" * 50)])
    count = lambda most: passages.build_passages(hits(spark, (0, 1), (1, 1), (2, 1)), chunks, 0, most).count()
    assert (count(6000), count(120), count(10)) == (3, 2, 1)


def test_run_without_hit_is_dropped(spark):
    chunks = table(spark, [("A", 0, "a"), ("A", 7, "b")])
    rows = passages.build_passages(hits(spark, (0, 1)), chunks, 1, 6000).collect()
    assert [r.text for r in rows] == ["a"]


def test_citations_and_refusals(spark):
    cited = lambda t: one(spark, ms.cited_numbers(F.lit(t), F.lit(3)))
    assert cited("A [E2]. B [E1][E3].") == [2, 1, 3]
    assert cited("Both [E1, E2] agree.") == [1, 2]
    assert cited("See (Excerpt 2) and (Excerpts 1 and 3).") == [2, 1, 3]
    assert cited("Bogus [E9] and [E0].") == [] and cited("array[1] is not a citation.") == [] and cited("[E1] [E1]") == [1]
    assert one(spark, ms.is_refusal(F.lit("The excerpts don't contain enough information.")))
    assert not one(spark, ms.is_refusal(F.lit("A closure is a function [E1].")))


def test_loose_json():
    assert ms.recover_json('{"a":1}') == '{"a": 1}'
    assert ms.recover_json('```json\n{"a":[1,2]}\n```') == '{"a": [1, 2]}'
    assert ms.recover_json('Sure! {"scores":[{"id":1}]} Hope that helps.') == '{"scores": [{"id": 1}]}'
    assert ms.recover_json('{"s":"brace } inside string"}') == '{"s": "brace } inside string"}'
    for bad in ("no json at all", "", '{"unterminated": '):
        assert ms.recover_json(bad) is None


def test_question_transforms(spark):
    listed = lambda t: one(spark, ms.paraphrase_list(F.lit(t), F.lit("orig")))
    assert listed('{"queries":["alt one","alt one","orig","alt two",""]}') == ["alt one", "alt two"]
    assert listed('["array form"]') == ["array form"] and listed('{"nope":true}') == []
    assert one(spark, ms.hypothetical_passage(F.lit("ok"))) == ""
    assert one(spark, ms.single_line(F.lit('"What does PATCH do?"'))) == "What does PATCH do?"


def test_presets():
    for name in LADDER:
        p = preset(name)
        assert p["name"] == name and p["retrieval"]["candidate_k"] >= p["retrieval"]["top_k"]
        assert p["abstain"]["signal"] != "rerank" or p["rerank"]["enabled"]
    assert preset("hybrid", {"retrieval": {"top_k": 7}})["retrieval"]["mode"] == "hybrid"
    assert preset("hybrid")["retrieval"]["top_k"] == 5 and preset("hybrid")["indexing"]["header"]
    assert index_signature(preset("basic")["indexing"]) == "basic.h0.t0.c0"
    with pytest.raises(ValueError):
        preset("nope")


def test_trace_counts_paraphrase_calls(spark):
    questions = spark.createDataFrame([("c", f"q{i}", "what is it") for i in range(3)] + [("none", "q3", "what")], "course string, qid string, standalone string")
    base = questions.withColumns({"model_calls": F.lit(0), "model_failures": F.lit(0)})
    recorded = spark.createDataFrame(
        [("q0", "paraphrase", '{"queries":["other words","other words"]}'), ("q1", "paraphrase", "no list here"), ("q2", "paraphrase", "[]")], "qid string, stage string, text string"
    )
    got = {r.qid: (r.paraphrases, r.model_calls, r.model_failures) for r in ms.with_paraphrases(base, recorded).collect()}
    assert got == {"q0": (["other words"], 1, 0), "q1": ([], 1, 1), "q2": ([], 1, 0), "q3": ([], 1, 1)}


def test_course_without_chunks_asks_no_model(spark):
    from passagelake.catalog import standins
    from passagelake.plans.retrieve import Models, retrieve

    history = "array<struct<question:string,answer:string>>"
    questions = spark.createDataFrame([("c", "q0", "green apples"), ("empty", "q1", "green apples")], "course string, qid string, question string")
    questions = questions.withColumn("history", F.array().cast(history))
    row = ("c", "l", 0, 0, "green apples grow on trees", "Lesson", "content", "", None, "", "", None, 0, "v", "l:content")
    names = "course string, lesson string, chunk_id long, chunk_index int, text string, lesson_title string, source string, source_label string, attachment_id string, context_header string, context_note string, page int, overlap_len int, index_version string, group_key string"
    recorded = spark.createDataFrame([(q, "paraphrase", '["apples that are green"]') for q in ("q0", "q1")], "qid string, stage string, text string")
    config = preset("multiquery", {"query": {"rewrite": False}, "indexing": {"chunker": "basic", "header": False}})
    out = retrieve(questions, standins.embed(spark.createDataFrame([row], names)), Models(standins.embed, responses=recorded, stem=False), config)
    got = {r.qid: (r.paraphrases, r.model_calls, r.model_failures) for r in out.trace.collect()}
    assert got == {"q0": (["apples that are green"], 1, 0), "q1": ([], 0, 0)}


TOPICS = {
    "closures": "# Closures\n\nA closure keeps variables of its outer function alive.\n\n## Counters\n\nA counter is a closure with a private number.",
    "promises": "# Promises\n\nA promise settles once with a value or an error.\n\n## Chaining\n\nThen handlers are chained and errors skip to catch.",
    "streams": "# Streams\n\nA stream delivers chunks of data over time.\n\n## Backpressure\n\nPausing readers signals backpressure to writers.",
}


# a preset takes a minute on a small machine: two that switch everything on between them stand for all, unless all are asked for
@pytest.mark.parametrize("name", [n for n in LADDER if n != "basic"] if os.environ.get("ALL_PRESETS") else ["hyde", "advanced"])
def test_presets_run_end_to_end(spark, name):
    from passagelake.catalog import standins
    from passagelake.operators import indexing as ix
    from passagelake.plans.retrieve import Models, retrieve

    config, basic = preset(name), preset("basic")
    names = "course string, lesson string, title string, attachment_id string, source_label string, pages array<string>"
    docs = spark.createDataFrame([(c, f"{c}-{t}", t.title(), None, "", [text]) for c in ("new", "old") for t, text in TOPICS.items()], names)

    def table(rows, cfg, version=None):
        chunks = ix.index_chunks(rows, cfg, standins.MODEL, "b").withColumn("chunk_id", F.xxhash64("chunk_key"))
        full = ix.embed_chunks(ix.scan_chunks(chunks, docs.select("lesson", "title")), cfg, standins.hashed_counts, standins.MODEL)
        return full.withColumn("index_version", F.lit(version)) if version else full

    chunks = table(docs.where("course = 'new'"), config).unionByName(table(docs.where("course = 'old'"), basic, "legacy"))
    history = "array<struct<question:string,answer:string>>"
    asked = [("new", "q0", "And the counters?", [("What is a closure?", "It keeps variables.")]), ("new", "q1", "How do readers signal backpressure?", []), ("old", "q2", "How are then handlers chained?", [])]
    questions = spark.createDataFrame(asked, f"course string, qid string, question string, history {history}")
    responses = [("q0", "rewrite", "How does a closure make private counters?"), ("q1", "paraphrase", '["pausing readers of a stream"]'), ("q0", "hyde", "A counter is a closure that keeps a private number alive.")]
    recorded = spark.createDataFrame(responses, "qid string, stage string, text string")
    out = retrieve(questions, chunks, Models(standins.embed, responses=recorded, judge=standins.overlap_judge), config)
    trace, ranked = {r.qid: r for r in out.trace.collect()}, out.ranked.orderBy("rank").collect()
    assert {q: r.pipeline for q, r in trace.items()} == {"q0": name, "q1": name, "q2": "basic (course not re-indexed yet)"}
    assert (trace["q0"].standalone == responses[0][2]) == config["query"]["rewrite"]
    assert trace["q1"].paraphrases == (["pausing readers of a stream"] if config["query"]["multi_query"] else [])
    lesson = {r.chunk_id: r.lesson for r in chunks.select("chunk_id", "lesson").collect()}
    first = {q: next(lesson[r.chunk_id] for r in ranked if r.qid == q) for q in trace}
    assert first["q1"] == "new-streams" and first["q2"] == "old-promises"
    assert first["q0"] == "new-closures" or not config["query"]["rewrite"]
    assert all((lesson[r.chunk_id][:3] == "old") == (r.qid == "q2") for r in ranked)
    assert {r.qid for r in out.passages.collect()} <= {r.qid for r in ranked if r.in_context}


def vectors(spark, courses, size=16, seed=4):
    rng = random.Random(seed)
    rows = [(c, k * 1000 + i, [rng.gauss(0, 1) for _ in range(size)]) for k, (c, n) in enumerate(courses) for i in range(n)]
    return spark.createDataFrame(rows, "course string, chunk_id long, embedding array<float>")


def asking(chunks):
    return chunks.select(F.col("course").alias("course"), F.col("chunk_id").cast("string").alias("qid"), F.col("embedding").alias("embedding"))


def test_approximate_search_keeps_courses_apart_and_finds_most(spark):
    chunks = vectors(spark, [("a", 300), ("b", 120), ("c", 1)])
    index = inverted_file.build(chunks)
    assert index.lists.count() == 421 and index.centres.agg(F.sum("size")).first()[0] == 421
    got = inverted_file.approximate_top_k(index, chunks, asking(chunks), 5).collect()
    exact = {(r.qid, r.chunk_id) for r in dense.dense_top_k(chunks, asking(chunks), 5).collect()}
    assert all({"a": 0, "b": 1, "c": 2}[r.course] == r.chunk_id // 1000 for r in got)
    assert len({(r.qid, r.chunk_id) for r in got} & exact) >= 0.9 * len(exact)
    pool = inverted_file.candidates(index, asking(chunks), 5)
    sizes = {r.course: r.n for r in pool.groupBy("course", "qid").count().groupBy("course").agg(F.max("count").alias("n")).collect()}
    assert sizes == {"a": 60, "b": 24, "c": 1}


def test_approximate_search_probing_all_lists_with_a_full_pool_is_exact(spark, monkeypatch):
    chunks = vectors(spark, [("a", 40), ("b", 7)])
    monkeypatch.setattr(inverted_file, "pool_size", lambda k, n: F.lit(100))
    got = inverted_file.approximate_top_k(inverted_file.build(chunks, sample=12), chunks, asking(chunks), 5, probed=1.0)
    rows = lambda df: sorted((r.qid, r.chunk_id, r.rank) for r in df.collect())
    assert rows(got) == rows(dense.dense_top_k(chunks, asking(chunks), 5))


def test_approximate_search_falls_back_and_forgets_removed_vectors(spark, tmp_path):
    chunks = vectors(spark, [("a", 30), ("b", 9)]).unionByName(spark.createDataFrame([("a", 77, [0.0] * 16)], "course string, chunk_id long, embedding array<float>"))
    inverted_file.build(chunks.where("course = 'a'"), path=str(tmp_path / "ivf"))
    index = inverted_file.read(spark, str(tmp_path / "ivf"))
    left = chunks.where("chunk_id not in (1, 2)")
    got = inverted_file.approximate_top_k(index, left, asking(chunks), 3)
    exact = {(r.qid, r.chunk_id) for r in dense.dense_top_k(left, asking(chunks), 3).where("course = 'b'").collect()}
    rows = got.collect()
    assert {(r.qid, r.chunk_id) for r in rows if r.course == "b"} == exact and not {r.chunk_id for r in rows} & {1, 2}
    assert all(sum(r.qid == q for r in rows) == 3 for q in {r.qid for r in rows})
    empty = inverted_file.approximate_top_k(inverted_file.build(chunks.limit(0)), chunks.limit(0), asking(chunks), 3)
    assert empty.count() == 0


def test_approximate_search_makes_no_row_per_question_and_list(spark):
    chunks = vectors(spark, [("a", 300), ("b", 120), ("c", 1)])
    index = inverted_file.build(chunks)
    assert index.centres.where("course = 'a'").count() > 4
    assert inverted_file.probes(index, asking(chunks)).count() == 421
    pool = lambda **size: sorted(tuple(r) for r in inverted_file.candidates(index, asking(chunks), 5, **size).collect())
    # blocks of a few vectors and questions give the same pools
    assert pool() == pool(chunk_block=40, question_block=70)


def test_stems_of_arrays_keep_rows_apart(spark):
    from passagelake.functions.stemming import stem_terms

    rows = [(0, ["indexes", "indexing", "run"]), (1, []), (2, None), (3, ["running", "indexes"]), (4, ["2024", "ponies", "ponies"])]
    got = spark.createDataFrame(rows, "i int, t array<string>").coalesce(1).select("i", stem_terms("t").alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [["index", "index", "run"], [], None, ["run", "index"], ["2024", "poni", "poni"]]


def zipf_corpus(spark, seed=1, n=160):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(40)]
    text = lambda size: " ".join(words[min(39, int(rng.paretovariate(0.7)) - 1)] for _ in range(size))
    chunks = [("ab"[i % 5 == 0], i, text(rng.randint(0, 30))) for i in range(n)]
    questions = [("ab"[i % 2], f"q{i}", text(rng.randint(1, 4)) + " absent") for i in range(20)] + [("none", "q90", "word1"), ("a", "q91", "")]
    return spark.createDataFrame(chunks, "course string, chunk_id long, text string"), spark.createDataFrame(questions, "course string, qid string, question string")


@pytest.mark.parametrize("block,k", [(3, 2), (128, 5), (3, 500)])
def test_block_max_search_equals_the_full_search(spark, tmp_path, block, k):
    chunks, questions = zipf_corpus(spark)
    index = posting_blocks.PostingBlocks(spark, str(tmp_path / "index"), stem=False, block=block)
    for batch in range(3):
        index.add(chunks.where(F.col("chunk_id") % 3 == batch), batch)
    index.add(chunks.where(F.col("chunk_id") % 3 == 2), 2)  # a repeated batch replaces itself
    rows = lambda df: sorted((r.course, r.qid, r.chunk_id, round(r.score, 8), r["rank"]) for r in df.collect())
    want = rows(lexical.bm25_top_k(chunks, questions, k, stem=False))
    assert rows(index.top_k(questions, k)) == want and want
    stats = {r.course: (r.docs, round(r.avg_len, 9)) for r in lexical.lexical_index(chunks, stem=False).course_stats().collect()}
    assert {r.course: (r.docs, round(r.avg_len, 9)) for r in index.stats().collect()} == stats


def test_block_max_search_reads_less_than_half_of_a_frequent_term(spark, tmp_path):
    rng = random.Random(3)
    rare = set(rng.sample(range(900), 12))
    text = lambda i: " ".join(["common"] * rng.choice([1, 1, 1, 2, 5]) + ["rare"] * (i in rare) + [f"filler{rng.randrange(200)}" for _ in range(rng.randint(1, 60))])
    chunks = spark.createDataFrame([("a", i, text(i)) for i in range(900)], "course string, chunk_id long, text string")
    questions = spark.createDataFrame([("a", "q", "common rare")], "course string, qid string, question string")
    index = posting_blocks.PostingBlocks(spark, str(tmp_path / "index"), stem=False, block=8)
    index.add(chunks, 0)
    read = index.needed(questions, 5).where("term = 'common'").agg(F.sum("n")).first()[0] or 0
    assert read < 450
    got, want = (sorted((r.chunk_id, round(r.score, 8)) for r in df.collect()) for df in (index.top_k(questions, 5), lexical.bm25_top_k(chunks, questions, 5, stem=False)))
    assert got == want


@pytest.mark.parametrize("stem", [True, False])
def test_postings_are_counted_inside_the_chunk(spark, stem):
    r = random.Random(5)
    words = ["alpha", "beta", "the", "7", "running", "runs", "runs"]
    text = lambda: r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randint(1, 9)))])
    # repeated and null ids are counted together, as long as course and length agree
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(60)]), text()) for _ in range(300)]
    chunks = spark.createDataFrame(rows, "course string, chunk_id long, text string")
    want = {}
    for course, chunk, tokens in chunks.select("course", "chunk_id", tx.terms(F.col("text"), stem)).collect():
        for at, term in enumerate(tokens or [None]):
            tf, leads = want.get((course, chunk, len(tokens), term), (0, 0))
            want[course, chunk, len(tokens), term] = (tf + (term is not None), max(leads, int(at == 0)))
    postings = lexical.lexical_index(chunks, stem=stem).postings
    got = {(p.course, p.chunk_id, p.doc_len, p.term): (p.tf, p.leads) for p in postings.collect()}
    assert got == want and postings.count() == len(want)
    # only chunks whose id repeats are grouped by term
    plan = postings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "LeftAnti" in plan and "LeftSemi" in plan


def test_searches_of_a_run_are_not_made_again_for_its_trace(spark):
    from passagelake.catalog import standins
    from passagelake.plans.retrieve import Models, retrieve

    row = ("a", 1, "alpha beta", "", "", "l", "t", 0, "content", "", None, None, 0, "basic.h0.t0.c0|hash-64", "l:content")
    names = "course string, chunk_id long, text string, context_header string, context_note string, lesson string, lesson_title string, chunk_index int, source string, source_label string, attachment_id string, page int, overlap_len int, index_version string, group_key string"
    chunks = standins.embed(spark.createDataFrame([row], names))
    questions = spark.createDataFrame([("a", "q", "alpha", [])], "course string, qid string, question string, history array<struct<question:string,answer:string>>")
    recorded = spark.createDataFrame([("q", "hyde", "alpha beta")], "qid string, stage string, text string")
    config = preset("hyde", {"query": {"rewrite": False, "multi_query": False}, "indexing": {"chunker": "basic", "header": False}})
    out = retrieve(questions, chunks, Models(standins.embed, responses=recorded, stem=False), config)
    assert "CoGroups" not in out.trace._jdf.queryExecution().executedPlan().toString()
    assert [(r.qid, r.retrieved) for r in out.trace.collect()] == [("q", 1)]


def test_block_max_search_makes_no_row_per_question_and_posting(spark, tmp_path, monkeypatch):
    chunks, _ = zipf_corpus(spark)
    questions = spark.createDataFrame([("a", f"q{i}", "word1 word2 word3") for i in range(30)], "course string, qid string, question string")
    index = posting_blocks.PostingBlocks(spark, str(tmp_path / "index"), stem=False)
    index.add(chunks, 0)
    kept, keep = [], posting_blocks.materialise
    monkeypatch.setattr(posting_blocks, "materialise", lambda df, name: kept.append((name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    rows = lambda df: sorted((r.qid, r.chunk_id, round(r.score, 8)) for r in df.collect())
    # cells of a few chunks and questions give the same hits
    assert rows(index.top_k(questions, 3, chunk_block=20, question_block=7)) == rows(lexical.bm25_top_k(chunks, questions, 3, stem=False))
    plan = dict(kept)["chosen"]
    assert "CoGroups" in plan and "HashAggregate" not in plan


def test_block_max_search_scores_chosen_chunks_in_cells(spark, tmp_path):
    chunks, questions = zipf_corpus(spark)
    index = posting_blocks.PostingBlocks(spark, str(tmp_path / "index"), stem=False, block=8)
    index.add(chunks, 0)
    got = index.top_k(questions, 4, chunk_block=20, question_block=3)
    # no join of a question's chunks with all their terms, no sum over a row per question, chunk and term
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "sum(" not in plan
    rows = lambda df: sorted((r.course, r.qid, r.chunk_id, round(r.score, 8), r["rank"]) for r in df.collect())
    assert rows(got) == rows(lexical.bm25_top_k(chunks, questions, 4, stem=False))
