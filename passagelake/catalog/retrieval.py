"""Lexical and dense retrieval, fusion, decision, passages and the composed pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passagelake.catalog import standins
from passagelake.catalog.indexing import headed_pages, lesson_docs
from passagelake.catalog.registry import query, r6
from passagelake.catalog.sql_parts import mmr_parts, passage_parts
from passagelake.config import preset
from passagelake.functions import text as tx
from passagelake.operators import dense, fusion, lexical, passages
from passagelake.operators import indexing as ix
from passagelake.operators import inverted_file as ivf
from passagelake.operators.posting_blocks import PostingBlocks
from passagelake.plans.retrieve import Models, frozen_baseline, retrieve
from passagelake.session import work_folder
from passagelake.sources.tables import Lake

K = 20


# ---------------------------------------------------------------- lexical


@query(
    "R1_terms",
    "SELECT chunk_id, len(terms) AS n_terms, md5(array_to_string(terms, ' ')) AS digest FROM chunk_terms",
)
def chunk_terms(lake: Lake):
    return lake.chunks().select("chunk_id", tx.terms(F.col("text"), stem=False).alias("t")).select(
        "chunk_id", F.size("t").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest")
    )


@query("R1_stemmed_terms")
def stemmed_terms(lake: Lake):
    return lake.chunks().select("chunk_id", F.explode(tx.terms(F.col("text"))).alias("stem")).groupBy("stem").agg(
        F.count("*").alias("uses"), F.count_distinct("chunk_id").alias("chunks")
    )


@query("R2_postings", "SELECT course, chunk_id, term, tf FROM postings")
def postings(lake: Lake):
    index = lexical.lexical_index(lake.chunks(), stem=False)
    return index.postings.where(F.col("term").isNotNull()).select("course", "chunk_id", "term", "tf")


@query("R2_term_statistics", "SELECT course, docs, round(avg_len, 6) AS avg_len, terms FROM course_stats JOIN (SELECT course, count(*) AS terms FROM doc_freq GROUP BY course) USING (course)")
def term_statistics(lake: Lake):
    index = lexical.lexical_index(lake.chunks(), stem=False)
    words = index.document_frequency().groupBy("course").agg(F.count("*").alias("terms"))
    return index.course_stats().join(words, "course").select("course", "docs", r6("avg_len").alias("avg_len"), "terms")


@query(
    "R3_header_terms",
    "SELECT chunk_id, len(terms) + CASE WHEN length(CAST(doc_id AS VARCHAR)) > 0 THEN 2 ELSE 0 END AS n_terms FROM chunk_terms",
)
def header_terms(lake: Lake):
    chunks = lake.chunks().withColumn("context_header", F.col("lesson_title"))
    return chunks.select("chunk_id", F.size(tx.terms(lexical.search_text(True), stem=False)).alias("n_terms"))


@query("R4_idf", "SELECT course, term, df, round(idf, 6) AS idf FROM term_idf")
def idf(lake: Lake):
    # stored: documents are cut and tokenised once, not again for the courses' statistics
    index = lexical.stored_index(lexical.lexical_index(lake.chunks(), stem=False))
    return index.document_frequency().join(index.course_stats(), "course").select(
        "course", "term", "df", r6(lexical.idf(F.col("docs"), F.col("df"))).alias("idf")
    )


@query("R5_bm25_top_k", "SELECT course, qid, chunk_id, round(score, 6) AS score, rank FROM bm25_top")
def bm25(lake: Lake):
    hits = lexical.bm25_top_k(lake.stored_chunks(), lake.questions(), K, stem=False)
    return hits.select("course", "qid", "chunk_id", r6("score").alias("score"), "rank")


@query("R5_block_max_top_k", "SELECT course, qid, chunk_id, round(score, 6) AS score, rank FROM bm25_top")
def bm25_blocks(lake: Lake):
    """The same hits from a stored index that was filled in two batches."""
    index = PostingBlocks(lake.spark, work_folder(lake.spark, "posting-blocks"), stem=False)
    chunks = lake.stored_chunks()
    for batch in (0, 1):
        index.add(chunks.where(F.pmod("chunk_id", F.lit(2)) == batch), batch)
    hits = index.top_k(lake.questions(), K)
    return hits.select("course", "qid", "chunk_id", r6("score").alias("score"), "rank")


@query("R5_bm25_stemmed")
def bm25_stemmed(lake: Lake):
    hits = lexical.bm25_top_k(lake.stored_chunks(), lake.questions(), K)
    return hits.select("course", "qid", "chunk_id", r6("score").alias("score"), "rank")


# ---------------------------------------------------------------- dense


@query("R6_vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(lake: Lake):
    return lake.vectors().select(F.col("chunk_id").alias("vec_id"), r6(tx.norm(F.col("embedding"))).alias("norm"))


NEXT_PAIR = """
    SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def following_vectors(lake: Lake):
    other = lake.vectors().select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("embedding").alias("other"))
    return lake.vectors().join(other, "chunk_id")


@query("R7_cosine", NEXT_PAIR)
def cosine(lake: Lake):
    return following_vectors(lake).select(F.col("chunk_id").alias("vec_id"), r6(tx.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


def vector_questions(lake: Lake):
    return lake.vectors().select("course", F.col("chunk_id").cast("string").alias("qid"), "embedding")


def dense_hits(lake: Lake, k: int):
    """Every vector asks its own course; a vector is not its own answer, so one more is taken and itself left out."""
    hits = dense.dense_top_k(lake.vectors(), vector_questions(lake), k + 1).where(F.col("qid") != F.col("chunk_id").cast("string"))
    order = Window.partitionBy("qid").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@query(
    "R8_dense_top_k",
    """
    SELECT course, qid, chunk_id, round(score, 6) AS score, rank, max(score) OVER (PARTITION BY qid) < 0.15 AS abstain FROM vector_top""",
)
def dense_top_k(lake: Lake):
    hits = dense_hits(lake, 5).withColumn("signal", F.col("score"))
    decided = fusion.decide(hits, F.lit(0.15), F.lit(None).cast("double"))
    return decided.select("course", "qid", "chunk_id", r6("score").alias("score"), "rank", "abstain")


@query("R9_pair_scores", "SELECT b.qid, b.chunk_id, round(d.score, 6) AS dense FROM bm25_top b JOIN dense_all d USING (qid, chunk_id)")
def pair_scores(lake: Lake):
    """Dense scores of the pairs BM25 found."""
    chunks, questions = lake.stored_chunks(), lake.questions()
    pairs = lexical.bm25_top_k(chunks, questions, K, stem=False).select("qid", "chunk_id")
    used = chunks.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi")
    scored = dense.score_pairs(pairs, standins.embed(used), standins.embed(questions, text="question"))
    return scored.select("qid", "chunk_id", r6("dense").alias("dense"))


def _closeness(v: str, centre: str) -> str:
    return f"round(list_inner_product({v}, {centre}) - list_inner_product({centre}, {centre}) / 2, 9)"


def _trained(last: str) -> str:
    """One round of training: a centre becomes the mean of the vectors nearest to it."""
    near = f"SELECT u.*, c.cell, row_number() OVER (PARTITION BY vec_id ORDER BY {_closeness('u.u', 'c.centre')} DESC, c.cell) AS pos FROM units u JOIN {last} c USING (course)"
    parts = f"SELECT course, cell, d, avg(x) AS x FROM (SELECT course, cell, unnest(u) AS x, unnest(range(len(u))) AS d FROM ({near}) WHERE pos = 1) GROUP BY ALL"
    means = f"SELECT course, cell, list(x ORDER BY d) AS mean FROM ({parts}) GROUP BY ALL"
    return f"SELECT course, cell, coalesce(mean, centre) AS centre FROM {last} LEFT JOIN ({means}) USING (course, cell)"


_CENTRES = f"centres_{ivf.ROUNDS}"

# the lists replayed: every course's sample is the whole course at these sizes
INVERTED = {
    "units": """
        SELECT CAST(label AS VARCHAR) AS course, vec_id, v, CASE WHEN list_inner_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) ELSE v END AS u,
          row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n
        FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
    "centres_0": "SELECT course, CAST(pos AS INT) AS cell, u AS centre FROM units WHERE pos < greatest(round(sqrt(n) / 2), 1)",
    **{f"centres_{r + 1}": _trained(f"centres_{r}") for r in range(ivf.ROUNDS)},
    "listed": f"""
        SELECT course, vec_id, v, u, n, cell, list_max(list_transform(u, lambda x: abs(x))) AS scale FROM (
          SELECT u.*, c.cell, row_number() OVER (PARTITION BY vec_id ORDER BY {_closeness('u.u', 'c.centre')} DESC, c.cell) AS near FROM units u JOIN {_CENTRES} c USING (course)) WHERE near = 1""",
    "coded": f"SELECT *, list_transform(u, lambda x: CASE WHEN scale > 0 THEN round_even(x / scale * {ivf.LEVELS}, 0) ELSE 0 END * (scale / {ivf.LEVELS})) AS code FROM listed",
    "list_sizes": "SELECT course, cell, count(*) AS size FROM listed GROUP BY ALL",
    "probed": f"""
        SELECT course, vec_id, cell FROM (
          SELECT u.course, u.vec_id, u.n, c.cell, s.size, sum(s.size) OVER (PARTITION BY u.vec_id ORDER BY {_closeness('u.u', 'c.centre')} DESC, c.cell) - s.size AS before
          FROM units u JOIN {_CENTRES} c USING (course) JOIN list_sizes s USING (course, cell)) WHERE before < {ivf.PROBED} * n""",
    "pooled": """
        SELECT course, q, chunk_id, n, pos FROM (
          SELECT p.course, p.vec_id AS q, c.vec_id AS chunk_id, c.n,
            row_number() OVER (PARTITION BY p.vec_id ORDER BY round(list_inner_product(a.u, c.code), 9) DESC, c.vec_id) AS pos
          FROM probed p JOIN units a ON a.vec_id = p.vec_id JOIN coded c ON c.course = p.course AND c.cell = p.cell) WHERE pos <= least(100, greatest(6, n // 5))""",
    "near_scored": """
        SELECT p.*, CASE WHEN list_inner_product(a.v, a.v) = 0 OR list_inner_product(b.v, b.v) = 0 THEN 0 ELSE
          list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) END AS score
        FROM pooled p JOIN units a ON a.vec_id = p.q JOIN units b ON b.vec_id = p.chunk_id""",
    "near_ranked": "SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM near_scored",
    "others_exact": """
        SELECT q, chunk_id FROM (
        SELECT a.vec_id AS q, b.vec_id AS chunk_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(
          CASE WHEN list_inner_product(a.v, a.v) = 0 OR list_inner_product(b.v, b.v) = 0 THEN 0 ELSE
          list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) END, 9) DESC, b.vec_id) AS rank
        FROM units a JOIN units b ON a.course = b.course AND a.vec_id <> b.vec_id) WHERE rank <= 5""",
    "others_near": """
        SELECT q, chunk_id FROM (SELECT q, chunk_id, row_number() OVER (PARTITION BY q ORDER BY rank) AS pos FROM near_ranked WHERE q <> chunk_id AND rank <= 6) WHERE pos <= 5""",
}


@query(
    "R10_approximate_top_k",
    "SELECT course, CAST(q AS VARCHAR) AS qid, chunk_id, round(score, 6) AS score, rank FROM near_ranked WHERE rank <= 6",
    INVERTED,
)
def approximate(lake: Lake):
    hits = ivf.approximate_top_k(ivf.build(lake.vectors()), lake.vectors(), vector_questions(lake), 6)
    return hits.select("course", "qid", "chunk_id", r6("score").alias("score"), "rank")


@query(
    "R10_recall",
    """
    SELECT count(*) AS exact_pairs, count(n.q) AS found_pairs, round(count(n.q) / count(*), 6) AS recall,
      (SELECT count(*) FROM pooled) AS pooled_pairs, (SELECT count(*) FROM units a JOIN units b USING (course)) AS course_pairs
    FROM others_exact e LEFT JOIN others_near n USING (q, chunk_id)""",
    INVERTED,
)
def approximate_recall(lake: Lake):
    """Share of the exact five nearest other vectors that the approximate search returns, and the pairs that it scores exactly."""
    index = ivf.build(lake.vectors())
    exact = dense_hits(lake, 5).select("qid", "chunk_id")
    others = ivf.approximate_top_k(index, lake.vectors(), vector_questions(lake), 6).where(F.col("qid") != F.col("chunk_id").cast("string"))
    at = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    near = others.withColumn("at", at).where("at <= 5").select("qid", "chunk_id", F.lit(1).alias("found"))
    pooled = ivf.candidates(index, vector_questions(lake), 6).agg(F.count("*").alias("pooled_pairs"))
    pairs = lake.vectors().groupBy("course").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("course_pairs"))
    found = exact.join(near, ["qid", "chunk_id"], "left").agg(
        F.count("*").alias("exact_pairs"), F.count("found").alias("found_pairs"), r6(F.count("found") / F.count("*")).alias("recall")
    )
    return found.join(pooled).join(pairs)  # three tables of one row


# ---------------------------------------------------------------- fusion to decision


def embedded_chunks(lake: Lake):
    """The stored chunk table: chunked and embedded once, read by column afterwards."""
    return lake.once("embedded", lambda: standins.embed(lake.chunks()))


def two_lists(lake: Lake, chunks=None):
    chunks, questions = chunks or embedded_chunks(lake), lake.questions()
    d = dense.dense_top_k(chunks, standins.embed(questions, text="question"), K)
    b = lexical.bm25_top_k(chunks, questions, K, stem=False)
    return d, b


@query("R8_dense_text_top_k", "SELECT course, qid, chunk_id, round(score, 6) AS score, rank FROM dense_top")
def dense_text(lake: Lake):
    d = dense.dense_top_k(embedded_chunks(lake), standins.embed(lake.questions(), text="question"), K)
    return d.select("course", "qid", "chunk_id", r6("score").alias("score"), "rank")


@query("R13_rank_fusion", "SELECT qid, chunk_id, round(rrf, 6) AS rrf, rank FROM fused")
def rank_fusion(lake: Lake):
    d, b = two_lists(lake)
    fused = fusion.reciprocal_rank_fusion(fusion.ranked_list(d, 0, 1.0).unionByName(fusion.ranked_list(b, 1, 1.0)))
    return fused.select("qid", "chunk_id", r6("rrf").alias("rrf"), "rank")


@query(
    "R13_zero_weight_list",
    """
    SELECT qid, chunk_id, round(sum(w / (60.0 + rank)), 6) AS rrf
    FROM (SELECT qid, chunk_id, rank, 0 AS w FROM dense_top UNION ALL SELECT qid, chunk_id, rank, 1 FROM bm25_top) GROUP BY qid, chunk_id""",
)
def zero_weight_list(lake: Lake):
    """The dense list has weight 0: its members stay, with a score of 0 unless the other list has them too."""
    d, b = two_lists(lake)
    fused = fusion.reciprocal_rank_fusion(fusion.ranked_list(d, 0, 0.0).unionByName(fusion.ranked_list(b, 1, 1.0)))
    return fused.select("qid", "chunk_id", r6("rrf").alias("rrf"))


def reworded(lake: Lake):
    """Recorded paraphrases: the questions in upper case (an alternative with other camelCase splits) as JSON."""
    body = F.to_json(F.struct(F.array(F.substring_index("question", ".", 1), F.col("question")).alias("queries")))
    return lake.questions().select("qid", F.lit("paraphrase").alias("stage"), body.alias("text"))


@query("R14_multi_query")
def multi_query(lake: Lake):
    config = preset("multiquery", {"query": {"rewrite": False}, "indexing": {"chunker": "basic", "header": False}})
    models = Models(standins.embed, responses=reworded(lake), stem=False)
    out = retrieve(asked(lake), embedded_chunks(lake), models, config)
    return out.ranked.select("qid", "chunk_id", r6("rrf").alias("rrf"), r6("dense").alias("dense"), "rank")


@query(
    "R15_hyde_gate",
    "SELECT q.qid, coalesce(max(d.score), -1) < 0.7 AS gated FROM questions q LEFT JOIN dense_top d USING (qid) GROUP BY q.qid",
)
def hyde_gate(lake: Lake):
    """Questions whose best dense match is below the gate get the hypothetical passage (recorded: the question itself)."""
    config = preset(
        "hyde", {"query": {"rewrite": False, "multi_query": False}, "indexing": {"chunker": "basic", "header": False}}
    )
    recorded = lake.questions().select("qid", F.lit("hyde").alias("stage"), F.concat(F.lit("A passage about it: "), "question").alias("text"))
    out = retrieve(asked(lake), embedded_chunks(lake), Models(standins.embed, responses=recorded, stem=False), config)
    return out.trace.select("qid", F.col("hyde").alias("gated"))


def asked(lake: Lake):
    return lake.questions().withColumn("history", F.array().cast("array<struct<question:string,answer:string>>"))


@query("R16_candidate_pool", "SELECT qid, chunk_id, rank, round(rrf, 6) AS rrf, round(dense, 6) AS dense, round(bm25, 6) AS bm25 FROM pool")
def candidate_pool(lake: Lake):
    chunks, questions = embedded_chunks(lake), lake.questions()
    d, b = two_lists(lake, chunks)
    fused = fusion.reciprocal_rank_fusion(fusion.ranked_list(d, 0, 1.0).unionByName(fusion.ranked_list(b, 1, 1.0)))
    size = fusion.pool_size(preset("hybrid"))
    own = dense.score_pairs(fused.where(F.col("rank") <= size).select("qid", "chunk_id"), chunks, standins.embed(questions, text="question"))
    pool = fusion.candidate_pool(fused, own.withColumnRenamed("dense", "score"), b, size)
    return pool.select("qid", "chunk_id", "rank", r6("rrf").alias("rrf"), r6("dense").alias("dense"), r6("bm25").alias("bm25"))


def lexical_pool(lake: Lake):
    """A candidate pool from BM25 alone, with texts."""
    b = lexical.bm25_top_k(lake.stored_chunks(), lake.questions(), K, stem=False)
    texts = lake.stored_chunks().select("chunk_id", "text", "context_header")
    asked_ = lake.questions().select("qid", F.col("question").alias("standalone"))
    pool = b.select("qid", "chunk_id", "rank", (1 / (60.0 + F.col("rank"))).alias("rrf"))
    return pool.join(texts, "chunk_id").join(asked_, "qid")


LEXICAL_JUDGED = {
    "lex_judged": """
        SELECT b.qid, b.chunk_id, b.rank AS pos, 1 / (60.0 + b.rank) AS rrf,
               CAST(floor(10 * len(list_intersect(q.terms, t.terms)) / len(q.terms)) AS DOUBLE) AS rerank
        FROM bm25_top b JOIN question_sets q USING (qid) JOIN chunk_terms t USING (chunk_id)""",
    "lex_ranked": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, pos) AS rank FROM lex_judged",
}


@query("R17_rerank_merge", "SELECT qid, chunk_id, rank, rerank FROM lex_ranked", LEXICAL_JUDGED)
def rerank_merge(lake: Lake):
    from passagelake.operators.model_stages import loose_json

    pool = lexical_pool(lake)
    responses = standins.overlap_judge(pool.select("qid").distinct(), pool).withColumn("json", loose_json("text"))
    merged = fusion.merge_rerank(pool.select("qid", "chunk_id", "rank", "rrf", F.lit(None).alias("rerank")), responses)
    return merged.select("qid", "chunk_id", "rank", "rerank")


@query(
    "R17_rejected_response",
    """
    SELECT qid, chunk_id, rank, CASE WHEN 2 * greatest(n // 3, 1) >= n THEN CAST(rank = 1 AS DOUBLE) END AS rerank
    FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM bm25_top)""",
)
def rejected_response(lake: Lake):
    """Responses that score a third of the passages are rejected as a whole and the fused order stays."""
    pool = lexical_pool(lake).select("qid", "chunk_id", "rank", "rrf", F.lit(None).alias("rerank"))
    sizes = pool.groupBy("qid").agg(F.floor(F.count("*") / 3).cast("int").alias("scored"))
    items = F.transform(F.sequence(F.lit(1), F.greatest("scored", F.lit(1))), lambda i: F.format_string('{"id":%d,"score":1}', i))
    responses = sizes.select("qid", F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("json"))
    return fusion.merge_rerank(pool, responses).select("qid", "chunk_id", "rank", "rerank")


@query(
    "R18_jaccard",
    """
    SELECT a.chunk_id, round(CASE WHEN len(a.terms) = 0 OR len(b.terms) = 0 THEN 0 ELSE
      len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms))) END, 6) AS jaccard
    FROM chunk_terms a JOIN chunk_terms b ON b.chunk_id = a.chunk_id + 1""",
)
def jaccard(lake: Lake):
    """Neighbouring chunks of one document."""
    sets = lake.chunks().select("chunk_id", F.array_distinct(tx.terms(F.col("text"), stem=False)).alias("a"))
    after = sets.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("a").alias("b"))
    return sets.join(after, "chunk_id").select("chunk_id", r6(tx.set_jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


MMR_LEXICAL = {
    "lex_hits": "SELECT qid, chunk_id, rank, 1 / (60.0 + rank) AS rrf FROM bm25_top",
    **mmr_parts("lex_hits", "rrf / (1 / 61.0)", "lex"),
}


@query("R19_mmr", "SELECT qid, chunk_id, pick AS rank FROM lex_picked", MMR_LEXICAL)
def mmr(lake: Lake):
    pool = lexical_pool(lake)
    tokens = pool.select("chunk_id", F.array_distinct(tx.terms(F.col("text"), stem=False)).alias("tokens")).dropDuplicates(["chunk_id"])
    candidates = pool.select("qid", "chunk_id", "rank", "rrf", F.lit(None).cast("double").alias("rerank"))
    return fusion.diversify(candidates, tokens, 5, 0.75).select("qid", "chunk_id", "rank")


@query(
    "R20_signal",
    "SELECT qid, chunk_id, CASE WHEN rank % 2 = 0 THEN 'rerank' ELSE 'dense' END AS signal_kind, CASE WHEN rank % 2 = 0 THEN 7.0 ELSE round(score, 6) END AS signal FROM bm25_top",
)
def signal(lake: Lake):
    b = lexical.bm25_top_k(lake.stored_chunks(), lake.questions(), K, stem=False)
    rows = b.select("qid", "chunk_id", F.col("score").alias("dense"), F.lit(7.0).alias("rerank"), (F.col("rank") % 2 == 0).alias("rerank_ok"))
    return fusion.with_signal(rows, "rerank").select("qid", "chunk_id", "signal_kind", r6("signal").alias("signal"))


@query(
    "R21_fallback_thresholds",
    """
    SELECT DISTINCT qid, CAST(CASE WHEN length(qid) % 2 = 0 THEN 5.0 ELSE 0.682 END AS DOUBLE) AS threshold, CAST(CASE WHEN length(qid) % 2 = 0 THEN 5.0 END AS DOUBLE) AS floor
    FROM questions""",
)
def fallback_thresholds(lake: Lake):
    threshold, floor = fusion.threshold_columns(preset("rerank")["abstain"])
    rows = lake.questions().withColumn("rerank_ok", F.length("qid") % 2 == 0)
    return rows.select("qid", threshold.alias("threshold"), floor.alias("floor"))


DECIDED = {
    "signalled": "SELECT qid, chunk_id, rank, CASE WHEN rank % 7 <> 0 THEN score END AS signal FROM bm25_top WHERE rank <= 10",
    "decided": """
        SELECT *, max(coalesce(signal, '-inf'::DOUBLE)) OVER (PARTITION BY qid) < 12 AS abstain FROM signalled""",
}


def decided_hits(lake: Lake):
    b = lexical.bm25_top_k(lake.stored_chunks(), lake.questions(), 10, stem=False)
    signalled = b.withColumn("signal", F.when(F.col("rank") % 7 != 0, F.col("score")))
    return fusion.decide(signalled, F.lit(12.0), F.lit(9.0))


@query(
    "R22_decision",
    "SELECT qid, chunk_id, abstain, NOT abstain AND coalesce(signal, '-inf'::DOUBLE) >= 9 AS in_context FROM decided",
    DECIDED,
)
def decision(lake: Lake):
    return decided_hits(lake).select("qid", "chunk_id", "abstain", "in_context")


CONTEXT = {
    **DECIDED,
    "context_hits": "SELECT qid, chunk_id, rank, signal FROM decided WHERE NOT abstain AND signal >= 9",
    **passage_parts("context_hits", "ctx", 1, 6000),
}


@query("R23_neighbours", "SELECT qid, chunk_id FROM ctx_near", CONTEXT)
def neighbours(lake: Lake):
    return passages.expand_neighbours(decided_hits(lake).where("in_context"), lake.stored_chunks(), 1).select("qid", "chunk_id")


@query("R24_runs", "SELECT qid, doc_id, min(chunk_index) AS first_index, count(*) AS pieces FROM ctx_runs GROUP BY qid, doc_id, run", CONTEXT)
def runs(lake: Lake):
    near = passages.expand_neighbours(decided_hits(lake).where("in_context"), lake.stored_chunks(), 1)
    merged = passages.merge_runs(near).groupBy("qid", "group_key", "run").agg(F.min("chunk_index").alias("first_index"), F.count("*").alias("pieces"))
    return merged.select("qid", F.split("group_key", ":")[0].cast("long").alias("doc_id"), "first_index", "pieces")


def passage_rows(found):
    return found.select(
        "qid", "position", F.col("lesson").cast("long").alias("doc_id"), "chunk_index", r6("score").alias("score"),
        F.length("text").alias("chars"), F.md5("text").alias("digest"),
    )


PASSAGE_SELECT = "SELECT qid, position, doc_id, chunk_index, round(score, 6) AS score, length(text) AS chars, md5(text) AS digest FROM "


@query("R25_passages", PASSAGE_SELECT.replace("position,", "CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INT) AS position,") + "ctx_all WHERE rank IS NOT NULL", CONTEXT)
def all_passages(lake: Lake):
    return passage_rows(passages.build_passages(decided_hits(lake).where("in_context"), lake.stored_chunks(), 1, 10**9))


@query("R26_context_budget", PASSAGE_SELECT + "ctx_passages", CONTEXT)
def context_budget(lake: Lake):
    return passage_rows(passages.build_passages(decided_hits(lake).where("in_context"), lake.stored_chunks(), 1, 6000))


# ---------------------------------------------------------------- the whole pipeline

PLAIN = {"indexing": {"chunker": "basic", "header": False, "task_types": False}}


def run_preset(lake: Lake, name: str, **models):
    config = preset(name, PLAIN)
    return retrieve(asked(lake), embedded_chunks(lake), Models(standins.embed, stem=False, **models), config)


BASIC_SQL = {
    "basic_hits": "SELECT qid, chunk_id, rank, score AS signal FROM dense_top WHERE rank <= 5",
    "basic_context": "SELECT * FROM basic_hits WHERE signal >= 0.15",
    **passage_parts("basic_context", "basic", 0, 6000),
}


@query("R28_retrieve_basic", PASSAGE_SELECT + "basic_passages", BASIC_SQL)
def retrieve_basic(lake: Lake):
    return passage_rows(run_preset(lake, "basic").passages)


HYBRID_SQL = {
    "hybrid_hits": "SELECT qid, chunk_id, rank, dense AS signal FROM pool WHERE rank <= 5",
    "hybrid_context": """
        SELECT qid, chunk_id, rank, signal FROM (SELECT *, max(signal) OVER (PARTITION BY qid) AS best FROM hybrid_hits)
        WHERE best >= 0.15 AND signal >= 0.15""",
    **passage_parts("hybrid_context", "hyb", 0, 6000),
}


@query("R28_retrieve_hybrid", PASSAGE_SELECT + "hyb_passages", HYBRID_SQL)
def retrieve_hybrid(lake: Lake):
    return passage_rows(run_preset(lake, "hybrid").passages)


ADVANCED_SQL = {
    **mmr_parts("reranked", "rerank / 10", "adv", "rerank"),
    "adv_hits": "SELECT qid, chunk_id, pick AS rank, carried AS signal FROM adv_picked",
    "adv_context": """
        SELECT qid, chunk_id, rank, signal FROM (SELECT *, max(signal) OVER (PARTITION BY qid) AS best FROM adv_hits)
        WHERE best >= 5 AND signal >= 5""",
    **passage_parts("adv_context", "advp", 1, 6000),
}


@query("R28_retrieve_advanced", PASSAGE_SELECT + "advp_passages", ADVANCED_SQL)
def retrieve_advanced(lake: Lake):
    return passage_rows(run_preset(lake, "advanced", judge=standins.overlap_judge).passages)


LEGACY_COURSE = "en"


def production_index(lake: Lake):
    """The chunk table of the default preset: structured chunks with headers; one course is still in the legacy index."""
    documents, config, basic = lesson_docs(lake, headed_pages()), preset("advanced"), preset("basic")
    old = F.col("course") == LEGACY_COURSE
    titles = documents.select("lesson", "title")

    def table(docs, cfg):
        chunks = ix.index_chunks(docs, cfg, standins.MODEL, "b1").withColumn("chunk_id", F.xxhash64("chunk_key"))
        return ix.embed_chunks(ix.scan_chunks(chunks, titles), cfg, standins.hashed_counts, standins.MODEL)

    return table(documents.where(~old), config).unionByName(table(documents.where(old), basic).withColumn("index_version", F.lit("legacy")))


def production_run(lake: Lake):
    """Every second question follows up on another one; its rewrite is recorded, but for every tenth, whose response is empty."""
    follows = F.col("item_id") % 2 == 0
    said = F.struct(F.substring_index("question", " ", 5).alias("question"), F.lit("An earlier answer.").alias("answer"))
    empty = F.array().cast("array<struct<question:string,answer:string>>")
    questions = lake.questions().withColumn("history", F.when(follows, F.array(said)).otherwise(empty))
    text = F.when(F.col("item_id") % 10 == 0, F.lit(" ")).otherwise(F.concat(F.lit('"'), F.substring_index("question", " ", 12), F.lit('"')))
    rewrites = lake.questions().where(follows).select("qid", F.lit("rewrite").alias("stage"), text.alias("text"))
    models = Models(standins.embed, responses=rewrites, judge=standins.overlap_judge)
    return retrieve(questions, lake.once("production", lambda: production_index(lake)), models, preset("advanced"))


@query("R28_retrieve_default")
def retrieve_default(lake: Lake):
    """The default pipeline: structure, headers, task types, rewrites, stemmed BM25, rerank, MMR, neighbours, legacy route."""
    return production_run(lake).passages.select(
        "qid", "position", F.col("lesson").cast("long").alias("doc_id"), "chunk_index", r6("score").alias("score"), F.length("text").alias("chars"), F.md5("text").alias("digest")
    )


@query(
    "R27_default_trace",
    """
    SELECT q.qid, CASE WHEN q.course = 'en' THEN 'basic (course not re-indexed yet)' ELSE 'advanced' END AS pipeline,
      CASE WHEN q.course <> 'en' AND q.item_id % 2 = 0 AND q.item_id % 10 <> 0 THEN trim(regexp_replace(array_to_string(list_slice(string_split(q.question, ' '), 1, 12), ' '), '\\s+', ' ', 'g')) ELSE q.question END AS standalone,
      0 AS paraphrases, CASE WHEN q.course = 'en' THEN 0 ELSE 1 + CAST(q.item_id % 2 = 0 AS INT) END AS model_calls,
      CASE WHEN q.course <> 'en' AND q.item_id % 10 = 0 THEN 1 ELSE 0 END AS model_failures, false AS rerank_failed
    FROM questions q""",
)
def default_trace(lake: Lake):
    out = production_run(lake).trace
    return out.select("qid", "pipeline", "standalone", F.size("paraphrases").alias("paraphrases"), "model_calls", "model_failures", "rerank_failed")


@query(
    "R27_trace",
    """
    SELECT q.qid, 'advanced' AS pipeline, q.question AS standalone, count(h.chunk_id) AS retrieved,
           coalesce(max(h.signal), -1) < 5 AS abstain, CASE WHEN count(h.chunk_id) > 0 THEN 1 ELSE 0 END AS model_calls, 0 AS model_failures
    FROM questions q LEFT JOIN adv_hits h USING (qid) GROUP BY q.qid, q.question""",
    ADVANCED_SQL,
)
def trace(lake: Lake):
    out = run_preset(lake, "advanced", judge=standins.overlap_judge).trace
    return out.select("qid", "pipeline", "standalone", "retrieved", "abstain", "model_calls", "model_failures")


@query(
    "R29_frozen_baseline",
    "SELECT qid, chunk_id, rank, round(signal, 6) AS signal, max(signal) OVER (PARTITION BY qid) < 0.15 AS abstain FROM basic_hits",
    BASIC_SQL,
)
def baseline(lake: Lake):
    hits = frozen_baseline(standins.embed(lake.questions(), text="question"), embedded_chunks(lake))
    return hits.select("qid", "chunk_id", "rank", r6("signal").alias("signal"), "abstain")
