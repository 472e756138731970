"""End-to-end retrieval for many questions over many courses, switched by a preset."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.config import preset
from passagelake.functions.text import terms
from passagelake.operators import fusion
from passagelake.operators.dense import dense_top_k, score_pairs
from passagelake.operators.indexing import course_routes
from passagelake.operators.lexical import bm25_top_k, lexical_index, search_text
from passagelake.operators.model_stages import (
    MOST_PARAPHRASES, hypothetical_passage, loose_json, question_variants, rerank_prompt, stage_responses, standalone_questions, with_paraphrases,
)
from passagelake.operators.passages import build_passages
from passagelake.sources.stores import materialise


@dataclass(frozen=True)
class Models:
    """What stands in for the models.

    ``embed(rows(text, ...), mode)`` adds ``embedding``; ``responses(qid, stage, text)`` holds recorded rewrite, paraphrase
    and hyde texts; ``judge(prompts(qid, prompt), pool)`` returns ``qid, text`` rerank responses.
    """

    embed: Callable[[DataFrame, str], DataFrame]
    responses: DataFrame | None = None
    judge: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    stem: bool = True


@dataclass(frozen=True)
class Retrieval:
    """``ranked`` (final order with scores and decision), ``passages`` and one ``trace`` row per question."""

    ranked: DataFrame
    passages: DataFrame
    trace: DataFrame


NO_RESPONSES = "qid string, stage string, text string"


def _prepare(questions: DataFrame, models: Models, config: dict) -> DataFrame:
    base = questions.select(
        "course", "qid", "question", "history", F.lit(0).alias("model_calls"), F.lit(0).alias("model_failures")
    )
    recorded = models.responses if models.responses is not None else questions.sparkSession.createDataFrame([], NO_RESPONSES)
    ready = standalone_questions(base, recorded) if config["query"]["rewrite"] else base.withColumn("standalone", F.col("question"))
    if config["query"]["multi_query"]:
        return with_paraphrases(ready, recorded)
    return ready.withColumn("paraphrases", F.array().cast("array<string>"))


def _candidates(prepared: DataFrame, chunks: DataFrame, models: Models, config: dict):
    """Fused pool with raw scores, and the questions for which the hypothetical passage was used."""
    r = config["retrieval"]
    hybrid = r["mode"] == "hybrid"
    variants = question_variants(prepared, r["multi_query_weight"])
    keyed = variants.withColumn("base_qid", F.col("qid")).withColumn("qid", F.concat_ws("~", "qid", F.col("variant").cast("string")))
    mode = "query" if config["indexing"]["task_types"] else ""
    # lists, gate and pool are read by several steps: written once, a search never runs again for the next step
    asked = materialise(models.embed(keyed, mode), "asked-vectors")
    depth = r["candidate_k"] if hybrid or config["rerank"]["enabled"] else r["top_k"]
    names = keyed.select("qid", "base_qid", "variant", F.col("weight").alias("w"))

    def lists(hits: DataFrame, slot: int, weight: float) -> DataFrame:
        return hits.join(names, "qid").select(
            F.col("base_qid").alias("qid"), "chunk_id", (F.col("variant") * 2 + slot).alias("list_no"), "rank",
            (F.col("w") * weight).alias("weight"), "score", "variant",
        )

    dense = materialise(lists(dense_top_k(chunks, asked, depth), 0, r["dense_weight"]), "dense-hits")
    columns = ["qid", "chunk_id", "list_no", "rank", "weight"]
    all_lists = dense.select(*columns)
    own_dense = dense.where(F.col("variant") == 0)
    own_bm25 = own_dense.limit(0)
    if hybrid:
        index = lexical_index(chunks, config["indexing"]["header"], models.stem)
        worded = keyed.withColumnRenamed("text", "question")
        hits = bm25_top_k(chunks, worded, r["candidate_k"], stem=models.stem, index=index)
        bm25 = materialise(lists(hits, 1, r["bm25_weight"]), "lexical-hits")
        all_lists = all_lists.unionByName(bm25.select(*columns))
        own_bm25 = bm25.where(F.col("variant") == 0)
    weak = None
    if config["query"]["hyde"] and r["hyde_gate"] > 0 and models.responses is not None:
        best = own_dense.groupBy("qid").agg(F.max("score").alias("best"))
        gated = prepared.select("course", "qid").join(best, "qid", "left").where(F.coalesce("best", F.lit(-1.0)) < r["hyde_gate"])
        weak = gated.join(stage_responses(models.responses, "hyde"), "qid", "left").select(
            "course", "qid", hypothetical_passage(F.col("hyde_response")).alias("text")
        )
        weak = materialise(weak, "hyde")
        imagined = models.embed(weak.where(F.col("text") != ""), "document" if config["indexing"]["task_types"] else "")
        extra = fusion.ranked_list(dense_top_k(chunks, imagined, r["candidate_k"]), 2 * (MOST_PARAPHRASES + 1), r["hyde_weight"])
        all_lists = all_lists.unionByName(extra)
        weak = weak.select("qid", (F.col("text") != "").alias("hyde"))
    fused = fusion.reciprocal_rank_fusion(all_lists, r["rrf_k"]).where(F.col("rank") <= fusion.pool_size(config))
    fused = materialise(fused, "fused")
    # every pooled chunk gets a dense score from the standalone question's own vector
    own_vectors = asked.where(F.col("variant") == 0).select(F.col("base_qid").alias("qid"), "embedding")
    scored = score_pairs(fused.select("qid", "chunk_id"), chunks, own_vectors).select(
        "qid", "chunk_id", F.col("dense").alias("score")
    )
    return fusion.candidate_pool(fused, scored, own_bm25, fusion.pool_size(config)), weak


def _run(questions: DataFrame, chunks: DataFrame, models: Models, config: dict) -> Retrieval:
    top_k = config["retrieval"]["top_k"]
    prepared = _prepare(questions, models, config)
    pool, weak = _candidates(prepared, chunks, models, config)
    pool = materialise(pool, "pool")
    judged = config["rerank"]["enabled"] and models.judge is not None
    if judged:
        shown = pool.where(F.col("rank") <= config["rerank"]["candidates"]).join(
            chunks.select("chunk_id", "text", "context_header"), "chunk_id"
        )
        shown = materialise(shown, "shown")
        prompts = rerank_prompt(shown, prepared, config["rerank"]["passage_chars"])
        responses = models.judge(prompts, shown.join(prepared.select("qid", "standalone"), "qid"))
        candidates = fusion.merge_rerank(
            pool, responses.withColumn("json", F.coalesce(loose_json("text"), F.lit("{}"))), config["rerank"]["candidates"]
        )
        candidates = materialise(candidates, "reranked")
    else:
        candidates = pool.withColumn("rerank_ok", F.lit(False))
    if config["mmr"]["enabled"]:
        used = candidates.where(F.col("rank") <= 2 * top_k).select("chunk_id").distinct()
        tokens = chunks.join(used, "chunk_id", "left_semi").select(
            "chunk_id", F.array_distinct(terms(search_text(config["indexing"]["header"]), models.stem)).alias("tokens")
        )
        selected = fusion.diversify(candidates, tokens, top_k, config["mmr"]["lambda"])
    else:
        selected = candidates.where(F.col("rank") <= top_k)
    signalled = fusion.with_signal(selected, config["abstain"]["signal"])
    ranked = materialise(fusion.decide(signalled, *fusion.threshold_columns(config["abstain"])), "ranked")
    passages = build_passages(
        ranked.where("in_context"), chunks, config["expand"]["neighbors"], config["expand"]["max_chars"]
    )
    per_question = ranked.groupBy("qid").agg(
        F.count("*").alias("retrieved"), F.bool_and("abstain").alias("abstain"), F.first("rerank_ok").alias("rerank_ok")
    )
    trace = prepared.join(per_question, "qid", "left")
    if weak is not None:
        trace = trace.join(weak, "qid", "left")
    else:
        trace = trace.withColumn("hyde", F.lit(None).cast("boolean"))
    hyde_asked, failed = F.col("hyde").isNotNull().cast("int"), F.lit(judged) & ~F.coalesce("rerank_ok", F.lit(False))
    has_rows = F.col("retrieved").isNotNull()
    # a question of a course without chunks is answered before any model is asked
    trace = trace.select(
        "qid", F.lit(config["name"]).alias("pipeline"),
        F.when(has_rows, F.col("standalone")).otherwise(F.col("question")).alias("standalone"),
        F.when(has_rows, F.col("paraphrases")).otherwise(F.array().cast("array<string>")).alias("paraphrases"),
        F.coalesce("retrieved", F.lit(0)).alias("retrieved"),
        F.coalesce("abstain", F.lit(True)).alias("abstain"),
        F.when(has_rows, F.col("model_calls") + hyde_asked + int(judged)).otherwise(0).alias("model_calls"),
        F.when(
            has_rows, F.col("model_failures") + (F.col("hyde").isNotNull() & ~F.coalesce("hyde", F.lit(False))).cast("int") + failed.cast("int")
        ).otherwise(0).alias("model_failures"),
        F.coalesce("hyde", F.lit(False)).alias("hyde"), (failed & has_rows).alias("rerank_failed"),
    )
    return Retrieval(ranked, passages, trace)


def retrieve(questions: DataFrame, chunks: DataFrame, models: Models, config: dict) -> Retrieval:
    """``questions(course, qid, question, history)`` against ``chunks`` (scan view plus ``embedding``).

    Courses whose chunks are all ``legacy`` are served by the basic preset until they are re-indexed.
    """
    if config["indexing"]["chunker"] == "basic":
        return _run(questions, chunks, models, config)
    routes = materialise(course_routes(chunks, config), "routes")  # a row per course
    old = routes.where(F.col("pipeline") == "basic").select("course")
    if old.isEmpty():
        return _run(questions, chunks, models, config)
    parts = []
    for kind, cfg in (("left_anti", config), ("left_semi", preset("basic"))):
        parts.append(_run(questions.join(old, "course", kind), chunks.join(old, "course", kind), models, cfg))
    fresh, legacy = parts
    renamed = legacy.trace.withColumn("pipeline", F.lit("basic (course not re-indexed yet)"))
    return Retrieval(
        fresh.ranked.unionByName(legacy.ranked),
        fresh.passages.unionByName(legacy.passages),
        fresh.trace.unionByName(renamed),
    )


def frozen_baseline(questions: DataFrame, chunks: DataFrame, top_k: int = 5, cut_off: float = 0.15) -> DataFrame:
    """The original retrieval: dense top-k with a fixed cosine cut-off; ``questions`` and ``chunks`` carry ``embedding``."""
    hits = dense_top_k(chunks, questions, top_k).withColumn("signal", F.col("score"))
    return fusion.decide(hits, F.lit(cut_off), F.lit(None).cast("double"))
