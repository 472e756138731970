"""Rank fusion, candidate pools, rerank merging, diversity and the answer/abstain decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passagelake.functions.text import let, set_jaccard


def ranked_list(hits: DataFrame, list_no: int, weight: float | Column) -> DataFrame:
    """One ranked list in the shape fusion expects."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return hits.select("qid", "chunk_id", F.lit(list_no).alias("list_no"), "rank", w.alias("weight"))


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60) -> DataFrame:
    """Sum ``weight / (k + rank)`` per question and chunk; ties keep first insertion (list, then position)."""
    fused = lists.groupBy("qid", "chunk_id").agg(
        F.sum(F.col("weight") / (k + F.col("rank"))).alias("rrf"),
        F.min(F.struct("list_no", "rank")).alias("seen"),
    )
    order = Window.partitionBy("qid").orderBy(F.round("rrf", 12).desc(), F.col("seen.list_no"), F.col("seen.rank"))
    return fused.withColumn("rank", F.row_number().over(order)).drop("seen")


def pool_size(config: dict) -> int:
    return max(config["rerank"]["candidates"], 2 * config["retrieval"]["top_k"])


def candidate_pool(fused: DataFrame, dense: DataFrame, bm25: DataFrame, size: int) -> DataFrame:
    """Top ``size`` fused rows with their raw scores: dense nullable, bm25 0 by default, rerank null."""
    return (
        fused.where(F.col("rank") <= size)
        .join(dense.select("qid", "chunk_id", F.col("score").alias("dense")), ["qid", "chunk_id"], "left")
        .join(bm25.select("qid", "chunk_id", F.col("score").alias("bm25")), ["qid", "chunk_id"], "left")
        .select(
            "qid", "chunk_id", "rank", "rrf", "dense",
            F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.lit(None).cast("double").alias("rerank"),
        )
    )


def judged_scores(responses: DataFrame) -> DataFrame:
    """``responses(qid, json)`` to ``qid, number, score``; the last of repeated numbers wins, scores clamp to 0..10."""
    # every item is parsed on its own, so one that is no object does not take the others with it
    plain = F.from_json("json", "array<string>")
    wrapped = F.from_json("json", "struct<scores:array<string>>")["scores"]
    listed = responses.select(
        "qid", F.posexplode(F.when(F.col("json").startswith("["), plain).otherwise(wrapped)).alias("at", "text")
    ).select("qid", "at", F.from_json("text", "map<string,string>").alias("item"))
    value = F.trim(F.col("item")["score"])
    # a score that is given as null or blank counts as 0, a missing one is no score
    given = F.when(F.map_contains_key("item", F.lit("score")), F.when(F.coalesce(value, F.lit("")) == "", 0.0).otherwise(value.try_cast("double")))
    items = listed.where(F.col("item").isNotNull()).select("qid", "at", F.col("item")["id"].try_cast("double").alias("number"), given.alias("score"))
    whole = F.col("number") == F.floor("number")
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return (
        items.where(whole & finite & (F.col("number") >= 1))
        .groupBy("qid", F.col("number").cast("int").alias("number"))
        .agg(F.max_by(F.least(F.greatest("score", F.lit(0.0)), F.lit(10.0)), "at").alias("score"))
    )


def merge_rerank(pool: DataFrame, responses: DataFrame, candidates: int = 20) -> DataFrame:
    """Attach listwise scores to the pool and order it.

    A response that scores fewer than half of the numbered passages is rejected as a whole: the fused order stays and
    ``rerank_ok`` is false. Numbers follow the fused rank.
    """
    given = judged_scores(responses).where(F.col("number") <= candidates)
    joined = pool.drop("rerank").join(
        given.select("qid", F.col("number").alias("rank"), F.col("score").alias("_score")), ["qid", "rank"], "left"
    )
    everyone = Window.partitionBy("qid")
    shown = F.count_if(F.col("rank") <= candidates).over(everyone)
    checked = (
        joined.withColumn("rerank_ok", F.count("_score").over(everyone) >= F.ceil(shown / 2))
        .where(~F.col("rerank_ok") | (F.col("rank") <= candidates))
        .withColumn("rerank", F.when(F.col("rerank_ok"), F.coalesce("_score", F.lit(0.0))))
    )
    order = Window.partitionBy("qid").orderBy(
        F.col("rerank").desc_nulls_last(), F.round("rrf", 12).desc(), F.col("rank")
    )
    return checked.withColumn("rank", F.row_number().over(order)).drop("_score")


def mmr_pick(pool: Column, k: int, lam: float) -> Column:
    """Greedy diversity over ``array<struct<pos,relevance,tokens>>``: positions in order of selection.

    Every remaining item carries its highest overlap with the picked ones, so a step compares the pool with one item.
    """
    item = "struct<pos:int,relevance:double,tokens:array<string>,overlap:double>"
    start = F.struct(
        F.array().cast("array<int>").alias("picked"),
        F.transform(
            pool,
            lambda p: F.struct(
                p["pos"].cast("int").alias("pos"), p["relevance"].cast("double").alias("relevance"),
                p["tokens"].alias("tokens"), F.lit(0.0).alias("overlap"),
            ),
        ).cast(f"array<{item}>").alias("left"),
    )

    def step(acc: Column, _: Column) -> Column:
        marginal = F.transform(
            acc["left"],
            lambda p: F.struct(
                F.round(lam * p["relevance"] - (1 - lam) * p["overlap"], 12).alias("gain"), (-p["pos"]).alias("early"),
                p["tokens"].alias("tokens"),
            ),
        )

        def take(won: Column) -> Column:
            rest = F.filter(acc["left"], lambda p: p["pos"] != -won["early"])
            return F.struct(
                F.concat(acc["picked"], F.array(-won["early"])).alias("picked"),
                F.transform(
                    rest,
                    lambda p: F.struct(
                        p["pos"].alias("pos"), p["relevance"].alias("relevance"), p["tokens"].alias("tokens"),
                        F.greatest(p["overlap"], set_jaccard(p["tokens"], won["tokens"])).alias("overlap"),
                    ),
                ).alias("left"),
            )

        return F.when(F.size(acc["left"]) == 0, acc).otherwise(let(F.array_max(marginal), take))

    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda acc: acc["picked"])


def diversify(candidates: DataFrame, tokens: DataFrame, top_k: int, lam: float) -> DataFrame:
    """Maximal marginal relevance over the first ``2·top_k`` candidates of each question."""
    pool = candidates.where(F.col("rank") <= 2 * top_k).join(tokens, "chunk_id")
    relevance = F.when(F.col("rerank").isNotNull(), F.col("rerank") / 10).otherwise(F.col("rrf") / F.col("_best"))
    best = F.max_by(F.when(F.col("rrf") == 0, F.lit(1.0)).otherwise(F.col("rrf")), -F.col("rank")).over(
        Window.partitionBy("qid")
    )
    items = pool.withColumn("_best", best).select(
        "qid", F.struct(F.col("rank").alias("pos"), relevance.alias("relevance"), "tokens").alias("item")
    )
    picks = items.groupBy("qid").agg(mmr_pick(F.sort_array(F.collect_list("item")), top_k, lam).alias("picked"))
    chosen = picks.select("qid", F.posexplode("picked").alias("_at", "rank"))
    return candidates.join(chosen, ["qid", "rank"]).withColumn("rank", F.col("_at") + 1).drop("_at")


def with_signal(candidates: DataFrame, wanted: str) -> DataFrame:
    """The score thresholds apply to: the reranker's if configured and usable, else the dense one."""
    use = F.lit(wanted == "rerank") & F.col("rerank_ok")
    return candidates.withColumn("signal", F.when(use, F.col("rerank")).otherwise(F.col("dense"))).withColumn(
        "signal_kind", F.when(use, F.lit("rerank")).otherwise(F.lit("dense"))
    )


def threshold_columns(abstain: dict) -> tuple[Column, Column]:
    """Threshold and per-chunk floor; a configured reranker that failed switches to the fallback pair."""
    fallback = abstain.get("fallback") or {}
    failed = F.lit(abstain["signal"] == "rerank") & ~F.col("rerank_ok")
    threshold = F.when(failed, F.lit(float(fallback.get("threshold") or 0.0))).otherwise(F.lit(float(abstain["threshold"])))
    floor = F.when(failed, F.lit(fallback.get("drop_below")).cast("double")).otherwise(
        F.lit(abstain.get("drop_below")).cast("double")
    )
    return threshold, floor


def decide(ranked: DataFrame, threshold: Column, floor: Column, keys: list[str] | None = None) -> DataFrame:
    """Add ``abstain`` and ``in_context``. A null signal counts as minus infinity and never satisfies a threshold."""
    per_question = Window.partitionBy(*(keys or ["qid"]))
    signal = F.coalesce("signal", F.lit(float("-inf")))
    marked = ranked.withColumn("_t", threshold).withColumn("_f", F.coalesce(floor, F.col("_t")))
    return (
        marked.withColumn("abstain", F.max(signal).over(per_question) < F.col("_t"))
        .withColumn("in_context", ~F.col("abstain") & (signal >= F.col("_f")))
        .drop("_t", "_f")
    )
