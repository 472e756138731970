"""Exact top-k search in bounded work cells.

Scoring every chunk of a collection against every question of that collection is the operator's definition; writing
those pairs out is not. Chunks are hashed into blocks and questions into question blocks, both sized from counts, so
the largest collection simply becomes more cells. One cell scores its block with numpy and emits only its best ``k``
per question; a ranked window over these short lists gives the exact answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passagelake.sources.stores import materialise

# Equal sides: with n chunks and q questions, each chunk is sent q / 20 000 times and each question n / 20 000 times.
CHUNK_BLOCK = 20_000
QUESTION_BLOCK = 20_000
STRIPE_BYTES = 32_000_000
CELL = ["course", "block", "question_block"]


def cell_counts(
    chunks: DataFrame, questions: DataFrame, chunk_block: int = CHUNK_BLOCK, question_block: int = QUESTION_BLOCK
) -> DataFrame:
    """``course, blocks, question_blocks`` for every course that has both chunks and questions.

    Written once: its size is known when the chunks are joined with it, so the planner need not shuffle them by course.
    """
    have = chunks.groupBy("course").agg(F.count("*").alias("n"))
    asked = questions.groupBy("course").agg(F.count("*").alias("q"))
    counted = have.join(asked, "course").select(
        "course",
        F.ceil(F.col("n") / chunk_block).cast("int").alias("blocks"),
        F.ceil(F.col("q") / question_block).cast("int").alias("question_blocks"),
    )
    return materialise(counted, "cells")


def chunk_cells(chunks: DataFrame, cells: DataFrame) -> DataFrame:
    return (
        chunks.join(cells, "course")
        .withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))
        .withColumn("question_block", F.explode(F.sequence(F.lit(0), F.col("question_blocks") - 1)))
        .drop("blocks", "question_blocks")
    )


def question_cells(questions: DataFrame, cells: DataFrame) -> DataFrame:
    return (
        questions.join(cells, "course")
        .withColumn("question_block", F.pmod(F.xxhash64("qid"), F.col("question_blocks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .drop("blocks", "question_blocks")
    )


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores, ties by position; the whole tie at the cut is considered."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:k]


def hits_table(course, qids, picks, chunk_ids) -> pa.Table:
    """Arrow rows ``course, qid, chunk_id, score`` from per-question (positions, scores)."""
    lengths = [len(at) for at, _ in picks]
    at = np.concatenate([p for p, _ in picks]) if picks else np.array([], dtype=np.int64)
    score = np.concatenate([s for _, s in picks]) if picks else np.array([], dtype=np.float64)
    return pa.table(
        {
            "course": pa.array([course] * int(sum(lengths)), pa.string()),
            "qid": pa.array(np.repeat(np.asarray(qids, dtype=object), lengths), pa.string()),
            "chunk_id": pa.array(chunk_ids[at], pa.int64()),
            "score": pa.array(score, pa.float64()),
        }
    )


HITS = "course string, qid string, chunk_id long, score double"


def keep_best(hits: DataFrame, k: int) -> DataFrame:
    """Rank per question: score descending (compared at nine decimals), chunk id ascending; keep ``k``."""
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("chunk_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
