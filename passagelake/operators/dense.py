"""Dense retrieval: exact per-course cosine top-k, and pair scoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.functions.text import cosine, norm
from passagelake.operators.blocks import (
    CELL, CHUNK_BLOCK, HITS, QUESTION_BLOCK, STRIPE_BYTES, best, cell_counts, chunk_cells, hits_table, keep_best, question_cells,
)


def with_norms(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn("norm", norm(F.col(vector)))


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row positions and vectors of a table's ``embedding`` column by vector length."""
    column = table.column("embedding").combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1]
    out = {}
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        take = starts[at][:, None] + np.arange(size)[None, :]
        out[int(size)] = (at, flat[take].astype(np.float64))
    return out


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _score_cell(k: int):
    def cell(key, chunks: pa.Table, questions: pa.Table) -> pa.Table:
        chunks = chunks.sort_by("chunk_id")
        ids = chunks.column("chunk_id").to_numpy()
        qids, picks = [], []
        if chunks.num_rows:
            stored = {size: (at, _unit(m)) for size, (at, m) in _matrices(chunks).items()}
            names = questions.column("qid").to_pylist()
            for size, (at, asked) in _matrices(questions).items():
                # a stripe of questions at a time, so that a cell's scores never stand in memory together
                stripe = max(1, STRIPE_BYTES // (8 * len(ids)))
                for first in range(0, len(at), stripe):
                    part = at[first : first + stripe]
                    scores = np.zeros((len(part), len(ids)))  # other lengths and zero vectors keep score 0
                    if size in stored:
                        where, matrix = stored[size]
                        scores[:, where] = _unit(asked[first : first + stripe]) @ matrix.T
                    np.round(scores, 12, out=scores)
                    for row, q in enumerate(part):
                        top = best(np.round(scores[row], 9), k)
                        qids.append(names[q])
                        picks.append((top, scores[row][top]))
        return hits_table(key[0].as_py(), qids, picks, ids)

    return cell


def dense_top_k(
    chunks: DataFrame, questions: DataFrame, k: int,
    chunk_block: int = CHUNK_BLOCK, question_block: int = QUESTION_BLOCK,
) -> DataFrame:
    """``chunks(course, chunk_id, embedding)`` × ``questions(course, qid, embedding)`` → best ``k`` per question."""
    stored = chunks.select("course", "chunk_id", "embedding")
    asked = questions.select("course", "qid", "embedding")
    cells = cell_counts(stored, asked, chunk_block, question_block)
    scored = (
        chunk_cells(stored, cells)
        .groupBy(*CELL)
        .cogroup(question_cells(asked, cells).groupBy(*CELL))
        .applyInArrow(_score_cell(k), HITS)
    )
    return keep_best(scored, k)


def score_pairs(pairs: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Add ``dense`` to given ``(qid, chunk_id)`` pairs."""
    asked = questions.select("qid", F.col("embedding").alias("_q"))
    stored = chunks.select("chunk_id", F.col("embedding").alias("_c"))
    return (
        pairs.join(stored, "chunk_id")
        .join(asked, "qid")
        .withColumn("dense", cosine(F.col("_q"), F.col("_c")))
        .drop("_q", "_c")
    )
