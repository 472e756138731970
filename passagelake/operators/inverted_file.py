"""Approximate nearest neighbours by an inverted file.

The vectors of a course are parted into cells around trained centres. A list holds a cell's vectors as one byte a component. A
question probes the lists in order of distance to their centres until these hold the share of the course it asks for, scores the
byte codes there, and keeps a bounded pool of the best; only the pool's vectors are read and scored exactly.

A question is one row with the numbers of its lists, and meets the codes of its course in blocks of bounded size.

Training sees a sample of at most about ``SAMPLE`` vectors of a course, drawn by digest; every vector lies in a list. Lists are
dealt by (course, cell) in blocks of bounded size, so a hot course or list only becomes more tasks, and are stored in that order,
so a probe reads the row groups of its list. Questions that get fewer hits than their course has vectors to give, because it has
no lists, are answered by the exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passagelake.functions.text import cosine
from passagelake.operators.blocks import (
    CELL, CHUNK_BLOCK, HITS, QUESTION_BLOCK, STRIPE_BYTES, best, cell_counts, chunk_cells, hits_table, keep_best, question_cells,
)
from passagelake.operators.dense import _matrices, _unit, dense_top_k
from passagelake.sources.stores import materialise

#: Vectors of a course that its centres are trained on, rounds of training, and the largest number of lists per trained vector.
SAMPLE, ROUNDS, PER_CENTRE = 20_000, 2, 4
#: Share of a course's vectors that lie in the lists a question probes.
PROBED = 0.9
LEVELS = 127


@dataclass
class InvertedFile:
    """``centres(course, cell, centre, size)`` and ``lists(course, cell, chunk_id, code, scale)``."""

    centres: DataFrame
    lists: DataFrame


def pool_size(k: int, n):
    """Pool of a course of ``n`` vectors: ten times ``k``, 100 at least, and never more than a fifth of the course but for ``k``."""
    return F.least(F.lit(max(10 * k, 100)), F.greatest(F.lit(k), F.floor(n / 5))).cast("int")


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Closeness of every vector to every centre: larger is nearer; compared at nine decimals."""
    return np.round(vectors @ centres.T - (centres * centres).sum(axis=1) / 2, 9)


def _train(table: pa.Table) -> pa.Table:
    table = table.sort_by([("mark", "ascending"), ("chunk_id", "ascending")])
    (sample,) = (_unit(m) for _, m in _matrices(table).values())
    centres = sample[: max(1, min(table.column("cells")[0].as_py(), len(sample)))]
    for _ in range(ROUNDS):
        at = _nearest(sample, centres).argmax(axis=1)
        held = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, sample)
        centres = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], centres)
    course = table.column("course")[0].as_py()
    return pa.table({"course": [course] * len(centres), "cell": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(centres.tolist(), pa.list_(pa.float64()))})


def train_centres(vectors: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``course, cell, centre``: about half the root of a course's size, started from its sampled vectors of smallest digest."""
    counts = vectors.groupBy("course").agg(F.count("*").alias("n"))
    mark = F.md5(F.col("chunk_id").cast("string"))
    drawn = F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") / 2**32 < sample / F.col("n")
    cells = F.least(F.greatest(F.round(F.sqrt("n") / 2), F.lit(1)), F.lit(sample // PER_CENTRE)).cast("int")
    rows = vectors.join(counts, "course").where(drawn).select("course", "chunk_id", "embedding", mark.alias("mark"), cells.alias("cells"))
    return materialise(rows.groupBy("course").applyInArrow(_train, "course string, cell int, centre array<double>"), "centres")


def _centre_matrix(table: pa.Table) -> np.ndarray:
    table = table.sort_by("cell")
    return np.array(table.column("centre").to_pylist(), dtype=np.float64)


def _assign(key, chunks: pa.Table, centres: pa.Table) -> pa.Table:
    """The cell of each vector, and its unit vector as one signed byte a component times ``scale``."""
    made = {"course": [], "cell": [], "chunk_id": [], "code": [], "scale": []}
    if centres.num_rows:
        ids, middle = chunks.column("chunk_id").to_numpy(), _centre_matrix(centres)
        for size, (at, matrix) in _matrices(chunks).items():
            if size != middle.shape[1]:
                continue  # a vector of another length has no list; the exact search scores it 0
            unit = _unit(matrix)
            scale = np.abs(unit).max(axis=1)
            codes = np.round(unit / np.where(scale > 0, scale, 1)[:, None] * LEVELS).astype(np.int8)
            made["course"] += [key[0].as_py()] * len(at)
            made["cell"] += _nearest(unit, middle).argmax(axis=1).tolist()
            made["chunk_id"] += ids[at].tolist()
            made["code"] += [c.tobytes() for c in codes]
            made["scale"] += scale.tolist()
    return pa.table(made, pa.schema([("course", pa.string()), ("cell", pa.int32()), ("chunk_id", pa.int64()), ("code", pa.binary()), ("scale", pa.float64())]))


def build(vectors: DataFrame, sample: int = SAMPLE, path: str | None = None) -> InvertedFile:
    """The inverted file of ``vectors(course, chunk_id, embedding)``, all of one length, stored below ``path`` or the work folder."""
    own = vectors.select("course", "chunk_id", "embedding")
    centres = train_centres(own, sample)
    asked = centres.withColumn("qid", F.col("cell").cast("string"))
    # every block of vectors meets all centres of its course: one block of questions
    cells = cell_counts(own, asked, question_block=1 << 40)
    dealt = chunk_cells(own, cells).groupBy(*CELL).cogroup(question_cells(asked, cells).groupBy(*CELL))
    listed = dealt.applyInArrow(_assign, "course string, cell int, chunk_id long, code binary, scale double")
    ordered = listed.repartition("course", "cell").sortWithinPartitions("course", "cell", "chunk_id")
    if path:
        ordered.write.mode("overwrite").parquet(f"{path}/lists")
        lists = own.sparkSession.read.parquet(f"{path}/lists")
    else:
        lists = materialise(ordered, "lists")
    sizes = lists.groupBy("course", "cell").agg(F.count("*").alias("size"))
    sized = centres.join(sizes, ["course", "cell"], "left").select("course", "cell", "centre", F.coalesce("size", F.lit(0)).alias("size"))
    if path:
        sized.write.mode("overwrite").parquet(f"{path}/centres")
        return InvertedFile(own.sparkSession.read.parquet(f"{path}/centres"), lists)
    return InvertedFile(materialise(sized, "centres"), lists)


def read(spark, path: str) -> InvertedFile:
    return InvertedFile(spark.read.parquet(f"{path}/centres"), spark.read.parquet(f"{path}/lists"))


def probes(index: InvertedFile, questions: DataFrame, probed: float = PROBED) -> DataFrame:
    """``course, qid, n, unit, cells``: the nearest lists of each question until they hold ``probed`` of its course's ``n`` vectors.

    One row per question, whose ``cells`` are packed numbers of 32 bits; a question's vector is not repeated for each list.
    """

    def pick(key, centres: pa.Table, asked: pa.Table) -> pa.Table:
        qids, counts, units, lists = [], [], [], []
        if centres.num_rows:
            centres = centres.sort_by("cell")
            middle, sizes = _centre_matrix(centres), centres.column("size").to_numpy()
            names = asked.column("qid").to_pylist()
            for size, (at, matrix) in _matrices(asked).items():
                if size != middle.shape[1]:
                    continue
                stripe = max(1, STRIPE_BYTES // (8 * len(middle)))
                for first in range(0, len(at), stripe):
                    unit = _unit(matrix[first : first + stripe])
                    order = np.argsort(-_nearest(unit, middle), axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    near = (before < probed * sizes.sum()) & (sizes[order] > 0)
                    qids += [names[q] for q in at[first : first + stripe]]
                    counts += [int(sizes.sum())] * len(unit)
                    units += [u.tobytes() for u in unit]
                    lists += [cells[own].astype(np.int32).tobytes() for cells, own in zip(order, near)]
        made = {"course": [key[0].as_py()] * len(qids), "qid": qids, "n": counts, "unit": units, "cells": lists}
        return pa.table(made, pa.schema([("course", pa.string()), ("qid", pa.string()), ("n", pa.int64()), ("unit", pa.binary()), ("cells", pa.binary())]))

    asked = questions.select("course", "qid", "embedding")
    centres = index.centres.withColumn("chunk_id", F.col("cell").cast("long"))
    cells = cell_counts(centres, asked, chunk_block=1 << 40)
    dealt = chunk_cells(centres, cells).groupBy(*CELL).cogroup(question_cells(asked, cells).groupBy(*CELL))
    return dealt.applyInArrow(pick, "course string, qid string, n long, unit binary, cells binary")


def _score_lists(key, held: pa.Table, asked: pa.Table) -> pa.Table:
    """The best codes of one block of a course for each question in the lists it probes, as many as the question's pool."""
    qids, picks, ids = [], [], np.zeros(0, np.int64)
    if held.num_rows and asked.num_rows:
        held = held.sort_by("chunk_id")
        ids, scale = held.column("chunk_id").to_numpy(), held.column("scale").to_numpy()
        codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.int8).reshape(len(ids), -1)
        vectors = codes * (scale / LEVELS)[:, None]
        numbers, cell = np.unique(held.column("cell").to_numpy(), return_inverse=True)
        of_list = np.split(np.argsort(cell, kind="stable"), np.cumsum(np.bincount(cell))[:-1])
        names, pools, units, lists = (asked.column(c).to_pylist() for c in ("qid", "pool", "unit", "cells"))
        # a stripe of questions at a time, so that a block's scores never stand in memory together
        stripe = max(1, STRIPE_BYTES // (8 * len(ids)))
        for first in range(0, len(names), stripe):
            unit = np.stack([np.frombuffer(u, np.float64) for u in units[first : first + stripe]])
            probed = np.stack([np.isin(numbers, np.frombuffer(c, np.int32)) for c in lists[first : first + stripe]])
            scores = np.full((len(unit), len(ids)), -np.inf)
            for c, at in enumerate(of_list):
                asking = np.flatnonzero(probed[:, c])
                scores[asking[:, None], at] = np.round(unit[asking] @ vectors[at].T, 9)
            for row, q in enumerate(range(first, first + len(unit))):
                top = best(scores[row], pools[q])
                top = top[scores[row][top] > -np.inf]
                qids.append(names[q])
                picks.append((top, scores[row][top]))
    return hits_table(key[0].as_py(), qids, picks, ids)


def candidates(
    index: InvertedFile, questions: DataFrame, k: int, probed: float = PROBED,
    chunk_block: int = CHUNK_BLOCK, question_block: int = QUESTION_BLOCK,
) -> DataFrame:
    """``course, qid, chunk_id``: the pool of each question.

    A question meets each block of its course's codes once, whatever number of lists it probes there.
    """
    asked = materialise(probes(index, questions, probed).withColumn("pool", pool_size(k, F.col("n"))).drop("n"), "probes")
    held = index.lists.select("course", "cell", "chunk_id", "code", "scale")
    cells = cell_counts(held, asked, chunk_block, question_block)
    dealt = chunk_cells(held, cells).groupBy(*CELL).cogroup(question_cells(asked, cells).groupBy(*CELL))
    scored = dealt.applyInArrow(_score_lists, HITS)
    order = Window.partitionBy("course", "qid").orderBy(F.col("score").desc(), "chunk_id")
    ranked = scored.withColumn("at", F.row_number().over(order))
    return ranked.join(asked.select("course", "qid", "pool").distinct(), ["course", "qid"]).where("at <= pool").select("course", "qid", "chunk_id")


def approximate_top_k(index: InvertedFile, chunks: DataFrame, questions: DataFrame, k: int, probed: float = PROBED) -> DataFrame:
    """``course, qid, chunk_id, score, rank``: the best ``k`` of each question's pool by exact cosine.

    Pairs lie within one course. Vectors that are no longer in ``chunks`` are dropped. A zero vector scores 0. Questions that
    lack hits their course could give get those of the exact search.
    """
    pool = materialise(candidates(index, questions, k, probed), "pool")
    stored = chunks.select("course", "chunk_id", F.col("embedding").alias("_c"))
    asked = questions.select("course", "qid", F.col("embedding").alias("_q"))
    scored = pool.join(asked, ["course", "qid"]).join(stored, ["course", "chunk_id"])
    hits = materialise(keep_best(scored.select("course", "qid", "chunk_id", cosine(F.col("_q"), F.col("_c")).alias("score")), k), "hits")
    have = hits.groupBy("course", "qid").agg(F.count("*").alias("have"))
    could = chunks.groupBy("course").agg(F.least(F.count("*"), F.lit(k)).alias("could"))
    counted = questions.join(have, ["course", "qid"], "left").join(could, "course")
    short = materialise(counted.where(F.coalesce("have", F.lit(0)) < F.col("could")).select("course", "qid", "embedding"), "short")
    exact = dense_top_k(chunks, short, k)
    return hits.join(short, ["course", "qid"], "left_anti").unionByName(exact.select(*hits.columns))
