"""BM25 over per-course statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelake.functions.text import terms
from passagelake.operators.blocks import (
    CELL, CHUNK_BLOCK, HITS, QUESTION_BLOCK, best, chunk_cells, hits_table, keep_best, question_cells,
)
from passagelake.sources.stores import materialise

K1 = 1.2
B = 0.75


def search_text(header: bool) -> Column:
    """The text BM25 sees: header, note and text, or the text alone."""
    if not header:
        return F.col("text")
    return F.concat(
        F.coalesce("context_header", F.lit("")), F.lit(" "), F.coalesce("context_note", F.lit("")), F.lit(" "), "text"
    )


@dataclass(frozen=True)
class LexicalIndex:
    """``postings(course, chunk_id, doc_len, term, tf, leads)``.

    One row per distinct term of a chunk; an empty chunk keeps one row with a null term, and exactly one row per chunk
    has ``leads = 1``, so document counts and lengths come from the same rows (and the same shuffle) as the postings.
    """

    postings: DataFrame

    def course_stats(self) -> DataFrame:
        return self.postings.groupBy("course").agg(
            F.sum("leads").alias("docs"),
            (F.sum(F.col("leads") * F.col("doc_len")) / F.sum("leads")).alias("avg_len"),
        )

    def document_frequency(self) -> DataFrame:
        found = self.postings.groupBy("course", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))
        return found.where(F.col("term").isNotNull())


def _term_counts(batches):
    """Each list of terms as its distinct terms in the order of their first places, with their numbers."""
    for b in batches:
        lists = b.column("terms")
        offsets = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(lists)), np.diff(offsets))
        found, first, tf = np.unique(row * max(len(words.dictionary), 1) + codes, return_index=True, return_counts=True)
        order = np.argsort(first)
        bounds = pa.array(np.searchsorted(row[first[order]], np.arange(len(lists) + 1)).astype(np.int32))
        terms_ = words.dictionary.take(pa.array(codes[first[order]]))
        columns = [b.column("course"), b.column("chunk_id"), pa.array(np.diff(offsets).astype(np.int32))]
        counted = [pa.ListArray.from_arrays(bounds, v) for v in (terms_, pa.array(tf[order].astype(np.int64)))]
        yield pa.record_batch([*columns, *counted], ["course", "chunk_id", "doc_len", "terms", "tfs"])


def lexical_index(chunks: DataFrame, header: bool = False, stem: bool = True) -> LexicalIndex:
    """Terms are counted inside the chunk's row and written once, a row per chunk; only chunks whose id repeats are grouped."""
    tokens = chunks.select("course", "chunk_id", terms(search_text(header), stem).alias("terms"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema.fields[:2])
    schema = f"{kinds}, doc_len int, terms array<string>, tfs array<long>"
    counted = materialise(tokens.mapInArrow(_term_counts, schema), "chunk-terms")
    key = ["course", "chunk_id", "doc_len"]
    repeated = counted.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(k).alias(f"_{k}") for k in key])
    repeated = materialise(repeated, "repeated-chunks")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))

    def rows(df: DataFrame) -> DataFrame:
        exploded = df.select(*key, F.posexplode_outer(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("pos", "t"))
        return exploded.select(
            *key, "t.term", F.coalesce("t.tf", F.lit(0)).alias("tf"), (F.coalesce("pos", F.lit(0)) == 0).cast("int").alias("leads")
        )

    grouped = rows(counted.join(repeated, same, "left_semi")).groupBy(*key, "term").agg(F.sum("tf").alias("tf"), F.max("leads").alias("leads"))
    return LexicalIndex(rows(counted.join(repeated, same, "left_anti")).unionByName(grouped))


def stored_index(index: LexicalIndex) -> LexicalIndex:
    """The same index with its postings written once, a row per term: for statistics that read all of them twice."""
    return LexicalIndex(materialise(index.postings, "postings"))


def idf(docs: Column, df: Column) -> Column:
    return F.when(df > 0, F.log1p((docs - df + 0.5) / (df + 0.5))).otherwise(F.lit(0.0))


def term_weight(tf: Column, doc_len: Column, avg_len: Column, k1: float = K1, b: float = B) -> Column:
    average = F.when(avg_len == 0, F.lit(1.0)).otherwise(avg_len)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * (doc_len / average)))


def question_terms(questions: DataFrame, stem: bool = True) -> DataFrame:
    return questions.select("course", "qid", F.explode(F.array_distinct(terms(F.col("question"), stem))).alias("term"))


def _score_cell(k: int):
    def cell(key, postings: pa.Table, asked: pa.Table) -> pa.Table:
        ids, doc = np.unique(postings.column("chunk_id").to_numpy(), return_inverse=True)
        words = postings.column("term").combine_chunks().dictionary_encode()
        code_of = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
        codes = words.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        doc, weight = doc[order], postings.column("weight").to_numpy()[order]
        edges = np.searchsorted(codes[order], np.arange(len(code_of) + 1))
        asked = asked.sort_by([("qid", "ascending"), ("term", "ascending")])
        wanted: dict[str, list[tuple[str, float]]] = {}
        for q, t, value in zip(*(asked.column(c).to_pylist() for c in ("qid", "term", "idf"))):
            wanted.setdefault(q, []).append((t, value))
        qids, picks = [], []
        for q, pairs in wanted.items():
            score = np.zeros(len(ids))
            for term, value in pairs:
                code = code_of.get(term)
                if code is not None:
                    span = slice(edges[code], edges[code + 1])
                    score[doc[span]] += value * weight[span]
            found = np.flatnonzero(score > 0)
            top = found[best(np.round(score[found], 9), k)]
            qids.append(q)
            picks.append((top, score[top]))
        return hits_table(key[0].as_py(), qids, picks, ids)

    return cell


def bm25_top_k(
    chunks: DataFrame, questions: DataFrame, k: int = 20, header: bool = False, stem: bool = True,
    index: LexicalIndex | None = None, chunk_block: int = CHUNK_BLOCK, question_block: int = QUESTION_BLOCK,
) -> DataFrame:
    """Best ``k`` chunks per question among those sharing a term, scored with statistics of the question's course."""
    index = index or lexical_index(chunks, header, stem)
    # statistics and the asked terms are written once: their sizes are known when the postings are joined with them
    stats = materialise(index.course_stats(), "course-stats")
    asked = question_terms(questions, stem)
    vocabulary = materialise(asked.select("course", "term").distinct(), "asked-terms")
    needed = index.postings.join(vocabulary, ["course", "term"], "left_semi")
    weighted = needed.join(stats, "course").select(
        "course", "chunk_id", "term", term_weight(F.col("tf"), F.col("doc_len"), F.col("avg_len")).alias("weight")
    )
    frequency = needed.groupBy("course", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    valued = (
        asked.join(frequency, ["course", "term"])
        .join(stats, "course")
        .select("course", "qid", "term", idf(F.col("docs"), F.col("df")).alias("idf"))
    )
    sizes = stats.select("course", "docs").join(
        questions.groupBy("course").agg(F.count("*").alias("asked")), "course"
    )
    counted = sizes.select(
        "course",
        F.ceil(F.col("docs") / chunk_block).cast("int").alias("blocks"),
        F.ceil(F.col("asked") / question_block).cast("int").alias("question_blocks"),
    )
    cells = materialise(counted, "cells")
    scored = (
        chunk_cells(weighted, cells)
        .groupBy(*CELL)
        .cogroup(question_cells(valued, cells).groupBy(*CELL))
        .applyInArrow(_score_cell(k), HITS)
    )
    return keep_best(scored, k)

