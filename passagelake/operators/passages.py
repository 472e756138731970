"""Small-to-big passages: neighbours, consecutive runs, stitching and the context budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passagelake.functions.text import fold_runs


def group_positions(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Reading position of every chunk in those documents that have a hit (ids only, no text)."""
    slim = chunks.select("chunk_id", "group_key", "chunk_index").join(
        wanted.select("group_key").distinct(), "group_key", "left_semi"
    )
    order = Window.partitionBy("group_key").orderBy("chunk_index", "chunk_id")
    return slim.withColumn("position", F.row_number().over(order))


def expand_neighbours(hits: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """``hits(qid, chunk_id, ...)`` to distinct ``qid, group_key, chunk_id, chunk_index, position`` around them.

    Neighbours are counted in list positions, not chunk indexes.
    """
    located = hits.select("qid", "chunk_id").join(chunks.select("chunk_id", "group_key"), "chunk_id")
    positions = group_positions(chunks, located)
    centres = located.join(positions.select("chunk_id", "position"), "chunk_id")
    around = centres.select(
        "qid", "group_key", F.explode(F.sequence(F.col("position") - radius, F.col("position") + radius)).alias("position")
    ).dropDuplicates()
    return around.join(positions, ["group_key", "position"]).select(
        "qid", "group_key", "chunk_id", "chunk_index", "position"
    )


def merge_runs(expanded: DataFrame) -> DataFrame:
    """Add ``run``: equal for consecutive chunk indexes of one document (gaps and islands)."""
    order = Window.partitionBy("qid", "group_key").orderBy("chunk_index")
    return expanded.withColumn("run", F.col("chunk_index") - F.row_number().over(order))


def build_passages(hits: DataFrame, chunks: DataFrame, radius: int, max_chars: int) -> DataFrame:
    """``hits(qid, chunk_id, rank, signal)`` to ordered passages within the budget.

    A run that contains no hit (possible when a window spans a gap in the chunk indexes) is dropped.
    """
    runs = merge_runs(expand_neighbours(hits, chunks, radius)).join(
        hits.select("qid", "chunk_id", F.col("rank").alias("hit_rank"), "signal"), ["qid", "chunk_id"], "left"
    )
    details = chunks.select(
        "chunk_id", "text", "overlap_len", "lesson", "lesson_title", "source", "source_label", "page", "context_header"
    )
    rows = runs.join(details, "chunk_id")
    best = lambda c: F.min_by(c, F.col("hit_rank"))
    pieces = F.transform(
        F.sort_array(F.collect_list(F.struct("chunk_index", "text", "overlap_len"))),
        lambda c: F.struct(c["text"].alias("text"), c["overlap_len"].alias("overlap_len")),
    )
    members = F.filter(
        F.transform(
            F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "hit_rank"))),
            lambda c: F.when(c["hit_rank"].isNotNull(), c["chunk_id"]),
        ),
        lambda c: c.isNotNull(),
    )
    passages = (
        rows.groupBy("qid", "group_key", "run")
        .agg(
            F.min("hit_rank").alias("rank"),
            fold_runs(pieces).alias("text"),
            best("lesson").alias("lesson"),
            best("lesson_title").alias("lesson_title"),
            best("source").alias("source"),
            best("source_label").alias("source_label"),
            best("context_header").alias("context_header"),
            best("chunk_index").alias("chunk_index"),
            best("signal").alias("score"),
            F.min_by("page", "chunk_index").alias("page"),
            members.alias("primary_chunk_ids"),
        )
        .where(F.col("rank").isNotNull())
        .drop("group_key", "run")
    )
    return within_budget(passages, max_chars)


def within_budget(passages: DataFrame, max_chars: int) -> DataFrame:
    """Keep passages in rank order until the first that would exceed the budget; the first always stays."""
    order = Window.partitionBy("qid").orderBy("rank")
    total = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        passages.withColumn("_total", total)
        .withColumn("position", F.row_number().over(order))
        .where((F.col("position") == 1) | (F.col("_total") <= max_chars))
        .drop("_total")
    )
