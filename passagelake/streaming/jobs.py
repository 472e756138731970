"""Streaming jobs: incremental indexing, completions to certificates, tutor usage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagelake.operators.indexing import DOCUMENT
from passagelake.sources.stores import ChunkTable


def latest_changes(changes: DataFrame) -> DataFrame:
    """The newest change per document; an aggregate, so a document changed very often combines map-side."""
    rest = [c for c in changes.columns if c not in DOCUMENT]
    newest = F.max_by(F.struct(*rest), F.struct("changed_at", "change_id"))
    return changes.groupBy(*DOCUMENT).agg(newest.alias("_c")).select(*DOCUMENT, "_c.*")


def incremental_index(
    changes: DataFrame, store: ChunkTable, index: Callable[[DataFrame, str], DataFrame], checkpoint: str, **trigger
) -> StreamingQuery:
    """Re-chunk changed documents and replace them in the table per batch.

    ``index(documents, batch_id)`` returns chunk rows. A retried batch, or one that a new checkpoint brings again, replaces the same
    documents once more and leaves the same table.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        documents = latest_changes(batch)
        store.publish(index(documents, str(batch_id)), documents)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def completion_counts(completions: DataFrame) -> DataFrame:
    """Distinct completed lessons per (student, course); a repeat counts once however late it comes.

    The state of a key is its set of lessons, which the course's lessons bound.
    """
    return completions.groupBy("student_id", "course_id").agg(
        F.size(F.collect_set("lesson_id")).cast("long").alias("completed"), F.max("ts").alias("last_at")
    )


def certificate_stream(
    completions: DataFrame, lesson_totals: DataFrame, certificates_path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Issue each certificate once: the updated counts of a batch meet the already issued table."""
    spark = completions.sparkSession
    schema = "student_id string, course_id string, completed long, issued_at timestamp"
    # an empty first batch, so that the table can be read from the start
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{certificates_path}/batch=-1")

    def apply(batch: DataFrame, batch_id: int) -> None:
        reached = batch.join(lesson_totals, "course_id").where(F.col("completed") >= F.col("total"))
        earned = reached.select("student_id", "course_id", "completed", F.col("last_at").alias("issued_at"))
        # earlier batches only: a retried batch must not see its own output
        issued = spark.read.schema(schema + ", batch long").option("basePath", certificates_path)
        known = issued.parquet(certificates_path).where(F.col("batch") < batch_id)
        fresh = earned.join(known, ["student_id", "course_id"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{certificates_path}/batch={batch_id}")

    counts = completion_counts(completions)
    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def usage_windows(requests: DataFrame, limit: int = 25, delay: str = "15 minutes") -> DataFrame:
    """Requests per user and 15-minute window with a flag above the limit."""
    return (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", "15 minutes"), "user_id")
        .agg(F.count("*").alias("requests"))
        .select("user_id", F.col("window.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("over_limit"))
    )
