"""Streaming jobs run to completion over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagelake.catalog.indexing import lesson_docs
from passagelake.catalog.registry import query
from passagelake.catalog.standins import MODEL
from passagelake.config import preset
from passagelake.operators import indexing as ix
from passagelake.session import work_folder
from passagelake.sources.stores import ChunkTable
from passagelake.sources.tables import Lake
from passagelake.streaming import jobs


def replayed(lake: Lake, df, name: str):
    """A table written once to the shared folder and read back as a stream of files."""
    path = work_folder(lake.spark, name)
    df.write.parquet(path)
    return lake.spark.readStream.schema(df.schema).parquet(path)


@query(
    "S1_incremental_index",
    "SELECT course, doc_id, count(*) AS chunks, md5(string_agg(text, chr(10) ORDER BY chunk_index)) AS digest FROM chunks GROUP BY ALL",
)
def incremental_index(lake: Lake):
    """Every document arrives twice, first with an outdated text; the index ends with the newer one."""
    docs = lesson_docs(lake).withColumn("source", F.lit("content"))
    old = docs.withColumns({"pages": F.array(F.lit("outdated")), "changed_at": F.lit(1), "change_id": F.lit(1)})
    new = docs.withColumns({"changed_at": F.lit(2), "change_id": F.lit(2)})
    changes = replayed(lake, old.unionByName(new), "changes")
    store = ChunkTable(lake.spark, work_folder(lake.spark, "live-index"), ix.document_key())
    index = lambda rows, batch: ix.index_chunks(rows, preset("basic"), MODEL, batch)
    run = jobs.incremental_index(changes, store, index, work_folder(lake.spark, "cp"), availableNow=True)
    run.awaitTermination()
    texts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"])
    return store.read().groupBy("course", F.col("lesson").cast("long").alias("doc_id")).agg(
        F.count("*").alias("chunks"), F.md5(F.array_join(texts, "\n")).alias("digest")
    )


@query(
    "S2_certificate_stream",
    """
    SELECT p.student_id, p.course_id, p.completed FROM track_progress p WHERE p.percent = 100""",
)
def certificate_stream(lake: Lake):
    """Completion events (with repeats) to certificates, each issued once."""
    done = lake.track_completions().withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("lesson_id")))
    totals = lake.track_lessons().groupBy("course_id").agg(F.count("*").alias("total"))
    path = work_folder(lake.spark, "certificates")
    run = jobs.certificate_stream(replayed(lake, done, "completions"), totals, path, work_folder(lake.spark, "cp"), availableNow=True)
    run.awaitTermination()
    return lake.spark.read.parquet(path).select("student_id", "course_id", "completed")


@query(
    "S3_usage_windows",
    """
    SELECT user_id, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS requests, count(*) > 1 AS over_limit
    FROM events GROUP BY ALL
    HAVING time_bucket(INTERVAL 15 MINUTE, any_value(ts)) + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 15 MINUTE FROM events)""",
)
def usage_windows(lake: Lake):
    """Closed windows only: the last ones stay open until the watermark passes them."""
    requests = lake.table("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    path, cp = work_folder(lake.spark, "usage"), work_folder(lake.spark, "cp")
    windows = jobs.usage_windows(replayed(lake, requests, "requests"), limit=1)
    run = windows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", cp).trigger(availableNow=True).start()
    run.awaitTermination()
    return lake.spark.read.schema(windows.schema).parquet(path).select(
        "user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "requests", "over_limit"
    )
