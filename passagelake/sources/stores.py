"""Sinks: the chunk table with replacement in place, run records, thresholds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.operators.evaluation import run_validity
from passagelake.session import work_folder


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below the shared work folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class ChunkTable:
    """Chunks in partitions by course and bucket of the document, whose documents are replaced in place.

    A publication reads only the partitions of the documents it replaces and overwrites them, so replaced and removed rows are
    gone from disk and no other file changes. Publishing the same batch again gives the same table, whoever publishes it, so a
    retried or restarted stream needs no record of batches. ``key`` names a document from the columns of chunks and documents; both
    have the course. One writer at a time; a reader that lists a partition while it is overwritten has to list again.

    Chunks of one course spread over ``buckets`` partitions: choose it so that a partition of the largest course fits one task.
    """

    def __init__(self, spark: SparkSession, root: str, key: Column, buckets: int = 16):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    def _placed(self, df: DataFrame) -> DataFrame:
        # a letter before the course, so that partition values are never read back as numbers
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        return df.withColumns({"_course": F.concat(F.lit("c"), F.coalesce(F.col("course").cast("string"), F.lit(""))), "_bucket": bucket})

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.root)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def publish(self, chunks: DataFrame, replaced: DataFrame) -> None:
        """Replace the documents ``replaced`` by ``chunks``; a replaced document without chunks disappears."""
        place = ["_course", "_bucket"]
        gone = materialise(self._placed(replaced).select(*place, self.key.alias("_doc")).distinct(), "replaced")
        touched = gone.select(*place).distinct()
        # a row that holds no chunk keeps a partition from being left out, and so left as it was, when its last document goes
        content = self._placed(chunks).withColumn("_chunk", F.lit(True)).unionByName(touched.withColumn("_chunk", F.lit(False)), allowMissingColumns=True)
        stored = self._stored()
        if stored is not None:
            kept = stored.where("_chunk").join(touched, place, "left_semi").withColumn("_doc", self.key).join(gone, [*place, "_doc"], "left_anti")
            content = content.unionByName(kept.drop("_doc"), allowMissingColumns=True)
        # written aside first: a table cannot be overwritten while it is read
        ready = materialise(content, "partitions")
        ready.repartition(*place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*place).parquet(self.root)

    def read(self) -> DataFrame | None:
        stored = self._stored()
        return None if stored is None else stored.where("_chunk").drop("_chunk", "_course", "_bucket")


def write_runs(records: DataFrame, path: str) -> DataFrame:
    """Store the records of valid experiments, partitioned by experiment; returns the validity table.

    An experiment with any errored question or model fallback is left out as a whole.
    """
    validity = run_validity(records)
    good = records.join(validity.where("valid").select("experiment"), "experiment", "left_semi")
    good.write.mode("overwrite").partitionBy("experiment").parquet(path)
    return validity


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    thresholds.write.mode("overwrite").partitionBy("experiment").json(path)


THRESHOLDS = "kind string, threshold double, drop_below double, j double, tpr double, tnr double, experiment string"


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(THRESHOLDS).json(path)
