"""Stages of the corpus pipeline: ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    from passagelake.llm.toxicity import reject_toxic

    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated three-line windows; documents of which nothing stays are left out."""
    from passagelake.llm.line_dedup import without_repeated_lines

    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every group of near duplicates (five words, similarity 0.8)."""
    from passagelake.llm.jaccard_join import one_per_group

    return one_per_group(docs, words=5, top=4, bottom=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a benchmark text."""
    from passagelake.llm.decontamination import without_benchmark

    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the documents' tokens, one sequence each, ids included."""
    from passagelake.llm.packing import pack
    from passagelake.llm.queries import tokenizer_path

    return pack(docs, tokenizer_path())
