"""Cleaning of a training corpus: five stages, each applied to what the one before kept.

``run`` stores each stage below the shared checkpoint folder and reads it again, so a lost executor repeats one stage at most
and no plan spans two stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagelake.llm import stages
from passagelake.sources.stores import materialise

STAGES = [
    ("toxicity", stages.toxicity),
    ("line_dedup", stages.line_dedup),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("benchmark_decontamination", stages.decontamination),
    ("packing", stages.packing),
]

#: Trained trees and tokenizer ids have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
