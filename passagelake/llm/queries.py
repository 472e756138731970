"""Registered queries of the operators: each applies one operator with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passagelake.llm import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op2_quality_rules": sql.QUALITY, "op8_line_dedup": sql.LINE_DEDUP, "op1_ngram_jaccard_join": sql.JACCARD,
    "op11_spelling_variants": sql.SPELLING, "op12_merkle_manifest": sql.MERKLE,
}

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def _query(name: str):
    def add(build):
        QUERIES[name] = build
        return build

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    try:
        import public_tokenizers
    except ImportError:
        return TOKENIZER
    return public_tokenizers.path("word_bpe_49k.json")


@_query("op2_quality_rules")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from passagelake.llm.quality import quality

    return quality(_table(spark, folder, "documents"))


@_query("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from passagelake.llm.packing import digest, pack

    return digest(pack(_table(spark, folder, "documents"), tokenizer_path()))


@_query("op8_line_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from passagelake.llm.line_dedup import dedup_lines

    done = dedup_lines(_table(spark, folder, "documents"))
    return done.select(
        "doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"), "text"
    )


@_query("op9_benchmark_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from passagelake.llm.decontamination import decontaminate

    return decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from passagelake.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, folder, "documents"))


@_query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from passagelake.llm.toxicity import toxicity

    return toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op5_license_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from passagelake.llm.license_scan import license_scan

    return license_scan(_table(spark, folder, "documents"))


@_query("op6_lm_scoring")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from passagelake.llm.lm_scoring import lm_scores

    return lm_scores(_table(spark, folder, "documents"))


@_query("op10_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from passagelake.llm.pii import digest, personal_data

    return digest(personal_data(_table(spark, folder, "documents")))


@_query("op7_substring_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from passagelake.llm.substring_dedup import repeated_passages

    return repeated_passages(_table(spark, folder, "documents"))


@_query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from passagelake.llm.spelling_variants import spelling_variants

    return spelling_variants(_table(spark, folder, "documents"))


@_query("op12_merkle_manifest")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from passagelake.llm.merkle_manifest import manifest_check

    return manifest_check(_table(spark, folder, "documents"))


@_query("op13_simhash")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from passagelake.llm.simhash import digest, simhash_components

    return digest(simhash_components(_table(spark, folder, "documents")))
