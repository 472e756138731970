"""Operator 8: line deduplication by overlapping three-line windows.

Lines that hold a word are numbered in each document; every run of three such lines is hashed. Of windows found more than once
anywhere, all but the first occurrence (smallest ``doc_id``, then smallest position) mark their three lines, and the merged
marks are removed. Only hashes and positions are shuffled: counts are aggregated before the shuffle, and just the marked
documents' positions go back to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelake.sources.stores import materialise

SIZE = 3
_BLANKS = "\t\u000b\u000c\r"


def _has_word(line: Column) -> Column:
    return F.length(F.trim(F.translate(line, _BLANKS, "    "))) > 0


def _word_lines(text: Column) -> Column:
    """The lines that hold a word, each with its place among all lines."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("place")))
    return F.filter(numbered, lambda x: _has_word(x["line"]))


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """``h1, h2, at, places, doc_id, row``: 128-bit hash of each run of ``size`` lines; ``at`` counts lines that hold a word."""
    starts = F.when(F.size("lines") >= size, F.sequence(F.lit(0), F.size("lines") - size)).otherwise(F.array().cast("array<int>"))
    parts = lambda i, field: [F.get("lines", i + j)[field] for j in range(size)]
    marked = lambda i: F.struct(
        F.xxhash64(*parts(i, "line")).alias("h1"), F.xxhash64(F.lit(7), *parts(i, "line")).alias("h2"), i.alias("at"), F.array(*parts(i, "place")).alias("places")
    )
    held = docs.select("doc_id", "row", _word_lines(F.col("text")).alias("lines"))
    return held.select("doc_id", "row", F.explode(F.transform(starts, marked)).alias("w")).select("w.*", "doc_id", "row")


def covered_lines(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, row, covered``: sorted places of the lines to remove, for documents that have any; ``row`` is the text's hash.

    A later window in the same document counts only where it does not overlap the first, so ``a a a a`` keeps three lines.
    """
    own = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    windows = materialise(_windows(own, size), "line-windows")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "at")).alias("first")).where("n > 1")
    later = (
        windows.join(first, ["h1", "h2"])
        .where(
            ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")))
            | (F.col("at") >= F.col("first.at") + size)
        )
        .select("doc_id", "row", F.explode("places").alias("line"))
    )
    return later.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line")).alias("covered"))


def dedup_lines(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """All columns of ``docs`` with ``text`` reduced, plus ``_n_lines`` and ``_n_removed``; one row per input row.

    Null and empty texts stay as they are. A document with fewer than ``size`` lines that hold a word has no window and stays.
    Rows that repeat both doc_id and text are one document to this operator and are all treated alike. Lines without a word
    are never windows' lines and stay.
    """
    own = docs.select(F.struct("*").alias("_all"), "doc_id", "text", F.xxhash64("text").alias("_row"))
    covered = covered_lines(own.select("doc_id", "text"), size).select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), F.col("covered").alias("_covered"))
    joined = own.join(covered, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")), "left")
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(_word_lines(F.col("text"))))
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_covered")
    left = F.array_join(F.get(F.transform(F.array(lines), lambda x: F.transform(stay, lambda i: F.get(x, i))), F.lit(0)), "\n")
    text = F.when(F.col("_covered").isNull(), F.col("text")).otherwise(left)
    others = [F.col(f"_all.`{c}`") if c != "text" else text.alias("text") for c in docs.columns]
    return joined.select(*others, count.alias("_n_lines"), F.coalesce(F.size("_covered"), F.lit(0)).alias("_n_removed"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """Columns of ``docs``: reduced texts, ``n_chars`` brought up to date, documents that lost every line left out."""
    done = dedup_lines(docs).where("_n_removed = 0 or _n_removed < _n_lines")
    columns = [F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return done.select(*columns)
