"""Operator 2: quality rules as one native projection.

Every measure is a built-in expression of the row's own text and every rule a row of ``RULES``; the table is compiled into a
single projection. No user function runs and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
WINDOW = 5

#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on this are from at or an "
    "le la les de des du et un une que qui dans en pour par sur est il elle pas "
    "der die das und von zu den mit ist des ein eine auf nicht im dem sich "
    "el los las y del se por con una su para es lo como no"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= top / bottom <= high``; a bound that is None is open. With a zero ``bottom`` the rule holds."""

    name: str
    top: str
    bottom: str | None
    low: float | None
    high: float | None


#: Thresholds of public web-text filters, in hundredths where they are ratios so that sums of integers decide.
RULES = (
    Rule("length", "n_words", None, 10, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 2, 20),
    Rule("symbols", "n_symbols", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.2),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 0.5),
)


def _stage(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("*", *[c.alias(name) for name, c in columns.items()])


def _window_hashes(words: Column, n: int = WINDOW) -> Column:
    """64-bit hashes of all ``n``-word windows."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)])
    )
    hashes = F.when(F.size(words) >= n, hashes).otherwise(F.array().cast("array<bigint>"))
    return hashes


def _covered(windows: Column, n: int) -> Column:
    """Words that lie in a window found twice or more, the first included; only rows with a repeated window come here."""
    numbered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, k, d: F.coalesce(F.get(s, k + d)["h"] == x["h"], F.lit(False))
        found = F.transform(s, lambda x, k: F.when(same(x, k, -1) | same(x, k, 1), x["i"]))
        return F.array_sort(F.filter(found, lambda i: i.isNotNull()))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    step = lambda a, i: F.struct((i + n).alias("end"), (a["total"] + n - F.greatest(F.lit(0), a["end"] - i)).alias("total"))
    # the sorted array is bound once, as the only element of an outer array, instead of being computed for each element
    return F.get(F.transform(F.array(numbered), lambda s: F.aggregate(repeated(s), start, step)["total"]), F.lit(0))


def measures(docs: DataFrame, stop_words: tuple[str, ...] | list[str] = tuple(STOP_WORDS)) -> DataFrame:
    """``doc_id`` and the counts that rules use, one row per input row.

    A null text counts as empty: all counts are 0. Columns other than ``doc_id`` and ``text`` are not read, so they cannot
    clash. Repeated rows give repeated results.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = dict.fromkeys(form for w in stop_words for form in (w, w.capitalize()))
    df = docs.select("doc_id", text.alias("_text"))
    df = _stage(
        df,
        _words=F.array_remove(F.split("_text", BLANKS), ""),
        _lines=F.filter(F.split("_text", "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\u000b\u000c\r", "    "))) > 0),
    )
    df = _stage(df, _windows=_window_hashes(F.col("_words")))
    bullet = lambda x: F.ltrim(x).rlike("^[-*•]")
    return df.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\u000b\u000c\r", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct(F.transform("_lines", lambda x: F.xxhash64(x))))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered(F.col("_windows"), WINDOW))
        .otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: w.isin(*known))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_lines", bullet)).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_cut_lines"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """One boolean column per rule: true where the rule holds."""

    def holds(r: Rule) -> Column:
        top, bottom = F.col(r.top).cast("double"), F.lit(1.0) if r.bottom is None else F.col(r.bottom).cast("double")
        parts = [top >= bottom * r.low] * (r.low is not None) + [top <= bottom * r.high] * (r.high is not None)
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out

    return [holds(r).alias(f"ok_{r.name}") for r in rules]


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, base decision, one boolean per rule and ``kept``: not base-failed and every rule holds. Whole texts."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = measures(docs).select("*", failed.alias("base_failed"), *compiled(rules))
    kept = ~F.col("base_failed")
    for r in rules:
        kept = kept & F.col(f"ok_{r.name}")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        "n_lines", "n_stop_words", "n_bullet_lines", "n_cut_lines", *[f"ok_{r.name}" for r in rules],
    )
