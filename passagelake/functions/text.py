"""Column functions over text and arrays; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's stop-word list.
STOPWORDS = (
    "a an and are as at be but by can could do does did for from had has have how i if in into is it its "
    "me my no not of on or our so than that the their them then there these they this to up us was we were "
    "what when where which who whom why will with would you your about after again all also any been before "
    "being both each few more most other over same some such only own too very just should now between "
    "through during while out off once here those"
).split(" ")

# Blanks as the reference's trimming understands them (ASCII blanks plus the Unicode space separators).
BLANK = "[\\s\\u00a0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


BLANK_CHARS = (
    " \t\n\x0b\f\r\u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_blanks(c: Column) -> Column:
    # trimming by character set looks at the two ends only; a regular expression would scan the whole text
    return F.btrim(c, F.lit(BLANK_CHARS))


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"{BLANK}+", " ")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Inside lambdas Catalyst does not share repeated sub-expressions, so an array referenced from a lambda would be
    rebuilt for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def raw_tokens(c: Column) -> Column:
    """Lower-cased alphanumeric pieces with camelCase split, before any filtering."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.split(F.lower(spaced), "[^a-z0-9]+")


def keeps_token(t: Column) -> Column:
    """Drop empties, stop words and one-character tokens that are not numbers."""
    return (t != "") & (~t.isin(STOPWORDS)) & ((F.length(t) >= 2) | t.rlike("^[0-9]+$"))


def terms(c: Column, stem: bool = True) -> Column:
    kept = F.filter(raw_tokens(c), keeps_token)
    if stem:
        from passagelake.functions.stemming import stem_terms

        return stem_terms(kept)
    return kept


def match_words(c: Column) -> Column:
    """Words for evidence matching: case-folded, identifier dots kept, sentence punctuation removed."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9$@._-]+", " ")
    return F.filter(
        F.transform(F.split(cleaned, "\\s+"), lambda w: F.btrim(w, F.lit("._-"))),
        lambda w: w != "",
    )


def word_grams(words: Column, n: int = 3) -> Column:
    """Distinct word n-grams; a shorter non-empty text is one gram of all its words."""
    def grams(ws: Column) -> Column:
        long_enough = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(ws) - n, F.lit(0))),
            lambda i: F.concat_ws(" ", *[F.get(ws, i + k) for k in range(n)]),
        )
        return (
            F.when(F.size(ws) >= n, F.array_distinct(long_enough))
            .when(F.size(ws) > 0, F.array(F.array_join(ws, " ")))
            .otherwise(F.array().cast("array<string>"))
        )

    return let(words, grams)


def gram_hashes(words: Column, n: int = 3) -> Column:
    """The distinct word n-grams as 64-bit hashes, without building their texts."""

    def grams(ws: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(n)]))
        return (
            F.when(F.size(ws) >= n, F.array_distinct(runs))
            .when(F.size(ws) > 0, F.array(F.xxhash64(F.size(ws), F.array_join(ws, " "))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(words, grams)


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token sets, 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - shared
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for different lengths or a zero vector."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    usable = (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(usable, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def fold_runs(texts: Column, glued: bool = False) -> Column:
    """Stitch consecutive chunks ``array<struct<text, overlap_len>>`` into one passage; with ``glued`` they tell which follow at once."""

    def joint(c: Column) -> Column:
        apart = F.when(c["overlap_len"] > 0, F.lit(" ")).otherwise(F.lit("\n\n"))
        return F.when(c["glued"], F.lit("")).otherwise(apart) if glued else apart

    def stitched(parts: Column) -> Column:
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
        tail = F.transform(
            rest,
            lambda c: F.concat(
                joint(c),
                F.ltrim(F.substring(c["text"], c["overlap_len"] + 1, F.length(c["text"])), F.lit(BLANK_CHARS)),
            ),
        )
        return F.when(F.size(parts) == 0, F.lit("")).otherwise(
            F.concat(F.get(parts, F.lit(0))["text"], F.array_join(tail, ""))
        )

    return let(texts, stitched)
