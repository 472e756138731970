"""Operator 10: personal data by bootstrapped contextual extraction, native throughout.

Seeds are matches of fixed formats. The words before and after them are lexical patterns, and identifier-like strings that no
format matches are instances to be judged. Patterns and instances form a bipartite graph that Spark scores in rounds: a pattern
is as good as the mean score of its different instances, an instance as good as its patterns together. Instances that good
patterns find become spans. Only occurrences (short strings and positions) are shuffled, never texts, and counts per pattern and
per instance are aggregated before the shuffle, so a frequent context word is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelake.sources.stores import materialise

KINDS = ("email", "ip", "card", "phone")
#: Round count, least different seeds of a pattern, least score of a pattern and of an instance, context characters read.
ROUNDS, LEAST_SEEDS, PATTERN_SCORE, INSTANCE_SCORE, CONTEXT = 2, 3, 0.6, 0.6, 40

_LOCAL = "A-Za-z0-9._%+-"
#: The formats; possessive groups and the anchors only keep the matcher linear and off the stack, they do not change matches.
FORMATS = {
    "email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]+\\.[0-9]+\\.[0-9]+",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: A text without this holds no match of the format.
_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][0-9\\x20-]{10}", "phone": "\\+[0-9]"}
_IDENTIFIER = f"(?<![{_LOCAL}@])[{_LOCAL}]*+(?<=[0-9]{{5}}|[0-9]{{3}}-[0-9]{{4}})(?![{_LOCAL}@])|(?<![{_LOCAL}@])[{_LOCAL}]++@[A-Za-z0-9._-]++"

_SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    doubled = lambda i: F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i)))
    return total % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, "\\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(F.length(_digits(s)).between(12, 19), _luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str, valid) -> Column:
    """Spans of the matches that are valid, with code point positions: matches and the gaps between them, added up."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gaps"])
        end = begin + F.length(x["matches"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("stop"), x["matches"].alias("value"))
        return F.struct(end.alias("at"), F.when(valid(x["matches"]), F.concat(a["found"], F.array(span))).otherwise(a["found"]).alias("found"))

    both = F.filter(F.arrays_zip(matches.alias("matches"), gaps.alias("gaps")), lambda x: x["matches"].isNotNull())
    return F.aggregate(both, start, step)["found"]


def _none() -> Column:
    return F.array().cast(_SPAN)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``email``, ``ip``, ``card``, ``phone``: spans of each kind in the column ``text`` (null: none)."""
    text = F.col("text")
    return docs.select(
        "*", *[F.when(text.rlike(_NEEDS[k]), _spans(text, k, FORMATS[k], lambda s, k=k: _valid(k, s))).otherwise(_none()).alias(k) for k in KINDS]
    )


def _shape(value: Column) -> Column:
    """The kind that an identifier could be, by its look alone."""
    n = F.length(_digits(value))
    return F.when(value.contains("@"), "email").when(value.rlike("^[0-9]+([.][0-9]+){3,}$"), "ip").when(n.between(12, 19), "card").when(n.between(7, 11), "phone")


def _occurrences(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, base, others``: per row the base spans, and spans of other identifiers, each with its context words."""
    text = F.col("text")
    base = F.concat(*[F.col(k) for k in KINDS])
    others = F.when(text.rlike("[0-9]{5}|[0-9]{3}-[0-9]{4}|@"), _spans(text, "", _IDENTIFIER, lambda s: _shape(s).isNotNull())).otherwise(_none())
    df = base_spans(docs).select("rid", "doc_id", "text", base.alias("base"), others.alias("others"))
    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (b["stop"] > x["start"]))

    def placed(x: Column, kind: Column) -> Column:
        before = F.substr("text", F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
        after = F.substr("text", x["stop"] + 1, F.lit(CONTEXT))
        word = "[\\p{L}\\p{N}]+"
        left = F.regexp_extract(before, f"({word})[^\\p{{L}}\\p{{N}}]*$", 1)
        right = F.regexp_extract(after, f"^[^\\p{{L}}\\p{{N}}]*({word})", 1)
        return F.struct(
            kind.alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"),
            F.array(F.concat(F.lit("<"), F.lower(left)), F.concat(F.lit(">"), F.lower(right))).alias("patterns"),
        )

    return df.select(
        "rid", "doc_id", F.transform("base", lambda x: placed(x, x["kind"])).alias("base"),
        F.transform(F.filter("others", free), lambda x: placed(x, _shape(x["value"]))).alias("others"),
    )


def _bootstrapped(found: DataFrame, rounds: int) -> DataFrame:
    """``kind, value`` of unseen identifiers that good patterns find."""
    every = found.select(F.explode("base").alias("x"), F.lit(1.0).alias("seed")).unionByName(found.select(F.explode("others").alias("x"), F.lit(0.0).alias("seed")))
    edges = (
        every.select("x.kind", "x.value", "seed", F.explode("x.patterns").alias("pattern"))
        .where("length(pattern) > 1")
        .groupBy("kind", "value", "pattern")
        .agg(F.max("seed").alias("seed"))
    )
    edges = materialise(edges, "patterns")
    scores = edges.groupBy("kind", "value").agg(F.max("seed").alias("seed"), F.max("seed").alias("score"))
    for _ in range(rounds):
        known = edges.select("kind", "value", "pattern").join(scores, ["kind", "value"])
        # two instances are added as doubtful ones, so that few occurrences prove little
        good = known.groupBy("kind", "pattern").agg((F.sum("score") / (F.count("*") + 2)).alias("weight"), F.sum("seed").alias("seeds"))
        good = good.where((F.col("seeds") >= LEAST_SEEDS) & (F.col("weight") >= PATTERN_SCORE)).select("kind", "pattern", "weight")
        reached = edges.join(good, ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log1p(-F.least("weight", F.lit(0.999)))))).alias("reach"))
        joined = scores.join(reached, ["kind", "value"], "left")
        scores = materialise(joined.select("kind", "value", "seed", F.greatest("seed", F.coalesce("reach", F.lit(0.0))).alias("score")), "instances")
    return scores.where((F.col("seed") == 0) & (F.col("score") >= INSTANCE_SCORE)).select("kind", "value")


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_spans, found_spans`` of every row of ``docs``.

    Spans are ``kind, start, stop`` in code points, stop exclusive, ordered by start, then kind as listed. A null or empty text has
    none. Found spans never overlap base spans. Repeated rows are handled each on its own. Other columns are not read.
    """
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = materialise(_occurrences(own), "occurrences")
    new = _bootstrapped(found, rounds)
    placed = found.select("rid", F.explode("others").alias("x")).select("rid", "x.kind", "x.value", "x.start", "x.stop")
    spans = placed.join(new, ["kind", "value"]).groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("new"))
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    ordered = lambda c: F.transform(F.array_sort(F.transform(c, lambda s: F.struct(s["start"], rank(s), s["stop"], s["kind"]))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    joined = found.join(spans, "rid", "left")
    return joined.select(
        "doc_id", *counts, ordered(plain(F.col("base"))).alias("base_spans"),
        ordered(F.coalesce("new", F.array().cast("array<struct<kind:string,start:int,stop:int>>"))).alias("found_spans"),
        ordered(F.concat(plain(F.col("base")), F.coalesce("new", F.array().cast("array<struct<kind:string,start:int,stop:int>>")))).alias("all_spans"),
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(text("base_spans"), 256).alias("base_sha256"), text("all_spans").alias("spans"))
