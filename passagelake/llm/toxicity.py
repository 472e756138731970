"""Operator 4: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are ratios of counts in the whole text, all built-in expressions: densities of a stated and of a learned lexicon,
second-person words close to lexicon words, capitals, punctuation and obfuscated words. The learned lexicon holds words and word
beginnings that mark toxic training rows. Trees, lexicon and calibration learn from a bounded sample of labelled rows
(``MOST_ROWS``); scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelake.sources.stores import materialise

#: About so many labelled rows are learned from at most: those whose hash of doc_id is in the share that leaves so many.
MOST_ROWS = 60_000
#: Learned lexicon entries at most, and the rows a word must occur in at least.
MOST_WORDS, LEAST_ROWS = 400, 5
BEGINNING = 4
THRESHOLD = 0.7

#: Common English insults (fixed values).
INSULTS = "idiot moron stupid pathetic worthless disgusting loser scum trash clown dumb jerk fool imbecile filth vermin".split()
#: Second-person words of English, French, German and Spanish (fixed values).
SECOND_PERSON = "you your yours yourself tu te toi ton vous votre du dich dir dein ihr euch usted ustedes vosotros contigo".split()

_LETTERS = "[^\\p{L}\\p{N}]+"


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``doc_id, text, toxic`` of labelled documents outside the held-out third."""
    known = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_d")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~_held_out(F.col("_d")))
    share = min(1.0, most / max(1, known.count()))
    sampled = lambda i: F.pmod(F.xxhash64(i), F.lit(1 << 30)) < int(share * (1 << 30))
    known = materialise(known.where(sampled(F.col("_d"))), "toxicity-labels")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ``most`` ids or so, however many documents there are: they go to the texts, which are not shuffled to meet them
    return own.where(sampled(F.col("doc_id"))).join(F.broadcast(known), F.col("doc_id") == F.col("_d")).drop("_d")


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), _LETTERS)


def learned_lexicon(rows: DataFrame, most: int = MOST_WORDS) -> tuple[list[str], list[str]]:
    """Words, and beginnings of longer words, whose share of toxic rows stands out; at most ``most`` of each."""
    words = F.array_distinct(_words(F.col("text")))
    starts = F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > BEGINNING), lambda w: F.left(w, F.lit(BEGINNING))))
    tagged = rows.select(F.col("toxic"), F.explode(F.concat(F.transform(words, lambda w: F.concat(F.lit("="), w)), F.transform(starts, lambda w: F.concat(F.lit("^"), w)))).alias("w"))
    totals = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)
    if not toxic or not clean:
        return [], []
    counted = tagged.groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") >= LEAST_ROWS)
    lift = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    best = counted.select("w", lift.alias("lift"), (lift * F.sqrt("a")).alias("z")).where("lift > 1.5 and length(w) > 3")
    found = {kind: [r["w"][1:] for r in best.where(F.col("w").startswith(kind)).orderBy(F.col("z").desc(), "w").limit(most).collect()] for kind in "=^"}
    return found["="], found["^"]


@dataclass(frozen=True)
class Features:
    """Dense features of a text, given the learned lexicon."""

    words: tuple[str, ...]
    beginnings: tuple[str, ...]

    def columns(self, docs: DataFrame) -> DataFrame:
        """``docs`` plus ``features``; a null or empty text has all features 0."""
        lexicon = list(dict.fromkeys([*INSULTS, *self.words]))
        text = F.coalesce(F.col("text"), F.lit(""))
        size = F.greatest(F.size("_w"), F.lit(1))
        in_lexicon = lambda w: w.isin(*lexicon)
        started = lambda w: (F.length(w) > BEGINNING) & F.left(w, F.lit(BEGINNING)).isin(*self.beginnings) if self.beginnings else F.lit(False)
        count = lambda f: F.size(F.filter("_w", f))
        df = docs.select("*", F.filter(_words(F.col("text")), lambda w: w != "").alias("_w"))
        df = df.select(
            "*", size.alias("_size"), F.greatest(F.length(text), F.lit(1)).alias("_chars"),
            count(lambda w: w.isin(*INSULTS)).alias("_stated"), count(in_lexicon).alias("_learned"), count(started).alias("_started"),
            F.filter(F.transform("_w", lambda w, i: F.when(w.isin(*SECOND_PERSON), i)), lambda i: i.isNotNull()).alias("_second"),
        )
        near = F.when(
            F.col("_learned") > 0,
            F.size(F.filter("_second", lambda i: F.exists(F.slice("_w", F.greatest(i - 2, F.lit(1)), F.least(i + 4, F.lit(7))), in_lexicon))),
        ).otherwise(0)
        obfuscated = F.regexp_count(text, F.lit("\\p{L}[@$*0!1]+\\p{L}"))
        values = [
            F.col("_stated") / F.col("_size"), F.col("_learned") / F.col("_size"), F.col("_started") / F.col("_size"),
            F.least("_learned", F.lit(20)), F.least("_started", F.lit(20)),
            F.size("_second") / F.col("_size"), near / F.col("_size"),
            F.regexp_count(text, F.lit("\\p{Lu}")) / F.col("_chars"), F.regexp_count(text, F.lit("\\b\\p{Lu}{3,}\\b")) / F.col("_size"),
            F.regexp_count(text, F.lit("[!?]")) / F.col("_size"), F.regexp_count(text, F.lit("[^\\p{L}\\p{N}\\s]")) / F.col("_chars"),
            obfuscated / F.col("_size"), F.log1p("_size"),
        ]
        from pyspark.ml.functions import array_to_vector

        features = F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])
        return df.select(*docs.columns, array_to_vector(features).alias("features"))


class ToxicityModel:
    """Trees, then an isotonic map from the trees' margin to a probability. Without both labels: the constant base rate."""

    def __init__(self, features: Features, trees, calibration, base: float):
        self.features, self.trees, self.calibration, self.base = features, trees, calibration, base

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, rounds: int = 16, depth: int = 4) -> ToxicityModel:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.regression import IsotonicRegression

        rows = materialise(training_rows(docs, labels, most), "toxicity-rows")
        fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
        words, starts = learned_lexicon(rows.where(~fold))
        features = Features(tuple(words), tuple(starts))
        counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        base = counts.get(1, 0) / max(1, sum(counts.values()))
        if len(counts) < 2:
            return cls(features, None, None, base)
        known = materialise(features.columns(rows).select("doc_id", "features", F.col("toxic").cast("double").alias("label")), "toxicity-features")
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, featuresCol="features", labelCol="label").fit(known.where(~fold))
        # calibrated on rows that neither the lexicon nor the trees saw
        margins = cls(features, trees, None, base).margins(known.where(fold))
        # equal margins as one weighted row
        held = margins.groupBy("margin").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
        seen = margins.agg(F.countDistinct("label").alias("n")).first()["n"]
        calibration = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="prediction_iso").fit(held) if seen == 2 else None
        return cls(features, trees, calibration, base)

    def margins(self, known: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return self.trees.transform(known).withColumn("margin", F.get(vector_to_array("rawPrediction"), F.lit(1)))

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``score``: calibrated, and between two equally calibrated texts a little higher for the higher margin."""
        if self.trees is None:
            return docs.withColumn("score", F.lit(float(self.base)))
        df = self.margins(self.features.columns(docs))
        p = 1 / (1 + F.exp(-2 * F.col("margin")))
        if self.calibration is not None:
            p = 0.98 * F.col("prediction_iso") + 0.02 * p
            df = self.calibration.transform(df)
        return df.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).select(*docs.columns, "score")


def toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; labels are used for learning only, from rows not held out.

    A null or empty text is scored from zero features. A row without doc_id is scored and not held out; repeated rows get equal
    scores. Where labels are missing altogether or of one kind, the score is their base rate.
    """
    model = model or ToxicityModel.fit(docs, labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return model.score(own).select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below the threshold."""
    model = model or ToxicityModel.fit(docs, labels)
    own = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"))
    return model.score(own).where(F.col("score") < THRESHOLD).select("_row.*")
