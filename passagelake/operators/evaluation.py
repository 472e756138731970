"""Retrieval evaluation: evidence matching, ranking metrics, summaries, thresholds and bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from passagelake.functions.grams import gram_lists
from passagelake.functions.random_draws import uniform_draws
from passagelake.functions.ranks import floor_percentiles, ordinals, running_sums
from passagelake.functions.text import gram_hashes, match_words, word_grams

# Evidence threshold, the ladder of experiments and metric names.
COVERAGE_THRESHOLD = 0.8
RANKING_METRICS = ["hit1", "hit3", "hit5", "recall3", "recall5", "mrr", "ndcg5", "precision5"]
EXPERIMENTS = [
    ("basic", "Basic RAG (frozen original)"),
    ("basic+thr", "Basic + tuned abstention threshold"),
    ("basic-prod", "Basic via new pipeline (parity check)"),
    ("chunk-structured", "+ structure-aware chunking"),
    ("chunk-header", "+ contextual header"),
    ("chunk-tasktype", "+ query/document task types"),
    ("hybrid", "+ hybrid BM25 + dense (RRF)"),
    ("hybrid-w50", "+ hybrid, BM25 weight 0.5"),
    ("hybrid-w25", "+ hybrid, BM25 weight 0.25"),
    ("bm25-only", "Diagnostic: BM25 alone"),
    ("rewrite", "+ conversational query rewrite"),
    ("multiquery", "+ multi-query expansion"),
    ("hyde", "+ HyDE (gated)"),
    ("rerank", "+ LLM rerank + MMR (from rewrite)"),
    ("rerank-dense", "Rerank on dense-only candidates (no BM25)"),
    ("contextual", "+ LLM contextual chunk notes"),
    ("advanced", "Production default (advanced)"),
]


# ---------------------------------------------------------------- dataset


def split_dev_test(questions: DataFrame, order: str = "position", width: int = 65_536) -> DataFrame:
    """The first two of every five questions of a category are the dev split, in file order."""
    placed = ordinals(questions, ["category"], [F.col(order)], F.floor(F.col(order) / width), "_i")
    return placed.withColumn("split", F.when((F.col("_i") - 1) % 5 < 2, F.lit("dev")).otherwise(F.lit("test"))).drop("_i")


def dataset_problems(questions: DataFrame, sources: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """``questions(id, category, question, answerable, history, gold)`` → ``id, problem`` rows.

    Gold may come as its own table ``spans(id, source, span)`` instead of a column: a question's spans then never stand in one row.
    Sources are joined by the hashes of their grams, made once for each source.
    """
    if spans is None:
        spans = questions.select("id", F.explode("gold").alias("g")).select("id", F.col("g.lesson").alias("source"), F.col("g.span").alias("span"))
        questions = questions.withColumn("_n_gold", F.size(F.coalesce("gold", F.array())))
    else:
        held = spans.groupBy("id").agg(F.count("*").alias("_n_gold"))
        questions = questions.join(held, "id", "left").withColumn("_n_gold", F.coalesce("_n_gold", F.lit(0)))
    duplicates = (
        questions.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("id", F.lit("duplicate id").alias("problem"))
    )
    n_gold, n_history = F.col("_n_gold"), F.size(F.coalesce("history", F.array()))
    rules = F.array(
        F.when(F.trim(F.coalesce("question", F.lit(""))) == "", F.lit("empty question")),
        F.when(F.col("answerable") & (n_gold <= 0), F.lit("answerable question has no gold spans")),
        F.when(~F.col("answerable") & (n_gold > 0), F.lit("unanswerable question must not have gold spans")),
        F.when((F.col("category") == "followup") & (n_history <= 0), F.lit("follow-up has no history")),
    )
    broken = questions.select("id", F.explode(F.filter(rules, lambda p: p.isNotNull())).alias("problem"))
    known = sources.select("source", gram_hashes(match_words(F.col("text"))).alias("_known"))
    asked = spans.select("id", "source", gram_hashes(match_words(F.col("span"))).alias("_grams"))
    verbatim = (F.size("_grams") > 0) & (F.size(F.array_except("_grams", "_known")) == 0)
    matched = asked.join(known, "source", "left")
    gold_rules = F.when(F.col("_known").isNull(), F.lit("unknown lesson")).when(~verbatim, F.lit("gold span not found verbatim"))
    bad_gold = matched.select("id", gold_rules.alias("problem")).where(F.col("problem").isNotNull())
    return duplicates.unionByName(broken).unionByName(bad_gold)


def dataset_profile(questions: DataFrame) -> DataFrame:
    return questions.groupBy("category").pivot("split", ["dev", "test"]).count().na.fill(0)


# ---------------------------------------------------------------- evidence


def coverage(span: Column, text: Column) -> Column:
    """Share of the span's distinct word 3-grams found in the text."""
    grams = word_grams(match_words(span))
    found = F.size(F.array_intersect(grams, word_grams(match_words(text))))
    return F.when(F.size(grams) == 0, F.lit(0.0)).otherwise(found / F.size(grams))


def gram_rows(df: DataFrame, key: list[str], text: str) -> DataFrame:
    grams = word_grams(match_words(F.col(text)))
    return df.select(*key, grams.alias("_grams")).select(*key, F.size("_grams").alias("n_grams"), F.explode("_grams").alias("gram"))


def span_coverage(spans: DataFrame, texts: DataFrame, span_key: list[str], text_key: list[str], on: list[str] | None = None) -> DataFrame:
    """Coverage for every (span, text) pair that shares a gram (and the columns ``on``), as an equi-join on grams."""
    on = on or []
    left = gram_rows(spans, span_key + [c for c in on if c not in span_key], "span")
    right = gram_rows(texts, text_key + [c for c in on if c not in text_key], "text").drop("n_grams")
    keys = list(dict.fromkeys(span_key + text_key + on))
    return (
        left.join(right, ["gram", *on])
        .groupBy(*keys, "n_grams")
        .agg(F.count("*").alias("shared"))
        .select(*keys, (F.col("shared") / F.col("n_grams")).alias("coverage"))
    )


def covering_pairs(spans: DataFrame, texts: DataFrame, span_key: list[str], text_key: list[str], threshold: float = COVERAGE_THRESHOLD) -> DataFrame:
    """``span_key, text_key, coverage`` of the pairs whose coverage reaches ``threshold``, by a join on the rarest grams only.

    A text that holds the share ``threshold`` of a span's n grams misses at most n - ceil(threshold n) of them, so it holds one of
    any n - ceil(threshold n) + 1. These are the span's grams that the fewest texts hold: a line that stands in every text never
    becomes a join key unless a span consists of little else. Pairs are then counted on all grams. Texts are scanned once; only
    their grams that occur in a span go on, as 64-bit hashes. A span without words is covered by nothing.
    """
    from passagelake.sources.stores import materialise

    span_id, text_id = F.struct(*span_key).alias("_span"), F.struct(*text_key).alias("_text")
    asked = gram_lists(spans, span_id, F.col("span"), "_grams").where(F.size("_grams") > 0)
    asked = materialise(asked, "span-grams")
    wanted = materialise(asked.select(F.explode("_grams").alias("_gram")).distinct(), "wanted-grams")
    grams = gram_lists(texts, text_id, F.col("text"), "_held").select("_text", F.explode("_held").alias("_gram"))
    hits = materialise(grams.join(wanted, "_gram", "left_semi"), "gram-hits")
    frequency = hits.groupBy("_gram").agg(F.count("*").alias("_df"))
    n = F.size("_grams")
    spare = (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")
    # grams that no text holds come first and can be left out of the prefix
    own = asked.select("_span", spare.alias("_spare"), n.alias("_n"), F.explode("_grams").alias("_gram")).join(frequency, "_gram")
    held = own.groupBy("_span").agg(F.first("_spare").alias("_spare"), F.first("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_df", "_gram"))).alias("_held"))
    rarest = F.slice("_held", F.lit(1), F.greatest(F.col("_spare") - (F.col("_n") - F.size("_held")), F.lit(0)))
    prefix = materialise(held.select("_span", F.explode(rarest).alias("_g")).select("_span", "_g._gram"), "rare-grams")
    pairs = materialise(hits.join(prefix, "_gram").select("_span", "_text").distinct(), "gram-pairs")
    found = hits.join(pairs.select("_text").distinct(), "_text", "left_semi").groupBy("_text").agg(F.collect_list("_gram").alias("_found"))
    shared = F.size(F.array_intersect("_grams", "_found")) / F.size("_grams")
    judged = pairs.join(found, "_text").join(asked, "_span").select("_span", "_text", shared.alias("coverage")).where(F.col("coverage") >= threshold)
    return judged.select(*[F.col(f"_span.{c}").alias(c) for c in span_key], *[F.col(f"_text.{c}").alias(c) for c in text_key], "coverage")


def cover_pairs(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """``ranked(experiment, qid, rank, source, text)`` × ``gold(qid, gold_no, source, span)`` → covering pairs.

    The join is per question and source; only a question's own returned rows meet its own spans. Grams are made once for each
    row of either side, and only they are joined.
    """
    rows = ranked.select("experiment", "qid", "rank", "source", gram_hashes(match_words(F.col("text"))).alias("_found"))
    spans = gold.select("qid", "gold_no", "source", gram_hashes(match_words(F.col("span"))).alias("_grams")).where(F.size("_grams") > 0)
    shared = F.size(F.array_intersect("_grams", "_found")) / F.size("_grams")
    return rows.join(spans, ["qid", "source"]).where(shared >= COVERAGE_THRESHOLD).select("experiment", "qid", "rank", "gold_no")


# ---------------------------------------------------------------- metrics


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Per (experiment, question with gold): hit, recall, mrr, ndcg with novelty gain, precision."""
    top = ranked.where(F.col("rank") <= k)
    from passagelake.sources.stores import materialise

    pairs = materialise(cover_pairs(top, gold), "covers")
    novelty = pairs.groupBy("experiment", "qid", "gold_no").agg(F.min("rank").alias("first_rank"))
    spans = novelty.groupBy("experiment", "qid").agg(
        F.count_if(F.col("first_rank") <= 3).alias("covered3"), F.count("*").alias("covered5")
    )
    gains = (
        novelty.select("experiment", "qid", "first_rank")
        .distinct()
        .groupBy("experiment", "qid")
        .agg(F.sum(1 / F.log2(F.col("first_rank") + 1)).alias("dcg"), F.min("first_rank").alias("first"))
    )
    relevant = pairs.select("experiment", "qid", "rank").distinct().groupBy("experiment", "qid").agg(F.count("*").alias("relevant"))
    returned = top.groupBy("experiment", "qid").agg(F.count("*").alias("returned"))
    wanted = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)
    )
    experiments = ranked.select("experiment", "qid").distinct()
    joined = experiments.join(wanted, "qid")
    for part in (returned, spans, gains, relevant):
        joined = joined.join(part, ["experiment", "qid"], "left")
    none = F.lit(0)
    return joined.select(
        "experiment",
        "qid",
        F.coalesce(F.col("first") <= 1, F.lit(False)).cast("double").alias("hit1"),
        F.coalesce(F.col("first") <= 3, F.lit(False)).cast("double").alias("hit3"),
        F.coalesce(F.col("first") <= k, F.lit(False)).cast("double").alias("hit5"),
        (F.coalesce("covered3", none) / F.col("n_gold")).alias("recall3"),
        (F.coalesce("covered5", none) / F.col("n_gold")).alias("recall5"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg5"),
        F.coalesce(F.col("relevant") / F.col("returned"), F.lit(0.0)).alias("precision5"),
    )


def context_metrics(decided: DataFrame, gold: DataFrame) -> DataFrame:
    """Quality of the rows kept by the decision (``in_context``)."""
    kept = decided.where(F.col("in_context"))
    pairs = cover_pairs(kept, gold)
    covered = pairs.groupBy("experiment", "qid").agg(
        F.count_distinct("gold_no").alias("covered"), F.count_distinct("rank").alias("relevant")
    )
    sizes = kept.groupBy("experiment", "qid").agg(F.count("*").alias("context_size"))
    wanted = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    return (
        decided.select("experiment", "qid")
        .distinct()
        .join(wanted, "qid")
        .join(covered, ["experiment", "qid"], "left")
        .join(sizes, ["experiment", "qid"], "left")
        .select(
            "experiment",
            "qid",
            (F.coalesce("covered", F.lit(0)) / F.col("n_gold")).alias("context_recall"),
            F.coalesce(F.col("relevant") / F.col("context_size"), F.lit(0.0)).alias("context_precision"),
            F.coalesce("context_size", F.lit(0)).alias("context_size"),
        )
    )


def apply_thresholds(ranked: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Decide per (experiment, question) with that experiment's threshold for the recorded signal kind.

    A kind without an own entry uses the experiment's dense entry.
    """
    from passagelake.operators.fusion import decide

    kinds = thresholds.select("experiment", F.col("kind").alias("signal_kind"), "threshold", "drop_below")
    dense = thresholds.where(F.col("kind") == "dense").select(
        "experiment", F.col("threshold").alias("_dt"), F.col("drop_below").alias("_dd")
    )
    joined = ranked.join(kinds, ["experiment", "signal_kind"], "left").join(dense, "experiment", "left")
    own = F.col("threshold").isNotNull()
    picked = joined.withColumn("_floor", F.when(own, F.col("drop_below")).otherwise(F.col("_dd"))).withColumn(
        "_threshold", F.when(own, F.col("threshold")).otherwise(F.col("_dt"))
    )
    return decide(picked, F.col("_threshold"), F.col("_floor"), ["experiment", "qid"]).drop(
        "threshold", "drop_below", "_dt", "_dd", "_floor", "_threshold"
    )


def score_runs(records: DataFrame, ranked: DataFrame, dataset: DataFrame, gold: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One scored row per (experiment, question).

    ``records(experiment, qid, signal_kind, model_calls, latency_ms, error)``; a question without ranked rows abstains and
    counts as a miss.
    """
    decided = apply_thresholds(ranked, thresholds)
    abstained = decided.groupBy("experiment", "qid").agg(F.bool_and("abstain").alias("abstain"))
    return (
        records.join(dataset.select("qid", "category", "split", "answerable"), "qid")
        .join(abstained, ["experiment", "qid"], "left")
        .join(ranking_metrics(ranked, gold), ["experiment", "qid"], "left")
        .join(context_metrics(decided, gold), ["experiment", "qid"], "left")
        .select(
            "experiment", "qid", "category", "split", "answerable",
            F.coalesce("abstain", F.lit(True)).alias("abstain"),
            F.coalesce("model_calls", F.lit(0)).alias("model_calls"), "latency_ms",
            F.col("error").isNotNull().alias("failed"),
            *[F.when(F.col("answerable"), F.coalesce(m, F.lit(0.0))).alias(m) for m in RANKING_METRICS],
            F.when(F.col("answerable"), F.coalesce("context_recall", F.lit(0.0))).alias("context_recall"),
            F.when(F.col("answerable"), F.coalesce("context_precision", F.lit(0.0))).alias("context_precision"),
            F.when(F.col("answerable"), F.coalesce("context_size", F.lit(0))).alias("context_size"),
        )
    )


def summarise(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Headline numbers per group."""
    yes, no = F.col("answerable"), ~F.col("answerable")
    mean = lambda c, cond=yes: F.coalesce(F.avg(F.when(cond, F.col(c))), F.lit(0.0))
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(yes).alias("n_answerable"),
        F.count_if(no).alias("n_unanswerable"),
        *[mean(m).alias(m) for m in RANKING_METRICS],
        mean("context_recall").alias("context_recall"),
        mean("context_precision", yes & (F.col("context_size") > 0)).alias("context_precision"),
        mean("context_size").alias("avg_context_size"),
        F.avg(F.when(yes, F.col("abstain").cast("double"))).alias("false_refusal"),
        F.avg(F.when(no, (~F.col("abstain")).cast("double"))).alias("false_answer"),
        F.avg((yes != F.col("abstain")).cast("double")).alias("decision_accuracy"),
        F.avg("model_calls").alias("avg_model_calls"),
        F.count_if("failed").alias("failures"),
    )
    latency = floor_percentiles(
        rows, keys, "latency_ms", {"latency_p50": 0.5, "latency_p95": 0.95}, F.floor(F.col("latency_ms"))
    )
    return base.join(latency, keys, "left")


# ---------------------------------------------------------------- bootstrap


def _positions(pairs: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
    return ordinals(pairs, keys, [F.col(order)], F.floor(F.col(order) / width), "_pos")


#: Tasks that share the resamples of a key, positions whose values one of them holds, and draws it makes at a time.
SLICES, HELD, DRAWN = 16, 1 << 21, 1 << 18


def _resampled(
    values: DataFrame, keys: list[str], sums: dict[str, str], resamples: int, seed: int, slices: int = SLICES, held: int = HELD
) -> DataFrame:
    """Sums per (key, resample) over positions drawn by the seeded generator; the numbered values and the sums are stored once.

    Draw ``r·n + i`` is computed from its own number, so no draw is ever a row: a task holds the values of up to ``held``
    positions of a key and draws its share of the resamples in blocks. The values of a key are so shuffled ``slices`` times,
    whatever the number of resamples; of a key with more than ``held`` rows each range of positions takes the draws that meet it.
    """
    from passagelake.sources.stores import materialise

    # rows without a key are in no resample
    kept = values.dropna(subset=keys).select(*keys, "_pos", *[F.col(c).cast("double").alias(c) for c in sums.values()])
    kept = materialise(kept, "numbered")
    sizes = kept.groupBy(*keys).agg(F.count("*").alias("_n"))
    dealt = kept.join(sizes, keys).select(
        *keys, "_pos", "_n", *sums.values(), F.floor((F.col("_pos") - 1) / held).alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice")
    )
    kinds = {f.name: f.dataType for f in kept.schema.fields}
    schema = T.StructType(
        [T.StructField(k, kinds[k]) for k in keys]
        + [T.StructField("_r", T.IntegerType())]
        + [T.StructField(n, T.DoubleType()) for n in sums]
        + [T.StructField("_n", T.LongType())]
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        n, start = table.column("_n")[0].as_py(), key[-2].as_py() * held
        at = table.column("_pos").to_numpy() - 1 - start
        present, amounts = [], []
        for c in sums.values():
            column = table.column(c)
            known, amount = np.zeros(len(at), bool), np.zeros(len(at))
            known[at], amount[at] = column.is_valid().to_numpy(), column.fill_null(0.0).to_numpy()
            present.append(None if known.all() else known)
            amounts.append(amount)
        drawn = list(range(key[-1].as_py(), resamples, slices))
        counts = np.zeros(len(drawn), np.int64)
        totals, met = np.zeros((len(sums), len(drawn))), np.zeros((len(sums), len(drawn)), np.int64)
        for j, r in enumerate(drawn):
            for first in range(0, n, DRAWN):
                place = np.floor(uniform_draws(r * n + first, min(DRAWN, n - first), seed) * n).astype(np.int64) - start
                if len(at) < n:
                    place = place[(place >= 0) & (place < len(at))]
                counts[j] += len(place)
                for k, (known, amount) in enumerate(zip(present, amounts)):
                    totals[k, j] += amount[place].sum()
                    met[k, j] += len(place) if known is None else int(known[place].sum())
        rows = {name: pa.array([v.as_py()] * len(drawn), kind) for name, v, kind in zip(keys, key, (v.type for v in key))}
        rows["_r"] = pa.array(drawn, pa.int32())
        for k, name in enumerate(sums):
            rows[name] = pa.array(totals[k], mask=met[k] == 0)
        return pa.table(rows | {"_n": counts})

    added = dealt.groupBy(*keys, "_part", "_slice").applyInArrow(run, schema)
    # a sum is null only where no drawn value is known; a resample that meets no row is none
    added = added.groupBy(*keys, "_r").agg(*[F.sum(n).alias(n) for n in sums], F.sum("_n").alias("_n"))
    return materialise(added, "resamples")


def bootstrap_mean(values: DataFrame, keys: list[str], value: str, order: str, resamples: int = 2000, seed: int = 7, width: int = 65_536) -> DataFrame:
    """Mean with a 95 % bootstrap interval per key; positions follow ``order``."""
    placed = _positions(values, keys, order, width)
    means = _resampled(placed.select(*keys, "_pos", F.col(value).alias("_v")), keys, {"_s": "_v"}, resamples, seed).select(
        *keys, (F.col("_s") / F.col("_n")).alias("_m")
    )
    interval = floor_percentiles(means, keys, "_m", {"lo": 0.025, "hi": 0.975}, F.floor(F.col("_m") * 1000))
    return values.groupBy(*keys).agg(F.avg(value).alias("mean")).join(interval, keys)


def paired_bootstrap(
    pairs: DataFrame, keys: list[str], a: str, b: str, order: str, resamples: int = 2000, seed: int = 11, width: int = 65_536
) -> DataFrame:
    """Mean difference and relative change of two systems on the same questions, each with a 95 % interval."""
    placed = _positions(pairs, keys, order, width).select(*keys, "_pos", F.col(a).alias("_a"), F.col(b).alias("_b"))
    sums = _resampled(placed, keys, {"_sa": "_a", "_sb": "_b"}, resamples, seed)
    changes = sums.select(
        *keys,
        ((F.col("_sb") - F.col("_sa")) / F.col("_n")).alias("_diff"),
        F.when(F.col("_sa") > 0, (F.col("_sb") - F.col("_sa")) / F.col("_sa")).alias("_rel"),
    )
    diff = floor_percentiles(changes, keys, "_diff", {"diff_lo": 0.025, "diff_hi": 0.975}, F.floor(F.col("_diff") * 1000))
    rel = floor_percentiles(changes, keys, "_rel", {"rel_lo": 0.025, "rel_hi": 0.975}, F.floor(F.col("_rel") * 1000))
    means = pairs.groupBy(*keys).agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))
    return (
        means.withColumn("diff", F.col("mean_b") - F.col("mean_a"))
        .withColumn("rel", F.when(F.col("mean_a") > 0, (F.col("mean_b") - F.col("mean_a")) / F.col("mean_a")))
        .join(diff, keys)
        .join(rel, keys, "left")
    )


# ---------------------------------------------------------------- thresholds


def best_signals(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("experiment", "qid", "signal_kind").agg(F.max("signal").alias("best"))


def sweep_thresholds(items: DataFrame, keys: list[str], bucket: Column | None = None) -> DataFrame:
    """Best separating threshold per key from ``items(answerable, best)``.

    Candidates lie below the smallest value, between neighbouring distinct values and above the largest. Counts below a
    candidate are running sums over distinct values, so no candidate meets the items again. Among candidates tied for
    the best TPR+TNR−1 the lower middle one is chosen.
    """
    spread = F.floor(F.col("value") * 1000) if bucket is None else bucket
    finite = F.coalesce("best", F.lit(float("-inf")))
    totals = items.groupBy(*keys).agg(F.count_if("answerable").alias("_p"), F.count_if(~F.col("answerable")).alias("_m"))
    never = items.where(F.col("best").isNull()).groupBy(*keys).agg(
        F.count_if("answerable").alias("_p0"), F.count_if(~F.col("answerable")).alias("_m0")
    )
    values = (
        items.where(finite > float("-inf"))
        .groupBy(*keys, F.col("best").alias("value"))
        .agg(F.count_if("answerable").alias("pos"), F.count_if(~F.col("answerable")).alias("neg"))
    )
    running = running_sums(
        values, keys, [F.col("value")], spread, {"upto_pos": F.col("pos"), "upto_neg": F.col("neg"), "n_at": F.lit(1).cast("long")}
    )
    # the next distinct value is looked up by its ordinal
    following = running.select(*keys, (F.col("n_at") - 1).alias("n_at"), F.col("value").alias("next_value"))
    above = running.join(following, [*keys, "n_at"], "left").select(
        *keys,
        F.coalesce((F.col("value") + F.col("next_value")) / 2, F.col("value") + 1e-3).alias("threshold"),
        F.col("n_at").alias("at"), "upto_pos", "upto_neg",
    )
    below = running.where(F.col("n_at") == 1).select(
        *keys, (F.col("value") - 1e-3).alias("threshold"), F.lit(0).cast("long").alias("at"),
        F.lit(0).cast("long").alias("upto_pos"), F.lit(0).cast("long").alias("upto_neg"),
    )
    scored = (
        above.unionByName(below)
        .join(totals, keys)
        .join(never, keys, "left")
        .where((F.col("_p") > 0) & (F.col("_m") > 0))
        .withColumn("tpr", (F.col("_p") - F.coalesce("_p0", F.lit(0)) - F.col("upto_pos")) / F.col("_p"))
        .withColumn("tnr", (F.coalesce("_m0", F.lit(0)) + F.col("upto_neg")) / F.col("_m"))
        .withColumn("j", F.col("tpr") + F.col("tnr") - 1)
        .select(*keys, "threshold", "at", "tpr", "tnr", "j")
    )
    top = scored.groupBy(*keys).agg(F.max("j").alias("_best"))
    tied = scored.join(top, keys).where(F.abs(F.col("j") - F.col("_best")) < 1e-9)
    placed = ordinals(tied, keys, [F.col("at")], F.floor(F.col("at") / 65_536), "_n")
    middle = tied.groupBy(*keys).agg(F.floor((F.count("*") - 1) / 2).alias("_mid"), F.min("threshold").alias("tied_from"), F.max("threshold").alias("tied_to"))
    return placed.join(middle, keys).where(F.col("_n") - 1 == F.col("_mid")).select(
        *keys, "threshold", "j", "tpr", "tnr", "tied_from", "tied_to"
    )


def half_up(value: Column, steps: int) -> Column:
    """Round to ``1/steps`` with halves going up."""
    return F.floor(value * steps + 0.5) / steps


def tuned_entries(swept: DataFrame) -> DataFrame:
    """Rounded entries: dense to three decimals, rerank to the nearest half."""
    rounded = F.when(F.col("kind") == "rerank", half_up(F.col("threshold"), 2)).otherwise(half_up(F.col("threshold"), 1000))
    return swept.withColumn("threshold", rounded)


def floor_search(
    decidable: DataFrame, questions: DataFrame, gold: DataFrame, thresholds: DataFrame, slack: float = 0.02
) -> DataFrame:
    """Largest whole per-chunk floor not above the threshold that keeps dev context recall within ``slack``.

    Raising the floor only removes rows, so each covered span is described by the highest signal among the rows that
    cover it; recall at every floor is then a count over those numbers.
    """
    kept = decidable.join(thresholds.select("experiment", "threshold"), "experiment")
    best = F.max("signal").over(Window.partitionBy("experiment", "qid"))
    answered = kept.withColumn("_best", best).where(F.col("_best") >= F.col("threshold"))
    reach = (
        cover_pairs(answered, gold)
        .join(answered.select("experiment", "qid", "rank", "signal"), ["experiment", "qid", "rank"])
        .groupBy("experiment", "qid", "gold_no")
        .agg(F.max("signal").alias("reach"))
    )
    wanted = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    denominators = questions.join(wanted, "qid").groupBy("experiment").agg(F.count("*").alias("n_questions"))
    spans = reach.join(wanted, "qid").withColumn("share", 1 / F.col("n_gold"))
    floors = thresholds.select(
        "experiment", F.explode(F.sequence(F.lit(0), F.floor("threshold").cast("int"))).alias("floor")
    )
    # spans fall into whole-number classes of reach; a floor keeps the classes at or above it
    classes = spans.groupBy("experiment", F.floor("reach").cast("int").alias("reach")).agg(F.sum("share").alias("share"))
    recall = (
        floors.join(classes, "experiment", "left")
        .groupBy("experiment", "floor")
        .agg(F.sum(F.when(F.col("reach") >= F.col("floor"), F.col("share")).otherwise(F.lit(0.0))).alias("covered"))
        .join(denominators, "experiment")
        .select("experiment", "floor", (F.col("covered") / F.col("n_questions")).alias("recall"))
    )
    base = recall.where(F.col("floor") == 0).select("experiment", F.col("recall").alias("_base"))
    return (
        recall.join(base, "experiment")
        .where(F.col("recall") >= F.col("_base") - slack)
        .groupBy("experiment")
        .agg(F.max("floor").alias("drop_below"))
    )


def thresholds_for(experiments: DataFrame, tuned: DataFrame) -> DataFrame:
    """Effective thresholds per (experiment, kind): fixed for the two basic rows, tuned, borrowed or default."""
    kinds = experiments.select("experiment", F.explode(F.array(F.lit("dense"), F.lit("rerank"))).alias("kind"))
    own = tuned.select("experiment", "kind", F.col("threshold").alias("_t"), F.col("drop_below").alias("_d"), F.lit(True).alias("_own"))
    known = tuned.select("experiment").distinct().withColumn("_known", F.lit(True))
    lent = tuned.where((F.col("experiment") == "rewrite") & (F.col("kind") == "dense")).select(
        "kind", F.col("threshold").alias("_lt"), F.col("drop_below").alias("_ld")
    )
    fixed = F.col("experiment").isin("basic", "basic-prod")
    borrowed = (F.col("kind") == "dense") & F.coalesce("_known", F.lit(False)) & F.col("_lt").isNotNull()
    default = F.when(F.col("kind") == "dense", F.lit(0.15)).otherwise(F.lit(4.0))
    default_floor = F.when(F.col("kind") == "rerank", F.lit(3.0))
    return (
        kinds.join(own, ["experiment", "kind"], "left")
        .join(known, "experiment", "left")
        .join(lent, "kind", "left")
        .select(
            "experiment",
            "kind",
            F.when(fixed, F.lit(0.15)).when(F.col("_own"), F.col("_t")).when(borrowed, F.col("_lt")).otherwise(default).alias("threshold"),
            F.when(fixed, F.lit(None).cast("double")).when(F.col("_own"), F.col("_d")).when(borrowed, F.col("_ld")).otherwise(default_floor).alias("drop_below"),
        )
    )


# ---------------------------------------------------------------- reports


def ladder(spark) -> DataFrame:
    return spark.createDataFrame([(i, n, label) for i, (n, label) in enumerate(EXPERIMENTS)], "position int, experiment string, label string")


def ablation_table(rows: DataFrame, split: str = "test") -> DataFrame:
    summary = summarise(rows.where(F.col("split") == split), ["experiment"])
    return summary.join(ladder(rows.sparkSession), "experiment").orderBy("position")


def compare_with(rows: DataFrame, base: str, metrics: list[str], order: str = "position", **bootstrap) -> DataFrame:
    """Paired bootstrap of every other experiment against ``base`` on shared answerable questions, per metric."""
    answerable = rows.where(F.col("answerable"))
    long = answerable.select(
        "experiment", "qid", order,
        F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*metrics))).alias("metric", "value"),
    )
    baseline = long.where(F.col("experiment") == base).select("qid", "metric", F.col("value").alias("a"))
    pairs = long.where(F.col("experiment") != base).withColumnRenamed("value", "b").join(baseline, ["qid", "metric"])
    return paired_bootstrap(pairs, ["experiment", "metric"], "a", "b", order, **bootstrap)


def parity(records: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """How many questions of ``records`` have identical ordered texts in both runs; compared rank by rank."""
    a = left.select("qid", "rank", F.col("text").alias("ta"))
    b = right.select("qid", "rank", F.col("text").alias("tb"))
    same = (
        a.join(b, ["qid", "rank"], "full_outer")
        .groupBy("qid")
        .agg(F.bool_and(F.coalesce(F.col("ta") == F.col("tb"), F.lit(False))).alias("same"))
    )
    return (
        records.select("qid")
        .join(same, "qid", "left")
        .agg(F.count_if(F.coalesce("same", F.lit(True))).alias("same"), F.count("*").alias("questions"))
    )


def missing_experiments(expected: DataFrame, runs: DataFrame) -> DataFrame:
    return expected.join(runs.select("experiment").distinct(), "experiment", "left_anti")


def run_validity(records: DataFrame) -> DataFrame:
    return records.groupBy("experiment").agg(
        F.count_if(F.col("error").isNotNull()).alias("question_errors"),
        F.sum(F.coalesce("model_failures", F.lit(0))).alias("model_failures"),
        (F.count_if(F.col("error").isNotNull()) + F.sum(F.coalesce("model_failures", F.lit(0))) == 0).alias("valid"),
    )


def valid_runs(records: DataFrame) -> DataFrame:
    return records.join(run_validity(records).where("valid").select("experiment"), "experiment", "left_semi")


def latency_summary(timings: DataFrame, keys: list[str]) -> DataFrame:
    base = timings.groupBy(*keys).agg(
        F.count("latency_ms").alias("n"), F.avg("latency_ms").alias("mean"), F.avg("model_calls").alias("model_calls")
    )
    spread = floor_percentiles(timings, keys, "latency_ms", {"p50": 0.5, "p95": 0.95}, F.floor("latency_ms"))
    return base.join(spread, keys)


def every_second(questions: DataFrame, order: str, most: int, width: int = 65_536) -> DataFrame:
    """The latency sample: every second question in order, at most ``most``."""
    placed = ordinals(questions.withColumn("_all", F.lit(0)), ["_all"], [F.col(order)], F.floor(F.col(order) / width), "_n")
    return placed.where(((F.col("_n") - 1) % 2 == 0) & ((F.col("_n") + 1) / 2 <= most)).drop("_n", "_all")
