"""Retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagelake.catalog import standins
from passagelake.catalog.registry import query, r6
from passagelake.catalog.sql_parts import bootstrap_parts, floor_percentile
from passagelake.functions import text as tx
from passagelake.operators import dense, lexical
from passagelake.operators import evaluation as ev
from passagelake.session import work_folder
from passagelake.sources.stores import materialise, read_runs, read_thresholds, write_runs, write_thresholds
from passagelake.sources.tables import Lake

# ---------------------------------------------------------------- inputs


def _gold(lake: Lake):
    """Benchmark passages found in documents: the document is the source, the passage the span."""
    items = lake.table("benchmark").select("item_id", F.col("text").alias("span"))
    docs = lake.documents().select("doc_id", "lang", "text")
    found = ev.covering_pairs(items, docs, ["item_id"], ["doc_id", "lang"])
    return found.join(items, "item_id").select(
        F.concat_ws("@", F.col("item_id").cast("string"), "lang").alias("qid"), F.col("doc_id").alias("gold_no"),
        F.col("doc_id").cast("string").alias("source"), "span",
    )


def gold(lake: Lake):
    return lake.once("gold", lambda: _gold(lake))


def dataset(lake: Lake, evidence=None):
    answerable = (gold(lake) if evidence is None else evidence).select("qid").distinct().withColumn("_a", F.lit(True))
    kind = F.when(F.length("question") < 240, F.lit("direct")).otherwise(F.lit("paraphrase"))
    labelled = lake.questions().join(answerable, "qid", "left").select(
        "qid", F.col("item_id").alias("position"), "question", F.concat_ws("-", kind, "course").alias("category"),
        F.coalesce("_a", F.lit(False)).alias("answerable"),
    )
    return ev.split_dev_test(labelled)


def ranked(lake: Lake):
    """Two recorded runs: dense as ``basic``, BM25 with a 0..10 signal as ``advanced``."""
    chunks, questions = lake.once("embedded", lambda: standins.embed(lake.chunks())), lake.questions()
    d = dense.dense_top_k(chunks, standins.embed(questions, text="question"), 5)
    b = lexical.bm25_top_k(chunks, questions, 5, stem=False)
    columns = lambda df, name, kind, signal: df.select(
        F.lit(name).alias("experiment"), F.lit(kind).alias("signal_kind"), "qid", "rank", signal.alias("signal"), "chunk_id"
    )
    both = columns(d, "basic", "dense", F.col("score")).unionByName(
        columns(b, "advanced", "rerank", F.least(F.col("score") / 8, F.lit(10.0)))
    )
    texts = chunks.select("chunk_id", F.col("lesson").alias("source"), "text")
    return materialise(both.join(texts, "chunk_id").drop("chunk_id"), "runs")


def records(lake: Lake):
    runs = F.explode(
        F.array(
            F.struct(F.lit("basic").alias("experiment"), F.lit("dense").alias("signal_kind"), F.lit(0).alias("model_calls"), F.lit(1.5).alias("pace")),
            F.struct(F.lit("advanced").alias("experiment"), F.lit("rerank").alias("signal_kind"), F.lit(1).alias("model_calls"), F.lit(4.0).alias("pace")),
        )
    )
    return lake.questions().select("qid", F.length("question").alias("_l"), runs.alias("e")).select(
        "e.experiment", "e.signal_kind", "qid", "e.model_calls", (F.col("_l") * F.col("e.pace")).alias("latency_ms"),
        F.lit(0).alias("model_failures"), F.lit(None).cast("string").alias("error"),
    )


def thresholds(lake: Lake):
    rows = [("basic", "dense", 0.5, None), ("advanced", "rerank", 5.0, 3.0), ("advanced", "dense", 0.5, None)]
    return lake.spark.createDataFrame(rows, "experiment string, kind string, threshold double, drop_below double")


def scored(lake: Lake):
    evidence = gold(lake)
    data = dataset(lake, evidence)
    rows = ev.score_runs(records(lake), ranked(lake), data, evidence, thresholds(lake))
    return materialise(rows.join(data.select("qid", "position"), "qid"), "scored")


# ---------------------------------------------------------------- dataset and evidence


@query("E1_split", "SELECT qid, category, split FROM split_dataset")
def split(lake: Lake):
    return dataset(lake).select("qid", "category", "split")


@query(
    "E2_dataset_problems",
    """
    SELECT CAST(position AS VARCHAR) AS id, 'duplicate id' AS problem FROM dataset GROUP BY position HAVING count(*) > 1
    UNION ALL SELECT CAST(position AS VARCHAR), 'answerable question has no gold spans' FROM dataset WHERE position % 2 = 0 AND NOT answerable
    UNION ALL SELECT CAST(position AS VARCHAR), 'unanswerable question must not have gold spans' FROM dataset WHERE position % 2 = 1 AND answerable
    UNION ALL SELECT CAST(item_id AS VARCHAR), 'gold span not found verbatim' FROM span_cover WHERE coverage >= 0.8 AND coverage < 1""",
)
def dataset_problems(lake: Lake):
    """Flags that contradict the evidence, repeated ids and spans that are only nearly present."""
    evidence = gold(lake)
    rows = dataset(lake, evidence).select(
        "qid", F.col("position").cast("string").alias("id"), "category", "question", (F.col("position") % 2 == 0).alias("answerable"),
        F.array().cast("array<struct<question:string,answer:string>>").alias("history"),
    )
    # an item asked in several courses is one id several times: problems are found by question and reported by id
    ids = rows.select("qid", "id")
    spans = evidence.select(F.col("qid").alias("id"), "source", "span")
    sources = lake.documents().select(F.col("doc_id").cast("string").alias("source"), "text")
    by_question = ev.dataset_problems(rows.drop("id").withColumnRenamed("qid", "id"), sources, spans)
    repeated = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    return by_question.withColumnRenamed("id", "qid").join(ids, "qid").select("id", "problem").unionByName(repeated)


@query(
    "E3_dataset_profile",
    "SELECT category, count(*) FILTER (WHERE split = 'dev') AS dev, count(*) FILTER (WHERE split = 'test') AS test FROM split_dataset GROUP BY category",
)
def dataset_profile(lake: Lake):
    return ev.dataset_profile(dataset(lake))


@query("E4_word_grams", "SELECT doc_id, count(*) AS grams, count(DISTINCT gram) AS distinct_grams FROM doc_grams GROUP BY doc_id")
def word_grams(lake: Lake):
    grams = tx.word_grams(tx.match_words(F.col("text")))
    return lake.documents().select("doc_id", F.explode(grams).alias("g")).groupBy("doc_id").agg(
        F.count("*").alias("grams"), F.count_distinct("g").alias("distinct_grams")
    )


@query("E5_span_coverage", "SELECT item_id, doc_id, round(coverage, 6) AS coverage FROM span_cover")
def span_coverage(lake: Lake):
    items = lake.table("benchmark").select("item_id", F.col("text").alias("span"))
    return ev.span_coverage(items, lake.documents().select("doc_id", "text"), ["item_id"], ["doc_id"]).withColumn("coverage", r6("coverage"))


@query("E5_covering_pairs", "SELECT item_id, doc_id, lang, round(coverage, 6) AS coverage FROM span_cover WHERE coverage >= 0.8")
def covering_pairs(lake: Lake):
    items = lake.table("benchmark").select("item_id", F.col("text").alias("span"))
    found = ev.covering_pairs(items, lake.documents().select("doc_id", "lang", "text"), ["item_id"], ["doc_id", "lang"])
    return found.withColumn("coverage", r6("coverage"))


@query("E6_covers", "SELECT experiment, qid, rank, gold_no FROM covers")
def covers(lake: Lake):
    return ev.cover_pairs(ranked(lake), gold(lake))


# ---------------------------------------------------------------- metrics


@query(
    "E7_ranking_metrics",
    """SELECT experiment, qid, hit1, hit3, hit5, round(recall3, 6) AS recall3, round(recall5, 6) AS recall5, round(mrr, 6) AS mrr,
       round(ndcg5, 6) AS ndcg5, round(precision5, 6) AS precision5 FROM metric_rows""",
)
def ranking_metrics(lake: Lake):
    rows = ev.ranking_metrics(ranked(lake), gold(lake))
    return rows.select("experiment", "qid", *[r6(m).alias(m) for m in ev.RANKING_METRICS])


@query(
    "E8_context_metrics",
    """SELECT experiment, qid, round(context_recall, 6) AS context_recall, round(context_precision, 6) AS context_precision, context_size FROM context_rows""",
)
def context_metrics(lake: Lake):
    rows = ev.context_metrics(ev.apply_thresholds(ranked(lake), thresholds(lake)), gold(lake))
    return rows.select("experiment", "qid", r6("context_recall").alias("context_recall"), r6("context_precision").alias("context_precision"), "context_size")


SCORED = ["hit1", "recall5", "mrr", "ndcg5", "precision5", "context_recall", "context_precision"]


@query(
    "E9_scored_runs",
    f"SELECT experiment, qid, split, answerable, abstain, model_calls, {', '.join(f'round({m}, 6) AS {m}' for m in SCORED)}, context_size FROM scored_rows",
)
def scored_runs(lake: Lake):
    return scored(lake).select("experiment", "qid", "split", "answerable", "abstain", "model_calls", *[r6(m).alias(m) for m in SCORED], "context_size")


def summary_sql(keys: str, where: str = "true") -> str:
    return f"""
    SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE answerable) AS n_answerable,
           round(coalesce(avg(recall5) FILTER (WHERE answerable), 0), 6) AS recall5, round(coalesce(avg(mrr) FILTER (WHERE answerable), 0), 6) AS mrr,
           round(coalesce(avg(ndcg5) FILTER (WHERE answerable), 0), 6) AS ndcg5, round(coalesce(avg(hit1) FILTER (WHERE answerable), 0), 6) AS hit1,
           round(coalesce(avg(context_precision) FILTER (WHERE answerable AND context_size > 0), 0), 6) AS context_precision,
           round(coalesce(avg(context_size) FILTER (WHERE answerable), 0), 6) AS avg_context_size,
           round(avg(CAST(abstain AS INT)) FILTER (WHERE answerable), 6) AS false_refusal,
           round(avg(1 - CAST(abstain AS INT)) FILTER (WHERE NOT answerable), 6) AS false_answer,
           round(avg(CAST(answerable <> abstain AS INT)), 6) AS decision_accuracy, round(avg(model_calls), 6) AS avg_model_calls,
           {floor_percentile('latency_ms', 0.5)} AS latency_p50, {floor_percentile('latency_ms', 0.95)} AS latency_p95
    FROM scored_rows WHERE {where} GROUP BY {keys}"""


ROUNDED = ["recall5", "mrr", "ndcg5", "hit1", "context_precision", "avg_context_size", "false_refusal", "false_answer", "decision_accuracy", "avg_model_calls"]


def summary_rows(df, *keys):
    return df.select(*keys, "n", "n_answerable", *[r6(m).alias(m) for m in ROUNDED], "latency_p50", "latency_p95")


@query("E10_run_summary", summary_sql("experiment, split"))
def run_summary(lake: Lake):
    return summary_rows(ev.summarise(scored(lake), ["experiment", "split"]), "experiment", "split")


@query("E17_ablation_table", summary_sql("experiment", "split = 'test'"))
def ablation_table(lake: Lake):
    return summary_rows(ev.ablation_table(scored(lake)), "experiment")


@query("E19_category_breakdown", summary_sql("experiment, category", "split = 'test'"))
def category_breakdown(lake: Lake):
    return summary_rows(ev.summarise(scored(lake).where(F.col("split") == "test"), ["experiment", "category"]), "experiment", "category")


# ---------------------------------------------------------------- statistics


@query(
    "E11_floor_percentiles",
    f"SELECT event_type, {floor_percentile('value', 0.025)} AS p025, {floor_percentile('value', 0.5)} AS p50, {floor_percentile('value', 0.95)} AS p95 FROM events GROUP BY event_type",
)
def floor_percentiles(lake: Lake):
    return ev.floor_percentiles(lake.table("events"), ["event_type"], "value", {"p025": 0.025, "p50": 0.5, "p95": 0.95}, F.floor("value"))


LABELLED = {
    "labelled": """
        SELECT lang AS key, doc_id, CAST(quality AS DOUBLE) AS a, 1 - CAST(toxic AS DOUBLE) AS b,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos
        FROM labels JOIN documents USING (doc_id)""",
}


def labelled(lake: Lake):
    return lake.table("labels").join(lake.documents().select("doc_id", "lang"), "doc_id").select(
        "lang", "doc_id", F.col("quality").cast("double").alias("a"), (1 - F.col("toxic").cast("double")).alias("b")
    )


@query(
    "E12_bootstrap_mean",
    f"""
    SELECT lang, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM
      (SELECT key AS lang, avg(a) AS mean FROM labelled GROUP BY key) JOIN
      (SELECT key AS lang, {floor_percentile('m', 0.025)} AS lo, {floor_percentile('m', 0.975)} AS hi
       FROM (SELECT d.key, d.r, sum(v.a) / count(*) AS m FROM bs_draws d JOIN labelled v ON v.key = d.key AND v.pos = d.pos GROUP BY d.key, d.r) GROUP BY key) USING (lang)""",
    {**LABELLED, **bootstrap_parts("labelled", "bs", 7)},
)
def bootstrap_mean(lake: Lake):
    out = ev.bootstrap_mean(labelled(lake), ["lang"], "a", "doc_id")
    return out.select("lang", *[r6(c).alias(c) for c in ("mean", "lo", "hi")])


def paired_sql(key: str, draws: str, values: str) -> str:
    sums = f"SELECT d.key, d.r, sum(v.a) AS sa, sum(v.b) AS sb, count(*) AS n FROM {draws} d JOIN {values} v ON v.key = d.key AND v.pos = d.pos GROUP BY d.key, d.r"
    changes = f"SELECT key, (sb - sa) / n AS diff, CASE WHEN sa > 0 THEN (sb - sa) / sa END AS rel FROM ({sums})"
    return f"""
    SELECT {key}, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_b - mean_a, 6) AS diff, round(diff_lo, 6) AS diff_lo, round(diff_hi, 6) AS diff_hi,
           round(CASE WHEN mean_a > 0 THEN (mean_b - mean_a) / mean_a END, 6) AS rel, round(rel_lo, 6) AS rel_lo, round(rel_hi, 6) AS rel_hi
    FROM (SELECT key, avg(a) AS mean_a, avg(b) AS mean_b FROM {values} GROUP BY key) JOIN
      (SELECT key, {floor_percentile('diff', 0.025)} AS diff_lo, {floor_percentile('diff', 0.975)} AS diff_hi,
              {floor_percentile('rel', 0.025)} AS rel_lo, {floor_percentile('rel', 0.975)} AS rel_hi FROM ({changes}) GROUP BY key) USING (key)"""


PAIRED = ["mean_a", "mean_b", "diff", "diff_lo", "diff_hi", "rel", "rel_lo", "rel_hi"]


@query("E13_paired_bootstrap", paired_sql("key AS lang", "pb_draws", "labelled"), {**LABELLED, **bootstrap_parts("labelled", "pb", 11)})
def paired_bootstrap(lake: Lake):
    return ev.paired_bootstrap(labelled(lake), ["lang"], "a", "b", "doc_id").select("lang", *[r6(c).alias(c) for c in PAIRED])


COMPARED = {
    "both_runs": f"""
        SELECT qid, any_value(position) AS position, {', '.join(f"max({m}) FILTER (WHERE experiment = '{e}') AS {m}_{n}" for m in ('mrr', 'recall5', 'precision5') for e, n in (('basic', 'a'), ('advanced', 'b')))}
        FROM scored_rows WHERE answerable GROUP BY qid""",
    "long_runs": " UNION ALL ".join(
        f"SELECT '{m}' AS key, position, split_part(qid, '@', 2) AS lang, {m}_a AS a, {m}_b AS b FROM both_runs" for m in ("mrr", "recall5", "precision5")
    ),
    "compared": "SELECT key, a, b, row_number() OVER (PARTITION BY key ORDER BY position, ascii(lang) * 256 + ascii(substr(lang, 2))) AS pos FROM long_runs",
}


@query("E18_baseline_comparison", paired_sql("'advanced' AS experiment, key AS metric", "cb_draws", "compared"), {**COMPARED, **bootstrap_parts("compared", "cb", 11)})
def baseline_comparison(lake: Lake):
    language = F.substring_index("qid", "@", -1)
    unique = F.col("position") * 65_536 + F.ascii(language) * 256 + F.ascii(F.substring(language, 2, 1))
    rows = scored(lake).withColumn("ord", unique)
    # questions of one item are far apart in this numbering, so buckets are wide
    out = ev.compare_with(rows, "basic", ["mrr", "recall5", "precision5"], order="ord", width=65_536 * 65_536)
    return out.select("experiment", "metric", *[r6(c).alias(c) for c in PAIRED])


# ---------------------------------------------------------------- thresholds

SIGNALS = {
    "signals": "SELECT lang AS key, quality = 1 AS answerable, n_chars / 1000.0 AS best FROM labels JOIN documents USING (doc_id)",
    "sig_values": "SELECT key, best AS v, row_number() OVER (PARTITION BY key ORDER BY best) AS i, lead(best) OVER (PARTITION BY key ORDER BY best) AS nxt FROM (SELECT DISTINCT key, best FROM signals)",
    "sig_candidates": """
        SELECT key, i AS ord, coalesce((v + nxt) / 2, v + 0.001) AS t FROM sig_values UNION ALL SELECT key, 0, v - 0.001 FROM sig_values WHERE i = 1""",
    "sig_scored": """
        SELECT c.key, c.ord, c.t, count(*) FILTER (WHERE answerable AND best >= t) / count(*) FILTER (WHERE answerable) AS tpr,
               count(*) FILTER (WHERE NOT answerable AND best < t) / count(*) FILTER (WHERE NOT answerable) AS tnr
        FROM sig_candidates c JOIN signals s ON s.key = c.key GROUP BY ALL""",
    "sig_tied": """
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS k, count(*) OVER (PARTITION BY key) AS n FROM
          (SELECT *, tpr + tnr - 1 AS j, max(tpr + tnr - 1) OVER (PARTITION BY key) AS best FROM sig_scored) WHERE abs(j - best) < 1e-9""",
}


def signals(lake: Lake):
    return lake.table("labels").join(lake.documents().select("doc_id", "lang", "n_chars"), "doc_id").select(
        "lang", (F.col("quality") == 1).alias("answerable"), (F.col("n_chars") / 1000.0).alias("best")
    )


@query(
    "E14_threshold_sweep",
    "SELECT key AS lang, floor(t * 1000 + 0.5) / 1000 AS threshold, round(j, 6) AS j, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr FROM sig_tied WHERE k - 1 = (n - 1) // 2",
    SIGNALS,
)
def threshold_sweep(lake: Lake):
    swept = ev.sweep_thresholds(signals(lake), ["lang"]).withColumn("kind", F.lit("dense"))
    return ev.tuned_entries(swept).select("lang", "threshold", *[r6(c).alias(c) for c in ("j", "tpr", "tnr")])


@query(
    "E15_floor_search",
    """
    SELECT 'advanced' AS experiment, max(d) AS drop_below FROM (
      SELECT d, sum(share) / any_value(nq) AS recall, max(sum(share) / any_value(nq)) OVER () AS base FROM (
        SELECT d, coalesce(1.0 / z.n_gold, 0) * CAST(reach IS NOT NULL AND reach >= d AS INT) AS share, (SELECT count(*) FROM gold_sizes) AS nq
        FROM (SELECT unnest(range(0, 6)) AS d), gold g JOIN gold_sizes z USING (qid)
        LEFT JOIN (SELECT c.qid, c.gold_no, max(c.signal) AS reach FROM covers c JOIN (SELECT qid FROM ranked WHERE experiment = 'advanced'
                   GROUP BY qid HAVING max(signal) >= 5) a ON a.qid = c.qid WHERE c.experiment = 'advanced' GROUP BY ALL) h
          ON h.qid = g.qid AND h.gold_no = g.gold_no) GROUP BY d) WHERE recall >= base - 0.02""",
)
def floor_search(lake: Lake):
    rerank = ranked(lake).where(F.col("signal_kind") == "rerank")
    entries = thresholds(lake).where((F.col("experiment") == "advanced") & (F.col("kind") == "rerank"))
    questions = records(lake).where(F.col("experiment") == "advanced").select("experiment", "qid")
    return ev.floor_search(rerank, questions, gold(lake), entries)


TUNED = {
    "tuned": """
        SELECT source AS experiment, 'rerank' AS kind, count(*) / 100.0 AS threshold, count(*) / 200.0 AS drop_below FROM documents GROUP BY source
        UNION ALL SELECT 'rewrite', 'dense', 0.682, NULL""",
    "known": "SELECT source AS experiment FROM documents UNION SELECT lang FROM documents UNION SELECT 'basic'",
}


@query(
    "E16_effective_thresholds",
    """
    SELECT k.experiment, x.kind,
           CAST(CASE WHEN k.experiment IN ('basic', 'basic-prod') THEN 0.15 WHEN t.kind IS NOT NULL THEN t.threshold
                WHEN x.kind = 'dense' AND k.experiment IN (SELECT experiment FROM tuned) THEN 0.682 WHEN x.kind = 'dense' THEN 0.15 ELSE 4 END AS DOUBLE) AS threshold,
           CAST(CASE WHEN k.experiment IN ('basic', 'basic-prod') THEN NULL WHEN t.kind IS NOT NULL THEN t.drop_below WHEN x.kind = 'rerank' THEN 3 END AS DOUBLE) AS drop_below
    FROM known k CROSS JOIN (VALUES ('dense'), ('rerank')) x(kind) LEFT JOIN tuned t ON t.experiment = k.experiment AND t.kind = x.kind""",
    TUNED,
)
def effective_thresholds(lake: Lake):
    docs = lake.documents()
    tuned = docs.groupBy(F.col("source").alias("experiment")).agg(
        F.lit("rerank").alias("kind"), (F.count("*") / 100.0).alias("threshold"), (F.count("*") / 200.0).alias("drop_below")
    )
    lent = lake.spark.createDataFrame([("rewrite", "dense", 0.682, None)], "experiment string, kind string, threshold double, drop_below double")
    basic = lake.spark.createDataFrame([("basic",)], "experiment string")
    experiments = docs.select(F.explode(F.array("source", "lang")).alias("experiment")).unionByName(basic).distinct()
    return ev.thresholds_for(experiments, tuned.unionByName(lent))


# ---------------------------------------------------------------- runs


@query(
    "E20_parity",
    """
    SELECT count(*) FILTER (WHERE same) AS same, count(*) AS questions FROM (
      SELECT q.qid, coalesce(bool_and(coalesce(a.text = b.text, false)) FILTER (WHERE a.qid IS NOT NULL OR b.qid IS NOT NULL), true) AS same
      FROM questions q LEFT JOIN ((SELECT * FROM ranked WHERE experiment = 'basic') a FULL JOIN (SELECT * FROM ranked WHERE experiment = 'advanced') b
        ON a.qid = b.qid AND a.rank = b.rank) ON q.qid = coalesce(a.qid, b.qid) GROUP BY q.qid)""",
)
def parity(lake: Lake):
    rows = ranked(lake)
    return ev.parity(lake.questions(), rows.where(F.col("experiment") == "basic"), rows.where(F.col("experiment") == "advanced"))


@query(
    "E21_missing_experiments",
    "SELECT DISTINCT p_brand || '-' || p_type AS experiment FROM part WHERE p_brand || '-' || p_type NOT IN (SELECT p_brand || '-' || p_type FROM part WHERE p_size > 45)",
)
def missing_experiments(lake: Lake):
    """Brand and type as expected experiments; only those with a large part have a run."""
    parts = lake.table("part").select(F.concat_ws("-", "p_brand", "p_type").alias("experiment"), "p_size")
    return ev.missing_experiments(parts.select("experiment").distinct(), parts.where(F.col("p_size") > 45))


GUARD_SQL = """
    SELECT event_type AS experiment, count(*) FILTER (WHERE value > 60) AS question_errors, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS model_failures,
           count(*) FILTER (WHERE value > 60) + count(*) FILTER (WHERE event_type = 'error') = 0 AS valid FROM events GROUP BY event_type"""


def event_records(lake: Lake):
    return lake.table("events").select(
        F.col("event_type").alias("experiment"), F.col("event_id").cast("string").alias("qid"),
        F.when(F.col("value") > 60, F.lit("timeout")).alias("error"), (F.col("event_type") == "error").cast("int").alias("model_failures"),
        F.col("value").alias("latency_ms"), F.lit(1).alias("model_calls"),
    )


@query("E22_run_guard", GUARD_SQL)
def run_guard(lake: Lake):
    return ev.run_validity(event_records(lake))


@query(
    "E23_latency_summary",
    f"SELECT event_type AS experiment, count(*) AS n, round(avg(value), 6) AS mean, {floor_percentile('value', 0.5)} AS p50, {floor_percentile('value', 0.95)} AS p95 FROM events GROUP BY event_type",
)
def latency_summary(lake: Lake):
    return ev.latency_summary(event_records(lake), ["experiment"]).select("experiment", "n", r6("mean").alias("mean"), "p50", "p95")


@query(
    "E23_latency_sample",
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE (n - 1) % 2 = 0 ORDER BY n LIMIT 20",
)
def latency_sample(lake: Lake):
    """The sampling operator: every second question in order, the first twenty."""
    return ev.every_second(lake.table("events").select("event_id"), "event_id", 20)


@query(
    "A6_run_store",
    "SELECT experiment, qid, signal_kind, model_calls FROM records",
)
def run_store(lake: Lake):
    path = work_folder(lake.spark, "run-store")
    rows = records(lake)
    write_runs(rows, path)
    return read_runs(lake.spark, path, rows.schema).select("experiment", "qid", "signal_kind", "model_calls")


@query(
    "A7_threshold_store",
    "SELECT key AS experiment, 'dense' AS kind, floor(t * 1000 + 0.5) / 1000 AS threshold FROM sig_tied WHERE k - 1 = (n - 1) // 2",
    SIGNALS,
)
def threshold_store(lake: Lake):
    path = work_folder(lake.spark, "thresholds")
    swept = ev.sweep_thresholds(signals(lake), ["lang"]).withColumnsRenamed({"lang": "experiment"}).withColumns({"kind": F.lit("dense"), "drop_below": F.lit(None).cast("double")})
    write_thresholds(ev.tuned_entries(swept).drop("tied_from", "tied_to"), path)
    return read_thresholds(lake.spark, path).select("experiment", "kind", "threshold")
