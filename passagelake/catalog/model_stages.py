"""Model-in-the-loop stages over conversations and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagelake.catalog.registry import query, r6
from passagelake.catalog.sql_parts import bootstrap_parts
from passagelake.catalog.evaluation import paired_sql
from passagelake.catalog.retrieval import CONTEXT, decided_hits, lexical_pool
from passagelake.operators import model_stages as ms
from passagelake.operators import evaluation as ev
from passagelake.operators.passages import build_passages
from passagelake.sources.tables import Lake

LAST3 = "last3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM chat_turns) WHERE n <= 3)"


@query(
    "M1_history_window",
    f"""
    SELECT * FROM (WITH {LAST3} SELECT conv_id, count(*) AS turns,
      md5(string_agg('Student: ' || question || chr(10) || 'Tutor: ' || substr(answer, 1, 300), chr(10) || chr(10) ORDER BY turn)) AS digest
    FROM last3 GROUP BY conv_id)""",
)
def history_window(lake: Lake):
    history = ms.history_window(lake.chat_turns(), ["conv_id"], "turn")
    return history.select("conv_id", F.size("history").cast("long").alias("turns"), F.md5(ms.history_text(F.col("history"))).alias("digest"))


def open_with_history(lake: Lake):
    return lake.open_questions().join(ms.history_window(lake.chat_turns(), ["conv_id"], "turn"), "conv_id", "left").withColumn(
        "qid", F.col("conv_id").cast("string")
    )


@query(
    "M2_standalone_questions",
    """
    SELECT CAST(o.conv_id AS VARCHAR) AS qid,
           CASE WHEN h.conv_id IS NOT NULL AND length(o.question) BETWEEN 1 AND 391 THEN 'About: ' || trim(regexp_replace(o.question, '\\s+', ' ', 'g')) || '?!'
                ELSE o.question END AS standalone,
           CAST(h.conv_id IS NOT NULL AS INT) AS model_calls, CAST(h.conv_id IS NOT NULL AND length(o.question) > 391 AS INT) AS model_failures
    FROM open_questions o LEFT JOIN (SELECT DISTINCT conv_id FROM chat_turns) h ON h.conv_id = o.conv_id""",
)
def standalone_questions(lake: Lake):
    """Recorded rewrites wrap the question in quotes; those of long questions exceed the limit and fall back."""
    questions = open_with_history(lake).withColumns({"model_calls": F.lit(0), "model_failures": F.lit(0)})
    wrapped = F.concat(F.lit('"About: '), F.trim(F.regexp_replace("question", "\\s+", " ")), F.lit('?!"\n'))
    responses = questions.select(
        "qid", F.lit("rewrite").alias("stage"),
        F.when(F.length("question") > 391, F.repeat(F.col("question"), 2)).otherwise(wrapped).alias("text"),
    )
    return ms.standalone_questions(questions, responses).select("qid", "standalone", "model_calls", "model_failures")


@query(
    "M3_paraphrases",
    """
    SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE 'first ' || turn || '|second' END AS paraphrases FROM conversations""",
)
def paraphrases(lake: Lake):
    """Recorded lists: plain, wrapped or broken, with repeats, the original and an empty entry."""
    said = F.concat(F.lit("first "), F.col("turn").cast("string"))
    entries = F.array(said, F.lit("second"), said, F.lit("`second`"), F.lit(""), F.lit("original"))
    listed, wrapped = F.to_json(entries), F.to_json(F.struct(entries.alias("queries")))
    text = (
        F.when(F.col("turn") % 4 == 3, F.lit("Sorry, no."))
        .when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Here: "), wrapped))
    )
    found = ms.paraphrase_list(ms.loose_json(text), F.lit("original"))
    return lake.table("conversations").select("conv_id", "turn", F.array_join(found, "|").alias("paraphrases"))


@query(
    "M4_hypothetical_passages",
    "SELECT conv_id, turn, CASE WHEN length(t) < 20 THEN 0 ELSE least(length(t), 800) END AS chars FROM (SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS t FROM conversations)",
)
def hypothetical_passages(lake: Lake):
    return lake.table("conversations").select("conv_id", "turn", F.length(ms.hypothetical_passage(F.col("text"))).alias("chars"))


@query(
    "M5_response_ingestion",
    "SELECT conv_id, turn, role <> 'system' AND turn % 3 <> 2 AS accepted, CASE WHEN role <> 'system' AND turn % 3 <> 2 THEN length(text) END AS chars FROM conversations",
)
def response_ingestion(lake: Lake):
    """Replies as JSON, fenced or inside chatter, and cut off in a third of the cases."""
    body = F.to_json(F.struct(F.lit("say }").alias("note"), F.col("text").alias("value")))
    text = (
        F.when(F.col("role") == "system", F.lit("no json at all"))
        .when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("Sure! "), body, F.lit(" Hope [that] helps.")))
        .otherwise(F.substring(body, F.lit(1), F.length(body) - 1))
    )
    got = ms.ingest_responses(lake.table("conversations").withColumn("text", text))
    return got.select("conv_id", "turn", "accepted", F.length(F.get_json_object("json", "$.value")).alias("chars"))


@query(
    "M6_rerank_prompts",
    """
    SELECT b.qid, md5('Student question: ' || any_value(q.question) || chr(10) || chr(10) || 'Passages:' || chr(10) || chr(10) ||
      string_agg('[' || b.rank || ']' || chr(10) || CASE WHEN length(c.text) > 700 THEN substr(c.text, 1, 700) || '...' ELSE c.text END, chr(10) || chr(10) ORDER BY b.rank)) AS digest
    FROM bm25_top b JOIN chunks c ON c.chunk_id = b.chunk_id JOIN questions q ON q.qid = b.qid GROUP BY b.qid""",
)
def rerank_prompts(lake: Lake):
    pool = lexical_pool(lake)
    prompts = ms.rerank_prompt(pool, pool.select("qid", "standalone").dropDuplicates(["qid"]))
    return prompts.select("qid", F.md5("prompt").alias("digest"))


@query(
    "M7_source_descriptions",
    """
    SELECT doc_id, CASE WHEN source = 'web' OR length(source) % 2 = 0 THEN 'file "' || source || '.pdf" attached to lesson "Document ' || doc_id || '", section "' || lang || ' > Intro", page ' || (doc_id % 9 + 1)
      ELSE 'lesson "Document ' || doc_id || '", section "' || lang || ' > Intro"' END AS description FROM documents""",
)
def source_descriptions(lake: Lake):
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    from_file = (F.col("source") == "web") | (F.length("source") % 2 == 0)
    rows = lake.documents().select(
        "doc_id", title.alias("lesson_title"), F.concat_ws(" > ", title, "lang", F.lit("Intro")).alias("context_header"),
        F.when(from_file, F.lit("attachment")).otherwise(F.lit("content")).alias("source"),
        F.concat("source", F.lit(".pdf")).alias("source_label"), (F.col("doc_id") % 9 + 1).cast("int").alias("page"),
    )
    return rows.select("doc_id", ms.source_description().alias("description"))


def found_passages(lake: Lake):
    return build_passages(decided_hits(lake).where("in_context"), lake.stored_chunks(), 1, 6000)


@query(
    "M8_grounded_prompts",
    """
    SELECT p.qid, md5('Course excerpts:' || chr(10) || string_agg('Excerpt E' || p.position || ' (from lesson "Document ' || p.doc_id || '"):' || chr(10) || p.text, chr(10) || chr(10) ORDER BY p.position)
      || chr(10) || chr(10) || 'Student question: ' || any_value(q.question)) AS digest
    FROM ctx_passages p JOIN questions q ON q.qid = p.qid GROUP BY p.qid""",
    CONTEXT,
)
def grounded_prompts(lake: Lake):
    questions = lake.questions().withColumn("history", F.array().cast("array<struct<question:string,answer:string>>"))
    prompts = ms.grounded_prompts(found_passages(lake), questions)
    return prompts.select("qid", F.md5("prompt").alias("digest"))


def tagged(lake: Lake):
    """Replies with citation tags whose numbers come from the turn."""
    tag = F.format_string(" [E%d] and (Excerpts %d, %d) [E 9]", F.col("turn") + 1, F.col("turn"), F.col("turn") + 1)
    return lake.table("conversations").withColumn("answer", F.concat("text", tag))


@query(
    "M9_citations",
    """
    SELECT conv_id, turn, CASE WHEN turn + 1 > 3 THEN CASE WHEN turn BETWEEN 1 AND 3 THEN CAST(turn AS VARCHAR) ELSE '' END
      WHEN turn = 0 THEN '1' ELSE (turn + 1) || ',' || turn END AS cited FROM conversations""",
)
def citations(lake: Lake):
    return tagged(lake).select("conv_id", "turn", F.array_join(ms.cited_numbers(F.col("answer"), F.lit(3)).cast("array<string>"), ",").alias("cited"))


@query(
    "M10_refusals",
    "SELECT conv_id, turn, turn % 2 = 1 AS refusal FROM conversations",
)
def refusals(lake: Lake):
    reply = F.when(F.col("turn") % 2 == 1, F.concat("text", F.lit(" The excerpts DON'T contain this."))).otherwise(F.col("text"))
    return lake.table("conversations").select("conv_id", "turn", ms.is_refusal(reply).alias("refusal"))


@query(
    "M11_citation_rows",
    """
    SELECT p.qid, p.position AS excerpt, p.position = 1 AND length(p.qid) % 2 = 0 AS inferred, least(length(p.text), 600) AS chars
    FROM ctx_passages p WHERE (length(p.qid) % 2 = 1 AND position = 2) OR (length(p.qid) % 2 = 0 AND position = 1)""",
    CONTEXT,
)
def citation_rows(lake: Lake):
    """Questions with an odd key length cite the second excerpt (twice), the others nothing."""
    answers = lake.questions().select(
        "qid", F.when(F.length("qid") % 2 == 1, F.lit("So it is [E2][E2].")).otherwise(F.lit("So it is.")).alias("answer"),
        F.lit(False).alias("interrupted"),
    )
    odd_single = ms.citation_rows(answers, found_passages(lake))
    # an out-of-range tag counts as no tag, so a single passage is attached as inferred
    return odd_single.where(~((F.length("qid") % 2 == 1) & F.col("inferred"))).select("qid", "excerpt", "inferred", F.length("text").alias("chars"))


@query(
    "M12_answer_records",
    """
    SELECT q.qid, coalesce(bool_and(d.abstain), true) AS abstained, count(d.chunk_id) AS retrieved_count,
           CASE WHEN coalesce(bool_and(d.abstain), true) THEN 'not found' WHEN length(q.qid) % 2 = 0 THEN 'empty' ELSE 'given' END AS kind
    FROM questions q LEFT JOIN decided d ON d.qid = q.qid GROUP BY q.qid""",
    CONTEXT,
)
def answer_records(lake: Lake):
    per_question = decided_hits(lake).groupBy("qid").agg(F.bool_and("abstain").alias("abstain"), F.count("*").alias("retrieved"))
    outcomes = lake.questions().join(per_question, "qid", "left").select(
        "qid", F.col("question").alias("standalone"), F.coalesce("abstain", F.lit(True)).alias("abstain"),
        F.coalesce("retrieved", F.lit(0)).alias("retrieved"), F.lit(1).alias("model_calls"),
    )
    answers = lake.questions().select("qid", F.when(F.length("qid") % 2 == 1, F.lit("It is so [E1].")).otherwise(F.lit("")).alias("answer"), F.lit(False).alias("interrupted"))
    stored = ms.answer_records(outcomes, answers, "basic")
    kind = F.when(F.col("answer") == ms.NOT_FOUND_ANSWER, "not found").when(F.col("answer") == ms.EMPTY_ANSWER, "empty").otherwise("given")
    return stored.select("qid", F.col("retrieval.abstained").alias("abstained"), F.col("retrieval.retrieved_count").alias("retrieved_count"), kind.alias("kind"))


# ---------------------------------------------------------------- judged answers

JUDGED = {
    "judged_docs": """
        SELECT CAST(doc_id AS VARCHAR) AS qid, doc_id, lang, quality = 1 AS answerable, n_chars % 5 = 0 AS judge_failed,
               (n_chars % 3) / 2.0 AS faithfulness, CAST(n_chars % 2 AS DOUBLE) AS correctness, toxic = 1 AS refused
        FROM labels JOIN documents USING (doc_id)""",
}


def judged(lake: Lake):
    """Judge responses built from the labels; a fifth gives a word instead of a number."""
    rows = lake.table("labels").join(lake.documents().select("doc_id", "lang", "n_chars"), "doc_id").withColumn("qid", F.col("doc_id").cast("string"))
    faith = F.when(F.col("n_chars") % 5 == 0, F.lit('"high"')).otherwise(((F.col("n_chars") % 3) / 2.0).cast("string"))
    text = F.concat(
        F.lit('Verdict: {"faithfulness": '), faith, F.lit(', "correctness": '), (F.col("n_chars") % 2).cast("string"),
        F.lit(', "refused": '), (F.col("toxic") == 1).cast("string"), F.lit("}"),
    )
    responses = ms.ingest_responses(rows.select("qid", text.alias("text")))
    return ms.judged_answers(responses).join(
        rows.select("qid", "doc_id", "lang", (F.col("quality") == 1).alias("answerable"), F.lit(False).alias("errored")), "qid"
    )


@query(
    "M14_judged_answers",
    """SELECT qid, CASE WHEN NOT judge_failed THEN faithfulness END AS faithfulness, CASE WHEN NOT judge_failed THEN correctness END AS correctness,
       CASE WHEN NOT judge_failed THEN refused END AS refused, judge_failed FROM judged_docs""",
    JUDGED,
)
def judged_answers(lake: Lake):
    return judged(lake).select("qid", "faithfulness", "correctness", "refused", "judge_failed")


@query(
    "M15_judged_summary",
    """
    SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT judge_failed) AS judged, round(avg(faithfulness) FILTER (WHERE NOT judge_failed), 6) AS faithfulness,
           round(coalesce(avg(correctness) FILTER (WHERE NOT judge_failed AND answerable), 0), 6) AS correctness_answerable,
           round(avg(CAST(refused AS INT)) FILTER (WHERE NOT judge_failed AND answerable), 6) AS refused_on_answerable,
           round(avg(1 - CAST(refused AS INT)) FILTER (WHERE NOT judge_failed AND NOT answerable), 6) AS hallucinated_on_unanswerable
    FROM judged_docs GROUP BY lang""",
    JUDGED,
)
def judged_summary(lake: Lake):
    out = ms.judged_summary(judged(lake), ["lang"])
    shares = ["faithfulness", "correctness_answerable", "refused_on_answerable", "hallucinated_on_unanswerable"]
    return out.select("lang", "n", "judged", *[r6(c).alias(c) for c in shares])


@query(
    "M16_source_lines",
    """
    SELECT chunk_id, CASE WHEN chunk_index % 2 = 0 THEN '[E' || (chunk_index + 1) || '] ' ELSE '' END || 'Document ' || doc_id ||
      CASE WHEN chunk_index > 0 THEN ', page ' || chunk_index ELSE '' END || CASE WHEN chunk_index % 2 = 1 THEN ' — closest related source' ELSE '' END AS line,
      CASE WHEN length(text) > 180 THEN substr(text, 1, 180) || '…' ELSE text END AS snippet FROM chunks""",
)
def source_lines(lake: Lake):
    rows = lake.chunks().withColumns(
        {
            "excerpt": F.when(F.col("chunk_index") % 2 == 0, F.col("chunk_index") + 1), "page": F.col("chunk_index"),
            "inferred": F.col("chunk_index") % 2 == 1,
        }
    )
    return rows.select("chunk_id", ms.source_line().alias("line"), ms.display_snippet(F.col("text")).alias("snippet"))


COMPARED = {
    **JUDGED,
    "judged_pairs": """
        SELECT m.metric AS key, m.a, m.b, row_number() OVER (PARTITION BY m.metric ORDER BY doc_id) AS pos FROM judged_docs,
        LATERAL (VALUES ('faithfulness', faithfulness, least(faithfulness + 0.5, 1.0), true), ('correctness', correctness, 1.0, answerable),
                        ('hallucination', CAST(NOT refused AS INT), 0.0, NOT answerable)) m(metric, a, b, counts)
        WHERE NOT judge_failed AND m.counts""",
    **bootstrap_parts("judged_pairs", "jb", 11),
}


@query("M17_judged_comparison", paired_sql("key AS metric", "jb_draws", "judged_pairs"), COMPARED)
def judged_comparison(lake: Lake):
    """Two judged systems on the same questions: paired intervals for faithfulness, correctness and hallucination."""
    first = judged(lake).where(~F.col("judge_failed"))
    second = first.select("qid", F.least(F.col("faithfulness") + 0.5, F.lit(1.0)).alias("f2"), F.lit(1.0).alias("c2"), F.lit(True).alias("r2"))
    both = first.join(second, "qid")
    metric = F.explode(
        F.filter(
            F.array(
                F.struct(F.lit("faithfulness").alias("metric"), F.col("faithfulness").alias("a"), F.col("f2").alias("b")),
                F.when(F.col("answerable"), F.struct(F.lit("correctness").alias("metric"), F.col("correctness").alias("a"), F.col("c2").alias("b"))),
                F.when(~F.col("answerable"), F.struct(F.lit("hallucination").alias("metric"), (~F.col("refused")).cast("double").alias("a"), (~F.col("r2")).cast("double").alias("b"))),
            ),
            lambda m: m.isNotNull(),
        )
    )
    pairs = both.select("doc_id", metric.alias("m")).select("doc_id", "m.metric", "m.a", "m.b")
    out = ev.paired_bootstrap(pairs, ["metric"], "a", "b", "doc_id")
    return out.select("metric", *[r6(c).alias(c) for c in ("mean_a", "mean_b", "diff", "diff_lo", "diff_hi", "rel", "rel_lo", "rel_hi")])

