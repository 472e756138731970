"""The data around model calls: prompts out, responses in.

A model is either a table of recorded responses ``(qid, stage, text)`` or a callable applied to batches; nothing here
talks to a provider. Bad or missing responses fall back the way the pipeline defines and are counted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from passagelake.functions.text import collapse_blanks, head, strip_blanks

# Limits, fixed sentences and patterns.
HISTORY_TURNS = 3
ANSWER_CHARS = 300
SNIPPET_CHARS = 600
NOT_FOUND_ANSWER = (
    "I couldn't find anything in this course's material that answers that question. "
    "Try rephrasing, or ask about a topic covered in the lessons."
)
EMPTY_ANSWER = "I wasn't able to generate an answer for that question. Please try again shortly."
INTERRUPTED_NOTE = "\n\n[The response was interrupted before it finished.]"
CITATION_TAG = "(?i)\\[\\s*E\\s*[0-9][^\\]]*\\]|\\(\\s*excerpts?\\s*[0-9][^)]*\\)"
REFUSAL = (
    "(?i)not (?:covered|mentioned|enough)"
    "|(?:does|do)(?: not|n'?t) (?:cover|contain|mention|include|have enough)"
    "|couldn'?t find|no information|(?:cannot|can'?t) (?:answer|find)"
)


# Fixed value: paraphrases used of a response.
MOST_PARAPHRASES = 3


# ---------------------------------------------------------------- conversation


def history_window(turns: DataFrame, keys: list[str], at: str, turns_kept: int = HISTORY_TURNS) -> DataFrame:
    """The last turns per key, oldest first, as ``history array<struct<question,answer>>``."""
    newest = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    recent = turns.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= turns_kept)
    ordered = F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), "question", "answer")))
    return recent.groupBy(*keys).agg(
        F.transform(ordered, lambda t: F.struct(t["question"].alias("question"), t["answer"].alias("answer"))).alias("history")
    )


def history_text(history: Column, turns: int = HISTORY_TURNS, answer_chars: int = ANSWER_CHARS) -> Column:
    last = F.slice(history, F.greatest(F.size(history) - turns + 1, F.lit(1)), F.lit(turns))
    return F.array_join(
        F.transform(
            last,
            lambda t: F.concat(
                F.lit("Student: "), t["question"], F.lit("\nTutor: "), head(F.coalesce(t["answer"], F.lit("")), answer_chars)
            ),
        ),
        "\n\n",
    )


def single_line(text: Column, most: int = 400) -> Column:
    """Trimmed, unquoted and collapsed; empty when nothing is left or the line is too long."""
    unquoted = F.regexp_replace(strip_blanks(F.coalesce(text, F.lit(""))), "^[\"'`]+|[\"'`]+$", "")
    line = collapse_blanks(unquoted)
    return F.when(F.length(line) <= most, line).otherwise(F.lit(""))


def stage_responses(responses: DataFrame, stage: str) -> DataFrame:
    return responses.where(F.col("stage") == stage).select("qid", F.col("text").alias(f"{stage}_response"))


def standalone_questions(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """Rewrite questions that have a history; fall back to the original and count it as a failure."""
    asked = F.size(F.coalesce("history", F.array().cast("array<struct<question:string,answer:string>>"))) > 0
    rewritten = single_line(F.col("rewrite_response"))
    return (
        questions.join(stage_responses(responses, "rewrite"), "qid", "left")
        .withColumn("standalone", F.when(asked & (rewritten != ""), rewritten).otherwise(F.col("question")))
        .withColumn("model_calls", F.col("model_calls") + asked.cast("int"))
        .withColumn("model_failures", F.col("model_failures") + (asked & (rewritten == "")).cast("int"))
        .drop("rewrite_response")
    )


def paraphrase_list(parsed: Column, original: Column, most: int = MOST_PARAPHRASES) -> Column:
    """Clean paraphrases from ``[...]`` or ``{"queries": [...]}``; anything else gives an empty list."""
    listed = F.when(parsed.startswith("["), F.from_json(parsed, "array<string>")).otherwise(
        F.from_json(parsed, "struct<queries:array<string>>")["queries"]
    )
    cleaned = F.filter(F.transform(listed, lambda q: single_line(q)), lambda q: (q != "") & (q != original))
    return F.coalesce(F.slice(F.array_distinct(cleaned), 1, most), F.array().cast("array<string>"))


def with_paraphrases(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """Add ``paraphrases``; the call is counted, and counted as failed when the response holds no list."""
    parsed = loose_json(F.col("paraphrase_response"))
    listed = F.coalesce(parsed.startswith("["), F.lit(False)) | F.from_json(parsed, "struct<queries:array<string>>")["queries"].isNotNull()
    return (
        questions.join(stage_responses(responses, "paraphrase"), "qid", "left")
        .withColumn("paraphrases", paraphrase_list(parsed, F.col("standalone")))
        .withColumn("model_calls", F.col("model_calls") + 1)
        .withColumn("model_failures", F.col("model_failures") + (~F.coalesce(listed, F.lit(False))).cast("int"))
        .drop("paraphrase_response")
    )


def question_variants(questions: DataFrame, weight: float) -> DataFrame:
    """``course, qid, variant, text, weight`` from ``standalone`` and ``paraphrases``: variant 0 is the question itself."""
    base = questions.withColumn("_texts", F.concat(F.array("standalone"), "paraphrases"))
    return base.select("course", "qid", F.posexplode("_texts").alias("variant", "text")).withColumn(
        "weight", F.when(F.col("variant") == 0, F.lit(1.0)).otherwise(F.lit(float(weight)))
    )


def hypothetical_passage(text: Column, least: int = 20, most: int = 800) -> Column:
    passage = strip_blanks(F.coalesce(text, F.lit("")))
    return F.when(F.length(passage) < least, F.lit("")).otherwise(head(passage, most))


def context_note(text: Column, most: int = 300) -> Column:
    return head(collapse_blanks(strip_blanks(F.coalesce(text, F.lit("")))), most)


def note_prompt(title: Column, document: Column, chunk: Column, document_chars: int = 12_000) -> Column:
    return F.concat(
        F.lit('<document title="'), title, F.lit('">\n'), head(document, document_chars),
        F.lit("\n</document>\n\n<chunk>\n"), chunk, F.lit("\n</chunk>"),
    )


# ---------------------------------------------------------------- response parsing


def _refuse(constant: str):
    raise ValueError(constant)


_decoder = json.JSONDecoder(parse_constant=_refuse)


def recover_json(text: str | None) -> str | None:
    """The whole text, or else the first object or array in it, as canonical JSON."""
    if not text or not text.strip():
        return None
    body = re.sub(r"\s*```\s*$", "", re.sub(r"^\s*```(?:json)?\s*", "", text.strip(), flags=re.IGNORECASE))
    starts = sorted(at for at in (body.find("{"), body.find("[")) if at >= 0)
    for at in [None, *starts]:
        try:
            value = json.loads(body, parse_constant=_refuse) if at is None else _decoder.raw_decode(body, at)[0]
            return json.dumps(value, ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def loose_json(texts: pd.Series) -> pd.Series:
    return texts.map(recover_json)


def ingest_responses(responses: DataFrame) -> DataFrame:
    """Add ``json`` (null when nothing parseable was found) and ``accepted``."""
    return responses.withColumn("json", loose_json("text")).withColumn("accepted", F.col("json").isNotNull())


# ---------------------------------------------------------------- prompts and answers


def rerank_prompt(pool: DataFrame, questions: DataFrame, passage_chars: int = 700) -> DataFrame:
    """``pool(qid, rank, text, context_header)`` to one listwise prompt per question."""
    header = F.when(F.coalesce("context_header", F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit(" ("), "context_header", F.lit(")"))
    )
    cut = F.when(F.length("text") > passage_chars, F.concat(head(F.col("text"), passage_chars), F.lit("..."))).otherwise(
        F.col("text")
    )
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]"), header, F.lit("\n"), cut)
    listed = pool.groupBy("qid").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n\n"
        ).alias("passages")
    )
    return listed.join(questions.select("qid", "standalone"), "qid").select(
        "qid",
        F.concat(F.lit("Student question: "), "standalone", F.lit("\n\nPassages:\n\n"), "passages").alias("prompt"),
    )


def source_description() -> Column:
    parts = F.split(F.coalesce("context_header", F.lit("")), " > ")
    section = F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " > ")
    section_part = F.when(section == "", F.lit("")).otherwise(F.concat(F.lit(', section "'), section, F.lit('"')))
    page_part = F.when(F.coalesce("page", F.lit(0)) == 0, F.lit("")).otherwise(
        F.concat(F.lit(", page "), F.col("page").cast("string"))
    )
    from_file = (F.col("source") == "attachment") & (F.coalesce("source_label", F.lit("")) != "")
    return F.when(
        from_file,
        F.concat(
            F.lit('file "'), "source_label", F.lit('" attached to lesson "'), "lesson_title", F.lit('"'),
            section_part, page_part,
        ),
    ).otherwise(F.concat(F.lit('lesson "'), "lesson_title", F.lit('"'), section_part))


def grounded_prompts(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """``passages(qid, position, text, ...)`` and ``questions(qid, question, history)`` to one prompt per question."""
    block = F.concat(
        F.lit("Excerpt E"), F.col("position").cast("string"), F.lit(" (from "), source_description(), F.lit("):\n"), "text"
    )
    excerpts = passages.groupBy("qid").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("position", block.alias("block")))), lambda s: s["block"]),
            "\n\n",
        ).alias("excerpts")
    )
    talk = F.when(
        F.size("history") > 0,
        F.concat(F.lit("Earlier conversation (for context only):\n"), history_text(F.col("history")), F.lit("\n\n")),
    ).otherwise(F.lit(""))
    return excerpts.join(questions, "qid").select(
        "qid",
        F.concat(
            F.lit("Course excerpts:\n"), "excerpts", F.lit("\n\n"), talk, F.lit("Student question: "), "question"
        ).alias("prompt"),
    )


def cited_numbers(answer: Column, most: Column) -> Column:
    """Excerpt numbers tagged in an answer: in range, first-seen order, distinct."""
    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION_TAG), F.lit(0))
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit("[0-9]+"), F.lit(0))))
    parsed = F.transform(numbers, lambda n: n.try_cast("int"))
    return F.array_distinct(F.filter(parsed, lambda n: n.isNotNull() & (n >= 1) & (n <= most)))


def is_refusal(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(REFUSAL)


def citation_rows(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """``answers(qid, answer, interrupted)`` × ``passages(qid, position, ...)`` to citation rows.

    Without tags the first passage is attached and marked inferred, unless the answer was interrupted or a refusal.
    """
    counts = passages.groupBy("qid").agg(F.count("*").cast("int").alias("_n"))
    tagged = answers.join(counts, "qid").withColumn("_tags", cited_numbers(F.col("answer"), F.col("_n")))
    untagged = (F.size("_tags") == 0) & ~F.col("interrupted") & ~is_refusal(F.col("answer"))
    chosen = tagged.withColumn("inferred", F.size("_tags") == 0).select(
        "qid",
        "inferred",
        F.posexplode(F.when(untagged, F.array(F.lit(1))).otherwise(F.col("_tags"))).alias("ordinal", "excerpt"),
    )
    return chosen.join(passages.withColumnRenamed("position", "excerpt"), ["qid", "excerpt"]).withColumn(
        "text", head(F.col("text"), SNIPPET_CHARS)
    )


def answer_records(outcomes: DataFrame, answers: DataFrame, pipeline: str) -> DataFrame:
    """One stored answer per question; abstained questions get the fixed sentence."""
    joined = outcomes.join(answers, "qid", "left")
    generated = F.coalesce(F.nullif("answer", F.lit("")), F.lit(EMPTY_ANSWER))
    noted = F.when(F.coalesce("interrupted", F.lit(False)), F.concat(generated, F.lit(INTERRUPTED_NOTE))).otherwise(generated)
    return joined.select(
        "qid",
        F.when(F.col("abstain"), F.lit(NOT_FOUND_ANSWER)).otherwise(noted).alias("answer"),
        F.struct(
            F.lit(pipeline).alias("pipeline"), F.col("standalone").alias("standalone_question"),
            F.col("retrieved").alias("retrieved_count"), F.col("abstain").alias("abstained"),
            F.col("model_calls").alias("model_calls"),
        ).alias("retrieval"),
    )


def source_line() -> Column:
    """How a stored citation is shown."""
    tag = F.when(F.coalesce("excerpt", F.lit(0)) == 0, F.lit("")).otherwise(
        F.concat(F.lit("[E"), F.col("excerpt").cast("string"), F.lit("] "))
    )
    from_file = (F.col("source") == "attachment") & (F.coalesce("source_label", F.lit("")) != "")
    name = F.when(
        from_file, F.concat("source_label", F.lit(' (attached to "'), "lesson_title", F.lit('")'))
    ).otherwise(F.col("lesson_title"))
    page = F.when(F.coalesce("page", F.lit(0)) == 0, F.lit("")).otherwise(
        F.concat(F.lit(", page "), F.col("page").cast("string"))
    )
    return F.concat(tag, name, page, F.when(F.col("inferred"), F.lit(" — closest related source")).otherwise(F.lit("")))


def display_snippet(text: Column, most: int = 180) -> Column:
    return F.when(F.length(text) > most, F.concat(head(text, most), F.lit("…"))).otherwise(text)


# ---------------------------------------------------------------- embeddings

Embedder = Callable[[list[str], str | None], np.ndarray]


def content_key(model: str, mode: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(model), F.lit(mode), text), 256)


def embed_missing(
    texts: DataFrame, store: DataFrame | None, embedder: Embedder, model: str, mode: str = "", batch: int = 256
) -> DataFrame:
    """Vectors for distinct texts: stored ones are reused, the rest is computed in batches.

    ``texts(text)`` and ``store(content_key, embedding)`` to ``content_key, embedding``.
    """
    keyed = texts.select(content_key(model, mode, F.col("text")).alias("content_key"), "text")
    distinct = keyed.groupBy("content_key").agg(F.first("text").alias("text"))
    missing = distinct if store is None else distinct.join(store, "content_key", "left_anti")

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = np.asarray(embedder(part["text"].tolist(), mode or None), dtype=np.float32)
                yield pd.DataFrame({"content_key": part["content_key"], "embedding": list(vectors)})

    fresh = missing.mapInPandas(compute, "content_key string, embedding array<float>")
    if store is None:
        return fresh
    return fresh.unionByName(store.join(distinct.select("content_key"), "content_key", "left_semi"))


def attach_embeddings(rows: DataFrame, vectors: DataFrame, model: str, mode: str, text: str = "text") -> DataFrame:
    return rows.withColumn("content_key", content_key(model, mode, F.col(text))).join(vectors, "content_key").drop("content_key")


# ---------------------------------------------------------------- judged answers


def judged_answers(responses: DataFrame) -> DataFrame:
    """``responses(qid, json)`` to typed judge scores; a non-numeric faithfulness means the judge failed."""
    got = F.from_json("json", "struct<faithfulness:string,correctness:string,refused:string>")
    numeric = F.col("json").rlike('"faithfulness": ?-?[0-9]')
    correct = F.coalesce(got["correctness"].try_cast("double"), F.lit(0.0))
    truthy = ~F.coalesce(got["refused"], F.lit("")).isin("", "false", "0", "null")
    return responses.select(
        "qid",
        F.when(numeric, got["faithfulness"].try_cast("double")).alias("faithfulness"),
        F.when(numeric, F.when(F.isnan(correct), F.lit(0.0)).otherwise(correct)).alias("correctness"),
        F.when(numeric, truthy).alias("refused"),
        (~F.coalesce(numeric, F.lit(False))).alias("judge_failed"),
    )


def judged_summary(judged: DataFrame, keys: list[str]) -> DataFrame:
    ok = ~F.col("judge_failed") & F.coalesce(~F.col("errored"), F.lit(True))
    rate = lambda cond, hit: F.avg(F.when(ok & cond, hit.cast("double")))
    answerable = F.col("answerable")
    return judged.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("judged"),
        F.coalesce(rate(F.lit(True), F.col("faithfulness")), F.lit(0.0)).alias("faithfulness"),
        F.coalesce(rate(answerable, F.col("correctness")), F.lit(0.0)).alias("correctness_answerable"),
        rate(answerable, F.col("refused")).alias("refused_on_answerable"),
        rate(~answerable, ~F.col("refused")).alias("hallucinated_on_unanswerable"),
    )
