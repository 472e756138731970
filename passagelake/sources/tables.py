"""Domain tables derived from the driver tables (see FIXTURES.md): a learning platform and a text corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.operators.chunking import paragraph_chunks
from passagelake.sources.stores import materialise

CHUNKS_PER_DOCUMENT = 1_000_000


#: Session setting: deal the documents to this many tasks after reading. Only for tables that lie in one row group, which
#: Spark cannot read in parallel; unset, as it should be on a cluster, documents are used in the splits they come in.
DEAL = "passagelake.documents.tasks"


class Lake:
    """Lazy access to the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._stored: dict[str, DataFrame] = {}
        self._courses: list[str] | None = None

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that several steps of one query read: written on first use, read by column afterwards."""
        if name not in self._stored:
            self._stored[name] = materialise(build(), name)
        return self._stored[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- learning platform

    def users(self) -> DataFrame:
        def person(df: DataFrame, mark: str, key: str, name: str, role) -> DataFrame:
            return df.select(
                F.concat(F.lit(mark), F.col(key).cast("string")).alias("user_id"),
                F.col(name).alias("name"),
                F.concat(F.lower(F.replace(F.col(name), F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("email"),
                role.alias("role"),
                F.col(key).alias("created_at"),
            )

        student = F.when(F.col("c_acctbal") < -900, F.lit("admin")).otherwise(F.lit("student"))
        return person(self.table("customer"), "c", "c_custkey", "c_name", student).unionByName(
            person(self.table("supplier"), "s", "s_suppkey", "s_name", F.lit("tutor"))
        )

    def courses(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("course_id"),
            F.col("p_name").alias("title"),
            F.concat_ws(" ", "p_type", "p_brand").alias("description"),
            F.col("p_brand").alias("category"),
            F.concat(F.lit("s"), (F.col("p_partkey") % 10).cast("string")).alias("tutor_id"),
            (F.col("p_size") > 12).alias("published"),
            F.col("p_partkey").alias("created_at"),
        )

    def purchases(self) -> DataFrame:
        return (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("student_id"),
                F.col("l_partkey").alias("course_id"),
                F.col("l_linenumber").alias("line"),
                F.col("l_linestatus").alias("line_status"),
                F.col("l_quantity").cast("int").alias("quantity"),
                F.col("o_orderstatus").alias("order_status"),
                F.col("o_orderdate").alias("requested_at"),
                F.col("o_orderkey").alias("request_id"),
                F.col("l_shipdate").alias("shipped_at"),
            )
        )

    def enrolment_requests(self) -> DataFrame:
        return self.purchases().select("student_id", "course_id", "requested_at", "request_id")

    def enrolments(self) -> DataFrame:
        return self.purchases().where(F.col("order_status") == "F").select("student_id", "course_id").distinct()

    def lessons(self) -> DataFrame:
        return (
            self.table("lineitem")
            .select(F.col("l_partkey").alias("course_id"), F.col("l_linenumber").alias("lesson_order"))
            .distinct()
            .select(
                "course_id",
                (F.col("course_id") * 10 + F.col("lesson_order")).alias("lesson_id"),
                F.concat(F.lit("Lesson "), F.col("lesson_order").cast("string")).alias("title"),
                F.concat(F.lit("Notes of course "), F.col("course_id").cast("string")).alias("content"),
                "lesson_order",
            )
        )

    def quizzes(self) -> DataFrame:
        def question(i: int):
            return F.struct(
                F.lit(f"Question {i}").alias("text"),
                F.array(*[F.lit(o) for o in "ABCD"]).alias("options"),
                ((F.col("p_size") + i) % 4).cast("int").alias("correct"),
            )

        return self.table("part").select(
            F.col("p_partkey").alias("quiz_id"),
            F.col("p_partkey").alias("course_id"),
            F.concat(F.col("p_name"), F.lit(" quiz")).alias("title"),
            F.array(*[question(i) for i in range(4)]).alias("questions"),
        )

    def attempts(self) -> DataFrame:
        answers = F.array(*[((F.col("quantity") + i * F.col("line")) % 4).cast("int") for i in range(4)])
        return (
            self.purchases()
            .select(
                F.col("course_id").alias("quiz_id"), "student_id", F.col("shipped_at").alias("created_at"), "line", "quantity",
                F.when(F.col("line") == 7, F.slice(answers, 1, 3)).otherwise(answers).alias("answers"),
            )
            .distinct()
        )

    def posts(self) -> DataFrame:
        lesson = F.get_json_object("props", "$.k").cast("bigint")
        behind = (F.col("event_id") % 5) + 1
        return self.table("events").select(
            F.col("event_id").alias("post_id"),
            lesson.alias("course_id"),
            lesson.alias("lesson_id"),
            F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("author_id"),
            F.col("event_type").alias("content"),
            F.when(F.col("event_type") != "signup", F.col("event_id") - behind).alias("parent_id"),
            F.col("ts").alias("created_at"),
        )

    # programme-level courses, in which complete courses exist

    def track_purchases(self) -> DataFrame:
        kinds = self.table("part").select(F.col("p_partkey").alias("course_id"), F.col("p_type").alias("track"))
        return self.purchases().join(kinds, "course_id").select("student_id", "track", "line", "line_status")

    def track_lessons(self) -> DataFrame:
        return self.track_purchases().select(F.col("track").alias("course_id"), F.col("line").alias("lesson_id")).distinct()

    def track_enrolments(self) -> DataFrame:
        return self.track_purchases().select("student_id", F.col("track").alias("course_id")).distinct()

    def track_completions(self) -> DataFrame:
        done = self.track_purchases().where(F.col("line_status") == "F")
        return done.select("student_id", F.col("track").alias("course_id"), F.col("line").alias("lesson_id"))

    # ---- conversations

    def chat_turns(self) -> DataFrame:
        """Each user turn with the assistant turn that follows it."""
        talk = self.table("conversations")
        said = talk.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
        replied = talk.where(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
        )
        return said.join(replied, ["conv_id", "turn"])

    def open_questions(self) -> DataFrame:
        talk = self.table("conversations")
        said = talk.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
        replied = talk.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"))
        return said.join(replied, ["conv_id", "turn"], "left_anti")

    # ---- corpus

    def documents(self) -> DataFrame:
        docs, tasks = self.table("documents"), self.spark.conf.get(DEAL, None)
        return docs.repartition(int(tasks), "doc_id") if tasks else docs

    def stored_chunks(self) -> DataFrame:
        return self.once("chunks", self.chunks)

    def chunks(self) -> DataFrame:
        """Paragraph chunks of every document as a chunk table; the course is the language."""
        docs = self.documents().select("doc_id", F.col("lang").alias("course"), "text")
        doc = F.col("doc_id").cast("string")
        # ids of two documents never meet: a document with more chunks than its range of ids fails
        fits = F.assert_true(F.col("chunk_index") < CHUNKS_PER_DOCUMENT, F.lit("too many chunks in one document")).isNull()
        return paragraph_chunks(docs).where(fits).select(
            "course",
            doc.alias("lesson"),
            (F.col("doc_id") * CHUNKS_PER_DOCUMENT + F.col("chunk_index")).alias("chunk_id"),
            "chunk_index",
            "text",
            F.concat(F.lit("Document "), doc).alias("lesson_title"),
            F.lit("content").alias("source"),
            F.lit("").alias("source_label"),
            F.lit(None).cast("string").alias("attachment_id"),
            F.lit("").alias("context_header"),
            F.lit("").alias("context_note"),
            F.lit(None).cast("int").alias("page"),
            F.lit(0).alias("overlap_len"),
            F.lit("basic.h0.t0.c0|hash-64").alias("index_version"),
            F.concat(doc, F.lit(":content")).alias("group_key"),
        )

    def questions(self) -> DataFrame:
        """Every benchmark text asked in every course: ``course, qid, item_id, question``."""
        if self._courses is None:
            rows = self.table("documents").select("lang").distinct().where("lang is not null").collect()  # one per language, a handful
            self._courses = sorted(r["lang"] for r in rows)
        courses = F.array(*[F.lit(c) for c in self._courses]).cast("array<string>")
        items = self.table("benchmark").select(F.explode(courses).alias("course"), "item_id", F.col("text").alias("question"))
        return items.withColumn(
            "qid", F.concat_ws("@", F.col("item_id").cast("string"), "course")
        )

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("label").cast("string").alias("course"), F.col("vec_id").alias("chunk_id"), "embedding"
        )
