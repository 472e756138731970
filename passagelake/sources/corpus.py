"""Reading lessons, attachments and labelled questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.functions.ranks import ordinals
from passagelake.functions.text import strip_blanks
from passagelake.sources.stores import materialise

# Attachment types whose text can be extracted.
EXTRACTABLE = ("application/pdf", "text/plain", "text/markdown")
TEXT_TYPES = ("text/plain", "text/markdown")

TURN = T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])
GOLD = T.StructType([T.StructField("lesson", T.StringType()), T.StructField("span", T.StringType())])
QUESTION_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "category", "question")]
    + [
        T.StructField("answerable", T.BooleanType()),
        T.StructField("history", T.ArrayType(TURN)),
        T.StructField("gold", T.ArrayType(GOLD)),
    ]
)


def parse_lessons(files: DataFrame, bucket: Column) -> DataFrame:
    """``files(file, raw)`` to ``slug, title, content, lesson_order``; order is the position of the file name.

    ``bucket`` must be monotone in the file name; it spreads the numbering over tasks.
    """
    text = F.regexp_replace("raw", "\r\n", "\n")
    line_end = F.instr(text, "\n")
    first = F.when(line_end == 0, text).otherwise(F.substring(text, F.lit(1), line_end - 1))
    rest = F.when(line_end == 0, F.lit("")).otherwise(F.substring(text, line_end + 1, F.length(text)))
    parsed = files.where(F.col("file").endswith(".md")).select(
        "file",
        F.regexp_replace("file", "\\.md$", "").alias("slug"),
        strip_blanks(F.regexp_replace(first, "^#\\s*", "")).alias("title"),
        strip_blanks(rest).alias("content"),
    )
    named = files.where(F.col("file").endswith(".md")).select("file", bucket.alias("_bucket_of"), F.lit(0).alias("_all"))
    placed = ordinals(named, ["_all"], [F.col("file")], F.col("_bucket_of"), "_n").select("file", (F.col("_n") - 1).alias("lesson_order"))
    return parsed.join(placed, "file").drop("file")


def read_lessons(spark: SparkSession, folder: str) -> DataFrame:
    """Lessons of a folder of Markdown files, numbered by file name.

    Names alone are dealt by range, whatever they begin with, and numbered range by range; the texts then meet their numbers.
    """
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))
    names = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_name").alias("file"))
    ranges = materialise(names.repartitionByRange("file").select("file", F.spark_partition_id().alias("range")), "lesson-names")
    return parse_lessons(files.join(ranges, "file"), F.col("range"))


def is_extractable(mimetype: Column) -> Column:
    return mimetype.isin(*EXTRACTABLE)


def extracted_pages(mimetype: Column, content: Column, pages: Column) -> Column:
    """Pages of an attachment: plain text and markdown are one page; paged types bring their pages; others have none."""
    none = F.array().cast("array<string>")
    return (
        F.when(mimetype.isin(*TEXT_TYPES), F.array(F.decode(content, "UTF-8")))
        .when(is_extractable(mimetype), F.coalesce(pages, none))
        .otherwise(none)
    )


def read_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Text files of a folder as attachment rows with one page each."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.endswith(".md"), F.lit("text/markdown")).when(name.endswith(".txt"), F.lit("text/plain"))
    typed = files.select(name.alias("original_name"), F.coalesce(kind, F.lit("application/octet-stream")).alias("mimetype"), "content")
    return typed.withColumn(
        "pages", extracted_pages(F.col("mimetype"), F.col("content"), F.lit(None).cast("array<string>"))
    ).drop("content")


def pages_text(pages: Column) -> Column:
    return F.array_join(pages, "\n\n")


def with_question_defaults(questions: DataFrame) -> DataFrame:
    return questions.select(
        "id", "category", "question",
        F.coalesce("answerable", F.lit(True)).alias("answerable"),
        F.coalesce("history", F.array().cast(QUESTION_SCHEMA["history"].dataType)).alias("history"),
        F.coalesce("gold", F.array().cast(QUESTION_SCHEMA["gold"].dataType)).alias("gold"),
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions from JSON lines; a malformed line fails the read with the offending record.

    Rows without an id stay, so that the dataset check can report them; blank lines are skipped.
    """
    return with_question_defaults(spark.read.schema(QUESTION_SCHEMA).option("mode", "FAILFAST").json(path))


def parse_questions(lines: DataFrame) -> DataFrame:
    """The same from a column ``value`` of JSON lines; blank lines are skipped."""
    text = lines.where(F.trim("value") != "")
    parsed = text.select(F.from_json("value", QUESTION_SCHEMA, {"mode": "FAILFAST"}).alias("q")).select("q.*")
    return with_question_defaults(parsed)
