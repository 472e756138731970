"""The versioned chunk table: building, replacing, removing, checking and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelake.config import index_version
from passagelake.operators.chunking import embed_text, lesson_pieces
from passagelake.operators.model_stages import Embedder, attach_embeddings, context_note, embed_missing, note_prompt

DOCUMENT = ["lesson", "source", "attachment_id"]


def document_key(lesson: str = "lesson", attachment: str = "attachment_id") -> Column:
    return F.concat(F.col(lesson), F.lit(":"), F.coalesce(F.col(attachment), F.lit("content")))


def index_chunks(documents: DataFrame, config: dict, model: str, batch_id: str, notes: DataFrame | None = None) -> DataFrame:
    """Chunk rows (without vectors) for ``documents(course, lesson, title, attachment_id, source_label, pages)``."""
    keyed = documents.withColumn("doc_key", document_key())
    pieces = lesson_pieces(keyed.select("doc_key", "title", "source_label", "pages"), "doc_key", config["indexing"]["chunker"])
    meta = keyed.select("doc_key", "course", "lesson", "attachment_id", "source_label", "title")
    noted = pieces.withColumn("context_note", F.lit(""))
    if notes is not None:
        noted = pieces.join(
            notes.select("doc_key", "chunk_index", context_note(F.col("text")).alias("context_note")),
            ["doc_key", "chunk_index"], "left",
        ).withColumn("context_note", F.coalesce("context_note", F.lit("")))
    return noted.join(meta, "doc_key").select(
        "course", "lesson", F.concat_ws("#", "doc_key", F.col("chunk_index").cast("string")).alias("chunk_key"), "chunk_index",
        "text", F.when(F.col("attachment_id").isNull(), F.lit("content")).otherwise(F.lit("attachment")).alias("source"),
        F.coalesce("source_label", F.lit("")).alias("source_label"), "attachment_id", "heading_path", "context_header",
        "context_note", "page", "overlap_len", F.lit(index_version(config, model)).alias("index_version"),
        F.lit(batch_id).alias("index_batch"),
    )


def note_requests(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One prompt per chunk that asks for its situating sentence."""
    keyed = documents.select(document_key().alias("doc_key"), "title", F.array_join("pages", "\n\n").alias("document"))
    return chunks.withColumn("doc_key", document_key()).join(keyed, "doc_key").select(
        "doc_key", "chunk_index", note_prompt(F.col("title"), F.col("document"), F.col("text")).alias("prompt")
    )


def chunk_embed_text(config: dict) -> Column:
    return embed_text(
        F.col("context_header"), F.col("context_note"), F.col("text"),
        config["indexing"]["header"], config["indexing"]["llm_context"],
    )


def embed_chunks(chunks: DataFrame, config: dict, embedder: Embedder, model: str, store: DataFrame | None = None) -> DataFrame:
    mode = "document" if config["indexing"]["task_types"] else ""
    texts = chunks.withColumn("_embed", chunk_embed_text(config))
    vectors = embed_missing(texts.select(F.col("_embed").alias("text")), store, embedder, model, mode)
    return attach_embeddings(texts, vectors, model, mode, "_embed").drop("_embed")


def _match(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"_{k}"])
    return condition


def replace_documents(current: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """The table after re-indexing ``touched(lesson, source, attachment_id, embedded)`` documents.

    Rows of a touched document are replaced as a whole; documents whose embedding failed keep their old rows; a document
    without new pieces loses its rows.
    """
    done = touched.where("embedded").select(*[F.col(k).alias(f"_{k}") for k in DOCUMENT]).distinct()
    kept = current.join(done, _match(current, done, DOCUMENT), "left_anti")
    added = fresh.join(done, _match(fresh, done, DOCUMENT), "left_semi")
    return kept.unionByName(added, allowMissingColumns=True)


def remove_documents(current: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Drop rows of removed lessons (``attachment_id`` null) or removed attachments."""
    lessons = tombstones.where(F.col("attachment_id").isNull()).select("lesson")
    attachments = tombstones.where(F.col("attachment_id").isNotNull()).select("attachment_id")
    return current.join(lessons, "lesson", "left_anti").join(attachments, "attachment_id", "left_anti").select(*current.columns)


def reindex_report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per document with its chunk count and ``ok``/``skip``/``FAIL`` status."""
    counts = chunks.groupBy(document_key().alias("doc_key")).agg(F.count("*").alias("chunks"))
    keyed = documents.withColumn("doc_key", document_key())
    empty = F.when(F.col("attachment_id").isNull(), F.lit("FAIL")).otherwise(F.lit("skip"))
    return keyed.join(counts, "doc_key", "left").select(
        "course", "lesson", "attachment_id", F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.when(F.coalesce("chunks", F.lit(0)) > 0, F.lit("ok")).otherwise(empty).alias("status"),
    )


def missing_documents(expected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Expected documents without any chunk; evaluation must not start unless this is empty."""
    have = chunks.select(*[F.col(k).alias(f"_{k}") for k in DOCUMENT]).distinct()
    return expected.join(have, _match(expected, have, DOCUMENT), "left_anti")


def version_report(chunks: DataFrame, expected: str) -> DataFrame:
    """Versions per course; ``legacy`` counts as the basic version when that is expected."""
    canonical = F.col("index_version")
    if expected.startswith("basic.h0.t0.c0|"):
        canonical = F.when(canonical == "legacy", F.lit(expected)).otherwise(canonical)
    # distinct first: map-side combine leaves one row per (course, version)
    versions = chunks.select("course", canonical.alias("version")).distinct()
    return versions.groupBy("course").agg(
        F.count("*").alias("versions"),
        (F.max("version") != F.min("version")).alias("mixed"),
        ((F.count("*") > 1) | (F.min("version") != expected)).alias("mismatch"),
    )


def course_routes(chunks: DataFrame, config: dict) -> DataFrame:
    """``course, pipeline``: a course whose chunks are all legacy is served by the basic preset."""
    legacy = F.bool_and(F.col("index_version") == "legacy") & F.lit(config["indexing"]["chunker"] != "basic")
    return chunks.groupBy("course").agg(F.when(legacy, F.lit("basic")).otherwise(F.lit(config["name"])).alias("pipeline"))


def change_stamps(chunks: DataFrame, lessons: DataFrame) -> DataFrame:
    """``count:newest chunk:newest lesson`` per course in epoch milliseconds; unchanged stamps need no rebuild."""
    counted = chunks.groupBy("course").agg(F.count("*").alias("n"), F.max("updated_at").alias("c_at"))
    newest = lessons.groupBy("course").agg(F.max("updated_at").alias("l_at"))
    millis = lambda c: F.coalesce(F.unix_millis(c), F.lit(0)).cast("string")
    return counted.join(newest, "course", "full_outer").select(
        "course",
        F.concat_ws(":", F.coalesce("n", F.lit(0)).cast("string"), millis(F.col("c_at")), millis(F.col("l_at"))).alias("stamp"),
    )


def indexed_flags(attachments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether an attachment had text and produced at least one chunk."""
    counts = chunks.where(F.col("attachment_id").isNotNull()).groupBy("attachment_id").agg(F.count("*").alias("n"))
    return attachments.join(counts, "attachment_id", "left").withColumn(
        "indexed", F.col("has_text") & (F.coalesce("n", F.lit(0)) > 0)
    ).drop("n")


def scan_chunks(chunks: DataFrame, lessons: DataFrame) -> DataFrame:
    """The read view of the chunk table: no vectors, defaults filled, lesson title and reading group attached."""
    titles = lessons.select("lesson", F.col("title").alias("lesson_title"))
    return chunks.drop("embedding").join(titles, "lesson", "left").select(
        "course", "lesson", "chunk_id", "chunk_index", "text",
        F.coalesce("lesson_title", F.lit("Unknown lesson")).alias("lesson_title"),
        F.coalesce("source", F.lit("content")).alias("source"),
        F.coalesce("source_label", F.lit("")).alias("source_label"),
        "attachment_id",
        F.coalesce("context_header", F.lit("")).alias("context_header"),
        F.coalesce("context_note", F.lit("")).alias("context_note"),
        "page",
        F.coalesce("overlap_len", F.lit(0)).alias("overlap_len"),
        F.coalesce("index_version", F.lit("legacy")).alias("index_version"),
        document_key().alias("group_key"),
    )


def source_slugs(chunks: DataFrame, lessons: DataFrame, attachments: DataFrame) -> DataFrame:
    """Resolve each chunk to the slug of the lesson or attachment it came from."""
    named = chunks.join(lessons.select("lesson", F.col("slug").alias("_ls")), "lesson", "left").join(
        attachments.select("attachment_id", F.col("slug").alias("_as")), "attachment_id", "left"
    )
    of_lesson = F.coalesce("_ls", F.lit("unknown-lesson"))
    of_file = F.coalesce("_as", F.lit("unknown-attachment"))
    return named.withColumn("source_slug", F.when(F.col("attachment_id").isNull(), of_lesson).otherwise(of_file)).drop("_ls", "_as")
