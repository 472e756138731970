"""Sources and corpus indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagelake.catalog.registry import query
from passagelake.catalog.sql_parts import grams_of, words_of  # noqa: F401  (re-exported for evaluation)
from passagelake.catalog.standins import MODEL, hashed_counts
from passagelake.config import index_version, preset
from passagelake.functions.text import BLANK
from passagelake.operators import chunking as ch
from passagelake.operators import indexing as ix
from passagelake.sources import corpus
from passagelake.sources.stores import ChunkTable, materialise
from passagelake.sources.tables import Lake
from passagelake.session import work_folder

LINES = "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def lines_of(lake: Lake):
    return lake.documents().select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def structured_docs(lake: Lake, label: str = ""):
    return lake.documents().select(
        "doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit(label).alias("source_label"),
        F.array("text").alias("pages"), F.lit(bool(label)).alias("plain"),
    )


def lesson_docs(lake: Lake, pages=None):
    """Documents as index input rows: the text is the lesson's own content."""
    doc = F.col("doc_id").cast("string")
    return lake.documents().select(
        F.col("lang").alias("course"), doc.alias("lesson"), F.concat(F.lit("Document "), doc).alias("title"),
        F.lit(None).cast("string").alias("attachment_id"), F.lit("").alias("source_label"),
        (F.array("text") if pages is None else pages).alias("pages"),
    )


# ---------------------------------------------------------------- sources


@query(
    "A1_lesson_corpus",
    """
    SELECT doc_id, trim(regexp_replace(CASE WHEN p = 0 THEN text ELSE substr(text, 1, p - 1) END, '^#\\s*', '')) AS title,
           length(CASE WHEN p = 0 THEN '' ELSE trim(substr(text, p + 1), ' ' || chr(10)) END) AS content_chars,
           row_number() OVER (ORDER BY doc_id) - 1 AS lesson_order
    FROM (SELECT doc_id, text, instr(text, chr(10)) AS p FROM documents)""",
)
def lesson_corpus(lake: Lake):
    files = lake.documents().select(
        F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".md")).alias("file"), F.col("text").alias("raw")
    )
    parsed = corpus.parse_lessons(files, F.substring("file", 1, 11))
    return parsed.select(
        F.regexp_extract("slug", "0*([0-9]+)$", 1).cast("long").alias("doc_id"), "title",
        F.length("content").alias("content_chars"), "lesson_order",
    )


@query(
    "A2_attachment_pages",
    """
    SELECT 'doc' || doc_id AS attachment_id, true AS extractable, 1 AS n_pages, length(text) AS chars FROM documents
    UNION ALL SELECT 'page' || page_id, false, 0, 0 FROM pages""",
)
def attachment_pages(lake: Lake):
    files = (
        lake.documents()
        .select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("attachment_id"), F.lit("text/plain").alias("mimetype"), F.encode("text", "UTF-8").alias("content"))
        .unionByName(
            lake.table("pages").select(
                F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("attachment_id"), F.lit("text/html").alias("mimetype"), F.encode("html", "UTF-8").alias("content")
            )
        )
    )
    pages = corpus.extracted_pages(F.col("mimetype"), F.col("content"), F.lit(None).cast("array<string>"))
    return files.select("attachment_id", corpus.is_extractable(F.col("mimetype")).alias("extractable"), pages.alias("p")).select(
        "attachment_id", "extractable", F.size("p").alias("n_pages"), F.length(F.array_join("p", "")).alias("chars")
    )


@query("A3_attachment_text", "SELECT doc_id, md5(replace(text, chr(10), chr(10) || chr(10))) AS digest FROM documents")
def attachment_text(lake: Lake):
    pages = F.split("text", "\n")
    return lake.documents().select("doc_id", F.md5(corpus.pages_text(pages)).alias("digest"))


@query(
    "A4_labelled_questions",
    """
    SELECT CAST(b.item_id AS VARCHAR) AS id, 'direct' AS category, b.text AS question, length(b.text) % 3 <> 0 AS answerable,
           0 AS history_turns, CASE WHEN length(b.text) % 3 <> 0 THEN 1 ELSE 0 END AS gold_spans FROM benchmark b""",
)
def labelled_questions(lake: Lake):
    has_gold = F.length("text") % 3 != 0
    # optional fields are absent from the JSON line, exactly as in the labelled files
    line = F.to_json(
        F.struct(
            F.col("item_id").cast("string").alias("id"), F.lit("direct").alias("category"), F.col("text").alias("question"),
            F.when(~has_gold, F.lit(False)).alias("answerable"),
            F.when(has_gold, F.array(F.struct(F.lit("x").alias("lesson"), F.col("text").alias("span")))).alias("gold"),
        )
    )
    lines = lake.table("benchmark").select(F.explode(F.array(line, F.lit(" "))).alias("value"))
    return corpus.parse_questions(lines).select(
        "id", "category", "question", "answerable", F.size("history").alias("history_turns"), F.size("gold").alias("gold_spans")
    )


@query(
    "A5_chunk_scan",
    """
    SELECT course, chunk_id, 'Document ' || doc_id AS lesson_title, 'content' AS source, '' AS source_label,
           CASE WHEN chunk_index % 2 = 0 THEN 'legacy' ELSE 'v2' END AS index_version, doc_id || ':content' AS group_key,
           length(text) AS chars FROM chunks""",
)
def chunk_scan(lake: Lake):
    stored = lake.chunks().drop("lesson_title", "group_key", "source", "source_label").withColumns(
        {
            "source": F.lit(None).cast("string"), "source_label": F.lit(None).cast("string"),
            "index_version": F.when(F.col("chunk_index") % 2 == 1, F.lit("v2")), "embedding": F.array(F.lit(0.0)),
        }
    )
    lessons = lake.documents().select(F.col("doc_id").cast("string").alias("lesson"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"))
    return ix.scan_chunks(stored, lessons).select(
        "course", "chunk_id", "lesson_title", "source", "source_label", "index_version", "group_key", F.length("text").alias("chars")
    )


@query(
    "A8_source_slugs",
    """
    SELECT chunk_id, CASE WHEN d.source IS NULL THEN 'unknown-lesson' WHEN c.chunk_index % 2 = 1 THEN 'file-' || c.doc_id
           ELSE d.source || '-' || c.doc_id END AS source_slug
    FROM chunks c JOIN documents d ON d.doc_id = c.doc_id""",
)
def source_slugs(lake: Lake):
    attached = F.when(F.col("chunk_index") % 2 == 1, F.concat(F.lit("a"), "lesson"))
    docs = lake.documents().select(F.col("doc_id").cast("string").alias("lesson"), "source")
    lessons = docs.select("lesson", F.concat_ws("-", "source", "lesson").alias("slug"))
    attachments = docs.select(F.concat(F.lit("a"), "lesson").alias("attachment_id"), F.concat(F.lit("file-"), "lesson").alias("slug"))
    chunks = lake.chunks().withColumn("attachment_id", attached)
    return ix.source_slugs(chunks, lessons, attachments).select("chunk_id", "source_slug")


# ---------------------------------------------------------------- chunkers


@query("I1_paragraph_chunks", "SELECT doc_id, chunk_index, length(text) AS chars, md5(text) AS digest FROM chunks")
def paragraph_chunks(lake: Lake):
    return ch.paragraph_chunks(lake.documents().select("doc_id", "text")).select(
        "doc_id", "chunk_index", F.length("text").alias("chars"), F.md5("text").alias("digest")
    )


@query(
    "I2_normalised_text",
    r"""
    SELECT doc_id, md5(replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'),
               chr(160), ' ')) AS digest FROM documents""",
)
def normalised_text(lake: Lake):
    return lake.documents().select("doc_id", F.md5(ch.normalised(F.col("text"))).alias("digest"))


# the same boundaries without look-around: abbreviations and boundaries are marked by control characters first
SENTENCES = rf"""
    WITH marked AS (SELECT doc_id, line_no, regexp_replace(line, '(?i)\b({ch.ABBREVIATIONS})\.\s+', '\1' || chr(2), 'g') AS line FROM {LINES}),
    cut AS (SELECT doc_id, line_no, regexp_replace(line, '([.!?]["'')\]]?)\s+(["''(\[`$A-Z0-9])', '\1' || chr(1) || '\2', 'g') AS line FROM marked),
    parts AS (SELECT doc_id, line_no, list_filter(list_transform(string_split(line, chr(1)), lambda s: trim(replace(s, chr(2), '. '))), lambda s: s <> '') AS s FROM cut)
    SELECT doc_id, line_no, unnest(range(len(s))) AS sentence_no, unnest(s) AS sentence FROM parts"""


@query("I3_sentences", SENTENCES)
def sentences(lake: Lake):
    return lines_of(lake).select("doc_id", "line_no", F.posexplode(ch.sentences(F.col("line"))).alias("sentence_no", "sentence"))


@query(
    "I4_list_lines",
    f"""
    SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^\\s*(?:[-*•]|[0-9]+[.)])\\s+')) AS list_lines, count(*) AS lines
    FROM {LINES} GROUP BY doc_id""",
)
def list_lines(lake: Lake):
    return lake.documents().select("doc_id", F.split("text", "\n").alias("lines")).select(
        "doc_id", F.size(F.filter("lines", lambda s: ch.is_list_block(F.array(s)))).cast("long").alias("list_lines"),
        F.size("lines").cast("long").alias("lines"),
    )


# documents as markdown: every line that is short becomes a heading, its level from its length
HEADED = f"""
    headed AS (SELECT doc_id, line_no, CASE WHEN length(trim(line)) BETWEEN 1 AND 60 THEN
                 repeat('#', 1 + length(trim(line)) % 3) || ' ' || trim(line) ELSE line END AS line FROM {LINES}),
    marks AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 1)) AS level FROM headed),
    placed AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM marks)"""


def headed_pages():
    """The document's text as one page of markdown."""
    short = lambda s: F.length(F.trim(s)).between(1, 60)
    marked = F.transform(
        F.split("text", "\n"),
        lambda s: F.when(short(s), F.concat(F.repeat(F.lit("#"), 1 + F.length(F.trim(s)) % 3), F.lit(" "), F.trim(s))).otherwise(s),
    )
    return F.array(F.array_join(marked, "\n"))


def headed_docs(lake: Lake):
    return lake.documents().select(
        "doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit("").alias("source_label"),
        F.lit(False).alias("plain"), headed_pages().alias("pages"),
    )


def sections_of(docs):
    return docs.select("doc_id", F.posexplode(ch.in_sections(ch.document_pieces(F.col("pages"), F.col("plain")))).alias("section", "s"))


@query(
    "I5_heading_sections",
    f"""
    WITH {HEADED}
    SELECT doc_id, section, max(level) AS level, count(*) AS lines FROM placed GROUP BY ALL""",
)
def heading_sections(lake: Lake):
    lines = F.aggregate("s.pieces", F.lit(0), lambda n, p: n + p["n"]).cast("long")
    return sections_of(headed_docs(lake)).select("doc_id", "section", F.coalesce("s.level", F.lit(0)).cast("long").alias("level"), lines.alias("lines")).where("lines > 0")


@query(
    "I5_heading_paths",
    f"""
    WITH {HEADED},
    heads AS (SELECT doc_id, section, level, regexp_extract(line, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 2) AS title FROM placed WHERE level > 0),
    bodies AS (SELECT DISTINCT doc_id, section FROM placed WHERE level = 0 AND trim(line) <> ''),
    above AS (SELECT b.doc_id, b.section, h.section AS pos, h.level, h.title FROM bodies b
              JOIN heads h ON h.doc_id = b.doc_id AND h.section <= b.section),
    seen AS (SELECT *, min(level) OVER (PARTITION BY doc_id, section ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM above)
    SELECT b.doc_id, b.section, coalesce(string_agg(o.title, ' > ' ORDER BY o.pos), '') AS path
    FROM bodies b LEFT JOIN seen o ON o.doc_id = b.doc_id AND o.section = b.section AND (o.later IS NULL OR o.level < o.later)
    GROUP BY ALL""",
)
def heading_paths(lake: Lake):
    parts = F.transform(ch.in_sections(ch.document_pieces(F.col("pages"), F.col("plain"))), lambda x: F.struct(
        x["level"].alias("level"), x["title"].alias("title"), F.exists(x["pieces"], lambda p: F.size(p["lines"]) > 0).alias("has_text")
    ))
    docs = headed_docs(lake).select("doc_id", parts.alias("s"))
    paths = ch.heading_paths(F.transform("s", lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"))))
    zipped = F.zip_with("s", paths, lambda x, p: F.struct(x["has_text"].alias("t"), F.array_join(p, " > ").alias("path")))
    return docs.select("doc_id", F.posexplode(zipped).alias("section", "z")).where("z.t").select("doc_id", "section", "z.path")


@query(
    "I6_plain_headings",
    f"""
    WITH lines AS (SELECT doc_id, line_no, line, trim(line) AS t, trim(coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no), '')) AS following,
        regexp_matches(line, '^\\s*```') AS fence,
        sum(CAST(regexp_matches(line, '^\\s*```') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM {LINES}),
    w AS (SELECT *, regexp_split_to_array(t, '\\s+') AS words, regexp_extract(line, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 1) AS marks FROM lines WHERE NOT fence AND fences % 2 = 0),
    v AS (SELECT *, list_filter(words, lambda x: length(x) > 3) AS weighty, regexp_extract(t, '^([0-9]+(?:\\.[0-9]+)*)[.)]?\\s', 1) AS number FROM w)
    SELECT doc_id, line_no, CASE WHEN marks <> '' THEN length(marks) WHEN number = '' THEN 1 ELSE len(string_split(number, '.')) END AS level,
      CASE WHEN marks <> '' THEN trim(regexp_extract(line, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 2)) ELSE t END AS title
    FROM v WHERE marks <> '' OR (t <> '' AND length(t) <= 80 AND NOT regexp_matches(t, '[.,;:!?]$') AND following <> '' AND NOT regexp_matches(t, '^[-*•]\\s+')
      AND len(words) <= 10 AND CASE WHEN regexp_matches(t, '^[0-9]+(\\.[0-9]+)*[.)]?\\s+[A-Z]') THEN len(words) <= 7
        ELSE len(weighty) > 0 AND len(words) <= 8 AND len(list_filter(weighty, lambda x: regexp_matches(x, '^[A-Z0-9]'))) >= 0.75 * len(weighty) END)""",
)
def plain_headings(lake: Lake):
    pieces = ch.document_pieces(F.col("pages"), F.col("plain"))
    found = structured_docs(lake, "notes.txt").select("doc_id", F.explode(pieces).alias("p"))
    return found.where(F.col("p.level").isNotNull()).select("doc_id", F.col("p.at").alias("line_no"), "p.level", "p.title")


@query(
    "I7_code_blocks",
    f"""
    WITH fenced AS (SELECT doc_id, line_no, CASE WHEN length(trim(line)) BETWEEN 1 AND 40 THEN '```' || trim(line) ELSE line END AS line FROM {LINES}),
    counted AS (SELECT *, regexp_matches(line, '^\\s*```') AS fence FROM fenced),
    runs AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM counted)
    SELECT doc_id, CAST((n + 1) // 2 AS BIGINT) AS code_block, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars
    FROM runs WHERE fence OR n % 2 = 1 GROUP BY ALL""",
)
def code_blocks(lake: Lake):
    fenced = F.transform(
        F.split("text", "\n"),
        lambda s: F.when(F.length(F.trim(s)).between(1, 40), F.concat(F.lit("```"), F.trim(s))).otherwise(s),
    )
    docs = lake.documents().select(
        "doc_id", F.lit(False).alias("plain"), F.array(F.array_join(fenced, "\n")).alias("pages")
    )
    blocks = F.filter(ch.document_pieces(F.col("pages"), F.col("plain")), lambda p: p["code"])
    return docs.select("doc_id", F.posexplode(blocks).alias("code_block", "p")).select(
        "doc_id", (F.col("code_block") + 1).cast("long").alias("code_block"), F.size("p.lines").cast("long").alias("lines"),
        F.aggregate("p.lines", F.lit(0).cast("long"), lambda n, line: n + F.length(line)).alias("chars"),
    )


@query("I8_long_units")
def long_units(lake: Lake):
    whole = F.struct(F.col("line").alias("text"), F.lit("\n\n").alias("sep"), F.lit(False).alias("is_code"), F.lit(None).cast("int").alias("page"))
    return lines_of(lake).select("doc_id", "line_no", F.posexplode(ch.long_parts(whole, 900)).alias("part_no", "u")).select(
        "doc_id", "line_no", "part_no", F.length("u.text").alias("chars"), F.md5("u.text").alias("digest")
    )


@query("I9_packed_sections")
def packed_sections(lake: Lake):
    return ch.structured_chunks(structured_docs(lake), "doc_id", ch.PackLimits(target=300, most=500, least=60, overlap=80)).select(
        "doc_id", "chunk_index", F.length("text").alias("chars"), "overlap_len"
    )


@query("I10_structured_chunks")
def structured_chunks(lake: Lake):
    return ch.structured_chunks(headed_docs(lake), "doc_id").select(
        "doc_id", "chunk_index", F.array_join("heading_path", " > ").alias("path"), "context_header", "overlap_len", "page",
        F.length("text").alias("chars"), F.md5("text").alias("digest"),
    )


@query(
    "I11_context_headers",
    """
    SELECT doc_id, concat_ws(' > ', 'Document ' || doc_id || ' (' || source || ')', nullif(lang, 'en'), 'Part') AS header FROM documents""",
)
def context_headers(lake: Lake):
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    # a path element that repeats the title is left out
    path = F.array(F.upper(title), F.when(F.col("lang") == "en", F.concat(F.lit(" "), title)).otherwise(F.col("lang")), F.lit("Part"))
    return lake.documents().select("doc_id", ch.context_header(title, F.col("source"), path).alias("header"))


@query("I12_embed_text", "SELECT chunk_id, md5('Document ' || doc_id || chr(10) || chr(10) || text) AS digest FROM chunks")
def embed_text(lake: Lake):
    header = F.col("lesson_title")
    return lake.chunks().select("chunk_id", F.md5(ch.embed_text(header, F.lit(""), F.col("text"))).alias("digest"))


@query(
    "I13_stitched_documents",
    """
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), ' +', ' ', 'g'))) AS digest FROM documents""",
)
def stitched_documents(lake: Lake):
    """Structured chunks stitched back: up to the width of blanks, the original text."""
    rebuilt = ch.stitched_documents(ch.structured_chunks(structured_docs(lake), "doc_id"), "doc_id")
    collapsed = F.regexp_replace(F.regexp_replace("text", f"{BLANK}+", " "), " +", " ")
    return rebuilt.select("doc_id", F.md5(F.trim(collapsed)).alias("digest"))


# ---------------------------------------------------------------- the chunk table


def note_responses(lake: Lake):
    """Recorded situating sentences for the first chunk of every document; the others have none."""
    return lake.documents().select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":content")).alias("doc_key"), F.lit(0).alias("chunk_index"),
        F.concat(F.lit("  About\n"), "source", F.lit("  in "), "lang").alias("text"),
    )


@query(
    "I14_context_notes",
    """
    SELECT chunk_id, CASE WHEN chunk_index = 0 THEN 'About ' || d.source || ' in ' || d.lang ELSE '' END AS context_note
    FROM chunks c JOIN documents d ON d.doc_id = c.doc_id""",
)
def context_notes(lake: Lake):
    config = preset("basic", {"indexing": {"llm_context": True}})
    chunks = ix.index_chunks(lesson_docs(lake), config, MODEL, "b1", note_responses(lake))
    return chunks.select((F.col("lesson").cast("long") * 1_000_000 + F.col("chunk_index")).alias("chunk_id"), "context_note")


@query(
    "I14_note_prompts",
    """
    SELECT c.chunk_id, md5('<document title="Document ' || c.doc_id || '">' || chr(10) || substr(d.text, 1, 12000) || chr(10) || '</document>'
      || chr(10) || chr(10) || '<chunk>' || chr(10) || c.text || chr(10) || '</chunk>') AS digest
    FROM chunks c JOIN documents d ON d.doc_id = c.doc_id""",
)
def note_prompts(lake: Lake):
    docs = lesson_docs(lake)
    prompts = ix.note_requests(ix.index_chunks(docs, preset("basic"), MODEL, "b1"), docs)
    key = F.split("doc_key", ":")[0].cast("long")
    return prompts.select((key * 1_000_000 + F.col("chunk_index")).alias("chunk_id"), F.md5("prompt").alias("digest"))


@query("I15_index_version", "SELECT 'basic.h0.t0.c0|hash-64' AS index_version, count(*) AS chunks FROM chunks")
def index_versions(lake: Lake):
    chunks = ix.index_chunks(lesson_docs(lake), preset("basic"), MODEL, "b1")
    return chunks.groupBy("index_version").agg(F.count("*").alias("chunks"))


REPLACED = """
    SELECT course, doc_id, count(*) AS chunks, CASE WHEN doc_id % 3 = 0 THEN 'b2' ELSE 'b1' END AS index_batch
    FROM chunks WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0) GROUP BY ALL"""


def replaced_table(lake: Lake):
    """Every third document was touched: even ones came back empty, odd ones with new chunks; others failed to embed."""
    current = ix.index_chunks(lesson_docs(lake), preset("basic"), MODEL, "b1")
    doc = F.col("lesson").cast("long")
    fresh = current.where((doc % 3 != 0) | (doc % 2 != 0)).withColumn("index_batch", F.lit("b2"))
    touched = lesson_docs(lake).select("lesson", F.lit("content").alias("source"), "attachment_id", (doc % 3 == 0).alias("embedded"))
    return ix.replace_documents(current, fresh, touched)


@query("I16_replace_documents", REPLACED)
def replace_documents(lake: Lake):
    return replaced_table(lake).groupBy("course", F.col("lesson").cast("long").alias("doc_id"), "index_batch").agg(F.count("*").alias("chunks"))


@query("I16_snapshots", REPLACED)
def snapshots(lake: Lake):
    """The same in the stored table: the second publication overwrites the partitions of the documents it replaces."""
    store = ChunkTable(lake.spark, work_folder(lake.spark, "chunk-table"), ix.document_key())
    current = materialise(ix.index_chunks(lesson_docs(lake), preset("basic"), MODEL, "b1"), "chunks")
    documents = lesson_docs(lake).withColumn("source", F.lit("content"))
    store.publish(current, documents)
    doc = F.col("lesson").cast("long")
    fresh = current.where((doc % 3 == 0) & (doc % 2 != 0)).withColumn("index_batch", F.lit("b2"))
    store.publish(fresh, documents.where(doc % 3 == 0))
    return store.read().groupBy("course", F.col("lesson").cast("long").alias("doc_id"), "index_batch").agg(F.count("*").alias("chunks"))


@query(
    "I17_remove_documents",
    """SELECT chunk_id FROM chunks c JOIN documents d ON d.doc_id = c.doc_id
       WHERE d.n_chars >= 200 AND NOT (c.chunk_index % 2 = 1 AND d.n_chars > 20000)""",
)
def remove_documents(lake: Lake):
    """Short documents were deleted as lessons; the (odd) attachment chunks of very long ones as attachments."""
    file_id = F.concat(F.lit("a"), "lesson")
    chunks = lake.chunks().withColumn("attachment_id", F.when(F.col("chunk_index") % 2 == 1, file_id))
    docs = lake.documents().select(F.col("doc_id").cast("string").alias("lesson"), "n_chars")
    lessons = docs.where(F.col("n_chars") < 200).select("lesson", F.lit(None).cast("string").alias("attachment_id"))
    files = docs.where(F.col("n_chars") > 20000).select("lesson", file_id.alias("attachment_id"))
    return ix.remove_documents(chunks, lessons.unionByName(files)).select("chunk_id")


@query(
    "I18_reindex_report",
    """
    SELECT d.doc_id, CASE WHEN d.n_chars >= 200 THEN n ELSE 0 END AS chunks, CASE WHEN d.n_chars >= 200 THEN 'ok' ELSE 'FAIL' END AS status
    FROM documents d JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c ON c.doc_id = d.doc_id""",
)
def reindex_report(lake: Lake):
    """Embedding is made to fail for short documents: they are reported, the rest proceeds."""
    docs = lesson_docs(lake)
    chunks = ix.index_chunks(docs, preset("basic"), MODEL, "b2")
    ok = lake.documents().where(F.col("n_chars") >= 200).select(F.col("doc_id").cast("string").alias("lesson"))
    return ix.reindex_report(docs, chunks.join(ok, "lesson", "left_semi")).select(F.col("lesson").cast("long").alias("doc_id"), "chunks", "status")


@query("I19_missing_documents", "SELECT doc_id FROM documents WHERE n_chars < 200")
def missing_documents(lake: Lake):
    docs = lesson_docs(lake).withColumn("source", F.lit("content"))
    ok = lake.documents().where(F.col("n_chars") >= 200).select(F.col("doc_id").cast("string").alias("lesson"))
    return ix.missing_documents(docs, lake.chunks().join(ok, "lesson", "left_semi")).select(F.col("lesson").cast("long").alias("doc_id"))


VERSIONED = """versioned AS (SELECT c.course, CASE WHEN c.course = 'en' OR d.source IS NULL THEN 'legacy'
      WHEN c.course = 'de' AND d.n_chars > 2000 THEN 'structured.h1.t1.c0|hash-64' ELSE 'basic.h0.t0.c0|hash-64' END AS v
    FROM chunks c JOIN documents d ON d.doc_id = c.doc_id)"""


def versioned_chunks(lake: Lake):
    size = lake.documents().select(F.col("doc_id").cast("string").alias("lesson"), "n_chars")
    version = (
        F.when(F.col("course") == "en", F.lit("legacy"))
        .when((F.col("course") == "de") & (F.col("n_chars") > 2000), F.lit("structured.h1.t1.c0|hash-64"))
        .otherwise(F.lit("basic.h0.t0.c0|hash-64"))
    )
    return lake.chunks().join(size, "lesson").withColumn("index_version", version)


@query(
    "I20_version_mix",
    f"""
    SELECT * FROM (WITH {VERSIONED}, canon AS (SELECT DISTINCT course, CASE WHEN v = 'legacy' THEN 'basic.h0.t0.c0|hash-64' ELSE v END AS v FROM versioned)
    SELECT course, count(*) AS versions, min(v) <> max(v) AS mixed, count(*) > 1 OR min(v) <> 'basic.h0.t0.c0|hash-64' AS mismatch
    FROM canon GROUP BY course)""",
)
def version_mix(lake: Lake):
    return ix.version_report(versioned_chunks(lake), index_version(preset("basic"), MODEL))


@query(
    "I21_course_routes",
    f"""
    SELECT * FROM (WITH {VERSIONED} SELECT course, CASE WHEN bool_and(v = 'legacy') THEN 'basic' ELSE 'advanced' END AS pipeline
    FROM versioned GROUP BY course)""",
)
def course_routes(lake: Lake):
    return ix.course_routes(versioned_chunks(lake), preset("advanced"))


@query(
    "I22_change_stamps",
    """
    SELECT coalesce(a.course, b.course) AS course, coalesce(n, 0) || ':' || coalesce(c_at, 0) || ':' || coalesce(l_at, 0) AS stamp
    FROM (SELECT CAST(user_id AS VARCHAR) AS course, count(*) AS n, epoch_us(max(ts)) // 1000 AS c_at FROM events WHERE event_type <> 'view' GROUP BY ALL) a
    FULL JOIN (SELECT CAST(user_id AS VARCHAR) AS course, epoch_us(max(ts)) // 1000 AS l_at FROM events WHERE event_type = 'view' GROUP BY ALL) b
    ON a.course = b.course""",
)
def change_stamps(lake: Lake):
    """Users as courses: their views stand for lesson edits, everything else for chunk writes."""
    rows = lake.table("events").select(F.col("user_id").cast("string").alias("course"), F.col("ts").cast("timestamp").alias("updated_at"), "event_type")
    return ix.change_stamps(rows.where(F.col("event_type") != "view"), rows.where(F.col("event_type") == "view"))


@query(
    "I24_indexed_flags",
    "SELECT doc_id, n_chars >= 500 AS indexed FROM documents",
)
def indexed_flags(lake: Lake):
    files = lake.documents().select("doc_id", F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("attachment_id"), "n_chars", (F.trim("text") != "").alias("has_text"))
    chunks = lake.chunks().withColumn("attachment_id", F.concat(F.lit("a"), "lesson"))
    long = files.where(F.col("n_chars") >= 500).select("attachment_id")
    return ix.indexed_flags(files, chunks.join(long, "attachment_id", "left_semi")).select("doc_id", "indexed")


@query(
    "M13_batch_embedding",
    """
    SELECT chunk_id, CAST(round(norm, 6) AS DOUBLE) AS norm FROM chunk_norms
    UNION ALL SELECT chunk_id, 0.0 FROM chunk_terms WHERE len(terms) = 0""",
)
def batch_embedding(lake: Lake):
    """Two passes over the same texts: the second finds half of the vectors in the store."""
    config = preset("basic")
    chunks = lake.chunks()
    from passagelake.operators.model_stages import embed_missing

    early = chunks.where(F.col("chunk_index") % 2 == 0).select("text")
    store = materialise(embed_missing(early, None, hashed_counts, MODEL), "vectors")
    embedded = ix.embed_chunks(chunks, config, hashed_counts, MODEL, store)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return embedded.select("chunk_id", F.round(norm, 6).alias("norm"))
