"""Documents to overlapping chunks.

Two chunkers are offered. ``paragraph_chunks`` packs paragraphs to a fixed size with higher-order functions inside
one row. ``structured_chunks`` does too: fences, headings, paragraphs and sections are found as positions in the
document's own array of lines, so nothing is shuffled from the scan to the chunk rows, and only the integer lengths
of units visit Python to decide where chunks begin and end.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.functions.text import BLANK, fold_runs, let, strip_blanks

# Fixed values of the two chunkers.
PARAGRAPH_LIMIT = 800
PARAGRAPH_OVERLAP = 150
ABBREVIATIONS = "e\\.g|i\\.e|vs|etc|approx|fig|no|dr|mr|ms|inc|cf"
SENTENCE_OPENERS = "[\"'(\\[`$A-Z0-9]"
LIST_LINE = f"^{BLANK}*(?:[-*\\u2022]|[0-9]+[.)]){BLANK}+"
HEADING_LINE = f"^(#{{1,6}}){BLANK}+(.+?){BLANK}*#*{BLANK}*$"
FENCE_LINE = f"^{BLANK}*```"


@dataclass(frozen=True)
class PackLimits:
    target: int = 650
    most: int = 900
    least: int = 120
    overlap: int = 140


# ---------------------------------------------------------------- paragraph chunker


def paragraph_pieces(text: Column, limit: int = PARAGRAPH_LIMIT, overlap: int = PARAGRAPH_OVERLAP) -> Column:
    """``array<string>`` of packed paragraphs; blank text gives one empty piece."""
    step = limit - overlap
    paragraphs = F.filter(F.transform(F.split(text, f"\\n{BLANK}*\\n"), strip_blanks), lambda p: p != "")

    def slices(p: Column) -> Column:
        # cut once into steps, then let each slice borrow the overlap from the next step: linear in the text
        count = F.greatest(F.ceil((F.length(p) - limit) / F.lit(step)).cast("int") + 1, F.lit(1))
        return let(
            F.regexp_extract_all(p, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)),
            lambda steps: F.transform(
                F.slice(steps, F.lit(1), count),
                lambda s, i: F.concat(s, F.coalesce(F.substring(F.get(steps, i + 1), 1, overlap), F.lit(""))),
            ),
        )

    def state(done: Column, open_: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"))

    def fold(acc: Column, p: Column) -> Column:
        open_, done = acc["open"], acc["done"]
        joined = F.when(open_ == "", p).otherwise(F.concat(open_, F.lit("\n\n"), p))
        closed = F.when(open_ == "", done).otherwise(F.concat(done, F.array(open_)))
        carried = F.when(open_ == "", F.lit("")).otherwise(
            F.substring(open_, F.greatest(F.length(open_) - overlap, F.lit(0)) + 1, F.length(open_))
        )
        return (
            F.when(F.length(open_) + 2 + F.length(p) <= limit, state(done, joined))
            .when(F.length(p) > limit, state(F.concat(closed, slices(p)), F.lit("")))
            .otherwise(state(closed, F.when(carried == "", p).otherwise(F.concat(carried, F.lit("\n\n"), p))))
        )

    empty = state(F.array().cast("array<string>"), F.lit(""))

    def finish(acc: Column) -> Column:
        last = strip_blanks(acc["open"])
        full = F.when(last == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))
        return F.when(F.size(full) > 0, full).otherwise(F.array(F.lit("")))

    return F.aggregate(paragraphs, empty, fold, finish)


def paragraph_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Explode ``docs`` to chunk rows: every other column, then ``chunk_index`` and ``text``."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(paragraph_pieces(F.col(text))).alias("chunk_index", "text"))


# ---------------------------------------------------------------- building blocks of the structured chunker


def normalised(text: Column) -> Column:
    unix = F.regexp_replace(text, "\\r\\n?", "\n")
    return F.regexp_replace(F.regexp_replace(unix, "[ \\t]+\\n", "\n"), "\\u00a0", " ")


def sentences(paragraph: Column) -> Column:
    """Sentence pieces; a boundary right after a known abbreviation does not split."""
    after_abbreviation = f"(?i:\\b({ABBREVIATIONS})\\.){BLANK}+(?={SENTENCE_OPENERS})"
    # the leading look-ahead lets the engine skip every position that is not a blank
    boundary = (
        f"(?={BLANK})(?<=[.!?][\"')\\]]?)(?<!(?i:\\b(?:{ABBREVIATIONS}))\\.){BLANK}+(?={SENTENCE_OPENERS})"
    )
    pieces = F.split(F.regexp_replace(paragraph, after_abbreviation, "$1. "), boundary)
    return F.filter(F.transform(pieces, strip_blanks), lambda s: s != "")


def is_list_block(lines: Column) -> Column:
    return F.forall(lines, lambda line: line.rlike(LIST_LINE))


def plain_heading(line: Column, following: Column) -> Column:
    """A short unpunctuated line, numbered or mostly capitalised, that is followed by text."""
    trimmed = strip_blanks(line)
    words = F.split(trimmed, f"{BLANK}+")
    weighty = F.filter(words, lambda w: F.length(w) > 3)
    capital = F.filter(weighty, lambda w: w.rlike("^[A-Z0-9]"))
    possible = (
        (trimmed != "")
        & (F.length(trimmed) <= 80)
        & ~trimmed.rlike("[.,;:!?]$")
        & (strip_blanks(F.coalesce(following, F.lit(""))) != "")
        & ~trimmed.rlike(f"^[-*\\u2022]{BLANK}+")
        & (F.size(words) <= 10)
    )
    shaped = F.when(trimmed.rlike(f"^[0-9]+(\\.[0-9]+)*[.)]?{BLANK}+[A-Z]"), F.size(words) <= 7).otherwise(
        (F.size(weighty) > 0) & (F.size(words) <= 8) & (F.size(capital) >= 0.75 * F.size(weighty))
    )
    return F.coalesce(possible & shaped, F.lit(False))


def plain_heading_level(line: Column) -> Column:
    number = F.regexp_extract(strip_blanks(line), f"^([0-9]+(?:\\.[0-9]+)*)[.)]?{BLANK}", 1)
    return F.when(number == "", F.lit(1)).otherwise(F.size(F.split(number, "\\.")))


def heading_paths(marks: Column) -> Column:
    """Fold ``array<struct<level,title>>`` (level null = no heading) into one title path per element."""
    start = F.struct(
        F.array().cast("array<struct<level:int,title:string>>").alias("open"),
        F.array().cast("array<array<string>>").alias("paths"),
    )

    def fold(acc: Column, mark: Column) -> Column:
        opened = F.when(mark["level"].isNull(), acc["open"]).otherwise(
            F.concat(
                F.filter(acc["open"], lambda o: o["level"] < mark["level"]),
                F.array(F.struct(mark["level"].alias("level"), mark["title"].alias("title"))),
            )
        )
        titles = F.transform(opened, lambda o: o["title"])
        return F.struct(opened.alias("open"), F.concat(acc["paths"], F.array(titles)).alias("paths"))

    return F.aggregate(marks, start, fold, lambda acc: acc["paths"])


def context_header(lesson_title: Column, source_label: Column, path: Column) -> Column:
    label = F.coalesce(source_label, F.lit(""))
    root = F.when(label == "", lesson_title).otherwise(F.concat(lesson_title, F.lit(" ("), label, F.lit(")")))
    below = F.filter(path, lambda t: F.lower(strip_blanks(t)) != F.lower(strip_blanks(lesson_title)))
    return F.array_join(F.filter(F.concat(F.array(root), below), lambda t: t != ""), " > ")


def embed_text(header: Column, note: Column, text: Column, use_header: bool = True, use_note: bool = True) -> Column:
    parts = ([header] if use_header else []) + ([note] if use_note else []) + [text]
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])


def split_long(text: Column, is_code: Column, most: int) -> Column:
    """Parts of at most ``most`` characters; a part keeps its leading separator (blank or newline).

    Prose breaks between words and code between lines; a single longer word or line is cut hard. The three
    alternatives are: the tail of a token cut hard, a full hard cut, the longest run that ends on a boundary.
    """

    def pattern(stop: str, lead: str) -> str:
        solid = f"[^{stop}]"
        return (
            f"(?s)(?<={solid}){solid}{{1,{most}}}(?!{solid})"
            f"|{lead}{solid}{{{most}}}(?={solid})"
            f"|{lead}{solid}(?:.{{0,{most - 2}}}.)?(?!{solid})"
        )

    words = F.regexp_extract_all(
        F.regexp_replace(text, f"{BLANK}+", " "), F.lit(pattern(" ", " ?")), F.lit(0)
    )
    lines = F.regexp_extract_all(text, F.lit(pattern("\\n", "\\n*")), F.lit(0))
    return F.when(F.length(text) <= most, F.array(text)).when(is_code, lines).otherwise(words)


def long_parts(unit: Column, most: int) -> Column:
    """A unit ``struct<text,sep,is_code,page>`` as an array of units none longer than ``most``."""
    parts = split_long(unit["text"], unit["is_code"], most)
    long = F.length(unit["text"]) > most

    def part(p: Column, i: Column) -> Column:
        body = F.when(long & unit["is_code"], F.regexp_replace(p, "^\\n+", "")).when(long, F.ltrim(p)).otherwise(p)
        lead = F.when(p.startswith("\n"), F.lit("\n")).when(p.startswith(" "), F.lit(" ")).otherwise(F.lit(""))
        return F.struct(
            body.alias("text"),
            F.when(i == 0, unit["sep"]).otherwise(lead).alias("sep"),
            unit["is_code"].alias("is_code"),
            unit["page"].alias("page"),
        )

    return F.transform(parts, part)


# ---------------------------------------------------------------- packing

BOUND = T.StructType([T.StructField(n, T.IntegerType()) for n in ("carry", "first", "end")])


def pack_bounds(sizes, seps, codes, limits: PackLimits) -> list[tuple[int, int, int]]:
    """Where chunks begin and end, as ``(carry, first, end)`` unit positions.

    Units ``carry..first`` repeat the tail of the previous chunk, ``first..end`` are the chunk's own. ``reach[i]`` is
    the length of everything before unit ``i`` with separators, so any joined length is one subtraction.
    """
    count = len(sizes)
    reach = [0] * (count + 1)
    for i in range(count):
        reach[i + 1] = reach[i] + seps[i] + sizes[i]

    def joined(a: int, b: int) -> int:
        return reach[b] - reach[a] - seps[a] if b > a else 0

    def repeated_from(a: int, b: int) -> int:
        at = b
        while at > a and not codes[at - 1] and joined(at - 1, b) <= limits.overlap:
            at -= 1
        return at

    bounds: list[tuple[int, int, int]] = []
    carry = first = 0
    for i in range(count):
        grown = joined(carry, i + 1)
        if i > first and (grown > limits.most or (grown > limits.target and joined(first, i) >= limits.least)):
            bounds.append((carry, first, i))
            carry, first = repeated_from(first, i), i
        if i == first and carry < first and joined(carry, i + 1) > limits.most:
            carry = i
    if count:
        bounds.append((carry, first, count))
    if len(bounds) > 1:
        (before, own, _), (_, last, end) = bounds[-2:]
        if joined(last, end) < limits.least and joined(before, end) <= limits.most:
            bounds[-2:] = [(before, own, end)]
    return bounds


def _pack_udf(limits: PackLimits):
    @F.arrow_udf(T.ArrayType(T.ArrayType(BOUND)))
    def bounds(documents: pa.Array) -> pa.Array:
        names = BOUND.fieldNames()

        def one(section: list[dict]) -> list[dict]:
            columns = ([u[c] for u in section] for c in ("size", "sep", "code"))
            return [dict(zip(names, b)) for b in pack_bounds(*columns, limits)]

        packed = [None if doc is None else [one(section) for section in doc] for doc in documents.to_pylist()]
        return pa.array(packed, pa.list_(pa.list_(pa.struct([(n, pa.int32()) for n in names]))))

    return bounds


def _chunk_of(units: Column, bound: Column) -> Column:
    def joined(a: Column, b: Column) -> Column:
        part = F.slice(units, a + 1, b - a)
        return F.array_join(
            F.transform(part, lambda u, i: F.when(i == 0, u["text"]).otherwise(F.concat(u["sep"], u["text"]))), ""
        )

    first = F.get(units, bound["first"])
    own = joined(bound["first"], bound["end"])
    return let(
        joined(bound["carry"], bound["first"]),
        lambda repeated: F.struct(
            F.when(repeated != "", F.concat(repeated, first["sep"], own)).otherwise(own).alias("text"),
            F.when(repeated != "", F.length(repeated) + F.length(first["sep"])).otherwise(F.lit(0)).alias("overlap_len"),
            first["page"].alias("page"),
            # only a part of a token or line that was cut hard follows without a separator
            ((bound["first"] > 0) & (first["sep"] == "")).alias("glued"),
        ),
    )


# ---------------------------------------------------------------- the structured chunker


def _range(start: Column, end: Column) -> Column:
    """``start..end - 1``, empty where there is nothing between."""
    return F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))


def page_pieces(page: Column, plain: Column) -> Column:
    """The lines of a page as ``array<struct<at,n,level,title,code,lines>>``, without leaving the row.

    A piece is a fenced block with its fences, or a break, which is a heading or blank line, with the text lines up to the next
    break. ``at`` and ``n`` are the first line and the number of all lines of the piece, ``level`` and ``title`` those of its heading,
    ``lines`` its text or code. Fences pair up by their positions; a fence left open lasts to the end of the page. Every step is a
    filter over positions or a slice, so the work grows with the lines.
    """

    def of_lines(lines: Column) -> Column:
        size = F.size(lines)
        line = lambda i: F.get(lines, i)

        def is_break(i: Column) -> Column:
            return (strip_blanks(line(i)) == "") | line(i).rlike(HEADING_LINE) | (plain & plain_heading(line(i), line(i + 1)))

        def text_piece(at: Column, end: Column, broken: Column) -> Column:
            text = line(at)
            markdown = broken & text.rlike(HEADING_LINE)
            named = broken & plain & (strip_blanks(text) != "")
            skip = F.when(broken, 1).otherwise(0)
            return F.struct(
                at.alias("at"),
                (end - at).alias("n"),
                F.when(markdown, F.length(F.regexp_extract(text, HEADING_LINE, 1))).when(named, plain_heading_level(text)).cast("int").alias("level"),
                F.when(markdown, strip_blanks(F.regexp_extract(text, HEADING_LINE, 2))).when(named, strip_blanks(text)).alias("title"),
                F.lit(False).alias("code"),
                F.slice(lines, at + skip + 1, end - at - skip).alias("lines"),
            )

        def text_pieces(start: Column, end: Column) -> Column:
            return let(
                F.filter(_range(start, end), is_break),
                lambda breaks: F.transform(
                    F.sequence(F.lit(0), F.size(breaks)),
                    lambda m: text_piece(F.when(m == 0, start).otherwise(F.get(breaks, m - 1)), F.coalesce(F.get(breaks, m), end), m > 0),
                ),
            )

        def code_piece(at: Column, end: Column) -> Column:
            none = F.lit(None)
            return F.struct(
                at.alias("at"), (end - at).alias("n"), none.cast("int").alias("level"), none.cast("string").alias("title"),
                F.lit(True).alias("code"), F.slice(lines, at + 1, end - at).alias("lines"),
            )

        def around_fences(fences: Column) -> Column:
            def before_and_in(pair: Column) -> Column:
                start = F.when(pair == 0, 0).otherwise(F.coalesce(F.get(fences, 2 * pair - 1) + 1, size))
                opening = F.get(fences, 2 * pair)
                end = F.coalesce(F.get(fences, 2 * pair + 1) + 1, size)
                text = let(F.struct(start.alias("a"), F.coalesce(opening, size).alias("b")), lambda r: text_pieces(r["a"], r["b"]))
                return F.when(opening.isNull(), text).otherwise(F.concat(text, F.array(code_piece(opening, end))))

            pairs = F.ceil(F.size(fences) / 2).cast("int")
            return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), pairs), before_and_in)), lambda p: p["n"] > 0)

        return let(F.filter(_range(F.lit(0), size), lambda i: line(i).rlike(FENCE_LINE)), around_fences)

    return let(F.split(normalised(page), "\\n"), of_lines)


PIECES = "array<struct<at:int,n:int,level:int,title:string,code:boolean,lines:array<string>,page_no:int>>"


def document_pieces(pages: Column, plain: Column) -> Column:
    """The pieces of all pages in order, each with its page from 0; a null page has none."""

    def numbered(page: Column, number: Column) -> Column:
        found = F.transform(page_pieces(page, plain), lambda p: F.struct(*[p[c].alias(c) for c in ("at", "n", "level", "title", "code", "lines")], number.alias("page_no")))
        return F.coalesce(found.cast(PIECES), F.array().cast(PIECES))

    return F.coalesce(F.flatten(F.transform(pages, numbered)), F.array().cast(PIECES))


def in_sections(pieces: Column) -> Column:
    """``array<struct<level,title,pieces>>``: the pieces before the first heading, then those from each heading on."""

    def cut(all_: Column) -> Column:
        heads = F.filter(_range(F.lit(0), F.size(all_)), lambda i: F.get(all_, i)["level"].isNotNull())

        def section(starts: Column, m: Column) -> Column:
            at, end = F.when(m == 0, 0).otherwise(F.get(starts, m - 1)), F.coalesce(F.get(starts, m), F.size(all_))
            head = F.when(m > 0, F.get(all_, at))
            return F.struct(head["level"].alias("level"), head["title"].alias("title"), F.slice(all_, at + 1, end - at).alias("pieces"))

        return let(heads, lambda starts: F.transform(F.sequence(F.lit(0), F.size(starts)), lambda m: section(starts, m)))

    return let(pieces, cut)


UNIT = "array<struct<text:string,sep:string,is_code:boolean,page:int>>"


def block_units(lines: Column, kind: Column, page: Column) -> Column:
    """Units of one block: a fenced block whole, list items one by one, prose by sentence."""

    def unit(text: Column, sep: Column) -> Column:
        return F.struct(
            text.alias("text"), sep.alias("sep"), (kind == "code").alias("is_code"), page.cast("int").alias("page")
        )

    trimmed = F.transform(lines, strip_blanks)
    items = F.transform(trimmed, lambda t, i: unit(t, F.when(i == 0, F.lit("\n\n")).otherwise(F.lit("\n"))))
    prose = F.transform(
        sentences(F.array_join(trimmed, " ")),
        lambda t, i: unit(t, F.when(i == 0, F.lit("\n\n")).otherwise(F.lit(" "))),
    )
    code = F.array(unit(F.array_join(lines, "\n"), F.lit("\n\n")))
    return (
        F.when(kind == "code", code)
        .when(kind == "text", F.when(is_list_block(lines), items).otherwise(prose))
        .otherwise(F.array())
        .cast(UNIT)
    )


def document_sections(pages: Column, plain: Column) -> Column:
    """Ordered sections ``array<struct<path, units>>``; sections without units are dropped."""

    def units(section: Column) -> Column:
        paged = F.size(pages) > 1
        kind = lambda p: F.when(p["code"], F.lit("code")).otherwise(F.lit("text"))
        return F.flatten(F.transform(section["pieces"], lambda p: block_units(p["lines"], kind(p), F.when(paged, p["page_no"] + 1))))

    def with_paths(sections: Column) -> Column:
        paths = heading_paths(F.transform(sections, lambda s: F.struct(s["level"].alias("level"), s["title"].alias("title"))))
        zipped = F.zip_with(sections, paths, lambda s, path: F.struct(path.alias("path"), units(s).alias("units")))
        return F.filter(zipped, lambda s: F.size(s["units"]) > 0)

    return let(in_sections(document_pieces(pages, plain)), with_paths)


def structured_chunks(docs: DataFrame, key: str, limits: PackLimits = PackLimits()) -> DataFrame:
    """Chunk every document of ``docs(key, title, source_label, pages, plain)``.

    Result: ``key, chunk_index, text, heading_path, context_header, overlap_len, page, glued``; a ``glued`` chunk goes on within a
    token, or a line of code, that the one before it begins.
    """

    def first_unit_bare(units: Column) -> Column:
        return F.transform(
            units,
            lambda u, i: F.struct(
                u["text"].alias("text"),
                F.when(i == 0, F.lit("")).otherwise(u["sep"]).alias("sep"),
                u["is_code"].alias("is_code"),
                u["page"].alias("page"),
            ),
        )

    about = [F.struct("title", "source_label").alias("about"), F.col("pages")]
    split = docs.select(key, *about, document_sections(F.col("pages"), F.col("plain")).alias("sections")).withColumn(
        "sections",
        F.transform(
            "sections",
            lambda s: F.struct(
                s["path"].alias("path"),
                F.flatten(F.transform(first_unit_bare(s["units"]), lambda u: long_parts(u, limits.most))).alias("units"),
            ),
        ),
    )
    measured = F.transform(
        "sections",
        lambda s: F.transform(
            s["units"],
            lambda u: F.struct(
                F.length(u["text"]).alias("size"), F.length(u["sep"]).alias("sep"), u["is_code"].alias("code")
            ),
        ),
    )
    bounded = split.withColumn("bounds", _pack_udf(limits)(measured))
    packed = F.flatten(
        F.zip_with(
            F.col("sections"),
            F.col("bounds"),
            lambda s, bounds: F.transform(
                bounds,
                lambda b: F.struct(s["path"].alias("path"), _chunk_of(s["units"], b).alias("chunk")),
            ),
        )
    )
    whole = F.array(
        F.struct(
            F.array().cast("array<string>").alias("path"),
            F.struct(
                strip_blanks(F.array_join("pages", "\n")).alias("text"),
                F.lit(0).alias("overlap_len"),
                F.lit(None).cast("int").alias("page"),
                F.lit(False).alias("glued"),
            ).alias("chunk"),
        )
    )
    # a document in which no line becomes a unit is one chunk of its raw text
    bare = (F.size("packed") == 0) & (strip_blanks(F.array_join("pages", "\n")) != "")
    chunks = bounded.select(key, "pages", "about", packed.alias("packed")).select(
        key, "about", F.posexplode(F.when(bare, whole).otherwise(F.col("packed"))).alias("chunk_index", "piece")
    )
    return chunks.select(
        key,
        "chunk_index",
        F.col("piece.chunk.text").alias("text"),
        F.col("piece.path").alias("heading_path"),
        context_header(F.col("about.title"), F.col("about.source_label"), F.col("piece.path")).alias("context_header"),
        F.col("piece.chunk.overlap_len").alias("overlap_len"),
        F.col("piece.chunk.page").alias("page"),
        F.col("piece.chunk.glued").alias("glued"),
    )


def lesson_pieces(docs: DataFrame, key: str, chunker: str) -> DataFrame:
    """Chunk ``docs(key, title, source_label, pages)`` with the configured chunker; attachments look for plain headings."""
    if chunker == "structured":
        plain = F.coalesce(F.col("source_label"), F.lit("")) != ""
        return structured_chunks(docs.withColumn("plain", plain), key).drop("glued")
    joined = docs.select(key, F.array_join("pages", "\n\n").alias("text"))
    return paragraph_chunks(joined).select(
        key,
        "chunk_index",
        "text",
        F.array().cast("array<string>").alias("heading_path"),
        F.lit("").alias("context_header"),
        F.lit(0).alias("overlap_len"),
        F.lit(None).cast("int").alias("page"),
    )


def stitched_documents(chunks: DataFrame, key: str) -> DataFrame:
    """Rebuild the running text of each document from its chunks; ``glued`` chunks, where known, follow without a blank."""
    glued = F.col("glued") if "glued" in chunks.columns else F.lit(False)
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "text", "overlap_len", glued.alias("glued"))))
    slim = F.transform(ordered, lambda c: F.struct(*[c[n].alias(n) for n in ("text", "overlap_len", "glued")]))
    return chunks.groupBy(key).agg(fold_runs(slim, glued=True).alias("text"))
