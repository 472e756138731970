import re

from pyspark.sql import functions as F

from passagelake.operators import chunking as ch

DOC = "k long, title string, source_label string, pages array<string>, plain boolean"


def chunks(spark, pages, title="T", label="", plain=False, **limits):
    docs = spark.createDataFrame([(1, title, label, pages, plain)], DOC)
    return ch.structured_chunks(docs, "k", ch.PackLimits(**limits)).orderBy("chunk_index").collect()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_sentences_keep_abbreviations_and_decimals(spark):
    text = "Use a cache, e.g. Redis, for hot reads. Version 3.14 shipped last week. It is fast! Is it safe? Yes."
    assert one(spark, ch.sentences(F.lit(text))) == [
        "Use a cache, e.g. Redis, for hot reads.", "Version 3.14 shipped last week.", "It is fast!", "Is it safe?", "Yes.",
    ]


def test_heading_paths_and_headers(spark):
    text = "# Closures\n\nIntro here.\n\n## Private state\n\nState is hidden.\n\n### Counters\n\nA counter example."
    rows = chunks(spark, [text], "Closures")
    assert [r.heading_path for r in rows] == [["Closures"], ["Closures", "Private state"], ["Closures", "Private state", "Counters"]]
    assert [r.context_header for r in rows] == ["Closures", "Closures > Private state", "Closures > Private state > Counters"]


def test_long_sentence_and_token_respect_the_limit(spark):
    rows = chunks(spark, ["word " * 600 + "end.\n\n" + "x" * 2500])
    assert len(rows) > 3 and max(len(r.text) for r in rows) <= 900


def test_fenced_code_stays_whole(spark):
    code = "```js\nfunction counter() {\n  let n = 0;\n# not a heading\n}\n```"
    rows = chunks(spark, [f"Intro sentence.\n\n{code}\n\nOutro sentence."])
    assert len(rows) == 1 and code in rows[0].text


def test_overlap_is_the_tail_of_the_previous_chunk(spark):
    base = "This is one sentence of moderate length used for packing tests."
    rows = chunks(spark, [" ".join(base.replace("one", f"no. {i}") for i in range(30))], target=300, most=500)
    assert len(rows) > 3
    for before, after in zip(rows, rows[1:]):
        if after.overlap_len:
            repeated = after.text[: after.overlap_len].strip()
            assert before.text.endswith(repeated) and repeated.endswith(".")


def test_stitching_reproduces_the_text(spark):
    text = " ".join(f"Sentence number {i} explains topic {i} in some detail." for i in range(20))
    docs = spark.createDataFrame([(1, "T", "", [text], False)], DOC)
    pieces = ch.structured_chunks(docs, "k", ch.PackLimits(target=250, most=400))
    assert re.sub(r"\s+", " ", ch.stitched_documents(pieces, "k").first().text).strip() == text


def test_stitching_glues_cut_tokens_and_keeps_blanks(spark):
    code = "```\n" + "y" * 950 + "\nz = 1\n```"
    texts = ["Before it. " + "x" * 2500 + " after it.", "word " * 300 + "w" * 901, "a" * 900 + " " + "b" * 900, f"Text.\n\n{code}"]
    docs = spark.createDataFrame([(i, "T", "", [t], False) for i, t in enumerate(texts)], DOC)
    found = {r.k: r.text for r in ch.stitched_documents(ch.structured_chunks(docs, "k"), "k").collect()}
    assert [re.sub(r"\s+", " ", found[i]).strip() for i in range(len(texts))] == [re.sub(r"\s+", " ", t).strip() for t in texts]


def test_pages_are_tracked(spark):
    page = lambda label: " ".join(f"{label} sentence {i} has some words in it." for i in range(30))
    rows = chunks(spark, [page("First"), page("Second")])
    assert {r.page for r in rows} == {1, 2}
    assert chunks(spark, ["single page only"])[0].page is None


def test_chunking_shuffles_nothing(spark):
    docs = spark.createDataFrame([(1, "T", "", ["# A\n\nText."], False)], DOC)
    plan = ch.structured_chunks(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_pieces_of_fences_headings_and_blanks(spark):
    text = "lead\n```\n# code\n```\n# One\n\ntwo\nthree\n``` open\nto the end"
    found = one(spark, ch.document_pieces(F.array(F.lit(text), F.lit(None).cast("string"), F.lit("")), F.lit(False)))
    assert [(p.page_no, p.at, p.n, p.level, p.title, p.code, p.lines) for p in found] == [
        (0, 0, 1, None, None, False, ["lead"]),
        (0, 1, 3, None, None, True, ["```", "# code", "```"]),
        (0, 4, 1, 1, "One", False, []),
        (0, 5, 3, None, None, False, ["two", "three"]),
        (0, 8, 2, None, None, True, ["``` open", "to the end"]),
        (2, 0, 1, None, None, False, []),
    ]
    assert one(spark, ch.document_pieces(F.lit(None).cast("array<string>"), F.lit(True))) == []


def test_many_lines_and_fences_take_linear_time(spark):
    text = "\n".join(["# Head", "Some words here.", "", "```", "code", "```"] * 2_000)
    rows = chunks(spark, [text])
    assert len(rows) == 2_000 and {r.text for r in rows} == {"Some words here.\n\n```\ncode\n```"}


def test_plain_headings_only_when_enabled(spark):
    text = (
        "Handbook\nIntro line that is long enough to be body text and ends properly.\n1. Pagination\n"
        "Body text about paging goes here and ends.\n2. Connection pooling\nBody text about pools goes here and ends."
    )
    on = chunks(spark, [text], "L", "f.pdf", True)
    assert ["1. Pagination"] in [r.heading_path for r in on] and ["2. Connection pooling"] in [r.heading_path for r in on]
    assert len(chunks(spark, [text], "L", "f.pdf")) == 1


def test_empty_and_heading_only_documents(spark):
    assert chunks(spark, ["   \n\n  "]) == []
    only = chunks(spark, ["# Only\n## Heads"])
    assert [r.text for r in only] == ["# Only\n## Heads"] and only[0].heading_path == []


def test_astral_characters_survive(spark):
    emoji = "😀" * 2000
    assert "".join(r.text for r in chunks(spark, [emoji])) == emoji


def test_paragraph_chunker(spark):
    pack = lambda t: one(spark, ch.paragraph_pieces(F.lit(t)))
    assert pack("  ") == [""]
    assert pack("a\n\n\n b ") == ["a\n\nb"]
    long = "".join(chr(97 + i % 26) for i in range(1700))
    assert pack(long) == [long[0:800], long[650:1450], long[1300:1700]]
    first, second = "x" * 500, "y" * 400
    assert pack(f"{first}\n\n{second}") == [first, first[-150:] + "\n\n" + second]


def test_header_and_embed_text(spark):
    assert one(spark, ch.context_header(F.lit("Lesson"), F.lit("f.pdf"), F.array(F.lit("Sec")))) == "Lesson (f.pdf) > Sec"
    assert one(spark, ch.embed_text(F.lit("H"), F.lit("N"), F.lit("T"))) == "H\n\nN\n\nT"
    assert one(spark, ch.embed_text(F.lit(""), F.lit(""), F.lit("T"))) == "T"


def test_pack_bounds_against_brute_force():
    import random

    limits = ch.PackLimits(target=60, most=90, least=12, overlap=14)
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 25)
        sizes = [rng.randint(1, 90) for _ in range(n)]
        seps = [0] + [rng.choice([1, 2]) for _ in range(n - 1)]
        codes = [rng.random() < 0.1 for _ in range(n)]
        bounds = ch.pack_bounds(sizes, seps, codes, limits)
        assert [b[1] for b in bounds[1:]] == [b[2] for b in bounds[:-1]] and bounds[0][1] == 0 and bounds[-1][2] == n
        for carry, first, end in bounds:
            assert carry <= first < end
            total = sum(sizes[carry:end]) + sum(seps[carry + 1 : end])
            assert total <= limits.most
            repeated = sum(sizes[carry:first]) + sum(seps[carry + 1 : first])
            assert repeated <= limits.overlap and not any(codes[carry:first])


def test_unicode_blank_lines_part_paragraphs(spark):
    first, second = "a" * 500, "b" * 500
    text = first + "\n\u00a0\u2003\n" + second
    got = spark.createDataFrame([(1, text)], "doc_id long, text string")
    from passagelake.operators.chunking import paragraph_chunks

    pieces = [r.text for r in paragraph_chunks(got).orderBy("chunk_index").collect()]
    assert [len(p) for p in pieces] == [500, 652] and pieces[1] == first[-150:] + "\n\n" + second
