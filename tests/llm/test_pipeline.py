"""The stages of the corpus pipeline, each on its own input, against brute force."""

import random

import pytest
from test_joins import brute_components, brute_lines, brute_tiles, words

import corpus_pipeline
from passagelake.llm import stages

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    """A small corpus with toxic texts, repeated lines, near copies, benchmark passages, and odd rows."""
    rng, rows, marks = random.Random(4), [], []
    shared = [prose(12, 800 + k) for k in range(3)]
    items = [(k, prose(30, 600 + k)) for k in range(3)]
    for k in range(240):
        lines = [prose(14, 2000 + 10 * k + j) for j in range(6)]
        if k % 6 == 0:
            lines = [" ".join(w if rng.random() < 0.7 else rng.choice(["idiot", "scum", "moron"]) for w in x.split()) for x in lines]
        elif k % 6 == 1 and k > 12:
            lines = shared + lines
        elif k % 6 == 2 and k > 12:
            lines = rows[2][1].split("\n")
            lines[k % 5] = lines[k % 5] + " " + prose(2, k)
        elif k == 9:
            lines.insert(3, items[1][1])
        rows.append((k, "\n".join(lines)))
        marks.append((k, 1, int(k % 6 == 0)))
    rows += [(300, None), (301, ""), (302, " \n "), (303, "short"), (303, "short"), (None, "no id")]
    path = str(tmp_path_factory.mktemp("corpus"))
    table = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(table, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_each_stage_on_what_the_one_before_kept(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    from passagelake.sources.stores import materialise

    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        columns = docs.columns
        docs = materialise(stage(spark, docs, path), name)
        seen[name] = before
        if name != "packing":
            assert docs.columns == columns
    after = {a: seen[b] for a, b in zip(seen, list(seen)[1:])}
    key = lambda rows: sorted(rows, key=str)
    toxic = {i for i, _ in seen["toxicity"] if i is not None and i < 240 and i % 6 == 0}
    left = {i for i, _ in after["toxicity"]}
    assert len(toxic & left) <= 2 and {i for i, _ in seen["toxicity"]} - toxic <= left
    expected = brute_lines(seen["line_dedup"])
    held = lambda t: sum(bool(x.strip()) for x in (t or "").split("\n"))
    was = dict(seen["line_dedup"])
    assert key(after["line_dedup"]) == key((i, t) for i, t, gone in expected if not gone or gone < held(was[i]))
    kept = {c for _, _, c in brute_components(seen["ngram_jaccard_join"], 5, 4, 5)}
    assert {i for i, _ in after["ngram_jaccard_join"]} == kept
    hit = lambda t: any(brute_tiles(words(t), words(x), 4) >= 0.8 * len(words(x)) for _, x in items)
    assert key(after["benchmark_decontamination"]) == key((i, t) for i, t in seen["benchmark_decontamination"] if not hit(t))
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in seen["packing"]}
    once = [r for r in pieces if r.doc_id is not None and r.doc_id != 303]  # 303 may stand twice
    assert sum(r.length for r in once) == sum({r.doc_id: r.doc_tokens for r in once}.values())


def test_stages_on_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for stage in (stages.toxicity, stages.line_dedup, stages.near_duplicates, stages.decontamination):
        out = stage(spark, empty, path)
        assert out.columns == empty.columns and out.count() == 0
    assert stages.packing(spark, empty, path).count() == 0
