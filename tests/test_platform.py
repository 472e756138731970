import json

import pytest
from pyspark.sql import functions as F

from passagelake.operators import learning as le
from passagelake.sources import corpus
from passagelake.sources.stores import ChunkTable


def test_progress_rounds_half_to_even(spark):
    enrol = spark.createDataFrame([("s", "c")], "student_id string, course_id string")
    lessons = spark.createDataFrame([("c", i) for i in range(8)], "course_id string, lesson_id int")
    done = spark.createDataFrame([("s", "c", i) for i in (0, 1, 2, 3, 4, 4)], "student_id string, course_id string, lesson_id int")
    row = le.progress(enrol, done, lessons).first()
    assert (row.completed, row.total, row.percent) == (5, 8, 62)


def test_quiz_scoring_and_rejects(spark):
    quizzes = spark.createDataFrame([(1, [("a", ["x", "y"], 1), ("b", ["x", "y"], 0)])], "quiz_id int, questions array<struct<text:string,options:array<string>,correct:int>>")
    attempts = spark.createDataFrame([(1, "s", [1, 1]), (1, "t", [1])], "quiz_id int, student_id string, answers array<int>")
    scored = le.scored_attempts(attempts, quizzes).collect()
    assert [(r.student_id, r.score, r.total) for r in scored] == [("s", 1, 2)]
    assert [r.student_id for r in le.rejected_attempts(attempts, quizzes).collect()] == ["t"]


def test_questions_of_all_quizzes_are_never_broadcast(spark):
    """Spark estimates an array by one element, so a table of a few MB on disk would be sent whole, with all its questions."""
    question = F.struct(F.lit("q").alias("text"), F.array(F.lit("A"), F.lit("B")).alias("options"), F.lit(1).alias("correct"))
    quizzes = spark.range(5).select(F.col("id").alias("quiz_id"), F.col("id").alias("course_id"), F.lit("t").alias("title"), F.array(question, question).alias("questions"))
    attempts = spark.range(50).select((F.col("id") % 5).alias("quiz_id"), F.array(F.lit(1), F.lit(0)).alias("answers"))
    rights = spark.range(50).select(F.lit("v").alias("viewer"), (F.col("id") % 5).alias("course_id"), *[F.lit(True).alias(c) for c in ("published", "manages", "has_access")])
    for rows, n in ((le.quiz_marks(attempts, quizzes), 50), (le.gated_quizzes(rights, quizzes), 50), (le.quizzes_with_answers(rights, quizzes), 50)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == n


def test_lesson_files(spark, tmp_path):
    (tmp_path / "b.md").write_text("# Beta\r\n\r\nBody b.\r\n")
    (tmp_path / "a.md").write_text("Alpha\nBody a.")
    rows = corpus.read_lessons(spark, str(tmp_path)).orderBy("lesson_order").collect()
    assert [(r.slug, r.title, r.content, r.lesson_order) for r in rows] == [("a", "Alpha", "Body a.", 0), ("b", "Beta", "Body b.", 1)]


def test_question_file(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text(json.dumps({"id": "1", "category": "direct", "question": "q?", "gold": [{"lesson": "l", "span": "s"}]}) + "\n\n")
    row = corpus.read_questions(spark, str(good)).first()
    assert row.answerable and row.history == [] and row.gold[0].lesson == "l"
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": \n')
    with pytest.raises(Exception):
        corpus.read_questions(spark, str(bad)).collect()


def test_chunk_table_rewrites_only_the_partitions_of_replaced_documents(spark, tmp_path):
    store = ChunkTable(spark, str(tmp_path / "table"), F.col("lesson"), buckets=8)
    rows = lambda *x: spark.createDataFrame(list(x), "course string, lesson string, text string")
    files = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    texts = lambda: sorted(r.text for r in store.read().collect())
    assert store.read() is None
    first = [(c, f"{c}{i}", f"{c}{i} old") for c in ("01", "2") for i in range(20)]
    store.publish(rows(*first), rows(*first))
    assert texts() == sorted(t for _, _, t in first)
    before = files()
    for _ in range(2):  # the same batch once more changes nothing
        store.publish(rows(("01", "013", "new"), ("01", "013", "more")), rows(("01", "013", "")))
        assert texts() == sorted([t for _, x, t in first if x != "013"] + ["new", "more"])
    after = files()
    kept = {f for f in before if after.get(f) == before[f]}
    changed = {f.rsplit("/", 1)[0] for f in set(before) - kept}
    assert len(changed) == 1 and all("_course=c01" in f for f in changed) and len(kept) == len(before) - len([f for f in before if f.rsplit("/", 1)[0] in changed])
    assert "old" not in {r.text for r in spark.read.parquet(str(tmp_path / "table")).where("lesson = '013'").collect()}
    gone = rows(*[x for x in first if x[0] == "2"])
    store.publish(gone.limit(0), gone)  # a course loses all its documents
    assert {r.course for r in store.read().collect()} == {"01"}


def test_a_second_stream_on_a_filled_table_is_not_dropped(spark, tmp_path):
    from passagelake.streaming import jobs

    names = "course string, lesson string, source string, attachment_id string, body string, changed_at int, change_id int"
    store = ChunkTable(spark, str(tmp_path / "table"), F.col("lesson"))
    index = lambda docs, batch: docs.select("course", "lesson", F.col("body").alias("text"))
    for n in (1, 2):
        spark.createDataFrame([("c", f"l{n}", "content", None, f"text {n}", 1, 1)], names).write.parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema(names).parquet(str(tmp_path / f"in{n}"))
        jobs.incremental_index(stream, store, index, str(tmp_path / f"cp{n}"), availableNow=True).awaitTermination()
    assert sorted(r.text for r in store.read().collect()) == ["text 1", "text 2"]


def test_a_late_repeat_of_a_lesson_counts_once(spark, tmp_path):
    from passagelake.streaming import jobs

    schema, path = "student_id string, course_id string, lesson_id int, ts timestamp", str(tmp_path / "in")
    totals = spark.createDataFrame([("c", 3)], "course_id string, total int")
    issued = lambda: spark.read.parquet(str(tmp_path / "out")).count()
    for n, lessons in enumerate([[1, 2], [1], [3]]):
        when = f"timestamp '2024-01-{n + 1:02d} 00:00:00'"
        batch = spark.createDataFrame([("s", "c", x) for x in lessons], "student_id string, course_id string, lesson_id int").withColumn("ts", F.expr(when))
        batch.write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        jobs.certificate_stream(stream, totals, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
        assert issued() == (1 if n == 2 else 0)


def test_entry_without_the_training_text_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("passagelake.llm")] + ["passagelake.llm"]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "R8_dense_top_k" in entry.queries() and "pipeline" not in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_and_its_sql(spark):
    """Each registered query against its SQL on the smallest driver tables, where they are present."""
    import os

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("driver tables are not here")
    duckdb = pytest.importorskip("duckdb")
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known)
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    for key in ("A1_lesson_corpus", "I1_paragraph_chunks", "I5_heading_paths", "R5_bm25_top_k", "R8_dense_top_k", "L12_progress", "L20_threads", "E14_threshold_sweep", "I16_snapshots", "S1_incremental_index", "L25_cascade_counts", "L25_cascade_remaining", "I3_sentences", "E5_covering_pairs", "R10_approximate_top_k", "R17_rerank_merge", "R27_trace"):
        mine = known[key](spark, folder)
        theirs = con.sql(sql[key])
        columns = sorted(mine.columns)
        assert columns == sorted(theirs.columns)
        at = [theirs.columns.index(c) for c in columns]
        shown = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
        a = sorted(tuple(map(shown, r)) for r in mine.select(*columns).collect())
        b = sorted(tuple(shown(r[i] if not hasattr(r[i], "as_tuple") else float(r[i])) for i in at) for r in theirs.fetchall())
        assert a == b, key
