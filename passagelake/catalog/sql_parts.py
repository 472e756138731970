"""Named SQL building blocks for the oracle side, and a composer that adds the blocks a statement needs."""

from __future__ import annotations

import re

from passagelake.functions.text import STOPWORDS

_stop = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens_of(text: str) -> str:
    spaced = f"regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    keep = f"t <> '' AND t NOT IN ({_stop}) AND (length(t) >= 2 OR regexp_full_match(t, '[0-9]+'))"
    return f"list_filter(string_split_regex(lower({spaced}), '[^a-z0-9]+'), lambda t: {keep})"


def words_of(text: str) -> str:
    cleaned = f"regexp_replace(lower({text}), '[^a-z0-9$@._-]+', ' ', 'g')"
    stripped = f"list_transform(string_split_regex({cleaned}, '\\s+'), lambda w: regexp_replace(w, '^[._-]+|[._-]+$', '', 'g'))"
    return f"list_filter({stripped}, lambda w: w <> '')"


def grams_of(words: str) -> str:
    """Distinct 3-grams of a list column ``words``."""
    many = f"list_distinct(list_transform(range(1, len({words}) - 1), lambda i: {words}[i] || ' ' || {words}[i+1] || ' ' || {words}[i+2]))"
    return f"CASE WHEN len({words}) >= 3 THEN {many} WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"


PARTS: dict[str, str] = {
    # ---- learning platform
    "users": """
        SELECT 'c' || c_custkey AS user_id, c_name AS name, lower(replace(c_name, '#', '.')) || '@example.org' AS email,
               CASE WHEN c_acctbal < -900 THEN 'admin' ELSE 'student' END AS role, c_custkey AS created_at FROM customer
        UNION ALL
        SELECT 's' || s_suppkey, s_name, lower(replace(s_name, '#', '.')) || '@example.org', 'tutor', s_suppkey FROM supplier""",
    "courses": """
        SELECT p_partkey AS course_id, p_name AS title, p_type || ' ' || p_brand AS description, p_brand AS category,
               's' || (p_partkey % 10) AS tutor_id, p_size > 12 AS published, p_partkey AS created_at FROM part""",
    "purchases": """
        SELECT 'c' || o_custkey AS student_id, l_partkey AS course_id, l_linenumber AS line, l_linestatus AS line_status,
               CAST(l_quantity AS INT) AS quantity, o_orderstatus AS order_status, o_orderdate AS requested_at,
               o_orderkey AS request_id, l_shipdate AS shipped_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "enrolments": "SELECT DISTINCT student_id, course_id FROM purchases WHERE order_status = 'F'",
    "lessons": """
        SELECT course_id, course_id * 10 + lesson_order AS lesson_id, 'Lesson ' || lesson_order AS title,
               'Notes of course ' || course_id AS content, lesson_order
        FROM (SELECT DISTINCT l_partkey AS course_id, l_linenumber AS lesson_order FROM lineitem)""",
    "quizzes": """
        SELECT p_partkey AS quiz_id, p_partkey AS course_id, p_name || ' quiz' AS title,
               [(p_size + i) % 4 FOR i IN [0, 1, 2, 3]] AS correct FROM part""",
    "attempts": """
        SELECT DISTINCT course_id AS quiz_id, student_id, shipped_at AS created_at, line, quantity,
               CASE WHEN line = 7 THEN [(quantity + i * line) % 4 FOR i IN [0, 1, 2]]
                    ELSE [(quantity + i * line) % 4 FOR i IN [0, 1, 2, 3]] END AS answers
        FROM purchases""",
    "posts": """
        SELECT event_id AS post_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS course_id,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS lesson_id, 'c' || user_id AS author_id,
               event_type AS content, CASE WHEN event_type <> 'signup' THEN event_id - (event_id % 5) - 1 END AS parent_id,
               ts AS created_at FROM events""",
    "track_purchases": """
        SELECT student_id, p_type AS track, line, line_status FROM purchases JOIN part ON course_id = p_partkey""",
    "track_lessons": "SELECT DISTINCT track AS course_id, line AS lesson_id FROM track_purchases",
    "track_enrolments": "SELECT DISTINCT student_id, track AS course_id FROM track_purchases",
    "track_completions": """
        SELECT DISTINCT student_id, track AS course_id, line AS lesson_id FROM track_purchases WHERE line_status = 'F'""",
    "track_progress": """
        SELECT e.student_id, e.course_id, coalesce(d.n, 0) AS completed, t.n AS total,
               CASE WHEN t.n > 0 THEN round_even(coalesce(d.n, 0) / t.n * 100, 0) ELSE 0 END AS percent
        FROM track_enrolments e
        LEFT JOIN (SELECT student_id, course_id, count(*) AS n FROM track_completions GROUP BY ALL) d USING (student_id, course_id)
        LEFT JOIN (SELECT course_id, count(*) AS n FROM track_lessons GROUP BY ALL) t USING (course_id)""",
    # ---- requests to see a course, with rights
    "view_requests": """
        SELECT DISTINCT student_id AS viewer, course_id FROM purchases
        UNION ALL SELECT tutor_id, course_id FROM courses
        UNION ALL SELECT NULL, course_id FROM courses""",
    "rights": """
        SELECT r.viewer, r.course_id, c.published,
               r.viewer IS NOT NULL AND coalesce(u.role = 'admin' OR c.tutor_id = r.viewer, false) AS manages,
               (r.viewer IS NOT NULL AND coalesce(u.role = 'admin' OR c.tutor_id = r.viewer, false))
                 OR e.student_id IS NOT NULL AS has_access
        FROM view_requests r JOIN courses c USING (course_id)
        LEFT JOIN users u ON u.user_id = r.viewer
        LEFT JOIN enrolments e ON e.student_id = r.viewer AND e.course_id = r.course_id""",
    # ---- conversations
    "chat_turns": """
        SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a
        JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
        WHERE a.role = 'user' AND b.role = 'assistant'""",
    "open_questions": """
        SELECT a.conv_id, a.turn, a.text AS question FROM conversations a
        WHERE a.role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations b
          WHERE a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant')""",
    # ---- corpus
    "chunks": """
        SELECT doc_id, lang AS course, CAST(i AS INT) AS chunk_index, doc_id * 1000000 + i AS chunk_id,
               CASE WHEN length(t) <= 800 THEN t ELSE substr(t, i * 650 + 1, 800) END AS text
        FROM (SELECT doc_id, lang, t, unnest(range(0, CASE WHEN length(t) <= 800 THEN 1
                ELSE CAST(ceil((length(t) - 800) / 650.0) AS BIGINT) + 1 END)) AS i
              FROM (SELECT doc_id, lang, trim(text, ' \t\n') AS t FROM documents))""".replace("\\t", "\t").replace("\\n", "\n"),
    "chunk_terms": f"SELECT course, doc_id, chunk_id, {tokens_of('text')} AS terms FROM chunks",
    "questions": """
        SELECT course, item_id, text AS question, item_id || '@' || course AS qid
        FROM benchmark, (SELECT DISTINCT lang AS course FROM documents)""",
    "question_terms": f"SELECT DISTINCT course, qid, unnest({tokens_of('question')}) AS term FROM questions",
    "postings": """
        SELECT course, chunk_id, term, count(*) AS tf FROM (SELECT course, chunk_id, unnest(terms) AS term FROM chunk_terms)
        GROUP BY ALL""",
    "course_stats": "SELECT course, count(*) AS docs, sum(len(terms)) / count(*) AS avg_len FROM chunk_terms GROUP BY course",
    "doc_freq": "SELECT course, term, count(*) AS df FROM postings GROUP BY ALL",
    "term_idf": """
        SELECT course, term, df, ln(1 + (docs - df + 0.5) / (df + 0.5)) AS idf FROM doc_freq JOIN course_stats USING (course)""",
    "bm25_all": """
        SELECT q.course, q.qid, p.chunk_id,
               sum(i.idf * (p.tf * 2.2) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * (len(c.terms) / s.avg_len)))) AS score
        FROM question_terms q JOIN postings p ON q.course = p.course AND q.term = p.term
        JOIN term_idf i ON i.course = q.course AND i.term = q.term
        JOIN course_stats s ON s.course = q.course JOIN chunk_terms c ON c.chunk_id = p.chunk_id
        GROUP BY ALL""",
    "bm25_top": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm25_all)
        WHERE rank <= 20""",
    "chunk_slots": """
        SELECT course, chunk_id, ('0x' || substr(md5(term), 1, 2))::INT % 64 AS slot, sum(tf) AS n FROM postings GROUP BY ALL""",
    "chunk_norms": "SELECT course, chunk_id, sqrt(sum(n * n)) AS norm FROM chunk_slots GROUP BY ALL",
    "question_slots": f"""
        SELECT course, qid, ('0x' || substr(md5(term), 1, 2))::INT % 64 AS slot, count(*) AS n
        FROM (SELECT course, qid, unnest({tokens_of('question')}) AS term FROM questions) GROUP BY ALL""",
    "question_norms": "SELECT course, qid, sqrt(sum(n * n)) AS norm FROM question_slots GROUP BY ALL",
    "dense_all": """
        SELECT q.course, q.qid, c.chunk_id, coalesce(d.dot / (qn.norm * cn.norm), 0) AS score
        FROM questions q JOIN chunks c ON q.course = c.course
        LEFT JOIN question_norms qn ON qn.qid = q.qid LEFT JOIN chunk_norms cn ON cn.chunk_id = c.chunk_id
        LEFT JOIN (SELECT a.qid, b.chunk_id, sum(a.n * b.n) AS dot FROM question_slots a
                   JOIN chunk_slots b ON a.course = b.course AND a.slot = b.slot GROUP BY ALL) d
          ON d.qid = q.qid AND d.chunk_id = c.chunk_id""",
    "dense_top": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM dense_all)
        WHERE rank <= 20""",
    "vector_all": """
        SELECT CAST(a.label AS VARCHAR) AS course, CAST(a.vec_id AS VARCHAR) AS qid, b.vec_id AS chunk_id,
               list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id""",
    "vector_top": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vector_all)
        WHERE rank <= 5""",
    "fused": """
        SELECT qid, chunk_id, rrf, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, seen) AS rank
        FROM (SELECT qid, chunk_id, sum(1.0 / (60 + rank)) AS rrf, min(list_no * 1000 + rank) AS seen
              FROM (SELECT qid, chunk_id, rank, 0 AS list_no FROM dense_top UNION ALL SELECT qid, chunk_id, rank, 1 FROM bm25_top)
              GROUP BY ALL)""",
    "pool": """
        SELECT f.qid, f.chunk_id, f.rank, f.rrf, d.score AS dense, coalesce(b.score, 0) AS bm25
        FROM fused f JOIN dense_all d USING (qid, chunk_id) LEFT JOIN bm25_top b USING (qid, chunk_id) WHERE f.rank <= 20""",
    "question_sets": "SELECT qid, list_distinct(list(term)) AS terms FROM question_terms GROUP BY qid",
    "judged": """
        SELECT p.*, CAST(floor(10 * len(list_intersect(q.terms, t.terms)) / len(q.terms)) AS DOUBLE) AS rerank
        FROM pool p JOIN question_sets q USING (qid) JOIN chunk_terms t USING (chunk_id)""",
    "reranked": """
        SELECT * REPLACE (row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, round(rrf, 12) DESC, rank) AS rank) FROM judged""",
}


PARTS.update(
    {
        # ---- evidence and recorded runs
        "item_words": f"SELECT item_id, text, {words_of('text')} AS words FROM benchmark",
        "item_grams": f"SELECT item_id, text, {grams_of('words')} AS grams FROM item_words",
        "doc_words": f"SELECT doc_id, lang, {words_of('text')} AS words FROM documents",
        "doc_grams": f"SELECT doc_id, lang, unnest({grams_of('words')}) AS gram FROM doc_words",
        "span_cover": """
            SELECT i.item_id, d.doc_id, d.lang, any_value(i.text) AS span, count(*) / any_value(i.n) AS coverage
            FROM (SELECT item_id, text, len(grams) AS n, unnest(grams) AS gram FROM item_grams) i JOIN doc_grams d ON i.gram = d.gram
            GROUP BY i.item_id, d.doc_id, d.lang""",
        "gold": """
            SELECT item_id || '@' || lang AS qid, doc_id AS gold_no, CAST(doc_id AS VARCHAR) AS source, span FROM span_cover
            WHERE coverage >= 0.8""",
        "dataset": """
            SELECT q.qid, q.item_id AS position, q.question, CASE WHEN length(q.question) < 240 THEN 'direct' ELSE 'paraphrase' END || '-' || q.course AS category,
                   g.qid IS NOT NULL AS answerable FROM questions q LEFT JOIN (SELECT DISTINCT qid FROM gold) g ON g.qid = q.qid""",
        "split_dataset": """
            SELECT *, CASE WHEN (row_number() OVER (PARTITION BY category ORDER BY position) - 1) % 5 < 2 THEN 'dev' ELSE 'test' END AS split
            FROM dataset""",
        "ranked": """
            SELECT 'basic' AS experiment, 'dense' AS signal_kind, t.qid, t.rank, t.score AS signal, CAST(c.doc_id AS VARCHAR) AS source, c.text
            FROM dense_top t JOIN chunks c ON c.chunk_id = t.chunk_id WHERE t.rank <= 5
            UNION ALL
            SELECT 'advanced', 'rerank', t.qid, t.rank, least(t.score / 8.0, 10), CAST(c.doc_id AS VARCHAR), c.text
            FROM bm25_top t JOIN chunks c ON c.chunk_id = t.chunk_id WHERE t.rank <= 5""",
        "records": """
            SELECT e.experiment, e.signal_kind, q.qid, e.model_calls, length(q.question) * CAST(e.pace AS DOUBLE) AS latency_ms
            FROM questions q, (VALUES ('basic', 'dense', 0, 1.5), ('advanced', 'rerank', 1, 4.0)) e(experiment, signal_kind, model_calls, pace)""",
        "near_gold": f"""
            SELECT r.experiment, r.qid, r.rank, r.signal, g.gold_no, {words_of('r.text')} AS words, i.grams AS wanted
            FROM ranked r JOIN gold g ON g.qid = r.qid AND g.source = r.source JOIN item_grams i ON i.text = g.span""",
        "near_grams": f"SELECT experiment, qid, rank, signal, gold_no, wanted, {grams_of('words')} AS have FROM near_gold",
        "covers": """
            SELECT experiment, qid, rank, signal, gold_no FROM near_grams WHERE len(list_intersect(wanted, have)) / len(wanted) >= 0.8""",
        "gold_sizes": "SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid",
        "first_cover": "SELECT experiment, qid, gold_no, min(rank) AS first_rank FROM covers GROUP BY ALL",
        "gains": """
            SELECT experiment, qid, sum(1 / log2(first_rank + 1)) AS dcg, min(first_rank) AS first
            FROM (SELECT DISTINCT experiment, qid, first_rank FROM first_cover) GROUP BY ALL""",
        "metric_rows": """
            SELECT r.experiment, r.qid, CAST(coalesce(n.first, 99) <= 1 AS DOUBLE) AS hit1, CAST(coalesce(n.first, 99) <= 3 AS DOUBLE) AS hit3,
                   CAST(coalesce(n.first, 99) <= 5 AS DOUBLE) AS hit5, coalesce(s.c3, 0) / z.n_gold AS recall3, coalesce(s.c5, 0) / z.n_gold AS recall5,
                   coalesce(1 / n.first, 0) AS mrr,
                   coalesce(n.dcg, 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, CAST(least(z.n_gold, 5) AS BIGINT) + 1)]) AS ndcg5,
                   coalesce(p.relevant / r.returned, 0) AS precision5
            FROM (SELECT experiment, qid, count(*) AS returned FROM ranked GROUP BY ALL) r JOIN gold_sizes z USING (qid)
            LEFT JOIN gains n USING (experiment, qid)
            LEFT JOIN (SELECT experiment, qid, count(*) FILTER (WHERE first_rank <= 3) AS c3, count(*) AS c5 FROM first_cover GROUP BY ALL) s USING (experiment, qid)
            LEFT JOIN (SELECT experiment, qid, count(DISTINCT rank) AS relevant FROM covers GROUP BY ALL) p USING (experiment, qid)""",
        "kept": """
            SELECT *, best < t AS abstain, best >= t AND signal >= f AS in_context FROM (
              SELECT *, max(signal) OVER (PARTITION BY experiment, qid) AS best, CASE WHEN experiment = 'basic' THEN 0.5 ELSE 5.0 END AS t,
                     CASE WHEN experiment = 'basic' THEN 0.5 ELSE 3.0 END AS f FROM ranked)""",
        "context_rows": """
            SELECT k.experiment, k.qid, coalesce(c.covered, 0) / z.n_gold AS context_recall,
                   coalesce(c.relevant / nullif(k.size, 0), 0) AS context_precision, k.size AS context_size
            FROM (SELECT experiment, qid, count(*) FILTER (WHERE in_context) AS size FROM kept GROUP BY ALL) k JOIN gold_sizes z USING (qid)
            LEFT JOIN (SELECT v.experiment, v.qid, count(DISTINCT v.gold_no) AS covered, count(DISTINCT v.rank) AS relevant FROM covers v
                       JOIN kept USING (experiment, qid, rank) WHERE in_context GROUP BY ALL) c USING (experiment, qid)""",
        "scored_rows": """
            SELECT r.experiment, r.qid, d.category, d.split, d.answerable, d.position, coalesce(a.abstain, true) AS abstain, r.model_calls, r.latency_ms,
                   CASE WHEN d.answerable THEN coalesce(m.hit1, 0) END AS hit1, CASE WHEN d.answerable THEN coalesce(m.recall5, 0) END AS recall5,
                   CASE WHEN d.answerable THEN coalesce(m.mrr, 0) END AS mrr, CASE WHEN d.answerable THEN coalesce(m.ndcg5, 0) END AS ndcg5,
                   CASE WHEN d.answerable THEN coalesce(m.precision5, 0) END AS precision5,
                   CASE WHEN d.answerable THEN coalesce(c.context_recall, 0) END AS context_recall,
                   CASE WHEN d.answerable THEN coalesce(c.context_precision, 0) END AS context_precision,
                   CASE WHEN d.answerable THEN coalesce(c.context_size, 0) END AS context_size
            FROM records r JOIN split_dataset d USING (qid)
            LEFT JOIN (SELECT experiment, qid, bool_and(abstain) AS abstain FROM kept GROUP BY ALL) a USING (experiment, qid)
            LEFT JOIN metric_rows m USING (experiment, qid) LEFT JOIN context_rows c USING (experiment, qid)""",
    }
)

MASK = 4294967295


def _mul32(a: str, b: str) -> str:
    return f"CAST((CAST({a} AS HUGEINT) * ({b})) & {MASK} AS BIGINT)"


def bootstrap_parts(values: str, prefix: str, seed: int, resamples: int = 2000) -> dict[str, str]:
    """Draws for ``values(key, pos, ...)`` with positions from 1: ``{prefix}_draws(key, r, pos)``."""
    state = f"(({seed} + (CAST(r AS BIGINT) * n + i + 1) * 1831565813) & {MASK})"
    return {
        f"{prefix}_n": f"SELECT key, count(*) AS n FROM {values} GROUP BY key",
        f"{prefix}_a": f"""
            SELECT key, n, r, {state} AS a FROM {prefix}_n, (SELECT unnest(range({resamples})) AS r), LATERAL (SELECT unnest(range(n)) AS i)""",
        f"{prefix}_t": f"SELECT key, n, r, {_mul32('xor(a, a >> 15)', 'a | 1')} AS t FROM {prefix}_a",
        f"{prefix}_u": f"SELECT key, n, r, xor(t, (t + {_mul32('xor(t, t >> 7)', 't | 61')}) & {MASK}) AS u FROM {prefix}_t",
        f"{prefix}_draws": f"SELECT key, r, CAST(floor(xor(u, u >> 14) / 4294967296.0 * n) AS BIGINT) + 1 AS pos FROM {prefix}_u",
    }


def floor_percentile(values: str, p: float) -> str:
    """sorted[min(n-1, floor(p*n))] of an aggregate expression."""
    listed = f"list_sort(list({values}) FILTER (WHERE {values} IS NOT NULL))"
    return f"{listed}[CAST(least(count({values}), floor({p} * count({values})) + 1) AS INT)]"


def mmr_parts(source: str, relevance: str, prefix: str, carry: str = "NULL", k: int = 5, lam: float = 0.75) -> dict[str, str]:
    """The greedy selection unrolled: one block per pick over ``source(qid, chunk_id, rank)``."""
    pool, pairs = f"{prefix}_pool", f"{prefix}_pairs"
    parts = {
        pool: f"SELECT qid, chunk_id, rank AS pos, {relevance} AS rel, {carry} AS carried FROM {source} WHERE rank <= {2 * k}",
        f"{prefix}_sets": f"SELECT chunk_id, list_distinct(terms) AS s FROM chunk_terms WHERE chunk_id IN (SELECT chunk_id FROM {pool})",
        pairs: f"""
            SELECT a.qid, a.pos AS pa, b.pos AS pb, CASE WHEN len(x.s) = 0 OR len(y.s) = 0 THEN 0 ELSE
              len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) END AS sim
            FROM {pool} a JOIN {pool} b ON a.qid = b.qid AND a.pos <> b.pos
            JOIN {prefix}_sets x ON x.chunk_id = a.chunk_id JOIN {prefix}_sets y ON y.chunk_id = b.chunk_id""",
    }
    picked = []
    for n in range(1, k + 1):
        if picked:
            parts[f"{prefix}_before{n}"] = " UNION ALL ".join(f"SELECT qid, pos FROM {p}" for p in picked)
            parts[f"{prefix}_overlap{n}"] = f"""
                SELECT r.qid, r.pa AS pos, max(r.sim) AS sim FROM {pairs} r
                JOIN {prefix}_before{n} s ON s.qid = r.qid AND s.pos = r.pb GROUP BY ALL"""
            overlap = "coalesce(o.sim, 0)"
            rest = f"""LEFT JOIN {prefix}_overlap{n} o ON o.qid = p.qid AND o.pos = p.pos
                LEFT JOIN {prefix}_before{n} x ON x.qid = p.qid AND x.pos = p.pos WHERE x.pos IS NULL"""
        else:
            overlap, rest = "0", ""
        parts[f"{prefix}_gain{n}"] = f"""
            SELECT p.qid, p.chunk_id, p.pos, p.carried, round({lam} * p.rel - (1 - {lam}) * {overlap}, 12) AS gain FROM {pool} p {rest}"""
        parts[f"{prefix}_pick{n}"] = f"""
            SELECT qid, chunk_id, pos, carried, {n} AS pick FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY gain DESC, pos) AS n
            FROM {prefix}_gain{n}) WHERE n = 1"""
        picked.append(f"{prefix}_pick{n}")
    parts[f"{prefix}_picked"] = " UNION ALL ".join(f"SELECT qid, chunk_id, pick, carried FROM {p}" for p in picked)
    return parts


def passage_parts(hits: str, prefix: str, radius: int, max_chars: int) -> dict[str, str]:
    """Passages of ``hits(qid, chunk_id, rank, signal)`` over the plain chunk table (no overlap is recorded there)."""
    return {
        f"{prefix}_near": f"""
            SELECT DISTINCT h.qid, n.doc_id, n.chunk_index, n.chunk_id, n.text FROM {hits} h
            JOIN chunks c ON c.chunk_id = h.chunk_id
            JOIN chunks n ON n.doc_id = c.doc_id AND n.chunk_index BETWEEN c.chunk_index - {radius} AND c.chunk_index + {radius}""",
        f"{prefix}_runs": f"""
            SELECT *, chunk_index - row_number() OVER (PARTITION BY qid, doc_id ORDER BY chunk_index) AS run FROM {prefix}_near""",
        f"{prefix}_all": f"""
            SELECT r.qid, min(h.rank) AS rank, r.doc_id, arg_min(r.chunk_index, h.rank) AS chunk_index, arg_min(h.signal, h.rank) AS score,
                   string_agg(CASE WHEN r.chunk_index = r.first_index THEN r.text ELSE ltrim(r.text, ' ' || chr(10)) END,
                              chr(10) || chr(10) ORDER BY r.chunk_index) AS text, count(*) AS pieces
            FROM (SELECT *, min(chunk_index) OVER (PARTITION BY qid, doc_id, run) AS first_index FROM {prefix}_runs) r
            LEFT JOIN {hits} h ON h.qid = r.qid AND h.chunk_id = r.chunk_id GROUP BY r.qid, r.doc_id, r.run""",
        f"{prefix}_passages": f"""
            SELECT * FROM (SELECT *, sum(length(text)) OVER w AS total, row_number() OVER w AS position FROM {prefix}_all
              WHERE rank IS NOT NULL WINDOW w AS (PARTITION BY qid ORDER BY rank)) WHERE position = 1 OR total <= {max_chars}""",
    }


def compose(final: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the blocks the statement mentions, directly or through other blocks, in dependency order."""
    known = {**PARTS, **(extra or {})}
    name = re.compile(r"\b(" + "|".join(sorted(known, key=len, reverse=True)) + r")\b")
    ordered: list[str] = []

    def visit(sql: str, path: tuple[str, ...]) -> None:
        for found in dict.fromkeys(name.findall(sql)):
            if found not in ordered and found not in path:
                visit(known[found], (*path, found))
                ordered.append(found)

    visit(final, ())
    blocks = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in ordered)
    return f"WITH {blocks}\n{final}" if blocks else final
