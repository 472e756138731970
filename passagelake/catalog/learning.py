"""Learning-platform queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagelake.catalog.registry import query
from passagelake.operators import learning as le
from passagelake.operators.chunking import paragraph_chunks
from passagelake.sources.tables import Lake


def view_requests(lake: Lake):
    """Everyone who ordered a course, its tutor, and an anonymous visitor."""
    courses = lake.courses()
    buyers = lake.purchases().select(F.col("student_id").alias("viewer"), "course_id").distinct()
    tutors = courses.select(F.col("tutor_id").alias("viewer"), "course_id")
    return buyers.unionByName(tutors).unionByName(courses.select(F.lit(None).cast("string").alias("viewer"), "course_id"))


def rights(lake: Lake):
    return le.access_rights(view_requests(lake), lake.courses(), lake.users(), lake.enrolments())


# ---------------------------------------------------------------- catalog and access


@query(
    "L1_catalog",
    """
    SELECT course_id, title, category, u.name AS tutor_name FROM courses c LEFT JOIN users u ON u.user_id = c.tutor_id WHERE published""",
)
def catalog(lake: Lake):
    return le.catalog(lake.courses(), lake.users()).select("course_id", "title", "category", "tutor_name")


@query(
    "L1_catalog_category",
    "SELECT course_id, title, u.name AS tutor_name FROM courses c LEFT JOIN users u ON u.user_id = c.tutor_id WHERE published AND category = 'Brand#3'",
)
def catalog_category(lake: Lake):
    return le.catalog(lake.courses(), lake.users(), category="Brand#3").select("course_id", "title", "tutor_name")


@query(
    "L2_text_search",
    """
    SELECT course_id, title FROM courses WHERE published AND
      len(list_intersect(string_split_regex(lower(title || ' ' || description), '[^a-z0-9]+'), ['blue', 'gear'])) > 0""",
)
def text_search(lake: Lake):
    return le.catalog(lake.courses(), lake.users(), search="the Blue gear", stem=False).select("course_id", "title")


@query("L3_own_courses", "SELECT tutor_id, course_id, published FROM courses WHERE tutor_id IN (SELECT user_id FROM users WHERE role = 'tutor')")
def own_courses(lake: Lake):
    tutors = lake.users().where(F.col("role") == "tutor").select(F.col("user_id").alias("tutor_id"))
    return le.own_courses(lake.courses(), tutors).select("tutor_id", "course_id", "published")


@query("L4_categories", "SELECT DISTINCT category FROM courses WHERE category <> ''")
def categories(lake: Lake):
    return le.categories(lake.courses())


@query("L5_access_rights", "SELECT viewer, course_id, published, manages, has_access FROM rights")
def access_rights(lake: Lake):
    return rights(lake).select("viewer", "course_id", "published", "manages", "has_access")


@query(
    "L6_gated_lessons",
    """
    SELECT r.viewer, r.course_id, l.lesson_id, l.title, l.lesson_order, CASE WHEN r.has_access THEN l.content END AS content, r.has_access
    FROM rights r JOIN lessons l USING (course_id) WHERE r.published OR r.manages""",
)
def gated_lessons(lake: Lake):
    return le.gated_lessons(rights(lake), lake.lessons()).select("viewer", "course_id", "lesson_id", "title", "lesson_order", "content", "has_access")


@query(
    "L6_gated_quizzes",
    """
    SELECT r.viewer, r.quiz_id, r.title, CASE WHEN has_access THEN 'Question 0,Question 1,Question 2,Question 3' END AS questions,
           CASE WHEN NOT has_access THEN 4 END AS question_count
    FROM (SELECT * FROM rights JOIN quizzes USING (course_id)) r WHERE published OR manages""",
)
def gated_quizzes(lake: Lake):
    shown = le.gated_quizzes(rights(lake), lake.quizzes())
    return shown.select("viewer", "quiz_id", "title", F.array_join(F.transform("questions", lambda q: q["text"]), ",").alias("questions"), "question_count")


@query("L7_accessible_lessons", "SELECT r.viewer, l.lesson_id, l.content FROM rights r JOIN lessons l USING (course_id) WHERE has_access")
def accessible_lessons(lake: Lake):
    return le.accessible(rights(lake), lake.lessons()).select("viewer", "lesson_id", "content")


@query("L7_quizzes_with_answers", "SELECT r.viewer, q.quiz_id, array_to_string(q.correct, ',') AS answers FROM rights r JOIN quizzes q USING (course_id) WHERE manages")
def quizzes_with_answers(lake: Lake):
    shown = le.quizzes_with_answers(rights(lake), lake.quizzes())
    return shown.select("viewer", "quiz_id", F.array_join(F.transform("questions", lambda q: q["correct"].cast("string")), ",").alias("answers"))


@query(
    "L9_changed_lessons",
    """
    SELECT lesson_id, NOT (coalesce(lesson_order, 0) BETWEEN 2 AND 5) OR course_id % 5 = 0 AS reindex FROM lessons""",
)
def changed_lessons(lake: Lake):
    """Before: first lessons are missing, sixth had no content, seventh another title; every fifth course was rewritten."""
    after = lake.lessons()
    before = after.where(F.col("lesson_order") != 1).withColumns(
        {
            "title": F.when(F.col("lesson_order") == 7, F.lit("Old")).otherwise(F.col("title")),
            "content": F.when(F.col("lesson_order") == 6, F.lit(None)).when(F.col("course_id") % 5 == 0, F.lit("old")).otherwise(F.col("content")),
        }
    )
    return le.changed_lessons(before, after).select("lesson_id", "reindex")


# ---------------------------------------------------------------- enrolment


@query(
    "L10_first_enrolments",
    """
    SELECT student_id, course_id, min(request_id) FILTER (WHERE requested_at = first_at) AS request_id FROM (
      SELECT *, min(requested_at) OVER (PARTITION BY student_id, course_id) AS first_at FROM purchases
      WHERE course_id IN (SELECT course_id FROM courses WHERE published)) GROUP BY student_id, course_id""",
)
def first_enrolments(lake: Lake):
    return le.first_enrolments(lake.enrolment_requests(), lake.courses()).select("student_id", "course_id", "request_id")


@query(
    "L11_my_enrolments",
    """
    SELECT student_id, course_id, title, category FROM (SELECT DISTINCT student_id, course_id FROM purchases
      WHERE course_id IN (SELECT course_id FROM courses WHERE published)) JOIN courses USING (course_id)""",
)
def my_enrolments(lake: Lake):
    enrolled = le.first_enrolments(lake.enrolment_requests(), lake.courses())
    return le.my_enrolments(enrolled, lake.courses()).select("student_id", "course_id", "title", "category")


@query(
    "L11_enrolment_lookup",
    """
    SELECT DISTINCT p.student_id, p.course_id, e.student_id IS NOT NULL AS enrolled FROM purchases p LEFT JOIN enrolments e USING (student_id, course_id)""",
)
def enrolment_lookup(lake: Lake):
    asked = lake.purchases().select("student_id", "course_id").distinct()
    found = le.enrolment_lookup(asked, lake.enrolments().withColumn("row", F.lit(1)))
    return found.select("student_id", "course_id", F.col("row").isNotNull().alias("enrolled"))


@query("L12_progress", "SELECT student_id, course_id, completed, total, percent FROM track_progress")
def progress(lake: Lake):
    return track_progress(lake).select("student_id", "course_id", "completed", "total", "percent")


def track_progress(lake: Lake):
    return le.progress(lake.track_enrolments(), lake.track_completions(), lake.track_lessons())


def issued(lake: Lake):
    """Certificates that already exist: those of students with an even key."""
    return lake.track_enrolments().where(F.substring("student_id", 2, 20).cast("long") % 2 == 0)


@query(
    "L13_new_certificates",
    "SELECT student_id, course_id FROM track_progress WHERE percent = 100 AND CAST(substr(student_id, 2) AS BIGINT) % 2 = 1",
)
def new_certificates(lake: Lake):
    return le.new_certificates(track_progress(lake), issued(lake))


@query(
    "L14_certificate_listing",
    "SELECT student_id, course_id, u.name AS student_name, 'Track ' || course_id AS course_title FROM track_progress JOIN users u ON u.user_id = student_id WHERE percent = 100",
)
def certificate_listing(lake: Lake):
    none = issued(lake).where(F.lit(False))
    titles = lake.track_lessons().select("course_id", F.concat(F.lit("Track "), "course_id").alias("title")).distinct()
    return le.certificate_listing(le.new_certificates(track_progress(lake), none), lake.users(), titles)


@query(
    "L30_completion_marks",
    """
    SELECT e.student_id, e.course_id, l.lesson_id, d.student_id IS NOT NULL AS completed FROM track_enrolments e JOIN track_lessons l USING (course_id)
    LEFT JOIN track_completions d ON d.student_id = e.student_id AND d.course_id = e.course_id AND d.lesson_id = l.lesson_id""",
)
def completion_marks(lake: Lake):
    return le.completion_marks(lake.track_enrolments(), lake.track_lessons(), lake.track_completions())


# ---------------------------------------------------------------- quizzes

MARKED = {
    "marked": """
        SELECT a.quiz_id, a.student_id, a.created_at, a.line, a.quantity, a.answers, q.correct, len(a.answers) = len(q.correct) AS accepted,
               [a.answers[i] = q.correct[i] FOR i IN range(1, len(a.answers) + 1)] AS marks
        FROM attempts a JOIN quizzes q USING (quiz_id)""",
}
ATTEMPT = "quiz_id, student_id, strftime(created_at, '%Y-%m-%d') AS taken_on, line, quantity"


def attempt_columns():
    return ["quiz_id", "student_id", F.date_format("created_at", "yyyy-MM-dd").alias("taken_on"), "line", "quantity"]


@query("L15_scored_attempts", f"SELECT {ATTEMPT}, CAST(len(list_filter(marks, lambda m: m)) AS INT) AS score, 4 AS total FROM marked WHERE accepted", MARKED)
def scored_attempts(lake: Lake):
    return le.scored_attempts(lake.attempts(), lake.quizzes()).select(*attempt_columns(), "score", "total")


@query("L15_rejected_attempts", f"SELECT {ATTEMPT} FROM marked WHERE NOT accepted", MARKED)
def rejected_attempts(lake: Lake):
    return le.rejected_attempts(lake.attempts(), lake.quizzes()).select(*attempt_columns())


@query(
    "L15_breakdown",
    """
    SELECT quiz_id, student_id, line, quantity, strftime(created_at, '%Y-%m-%d') AS taken_on, i - 1 AS question_no, answers[i] AS answer, correct[i] AS correct_option,
           marks[i] AS is_correct FROM marked, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE accepted""",
    MARKED,
)
def breakdown(lake: Lake):
    rows = le.attempt_breakdown(lake.attempts(), lake.quizzes())
    return rows.select(*attempt_columns(), "question_no", "answer", "correct_option", "is_correct")


@query(
    "L16_pass_flags",
    """SELECT quiz_id, count(*) AS attempts, count(*) FILTER (WHERE len(list_filter(marks, lambda m: m)) / 4 >= 0.6) AS passed FROM marked WHERE accepted GROUP BY quiz_id""",
    MARKED,
)
def pass_flags(lake: Lake):
    scored = le.scored_attempts(lake.attempts(), lake.quizzes())
    return scored.groupBy("quiz_id").agg(F.count("*").alias("attempts"), F.count_if(le.passed()).alias("passed"))


@query("L17_attempts_history", f"SELECT {ATTEMPT} FROM attempts WHERE (quiz_id, student_id) IN (SELECT course_id, student_id FROM enrolments)")
def attempts_history(lake: Lake):
    asked = lake.enrolments().select(F.col("course_id").alias("quiz_id"), "student_id")
    return le.attempts_history(lake.attempts(), asked).select(*attempt_columns())


# ---------------------------------------------------------------- discussion


def post_viewers(lake: Lake):
    """The tutor of each course and the customer of the same number look at its discussion."""
    courses = lake.courses()
    named = courses.select(F.concat(F.lit("c"), F.col("course_id").cast("string")).alias("viewer"), "course_id")
    asked = courses.select(F.col("tutor_id").alias("viewer"), "course_id").unionByName(named)
    return le.access_rights(asked, courses, lake.users(), lake.enrolments())


@query(
    "L18_discussion_listing",
    """
    SELECT v.viewer, p.post_id, u.name AS author_name, u.role AS author_role,
           v.viewer = c.tutor_id OR coalesce(w.role = 'admin', false) OR p.author_id = v.viewer AS can_delete
    FROM (SELECT tutor_id AS viewer, course_id FROM courses UNION ALL SELECT 'c' || course_id, course_id FROM courses) v
    JOIN courses c USING (course_id) JOIN posts p USING (course_id) LEFT JOIN users u ON u.user_id = p.author_id
    LEFT JOIN users w ON w.user_id = v.viewer""",
)
def discussion_listing(lake: Lake):
    return le.discussion_listing(lake.posts(), lake.users(), post_viewers(lake)).select("viewer", "post_id", "author_name", "author_role", "can_delete")


@query(
    "L19_invalid_replies",
    """SELECT r.post_id, r.parent_id FROM posts r LEFT JOIN posts p ON p.post_id = r.parent_id
       WHERE r.parent_id IS NOT NULL AND (p.post_id IS NULL OR p.lesson_id <> r.lesson_id)""",
)
def invalid_replies(lake: Lake):
    return le.invalid_replies(lake.posts()).select("post_id", "parent_id")


@query(
    "L20_threads",
    """SELECT post_id, post_id AS thread_id, false AS is_reply FROM posts WHERE parent_id IS NULL
       UNION ALL SELECT r.post_id, r.parent_id, true FROM posts r JOIN posts p ON p.post_id = r.parent_id WHERE p.parent_id IS NULL""",
)
def threads(lake: Lake):
    return le.threads(lake.posts()).select("post_id", "thread_id", "is_reply")


# ---------------------------------------------------------------- platform


@query(
    "L21_platform_stats",
    """
    SELECT (SELECT count(*) FROM users) AS users_total, (SELECT count(*) FROM users WHERE role = 'admin') AS users_admin,
           (SELECT count(*) FROM users WHERE role = 'student') AS users_student, (SELECT count(*) FROM users WHERE role = 'tutor') AS users_tutor,
           (SELECT count(*) FROM courses) AS courses_total, (SELECT count(*) FROM courses WHERE published) AS courses_published,
           (SELECT count(*) FROM courses WHERE NOT published) AS courses_draft, (SELECT count(*) FROM enrolments) AS enrolments,
           (SELECT count(*) FROM attempts) AS quiz_attempts""",
)
def platform_stats(lake: Lake):
    return le.platform_stats(lake.users(), lake.courses(), lake.enrolments(), lake.attempts())


@query("L22_user_list", "SELECT user_id, name, email, role FROM users")
def user_list(lake: Lake):
    return le.user_list(lake.users().withColumn("password_hash", F.lit("x"))).select("user_id", "name", "email", "role")


@query("L23_all_courses", "SELECT course_id, published, u.name AS tutor_name, u.email AS tutor_email FROM courses c LEFT JOIN users u ON u.user_id = c.tutor_id")
def all_courses(lake: Lake):
    return le.all_courses(lake.courses(), lake.users()).select("course_id", "published", "tutor_name", "tutor_email")


def cascade(lake: Lake):
    tables = {
        "lessons": lake.lessons(), "quizzes": lake.quizzes(), "attempts": lake.attempts(), "enrolments": lake.enrolments(),
        "chunks": paragraph_chunks(lake.lessons().select("course_id", "lesson_id", F.col("content").alias("text"))),
        "chat": lake.chat_turns().withColumn("course_id", F.col("conv_id")),
    }
    doomed = lake.courses().where(~F.col("published"))
    return le.cascade_delete(doomed, tables)


@query(
    "L25_cascade_counts",
    """
    SELECT c.course_id, count(l.lesson_id) AS deleted_lessons, 1 AS deleted_quizzes, count(l.lesson_id) AS deleted_chunks FROM courses c LEFT JOIN lessons l USING (course_id)
    WHERE NOT published GROUP BY c.course_id""",
)
def cascade_counts(lake: Lake):
    return cascade(lake)[1]


@query(
    "L25_cascade_remaining",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows_left FROM {source} WHERE {key} NOT IN (SELECT course_id FROM courses WHERE NOT published)"
        for t, source, key in (("lessons", "lessons", "course_id"), ("chunks", "lessons", "course_id"), ("quizzes", "quizzes", "course_id"), ("attempts", "attempts", "quiz_id"), ("enrolments", "enrolments", "course_id"), ("chat", "chat_turns", "conv_id"))
    ),
)
def cascade_remaining(lake: Lake):
    left, _ = cascade(lake)
    parts = [df.agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left") for name, df in left.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("L26_tutor_dashboard", "SELECT tutor_id, count(*) AS courses, count(*) FILTER (WHERE published) AS published_courses FROM courses GROUP BY tutor_id")
def tutor_dashboard(lake: Lake):
    return le.tutor_dashboard(lake.courses())


@query("L26_student_dashboard", "SELECT student_id, count(*) FILTER (WHERE percent < 100) AS in_progress, count(*) FILTER (WHERE percent >= 100) AS completed FROM track_progress GROUP BY student_id")
def student_dashboard(lake: Lake):
    return le.student_dashboard(track_progress(lake))


@query(
    "L27_violations",
    """
    SELECT 'users' AS "table", user_id AS "key", 'role allowed' AS rule FROM users WHERE role = 'admin'
    UNION ALL SELECT 'users', user_id, 'valid email' FROM users WHERE NOT regexp_full_match(email, '[^@\\s]+@[^@\\s]+\\.[A-Za-z]{2,}')
    UNION ALL SELECT 'users', user_id, 'password length' FROM users WHERE length(user_id) < 6
    UNION ALL SELECT 'lessons', CAST(lesson_id AS VARCHAR), 'order not negative' FROM lessons WHERE lesson_order < 3
    UNION ALL SELECT 'quizzes', CAST(quiz_id AS VARCHAR), 'correct option exists' FROM quizzes WHERE list_max(correct[1:1]) = 3
    UNION ALL SELECT 'posts', CAST(post_id AS VARCHAR), 'content required' FROM posts WHERE content = 'view'""",
)
def violation_report(lake: Lake):
    """Self-registration rules over all users, and content rules over tables with some fields spoiled."""
    users = le.violations(lake.users().withColumn("password", F.col("user_id")), "users", "user_id", le.user_rules(self_registered=True))
    courses = le.violations(lake.courses(), "courses", "course_id", le.course_rules())
    lessons = le.violations(lake.lessons().withColumn("lesson_order", F.col("lesson_order") - 3), "lessons", "lesson_id", le.lesson_rules())
    # the first question loses an option, so its last option no longer exists
    cut = F.transform(
        "questions",
        lambda q, i: F.when(i == 0, q.withField("options", F.slice(q["options"], 1, 3))).otherwise(q),
    )
    quizzes = le.violations(lake.quizzes().withColumn("questions", cut), "quizzes", "quiz_id", le.quiz_rules())
    posts = lake.posts().withColumn("content", F.when(F.col("content") == "view", F.lit("  ")).otherwise(F.col("content")))
    found = users.unionByName(courses).unionByName(lessons).unionByName(quizzes)
    return found.unionByName(le.violations(posts, "posts", "post_id", le.post_rules()))


@query("L28_chat_history", "SELECT conv_id, turn, length(question) AS question_chars, length(answer) AS answer_chars FROM chat_turns")
def chat_history(lake: Lake):
    turns = lake.chat_turns().withColumn("created_at", F.col("turn"))
    return le.chat_history(turns).select("conv_id", "turn", F.length("question").alias("question_chars"), F.length("answer").alias("answer_chars"))


@query(
    "L29_duplicate_keys",
    "SELECT student_id, course_id, count(*) AS copies FROM purchases GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_keys(lake: Lake):
    return le.duplicate_keys(lake.enrolment_requests(), ["student_id", "course_id"])
