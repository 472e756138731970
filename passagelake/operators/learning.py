"""The relational side of a learning platform."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelake.functions.text import terms

ROLES = ["admin", "student", "tutor"]


# ---------------------------------------------------------------- catalog and access


def matches_search(query: str, stem: bool = True) -> Column:
    """Any query term occurs in title or description."""
    wanted = terms(F.lit(query), stem)
    return F.arrays_overlap(terms(F.concat_ws(" ", "title", "description"), stem), wanted)


def with_tutor(courses: DataFrame, users: DataFrame, fields: tuple[str, ...] = ("name",)) -> DataFrame:
    tutors = users.select(F.col("user_id").alias("tutor_id"), *[F.col(f).alias(f"tutor_{f}") for f in fields])
    return courses.join(tutors, "tutor_id", "left")


def catalog(courses: DataFrame, users: DataFrame, category: str | None = None, search: str | None = None, stem: bool = True) -> DataFrame:
    listed = courses.where("published")
    if category:
        listed = listed.where(F.col("category") == category)
    if search:
        listed = listed.where(matches_search(search, stem))
    return with_tutor(listed, users).orderBy(F.col("created_at").desc())


def own_courses(courses: DataFrame, tutors: DataFrame) -> DataFrame:
    return courses.join(tutors.select("tutor_id").distinct(), "tutor_id", "left_semi").orderBy(F.col("created_at").desc())


def categories(courses: DataFrame) -> DataFrame:
    return courses.select("category").where(F.coalesce("category", F.lit("")) != "").distinct().orderBy("category")


def access_rights(requests: DataFrame, courses: DataFrame, users: DataFrame, enrolments: DataFrame) -> DataFrame:
    """Add ``manages`` and ``has_access`` to ``requests(viewer, course_id)``; a null viewer is anonymous."""
    enrolled = enrolments.select(F.col("student_id").alias("viewer"), "course_id").distinct().withColumn("_enrolled", F.lit(True))
    return (
        requests.join(courses.select("course_id", "tutor_id", "published"), "course_id")
        .join(users.select(F.col("user_id").alias("viewer"), "role"), "viewer", "left")
        .join(enrolled, ["viewer", "course_id"], "left")
        .withColumn(
            "manages",
            F.col("viewer").isNotNull()
            & F.coalesce((F.col("role") == "admin") | (F.col("tutor_id") == F.col("viewer")), F.lit(False)),
        )
        .withColumn("has_access", F.col("manages") | F.coalesce("_enrolled", F.lit(False)))
        .drop("_enrolled", "role", "tutor_id")
    )


def visible_requests(rights: DataFrame) -> DataFrame:
    return rights.where(F.col("published") | F.col("manages"))


def gated_lessons(rights: DataFrame, lessons: DataFrame) -> DataFrame:
    """Lessons of visible courses; without access only identity, title and order remain."""
    shown = visible_requests(rights).join(lessons, "course_id")
    hidden = [c for c in lessons.columns if c not in {"lesson_id", "course_id", "title", "lesson_order"}]
    return shown.select(
        "viewer", "course_id", "lesson_id", "title", "lesson_order", "has_access",
        *[F.when(F.col("has_access"), F.col(c)).alias(c) for c in hidden],
    )


def without_answers(questions: Column) -> Column:
    return F.transform(questions, lambda q: q.dropFields("correct"))


def sorted_in(quizzes: DataFrame) -> DataFrame:
    """``quizzes`` for a sort-merge join: Spark takes an array for one element and would broadcast the questions of all quizzes."""
    return quizzes.hint("merge")


def gated_quizzes(rights: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Quizzes of visible courses: questions without answers with access, otherwise only how many there are."""
    return visible_requests(rights).join(sorted_in(quizzes), "course_id").select(
        "viewer", "course_id", "quiz_id", "title", "has_access",
        F.when(F.col("has_access"), without_answers(F.col("questions"))).alias("questions"),
        F.when(~F.col("has_access"), F.size("questions")).alias("question_count"),
    )


def accessible(rights: DataFrame, content: DataFrame) -> DataFrame:
    """Full rows of lessons or quizzes for requests that may see them."""
    allowed = rights.where("has_access").select("viewer", "course_id")
    return allowed.join(content, "course_id")


def quizzes_with_answers(rights: DataFrame, quizzes: DataFrame) -> DataFrame:
    return rights.where("manages").select("viewer", "course_id").join(sorted_in(quizzes), "course_id")


def changed_lessons(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lessons whose title or content differs (or that are new) and therefore need a new index."""
    old = before.select("lesson_id", F.col("title").alias("_t"), F.col("content").alias("_c"), F.lit(True).alias("_old"))
    return after.join(old, "lesson_id", "left").withColumn(
        "reindex", F.col("_old").isNull() | ~(F.col("title").eqNullSafe(F.col("_t")) & F.col("content").eqNullSafe(F.col("_c")))
    ).drop("_t", "_c", "_old")


# ---------------------------------------------------------------- enrolment, progress, certificates


def first_enrolments(requests: DataFrame, courses: DataFrame) -> DataFrame:
    """The first request per (student, course) in a published course; an aggregate, so hot pairs combine map-side."""
    open_ = courses.where("published").select("course_id")
    rest = [c for c in requests.columns if c not in {"student_id", "course_id", "requested_at", "request_id"}]
    return (
        requests.join(open_, "course_id", "left_semi")
        .groupBy("student_id", "course_id")
        .agg(F.min(F.struct("requested_at", "request_id", *rest)).alias("_first"))
        .select("student_id", "course_id", "_first.*")
    )


def my_enrolments(enrolments: DataFrame, courses: DataFrame) -> DataFrame:
    shown = courses.select("course_id", "title", "description", "category")
    return enrolments.join(shown, "course_id", "left").orderBy(F.col("requested_at").desc())


def enrolment_lookup(asked: DataFrame, enrolments: DataFrame) -> DataFrame:
    """Each asked (student, course) with its enrolment or nulls."""
    return asked.join(enrolments, ["student_id", "course_id"], "left")


def progress(enrolments: DataFrame, completions: DataFrame, lessons: DataFrame) -> DataFrame:
    """Distinct completed lessons and the percentage of the course, rounded half to even."""
    done = completions.select("student_id", "course_id", "lesson_id").distinct().groupBy("student_id", "course_id").agg(
        F.count("*").alias("completed")
    )
    totals = lessons.groupBy("course_id").agg(F.count("*").alias("total"))
    joined = enrolments.join(done, ["student_id", "course_id"], "left").join(totals, "course_id", "left")
    completed, total = F.coalesce("completed", F.lit(0)), F.coalesce("total", F.lit(0))
    percent = F.when(total > 0, F.bround(completed / total * 100, 0)).otherwise(F.lit(0.0))
    return joined.withColumn("completed", completed).withColumn("total", total).withColumn("percent", percent)


def new_certificates(progressed: DataFrame, issued: DataFrame) -> DataFrame:
    return (
        progressed.where(F.col("percent") == 100)
        .select("student_id", "course_id")
        .distinct()
        .join(issued.select("student_id", "course_id"), ["student_id", "course_id"], "left_anti")
    )


def certificate_listing(certificates: DataFrame, users: DataFrame, courses: DataFrame) -> DataFrame:
    names = users.select(F.col("user_id").alias("student_id"), F.col("name").alias("student_name"))
    titles = courses.select("course_id", F.col("title").alias("course_title"))
    return certificates.join(names, "student_id", "left").join(titles, "course_id", "left")


def completion_marks(enrolments: DataFrame, lessons: DataFrame, completions: DataFrame) -> DataFrame:
    done = completions.select("student_id", "course_id", "lesson_id").distinct().withColumn("_done", F.lit(True))
    return (
        enrolments.select("student_id", "course_id")
        .join(lessons, "course_id")
        .join(done, ["student_id", "course_id", "lesson_id"], "left")
        .withColumn("completed", F.coalesce("_done", F.lit(False)))
        .drop("_done")
    )


# ---------------------------------------------------------------- quizzes


def quiz_marks(attempts: DataFrame, quizzes: DataFrame) -> DataFrame:
    """``attempts(..., quiz_id, answers)`` with ``marks array<boolean>``; rejected when the lengths differ."""
    keyed = attempts.join(sorted_in(quizzes.select("quiz_id", "questions")), "quiz_id")
    fits = F.size("answers") == F.size("questions")
    marks = F.zip_with("questions", "answers", lambda q, a: F.coalesce(q["correct"] == a, F.lit(False)))
    return keyed.withColumn("accepted", fits).withColumn("marks", F.when(fits, marks))


def scored_attempts(attempts: DataFrame, quizzes: DataFrame) -> DataFrame:
    marked = quiz_marks(attempts, quizzes).where("accepted")
    score = F.size(F.filter("marks", lambda m: m))
    return marked.withColumn("score", score).withColumn("total", F.size("marks")).drop("marks", "questions", "accepted")


def rejected_attempts(attempts: DataFrame, quizzes: DataFrame) -> DataFrame:
    return quiz_marks(attempts, quizzes).where(~F.col("accepted")).drop("marks", "questions", "accepted")


def attempt_breakdown(attempts: DataFrame, quizzes: DataFrame) -> DataFrame:
    marked = quiz_marks(attempts, quizzes).where("accepted")
    rows = F.arrays_zip(
        F.transform("questions", lambda q: q["text"]).alias("question"),
        F.col("answers").alias("answer"),
        F.transform("questions", lambda q: q["correct"]).alias("correct_option"),
        F.col("marks").alias("is_correct"),
    )
    keep = [c for c in attempts.columns if c != "answers"]
    return marked.select(*keep, F.posexplode(rows).alias("question_no", "r")).select(
        *keep, "question_no", F.col("r.question").alias("question"), F.col("r.answer").alias("answer"),
        F.col("r.correct_option").alias("correct_option"), F.col("r.is_correct").alias("is_correct"),
    )


def passed() -> Column:
    return F.col("score") / F.col("total") >= 0.6


def attempts_history(attempts: DataFrame, asked: DataFrame) -> DataFrame:
    return attempts.join(asked.distinct(), ["quiz_id", "student_id"], "left_semi").orderBy(F.col("created_at").desc())


# ---------------------------------------------------------------- discussion


def discussion_listing(posts: DataFrame, users: DataFrame, rights: DataFrame) -> DataFrame:
    """Posts for each viewing request ``rights(viewer, course_id, manages)``, oldest first, with ``can_delete``."""
    authors = users.select(F.col("user_id").alias("author_id"), F.col("name").alias("author_name"), F.col("role").alias("author_role"))
    return (
        rights.select("viewer", "course_id", "manages")
        .join(posts, "course_id")
        .join(authors, "author_id", "left")
        .withColumn("can_delete", F.col("manages") | F.coalesce(F.col("author_id") == F.col("viewer"), F.lit(False)))
        .drop("manages")
        .orderBy("created_at")
    )


def invalid_replies(posts: DataFrame) -> DataFrame:
    """Replies whose parent is missing or belongs to another lesson."""
    parents = posts.select(F.col("post_id").alias("parent_id"), F.col("lesson_id").alias("_lesson"))
    return (
        posts.where(F.col("parent_id").isNotNull())
        .join(parents, "parent_id", "left")
        .where(~F.coalesce(F.col("_lesson") == F.col("lesson_id"), F.lit(False)))
        .drop("_lesson")
    )


def threads(posts: DataFrame) -> DataFrame:
    """One level of threading as rows: top-level posts and the replies to them.

    Replies stay rows (no array per parent), so a parent with very many replies is not gathered in one place.
    """
    top = posts.where(F.col("parent_id").isNull())
    heads = top.withColumn("thread_id", F.col("post_id")).withColumn("is_reply", F.lit(False))
    replies = (
        posts.where(F.col("parent_id").isNotNull())
        .join(top.select(F.col("post_id").alias("parent_id")), "parent_id", "left_semi")
        .withColumn("thread_id", F.col("parent_id"))
        .withColumn("is_reply", F.lit(True))
    )
    return heads.unionByName(replies)


# ---------------------------------------------------------------- platform


def platform_stats(users: DataFrame, courses: DataFrame, enrolments: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row of counts; roles are zero-filled."""
    parts = [
        users.agg(
            F.count_if(F.col("role").isin(ROLES)).alias("users_total"),
            *[F.count_if(F.col("role") == r).alias(f"users_{r}") for r in ROLES],
        ),
        courses.agg(
            F.count("*").alias("courses_total"),
            F.count_if("published").alias("courses_published"),
            F.count_if(~F.col("published")).alias("courses_draft"),
        ),
        enrolments.agg(F.count("*").alias("enrolments")),
        attempts.agg(F.count("*").alias("quiz_attempts")),
    ]
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]  # each part is a single row
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")


def user_list(users: DataFrame) -> DataFrame:
    return users.drop("password_hash").orderBy(F.col("created_at").desc())


def all_courses(courses: DataFrame, users: DataFrame) -> DataFrame:
    return with_tutor(courses, users, ("name", "email")).orderBy(F.col("created_at").desc())


def cascade_delete(doomed: DataFrame, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remaining tables after deleting ``doomed(course_id)``, and deletion counts per course.

    ``tables`` may hold lessons, chunks, quizzes, attempts, enrolments and chat; attempts go through their quizzes. Posts
    and certificates are not touched.
    """
    ids = doomed.select("course_id").distinct()
    left = {n: t.join(ids, "course_id", "left_anti") for n, t in tables.items() if n != "attempts"}
    gone = tables["quizzes"].join(ids, "course_id", "left_semi")
    if "attempts" in tables:
        left["attempts"] = tables["attempts"].join(gone.select("quiz_id"), "quiz_id", "left_anti")
    lessons = tables["lessons"].join(ids, "course_id", "left_semi").groupBy("course_id").agg(F.count("*").alias("deleted_lessons"))
    quizzes = gone.groupBy("course_id").agg(F.count("*").alias("deleted_quizzes"))
    counts = ids.join(lessons, "course_id", "left").join(quizzes, "course_id", "left")
    if "chunks" in tables:
        chunks = tables["chunks"].join(ids, "course_id", "left_semi").groupBy("course_id").agg(F.count("*").alias("deleted_chunks"))
        counts = counts.join(chunks, "course_id", "left")
    return left, counts.na.fill(0)


def tutor_dashboard(courses: DataFrame) -> DataFrame:
    return courses.groupBy("tutor_id").agg(F.count("*").alias("courses"), F.count_if("published").alias("published_courses"))


def student_dashboard(progressed: DataFrame) -> DataFrame:
    return progressed.groupBy("student_id").agg(
        F.count_if(F.col("percent") < 100).alias("in_progress"), F.count_if(F.col("percent") >= 100).alias("completed")
    )


def chat_history(messages: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    shown = messages if asked is None else messages.join(asked.distinct(), ["course_id", "student_id"], "left_semi")
    return shown.orderBy("created_at")


# ---------------------------------------------------------------- data quality


def violations(df: DataFrame, table: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """``table, key, rule`` for every broken rule; a rule column is true when the row is fine."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(
        F.lit(table).alias("table"),
        F.col(key).cast("string").alias("key"),
        F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"),
    )


def required(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) != ""


def user_rules(self_registered: bool = False) -> dict[str, Column]:
    allowed = ["student", "tutor"] if self_registered else ROLES
    rules = {
        "name required": required("name"),
        "valid email": F.col("email").rlike("^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{2,}$"),
        "role allowed": F.col("role").isin(allowed),
    }
    if self_registered:
        rules["password length"] = F.length("password") >= 6
    return rules


def course_rules() -> dict[str, Column]:
    return {"title required": required("title"), "description required": required("description")}


def lesson_rules() -> dict[str, Column]:
    return {
        "title required": required("title"),
        "content required": required("content"),
        "order not negative": F.coalesce(F.col("lesson_order") >= 0, F.lit(True)),
    }


def quiz_rules() -> dict[str, Column]:
    questions = F.coalesce("questions", F.array())
    return {
        "title required": required("title"),
        "one question": F.size(questions) >= 1,
        "question text": F.forall("questions", lambda q: F.trim(F.coalesce(q["text"], F.lit(""))) != ""),
        "two options": F.forall("questions", lambda q: F.size(q["options"]) >= 2),
        "correct option exists": F.forall("questions", lambda q: (q["correct"] >= 0) & (q["correct"] < F.size(q["options"]))),
    }


def post_rules() -> dict[str, Column]:
    return {"content required": required("content")}


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
