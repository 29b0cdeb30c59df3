"""Progress of a user across sessions, and the session lists.

Sessions: user_id, session_id, title, target_role, created_at. Every roll-up is an aggregation that shrinks
map-side. The only lists are those that are the result: the titles and scores of one user's sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as T
from .scorecards import MIN_ANSWERS, readiness_of


def session_results(scores: DataFrame, answers: DataFrame, latest_by: tuple = ("answered_at", "answer_key"), minimum: int = MIN_ANSWERS) -> DataFrame:
    """(session_id, match_score, readiness_score, answers, s10) of every session with a score or an answer.

    ``answers`` (session_id, question_id, score10 and the columns of ``latest_by``) are read once: readiness counts
    the latest answer of each question, ``answers`` and ``s10`` count **all**.
    """
    per_question = answers.groupBy("session_id", "question_id").agg(
        F.max_by("score10", F.struct(*latest_by)).alias("last"), F.count("*").alias("n"), F.sum("score10").alias("s10")
    )
    totals = per_question.groupBy("session_id").agg(
        F.count("*").alias("asked"), F.sum("last").alias("last10"), F.sum("n").alias("answers"), F.sum("s10").alias("s10")
    )
    asked = F.coalesce("asked", F.lit(0))
    return scores.select("session_id", F.col("overall_score").alias("match_score")).join(totals, "session_id", "full").select(
        "session_id", "match_score",
        F.when(asked >= minimum, readiness_of(F.col("match_score"), asked, F.col("last10"))).alias("readiness_score"),
        F.coalesce("answers", F.lit(0)).alias("answers"), F.coalesce("s10", F.lit(0)).alias("s10"),
    )


def session_points(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """One point per session: match, readiness, number and mean of all its answers, from ``session_results``."""
    return sessions.join(results, "session_id", "left").select(
        "user_id", "session_id", "title", "target_role", "created_at", "match_score", "readiness_score",
        F.coalesce("answers", F.lit(0)).alias("answers"), F.coalesce("s10", F.lit(0)).alias("s10"),
        F.when(F.col("answers") > 0, F.bround(F.col("s10") / (10 * F.greatest("answers", F.lit(1))), 2)).alias("mean_answer_score"),
    )


def recurring_gaps(sessions: DataFrame, items: DataFrame, by_title: bool = True, top: int = 8) -> DataFrame:
    """(user_id, place, gap_key, label, missing_in, applications): gaps of at least two applications, which are
    listed in the order in which the gap was met.

    Applications count by title unless ``by_title`` is off. Grouping first by (user, key, title) keeps
    the distinct count exact and its state small.
    """
    counted = F.col("title") if by_title else F.col("session_id").cast("string")
    missing = (
        items.filter("status = 'missing' and kind = 'evidenceable'")
        .select("session_id", "order_key", "requirement", T.gap_key(F.col("requirement")).alias("gap_key"))
        .filter("gap_key <> ''")
        .join(sessions.select("user_id", "session_id", "title", "created_at"), "session_id")
    )
    first = F.struct("created_at", "session_id", "order_key")
    per_title = missing.groupBy("user_id", "gap_key", counted.alias("application")).agg(
        F.min(F.struct(first.alias("at"), F.col("requirement").alias("label"))).alias("first")
    )
    per_gap = (
        per_title.groupBy("user_id", "gap_key")
        .agg(
            F.count("*").alias("missing_in"), F.min("first").alias("first"),
            F.array_sort(F.collect_list(F.struct("first.at", "application"))).alias("met"),
        )
        .filter("missing_in >= 2")
        .select("user_id", "gap_key", F.col("first.label").alias("label"), "missing_in", F.col("met.application").alias("applications"))
    )
    order = Window.partitionBy("user_id").orderBy(F.desc("missing_in"), "label", "gap_key")
    return per_gap.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def competency_trend(sessions: DataFrame, comps: DataFrame) -> DataFrame:
    """(user_id, name, points, first, latest, series, delta) of dimensions scored in two sessions or more; the
    series is in date order. ``comps``: session_id, name, score.
    """
    dated = comps.join(sessions.select("user_id", "session_id", "created_at"), "session_id")
    at = F.struct("created_at", "session_id")
    return (
        dated.groupBy("user_id", "name")
        .agg(
            F.count("*").alias("points"), F.min_by("score", at).alias("first"), F.max_by("score", at).alias("latest"),
            F.array_sort(F.collect_list(F.struct("created_at", "session_id", "score")))["score"].alias("series"),
        )
        .filter("points >= 2")
        .withColumn("delta", F.bround(F.col("latest") - F.col("first"), 2))
    )


def progress_totals(points: DataFrame) -> DataFrame:
    """One row per user over ``session_points``."""
    at = F.struct("created_at", "session_id")
    ready, match = F.col("readiness_score"), F.col("match_score")
    scored = F.when(ready.isNotNull(), at)
    out = points.groupBy("user_id").agg(
        F.count("*").alias("sessions_total"),
        F.count(ready).alias("sessions_scored"),
        F.sum("answers").alias("answers_total"),
        F.sum("s10").alias("s10"),
        F.max(ready).alias("best_readiness"),
        F.max_by("readiness_score", scored).alias("latest_readiness"),
        F.min_by("readiness_score", scored).alias("first_readiness"),
        F.sum(match).alias("match_sum"), F.count(match).alias("match_n"),
    )
    return out.select(
        "user_id", "sessions_total", "sessions_scored", "answers_total",
        F.when(F.col("answers_total") > 0, F.bround(F.col("s10") / F.greatest(10 * F.col("answers_total"), F.lit(1)), 2)).alias("mean_answer_score"),
        "best_readiness", "latest_readiness",
        F.when(F.col("sessions_scored") >= 2, F.col("latest_readiness") - F.col("first_readiness")).alias("readiness_delta"),
        F.when(F.col("match_n") > 0, F.bround(F.col("match_sum") / F.greatest("match_n", F.lit(1)), 1)).alias("mean_match"),
        (F.col("sessions_scored") >= K.MIN_TREND_POINTS).alias("has_trend"),
    )


def session_overview(sessions: DataFrame, documents: DataFrame, questions: DataFrame, answers: DataFrame, results: DataFrame) -> DataFrame:
    """List row of a session. ``questions``/``answers``: session_id, question_id; ``results``: ``session_results``."""
    def marked(rows: DataFrame, question: Column, d: int, q: int, a: int) -> DataFrame:
        return rows.select("session_id", question.alias("question_id"), F.lit(d).alias("d"), F.lit(q).alias("q"), F.lit(a).alias("a"))

    none = F.lit(None).cast(questions.schema["question_id"].dataType)
    marks = marked(documents, none, 1, 0, 0).union(marked(questions, F.col("question_id"), 0, 1, 0)).union(marked(answers, F.col("question_id"), 0, 0, 1))
    counts = (
        marks.groupBy("session_id", "question_id").agg(F.sum("d").alias("d"), F.sum("q").alias("q"), F.max("a").alias("a"))
        .groupBy("session_id").agg(
            F.sum("d").alias("documents"), F.sum("q").alias("question_count"), F.sum(F.col("q") * F.col("a")).alias("answered_count"))
    )
    out = sessions.join(counts, "session_id", "left").join(results.select("session_id", "match_score", "readiness_score"), "session_id", "left")
    return out.select(
        *sessions.columns,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "question_count", "answered_count")],
        F.col("match_score").isNotNull().alias("has_analysis"), "readiness_score",
    )


def newest_page(sessions: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    """One page of the newest sessions per user; the rank limit cuts every task before the shuffle."""
    limit = max(1, min(100, limit))
    order = Window.partitionBy("user_id").orderBy(F.desc("session_id"))
    ranked = sessions.withColumn("place", F.row_number().over(order))
    return ranked.filter((F.col("place") > skip) & (F.col("place") <= skip + limit))
