"""Questions, answers, scorecards, progress and lists; orders stand in for sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import interview as I
from ..operators import progress as G
from ..operators import reports as P
from ..operators import scorecards as S
from .tables import latest_answers, order_answers, order_items, order_sessions, qa_pairs, spread, table


# --- questions ---------------------------------------------------------------------------
def question_priority(spark, sf_dir):
    return I.plan_questions(order_items(spark, sf_dir))


def question_topup(spark, sf_dir):
    return I.top_up(order_items(spark, sf_dir))


def question_link(spark, sf_dir):
    items = order_items(spark, sf_dir)
    planned = I.plan_questions(items, n_technical=2, n_behavioural=1)
    return I.link_questions(planned, items).select("session_id", "category", "place", "linked_item")


# --- answers -----------------------------------------------------------------------------
def _scored(spark, sf_dir):
    pairs = spread(qa_pairs(spark, sf_dir)).withColumn("requirement", F.col("question"))
    category = F.when(F.col("question_id") == 0, "technical").otherwise("behavioural")
    return I.score_answers(I.answer_features(pairs).withColumn("rubric", I.rubric_of(category)))


def answer_features(spark, sf_dir):
    pairs = spread(qa_pairs(spark, sf_dir)).withColumn("requirement", F.col("question"))
    return I.answer_features(pairs).drop("question", "answer", "requirement").withColumn("cover", F.round("cover", 6))


def answer_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "session_id", "question_id", "answer_id", "rubric",
        F.array_join(F.transform("criteria", lambda c: F.concat(c["name"], F.lit(":"), c["score"].cast("string"))), ";").alias("criteria"),
        "overall_score", F.array_join("strengths", " | ").alias("strengths"),
        F.array_join("improvements", " | ").alias("improvements"), "weakest", "follow_up",
    )


# --- scorecards --------------------------------------------------------------------------
def latest_per_key(spark, sf_dir):
    return latest_answers(spark, sf_dir).select("session_id", "question_id", "answer_key", "score10")


def _scores(spark, sf_dir):
    return P.match_scores(order_items(spark, sf_dir))


def order_match_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


def _cards(spark, sf_dir):
    return S.readiness(_scores(spark, sf_dir), latest_answers(spark, sf_dir))


def scorecard(spark, sf_dir):
    return _cards(spark, sf_dir)


def competency_means(spark, sf_dir):
    return S.competencies(latest_answers(spark, sf_dir))


def scorecard_strengths(spark, sf_dir):
    return S.strengths(order_items(spark, sf_dir), competency_means(spark, sf_dir))


def scorecard_gaps(spark, sf_dir):
    return S.gaps(order_items(spark, sf_dir), competency_means(spark, sf_dir))


def action_items(spark, sf_dir):
    return S.action_items(order_sessions(spark, sf_dir), order_items(spark, sf_dir), competency_means(spark, sf_dir))


def score_history(spark, sf_dir):
    return S.score_history(latest_answers(spark, sf_dir))


def display_tone(spark, sf_dir):
    cards = _cards(spark, sf_dir)
    return cards.groupBy(P.tone(F.col("readiness_score")).alias("tone"), P.tone(F.col("answer_mean"), F.lit(5)).alias("answer_tone")).agg(
        F.count("*").alias("sessions")
    )


# --- progress ----------------------------------------------------------------------------
def _results(spark, sf_dir):
    return G.session_results(_scores(spark, sf_dir), order_answers(spark, sf_dir))


def _points(spark, sf_dir):
    return G.session_points(order_sessions(spark, sf_dir), _results(spark, sf_dir))


def session_points(spark, sf_dir):
    return _points(spark, sf_dir).drop("s10")


def recurring_gaps(spark, sf_dir):
    found = G.recurring_gaps(order_sessions(spark, sf_dir), order_items(spark, sf_dir))
    return found.withColumn("applications", F.array_join("applications", " | "))


def competency_trend(spark, sf_dir):
    found = G.competency_trend(order_sessions(spark, sf_dir), competency_means(spark, sf_dir))
    return found.withColumn("series", F.array_join(F.transform("series", lambda v: F.format_string("%.2f", v)), ","))


def progress_totals(spark, sf_dir):
    return G.progress_totals(_points(spark, sf_dir))


# --- lists -------------------------------------------------------------------------------
def session_overview(spark, sf_dir):
    """Documents of an order = its distinct suppliers' papers, questions = part of its lines."""
    lines = table(spark, sf_dir, "lineitem")
    documents = lines.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("session_id"))
    questions = lines.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("question_id")).distinct()
    answers = lines.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("question_id"))
    sessions = order_sessions(spark, sf_dir).select("user_id", "session_id", "title")
    return G.session_overview(sessions, documents, questions, answers, _results(spark, sf_dir))


def newest_page(spark, sf_dir):
    return G.newest_page(order_sessions(spark, sf_dir), skip=2, limit=3).select("user_id", "session_id", "title", "place")


def owned_only(spark, sf_dir):
    """Sessions of the callers of one market segment, by an ownership semi-join."""
    callers = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return order_sessions(spark, sf_dir).join(callers, "user_id", "left_semi").select("user_id", "session_id")


def order_letters(spark, sf_dir):
    """Letter claims of every order."""
    return P.letter_lines(P.letter_material(order_items(spark, sf_dir), order_sessions(spark, sf_dir)))


def gap_keys(spark, sf_dir):
    return order_items(spark, sf_dir).groupBy(T.gap_key(F.col("requirement")).alias("gap_key")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        question_priority, question_topup, question_link, answer_features, answer_scores, latest_per_key,
        order_match_scores, scorecard, competency_means, scorecard_strengths, scorecard_gaps, action_items,
        score_history, display_tone, session_points, recurring_gaps, competency_trend, progress_totals,
        session_overview, newest_page, owned_only, order_letters, gap_keys,
    )
}
