"""Scorecards: stored verdicts and evaluations of a session rolled up.

Evaluations: session_id, question_id, answer_key (orderable), score10 (tenths, integer), criteria
(array<struct<name,score:int>>). Integer sums keep every mean exact, whatever the partition order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as T

MIN_ANSWERS = 1


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key. An aggregation, not a window: rows of a hot key shrink map-side."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
        .select(*keys, "last.*")
    )


def competencies(evaluations: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, name, score): mean of every criterion, two decimals."""
    return (
        evaluations.select(key, F.explode("criteria").alias("c"))
        .groupBy(key, F.col("c.name").alias("name"))
        .agg(F.bround(F.sum("c.score") / F.count("*"), 2).alias("score"))
    )


def readiness_of(match: Column, n: Column, s10: Column) -> Column:
    """Readiness from the match score and the number and summed tenths of the latest answers."""
    return F.when(n > 0, F.bround((2 * match * n + 6 * s10) / (5 * n), 0).cast("long")).otherwise(match)


def readiness(scores: DataFrame, latest: DataFrame, key: str = "session_id", minimum: int = MIN_ANSWERS) -> DataFrame:
    """(key, overall_score, answers, answer_mean, readiness_score, readiness_band).

    ``minimum`` answers are needed for a card; with 0, sessions without answers are as ready as
    their match.
    """
    means = latest.groupBy(key).agg(F.count("*").alias("answers"), F.sum("score10").alias("s10"))
    n, m, s = F.col("answers"), F.col("overall_score"), F.col("s10")
    return (
        scores.join(means, key, "left")
        .withColumn("answers", F.coalesce("answers", F.lit(0)))
        .filter(F.col("answers") >= minimum)
        .select(
            key, "overall_score", "answers",
            F.when(n > 0, F.bround(s / (10 * n), 1)).alias("answer_mean"), readiness_of(m, n, s).alias("readiness_score"),
        )
        .withColumn("readiness_band", T.band(F.col("readiness_score"), K.READINESS_BANDS))
    )


def _top(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    place = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("pos", F.row_number().over(place)).filter(F.col("pos") <= n)


def _points(items: DataFrame, comps: DataFrame, key: str, status: str, best: bool) -> DataFrame:
    from_items = _top(items.filter(F.col("status") == status), key, ["order_key"], 4).select(
        key, F.lit(0).alias("tier"), "pos", F.col("requirement").alias("label")
    )
    order = F.desc("score") if best else F.asc("score")
    wanted = F.col("score") >= 4 if best else F.col("score") <= 3
    from_comps = _top(comps, key, [order, "name"], 2).filter(wanted).select(
        key, F.lit(1).alias("tier"), "pos", F.format_string("%s %.2f/5", "name", "score").alias("label")
    )
    return _ordered(from_items.unionByName(from_comps), key, 6)


def _ordered(rows: DataFrame, key: str, cap: int) -> DataFrame:
    place = Window.partitionBy(key).orderBy("tier", "pos")
    return rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= cap).drop("pos")


def strengths(items: DataFrame, comps: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, place, tier, label): four evidenced requirements, then the best two dimensions."""
    return _points(items, comps, key, "strong", True)


def gaps(items: DataFrame, comps: DataFrame, key: str = "session_id") -> DataFrame:
    return _points(items, comps, key, "missing", False)


def action_items(sessions: DataFrame, items: DataFrame, comps: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, place, priority, title): missing must-haves, weak dimensions, thin evidence; at most 8.

    Every source is read once, and ranked and cut to eight per session and tier before the tiers are merged.
    """
    wanted = F.when((F.col("status") == "missing") & (F.col("category") == "must_have"), 0).when(F.col("status") == "partial", 2)
    place = Window.partitionBy(key, "tier").orderBy("order_key")
    from_items = (
        items.select(key, "order_key", "requirement", wanted.alias("tier"))
        .filter("tier is not null")
        .withColumn("pos", F.row_number().over(place))
        .filter("pos <= 8")
        .select(key, "tier", "pos", F.when(F.col("tier") == 0, "high").otherwise("medium").alias("priority"), F.col("requirement").alias("title"))
    )
    weak = _top(comps.filter("score <= 3"), key, ["score", "name"], 8).select(
        key, F.lit(1).alias("tier"), "pos",
        F.when(F.col("score") <= 2, "high").otherwise("medium").alias("priority"), F.col("name").alias("title"),
    )
    found = _ordered(from_items.unionByName(weak), key, 8)
    # A session for which nothing was found gets one item of its own.
    return sessions.select(key).distinct().join(found, key, "full").select(
        key, F.coalesce("tier", F.lit(3)).alias("tier"), F.coalesce("priority", F.lit("low")).alias("priority"),
        F.coalesce("title", F.when(F.col("tier").isNull(), "Rehearse the strongest answers")).alias("title"),
        F.coalesce("place", F.lit(1)).alias("place"),
    )


def score_history(latest: DataFrame, key: str = "session_id", n: int = 5) -> DataFrame:
    """(key, place, question_id, score, weakest, answers, mean): five answers with their weakest criterion."""
    totals = latest.groupBy(key).agg(
        F.count("*").alias("answers"), F.sum("score10").alias("s10")
    )
    weakest = F.array_min(
        F.transform("criteria", lambda c, i: F.struct(c["score"].alias("score"), i.alias("i"), c["name"].alias("name")))
    )["name"]
    shown = _top(latest, key, ["question_id"], n).select(
        key, F.col("pos").alias("place"), "question_id", (F.col("score10") / 10).alias("score"), weakest.alias("weakest")
    )
    return shown.join(totals, key).select(
        key, "place", "question_id", "score", "weakest", "answers", F.bround(F.col("s10") / (10 * F.col("answers")), 1).alias("mean")
    )
