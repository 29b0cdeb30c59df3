"""Scores and reports over match items.

Items: session_id, order_key (any orderable value), requirement, category, kind, status, confidence,
evidence_quote. A session's list is cut to the few entries shown before anything is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as T


def half_credit(status: Column) -> Column:
    """Credit in half points, so that sums stay integers."""
    return F.when(status == "strong", 2).when(status == "partial", 1).otherwise(0)


def weight(category: Column) -> Column:
    return F.when(category == "must_have", 2).otherwise(1)


def percent(earned_halves: Column, total: Column) -> Column:
    """Rounded percentage; 0 when there is nothing to score."""
    return F.coalesce(
        F.bround(50 * earned_halves / F.nullif(total, F.lit(0)), 0).cast("long"), F.lit(0)
    )


def first_texts(rows: DataFrame, n: int, name: str, key: str = "session_id", order: str = "order_key",
                value: str = "requirement") -> DataFrame:
    """(key, name array): the first n values per key. The rank limit is applied before the shuffle."""
    place = Window.partitionBy(key).orderBy(order)
    return (
        rows.withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= n)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("place", value))).alias("kept"))
        .select(key, F.col(f"kept.{value}").alias(name))
    )


def match_scores(items: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, overall_score, verdict, tallies): weighted percentage over evidenceable items."""
    counted = F.col("kind") == "evidenceable"
    w = F.when(counted, weight(F.col("category"))).otherwise(0)
    sums = items.groupBy(key).agg(
        F.sum(w * half_credit(F.col("status"))).alias("earned"),
        F.sum(w).alias("total"),
        *[
            F.count_if(counted & (F.col("status") == s)).alias(f"n_{s}")
            for s in ("strong", "partial", "missing")
        ],
        F.count_if(counted).alias("n_scored"),
        F.count_if(~counted).alias("n_behavioural"),
    )
    return (
        sums.withColumn("overall_score", percent(F.col("earned"), F.col("total")))
        .withColumn("verdict", T.band(F.col("overall_score"), K.VERDICT_BANDS))
        .drop("earned", "total")
    )


def match_reports(items: DataFrame, key: str = "session_id") -> DataFrame:
    """Scores with the stated counts, and the first three must-haves without evidence."""
    gaps = first_texts(
        items.filter("kind = 'evidenceable' and status = 'missing' and category = 'must_have'"),
        3, "must_missing", key,
    )
    return match_scores(items, key).join(gaps, key, "left").select(
        "*",
        F.format_string(
            "%d of %d requirements are backed by evidence; %d have none.",
            "n_strong", "n_scored", "n_missing",
        ).alias("summary"),
    ).withColumn("must_missing", F.coalesce("must_missing", T.no_strings()))


def report_digest(items: DataFrame, key: str = "session_id") -> DataFrame:
    """Overall score with the first four evidenced and the first four missing requirements."""
    out = match_scores(items, key).select(key, "overall_score", "verdict")
    for status in ("strong", "missing"):
        out = out.join(first_texts(items.filter(F.col("status") == status), 4, status, key), key, "left")
    return out.select(
        key, "overall_score", "verdict",
        *[F.coalesce(s, T.no_strings()).alias(s) for s in ("strong", "missing")],
    )


def carry_kind(items: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """The kind decided at extraction wins by position; the judged one only fills gaps."""
    decided = extracted.select(*keys, F.col("kind").alias("decided"))
    return items.join(decided, keys, "left").withColumn("kind", F.coalesce("decided", "kind")).drop("decided")


def refused_sessions(sessions: DataFrame, requirements: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions whose posting yielded no requirement: refused, never scored 0 or 100."""
    return sessions.join(requirements.select(key).distinct(), key, "left_anti").select(
        key, F.lit("no_requirements").alias("status")
    )


# --- letters, bullets, display -----------------------------------------------------------
def letter_material(items: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, claims array<struct<requirement,quote,confidence>>, forbidden array<string>).

    The claims a letter may make, achievements first, cut to the letter's paragraphs before collecting; and the
    requirements it must not claim, in the order of the posting. ``sessions`` brings ``target_role``.
    """
    strong = items.filter("status = 'strong' and evidence_quote is not null and evidence_quote <> ''")
    usable = strong.join(sessions.select(key, "target_role"), key).filter(
        ~T.restates_role(F.col("requirement"), F.col("target_role"))
    )
    order = Window.partitionBy(key).orderBy(
        T.is_achievement(F.col("evidence_quote")).desc(), F.bround("confidence", 2).desc(), "order_key"
    )
    claims = (
        usable.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= K.LETTER_CLAIMS)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct(
            "place", F.struct("requirement", F.col("evidence_quote").alias("quote"), F.bround("confidence", 2).alias("confidence")).alias("claim")
        ))).alias("kept"))
        .select(key, F.col("kept.claim").alias("claims"))
    )
    forbidden = items.filter("status = 'missing' and category = 'must_have' and kind = 'evidenceable'")
    return (
        sessions.select(key)
        .join(claims, key, "left")
        .join(forbidden.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("order_key", "requirement"))).alias("held")), key, "left")
        .select(
            key, F.coalesce("claims", F.array().cast(claims.schema["claims"].dataType)).alias("claims"),
            F.coalesce(F.col("held.requirement"), T.no_strings()).alias("forbidden"),
        )
    )


def letter_lines(material: DataFrame) -> DataFrame:
    """``letter_material`` as text: a claim with its confidence and quote, and the forbidden requirements."""
    def line(c: Column) -> Column:
        return F.format_string("%s [%.2f] %s", c["requirement"], c["confidence"], c["quote"])

    return material.withColumn("claims", F.array_join(F.transform("claims", line), " | ")).withColumn(
        "n_forbidden", F.size("forbidden")
    ).withColumn("forbidden", F.array_join("forbidden", " | "))


def gate_bullets(bullets: DataFrame) -> DataFrame:
    """Add ``refusal``: strong items need no bullet; an unevidenced one must stay a template.

    Columns: status, evidence_quote, bullet, placeholders array<string>.
    """
    held = F.size(F.filter("placeholders", lambda p: F.contains(F.col("bullet"), p)))
    unevidenced = F.coalesce(F.col("evidence_quote"), F.lit("")) == ""
    return bullets.withColumn(
        "refusal",
        F.when(F.col("status") == "strong", "already_evidenced")
        .when(unevidenced & (held < K.MIN_PLACEHOLDERS), "finished_claim")
        .otherwise(""),
    )


def tone(score: Column, top: Column | None = None) -> Column:
    """Display colour of a score on its own scale."""
    pct = score if top is None else F.when(top != 0, score / top * 100).otherwise(0)
    return T.band(pct, K.TONE_BANDS)
