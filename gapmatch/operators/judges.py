"""Judges of citations: is the quoted sentence evidence for its requirement?

A judge is a name, whether it can be trusted against what it grades, and a function from (requirement, quote, passages)
Columns to a struct of ``supported``, ``score`` and ``rationale``. The function is an expression or a vectorised
UDF that returns structs, so a model can serve as a judge. All judges run over one table of verdicts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import written
from .evaluation import share
from .evidence import KEY, heuristic_judge

OPINION = "supported boolean, score double, rationale string"


@dataclass(frozen=True)
class Judge:
    name: str
    trustworthy: bool
    opinion: Callable[[Column, Column, Column], Column]


def model_judge(name: str, grade: Callable[[list[str], list[str], list[list[str]]], list[tuple[bool, float, str]]], trustworthy: bool = True) -> Judge:
    """A judge from a function of batches: requirements, quotes and passages to (supported, score, rationale)."""
    @F.pandas_udf(OPINION)
    def opinion(requirement: pd.Series, quote: pd.Series, passages: pd.Series) -> pd.DataFrame:
        rows = grade(requirement.tolist(), quote.tolist(), [list(p) for p in passages])
        return pd.DataFrame(rows, columns=["supported", "score", "rationale"])

    return Judge(name, trustworthy, opinion)


def verbatim_opinion(requirement: Column, quote: Column, passages: Column) -> Column:
    """Holds the quote to its source and to the requirement's own words: a retrieved passage has it word for word, and
    at least a quarter of the requirement's keywords are in it."""
    asked = T.keywords(requirement)
    met = F.array_intersect(asked, F.array_distinct(T.tokens(quote)))
    held = F.exists(passages, lambda p: F.contains(T.normalise(p), T.normalise(quote)))
    score = F.round(F.size(met) / F.greatest(F.size(asked), F.lit(1)), 3)
    return F.struct(
        (held & (score >= 0.25)).alias("supported"), score.alias("score"),
        F.format_string("%s, %d of %d keywords", F.when(held, "quoted word for word").otherwise("not in a passage"), F.size(met), F.size(asked)).alias("rationale"))


VERBATIM = Judge("verbatim", False, verbatim_opinion)


def judged(items: DataFrame, passages: DataFrame, judges: list[Judge]) -> DataFrame:
    """(scope, query_id, judge, trustworthy, supported, score, rationale): every judge on every item with a quote.

    A requirement's passages are at most the retrieval's top few, so they travel as one array.
    """
    quoted = items.filter("evidence_quote is not null and evidence_quote <> ''").select(*KEY, F.col("text").alias("requirement"), "evidence_quote")
    found = passages.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("found"))
    cases = quoted.join(found, KEY, "left").select(
        *KEY, "requirement", "evidence_quote", F.coalesce(F.transform("found", lambda p: p["text"]), F.array().cast("array<string>")).alias("passages"))
    cases = written(cases, "cases") if len(judges) > 1 else cases
    out = None
    for judge in judges:
        opinion = judge.opinion(F.col("requirement"), F.col("evidence_quote"), F.col("passages"))
        part = cases.withColumn("o", F.explode(F.array(opinion))).select(
            *KEY, F.lit(judge.name).alias("judge"), F.lit(judge.trustworthy).alias("trustworthy"), "o.supported", "o.score", "o.rationale")
        out = part if out is None else out.unionByName(part)
    return out


def heuristic_judged(items: DataFrame, passages: DataFrame) -> DataFrame:
    """The rule-based judge in the same shape. It shares the view of the verdicts it grades, so it is not trusted."""
    found = heuristic_judge(items, passages)
    reason = F.concat(F.lit("decisive term "), F.when(F.col("gate"), "present").otherwise("absent"), F.lit(", weighted coverage "), F.col("score").cast("string"))
    return found.select(*KEY, F.lit("heuristic").alias("judge"), F.lit(False).alias("trustworthy"), "supported", "score", reason.alias("rationale"))


def by_judge(opinions: DataFrame) -> DataFrame:
    """What each judge says of all items, and how far the others agree with it."""
    other = opinions.select(*KEY, F.col("judge").alias("other"), F.col("supported").alias("theirs"))
    agreed = opinions.join(other, KEY).filter("judge <> other").groupBy("judge").agg(F.round(share(F.col("supported") == F.col("theirs")), 6).alias("agreement"))
    rates = opinions.groupBy("judge", "trustworthy").agg(
        F.count(F.lit(1)).alias("judged"), F.round(share(F.col("supported")), 6).alias("support_rate"), F.round(F.avg("score"), 6).alias("mean_score"))
    return rates.join(agreed, "judge", "left").withColumn("note", F.when(F.col("trustworthy"), "").otherwise("indicative only"))
