"""Agreement metrics: lines grouped by supplier, price rank as the human score, quantity as the system's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from .retrieval_queries import bm25_hit_rate
from .tables import order_answers, order_key, table


def _scores(spark, sf_dir):
    """(suite, answer_id, expected, predicted): integer halves, so every mean is exact."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("suite"), F.concat_ws("/", "l_orderkey", order_key()).alias("answer_id"),
        (F.lit(1) + F.floor(F.col("l_extendedprice") / 25000)).cast("double").alias("expected"),
        (F.lit(2) + F.floor(F.col("l_quantity") / 7)).cast("double").alias("predicted"),
    )


def score_agreement(spark, sf_dir):
    return E.score_agreement(_scores(spark, sf_dir), "suite")


def spearman(spark, sf_dir):
    return E.spearman(_scores(spark, sf_dir), "suite")


def pairwise(spark, sf_dir):
    """Consecutive line numbers of an order are judged pairs: the earlier line should score higher."""
    lines = table(spark, sf_dir, "lineitem")
    best = lines.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").alias("predicted"))
    scores = best.select(F.concat_ws("/", "o", "n").alias("answer_id"), "predicted")
    pairs = best.select(
        F.concat_ws("/", "o", "n").alias("better"), F.concat_ws("/", "o", (F.col("n") + 1).cast("string")).alias("worse"), (F.col("o") % 10).alias("suite"),
    )
    return E.pairwise_accuracy(E.pair_outcomes(pairs, scores), "suite")


def self_consistency(spark, sf_dir):
    """Repeated answers to one question, deviation per question number."""
    repeats = order_answers(spark, sf_dir).select(
        F.concat_ws("/", "session_id", "question_id").alias("answer_id"), F.col("question_id").alias("suite"), (F.col("score10") / 10).alias("score")
    )
    return E.self_consistency(repeats, "answer_id", "suite")


def metrics_sink(spark, sf_dir):
    """Metric rows in the long form the sink appends."""
    return E.long_metrics(bm25_hit_rate(spark, sf_dir), "retrieval").union(
        E.long_metrics(E.score_agreement(_scores(spark, sf_dir)), "scoring")
    )


def label_read(spark, sf_dir):
    """Labels by expected status, with how many requirements have none."""
    expected = F.when(F.col("toxic") == 1, "missing").when(F.col("quality") == 0, "partial").otherwise("strong")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("documents"), F.count("quality").alias("labelled"),
        *[F.count_if(F.col("quality").isNotNull() & (expected == s)).alias(f"n_{s}") for s in ("strong", "partial", "missing")],
    )


QUERIES = {f.__name__: f for f in (score_agreement, spearman, pairwise, self_consistency, metrics_sink, label_read)}
