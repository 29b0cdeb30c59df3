"""Quality metrics over result tables: retrieval, grounding, answer scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as T
from .chunking import document_of
from .ranks import with_below

def share(flag: Column) -> Column:
    """Mean of a boolean over the rows where it is known; null when there are none."""
    return F.avg(flag.cast("double"))


# --- retrieval ---------------------------------------------------------------------------
def first_relevant(ranked: DataFrame, chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(scope, query_id, first_rank, retrieved) for every probe of ``wanted`` (scope, query_id,
    wanted array of normalised phrases); probes that found nothing stay, with a null rank."""
    texts = chunks.select("scope", "chunk_id", T.normalise(F.col("text")).alias("norm"))
    judged = ranked.join(texts, ["scope", "chunk_id"]).join(wanted, ["scope", "query_id"]).select(
        "scope", "query_id", "rank",
        T.let(
            F.col("norm"), lambda n: F.exists("wanted", lambda w: F.contains(n, w))
        ).alias("relevant"),
    )
    per_probe = judged.groupBy("scope", "query_id").agg(
        F.min(F.when(F.col("relevant"), F.col("rank"))).cast("long").alias("first_rank"),
        F.count("*").alias("retrieved"),
    )
    return wanted.select("scope", "query_id").join(per_probe, ["scope", "query_id"], "left").withColumn(
        "retrieved", F.coalesce("retrieved", F.lit(0))
    )


def retrieval_metrics(outcomes: DataFrame, *by: str) -> DataFrame:
    rank = F.col("first_rank")
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("probes"),
        F.count(rank).alias("found"),
        *[
            F.round(F.coalesce(F.avg(F.coalesce((rank <= k).cast("double"), F.lit(0.0))), F.lit(0.0)), 6).alias(f"hit_rate_{k}")
            for k in (1, 3, 5)
        ],
        F.round(F.coalesce(F.avg(F.coalesce(1 / rank, F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.avg(rank), 6).alias("mean_first_rank"),
    )


# --- grounding ---------------------------------------------------------------------------
ANCHOR = 6  # leading characters of a phrase that a requirement has to contain


def match_label(requirements: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """First label (by ``label_pos``) of the same scope whose phrase occurs in the requirement.

    ``labels``: scope, label_pos, phrase, expected. Containment runs as an equi-join: equal phrases
    collapse to their first label, and a phrase meets only requirements that contain its leading
    characters, so a large scope never pairs all its labels with all its requirements.
    """
    phrases = labels.groupBy("scope", F.lower("phrase").alias("phrase")).agg(
        F.min(F.struct("label_pos", "expected")).alias("first")
    ).withColumn("anchor", F.left("phrase", F.lit(ANCHOR)))
    low = F.lower("requirement")

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(low, i, n))

    pieces = F.flatten(F.array(*[grams(n) for n in range(1, ANCHOR + 1)]))
    met = (
        requirements.select(*keys, low.alias("low"), F.explode(F.array_distinct(pieces)).alias("anchor"))
        .join(phrases, ["scope", "anchor"])
        .filter(F.contains(F.col("low"), F.col("phrase")))
        .groupBy(*keys)
        .agg(F.min("first").alias("first"))
        .select(*keys, F.col("first.expected").alias("expected"))
    )
    return requirements.join(met, keys, "left")


def grounding_outcomes(
    items: DataFrame, passages: DataFrame, sources: DataFrame, labels: DataFrame | None = None, expected: DataFrame | None = None
) -> DataFrame:
    """Verdicts with the columns the grounding metrics read. ``expected`` (scope, query_id, expected) are labels that
    have been matched before.

    The quote is sought in the whole document it cites (``sources``: doc_key, text) and in the passages
    retrieved for its requirement.
    """
    key = ["scope", "query_id"]
    quote = T.normalise(F.col("evidence_quote"))
    in_context = (
        items.join(passages.select(*key, F.col("text").alias("passage")), key)
        .groupBy(*key)
        .agg(F.max(F.contains(T.normalise(F.col("passage")), quote)).alias("quote_in_context"))
    )
    asked = items.withColumn("requirement", F.col("text")).withColumn("doc_key", document_of(F.col("evidence_chunk_id")))
    labelled = match_label(asked, labels, key) if expected is None else asked.join(expected, key, "left")
    return (
        labelled.join(in_context, key, "left")
        .join(sources.select("doc_key", T.normalise(F.col("text")).alias("source_text")), "doc_key", "left")
        .select(
            *key, "requirement", F.col("status").alias("predicted"), "expected", "category", F.col("evidence_quote").alias("quote"),
            F.when(quote.isNotNull(), F.coalesce(F.contains("source_text", quote), F.lit(False))).alias("quote_in_source"), "quote_in_context", "kind",
        )
    )


def grounding_metrics(items: DataFrame, *by: str) -> DataFrame:
    """``items``: predicted, expected (null = unlabelled), quote (null = none), quote_in_source,
    quote_in_context."""
    cited = F.col("quote").isNotNull() & (F.col("quote") != "")
    predicted, expected = F.col("predicted"), F.col("expected")

    def order(status: Column) -> Column:
        chain = None
        for name, n in K.STATUS_ORDER.items():
            chain = F.when(status == name, n) if chain is None else chain.when(status == name, n)
        return chain

    def r(value: Column, name: str) -> Column:
        return F.round(value, 6).alias(name)

    return items.groupBy(*by).agg(
        F.count("*").alias("requirements"),
        F.count(expected).alias("labelled"),
        r(share(F.when(cited, F.col("quote_in_source"))), "citation_validity"),
        r(share(F.when(cited, F.col("quote_in_context"))), "citation_in_context"),
        r(F.coalesce(share(F.when(predicted != "missing", ~cited)), F.lit(0.0)), "unsupported_verdict_rate"),
        r(share(predicted == expected), "status_accuracy"),
        r(share(F.abs(order(predicted) - order(expected)) <= 1), "status_within_one"),
        r(share(F.when(expected == "missing", predicted != "missing")), "false_evidence_rate"),
        r(share(F.when(expected == "strong", predicted == "missing")), "missed_evidence_rate"),
    )


def disagreements(items: DataFrame) -> DataFrame:
    return items.filter("expected is not null and predicted <> expected")


def numeric_consistency(reports: DataFrame, items: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, consistent): do the counts stated in the summary equal the verdicts? Reports that state
    no count are left out."""
    stated = reports.select(
        key,
        F.regexp_extract("summary", K.COUNT_CLAIM, 1).alias("a"),
        F.regexp_extract("summary", K.COUNT_CLAIM, 2).alias("b"),
    ).filter("a <> ''")
    actual = items.groupBy(key).agg(
        F.count_if(F.col("predicted") == "strong").alias("strong"), F.count("*").alias("total")
    )
    return stated.join(actual, key, "left").select(
        key,
        (
            (F.col("a").cast("long") == F.coalesce("strong", F.lit(0)))
            & (F.col("b").cast("long") == F.coalesce("total", F.lit(0)))
        ).alias("consistent"),
    )


# --- answer scoring ----------------------------------------------------------------------
def score_agreement(scores: DataFrame, *by: str) -> DataFrame:
    """``scores``: expected, predicted."""
    d = F.col("predicted") - F.col("expected")
    return scores.groupBy(*by).agg(
        F.count("*").alias("answers"),
        F.round(F.avg(F.abs(d)), 6).alias("score_mae"),
        F.round(F.avg(d), 6).alias("score_bias"),
        F.round(share(F.abs(d) <= 1.0), 6).alias("within_one"),
    )


def pair_outcomes(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(better, worse, correct); pairs with an unscored side drop out.

    ``pairs``: better, worse; ``scores``: answer_id, predicted.
    """
    def side(name):
        return scores.select(F.col("answer_id").alias(name), F.col("predicted").alias(f"{name}_score"))

    return (
        pairs.join(side("better"), "better").join(side("worse"), "worse")
        .withColumn("correct", F.col("better_score") > F.col("worse_score"))
    )


def pairwise_accuracy(outcomes: DataFrame, *by: str) -> DataFrame:
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("checked"),
        F.count_if(~F.col("correct")).alias("violations"),
        F.round(share(F.col("correct")), 6).alias("pairwise_accuracy"),
    )


def self_consistency(repeats: DataFrame, key: str, *by: str) -> DataFrame:
    """Mean population deviation over answers scored more than once. ``repeats``: key, score."""
    per_answer = repeats.groupBy(*by, key).agg(
        F.count("*").alias("n"), F.stddev_pop("score").alias("dev")
    ).filter("n > 1")
    return per_answer.groupBy(*by).agg(
        F.count("*").alias("repeated"), F.round(F.avg("dev"), 6).alias("self_consistency")
    )


def average_ranks(scores: DataFrame, value: str, name: str, by: str) -> DataFrame:
    """(by, value, name): the shared rank of every distinct value within its group."""
    counts = with_below(scores.groupBy(by, value).agg(F.count("*").alias("n")), by, value)
    return counts.select(by, value, (F.col("below") + (F.col("n") + 1) / 2).alias(name))


def spearman(scores: DataFrame, by: str) -> DataFrame:
    """Rank correlation of expected and predicted per group; null under three rows or without spread."""
    a = average_ranks(scores, "expected", "ra", by)
    b = average_ranks(scores, "predicted", "rb", by)
    # Rows with equal score pairs count as one weighted row, so the joins carry distinct pairs only.
    pairs = scores.groupBy(by, "expected", "predicted").agg(F.count("*").alias("w"))
    ranked = pairs.join(a, [by, "expected"]).join(b, [by, "predicted"])
    w, x, y = F.col("w").cast("double"), F.col("ra"), F.col("rb")
    sums = ranked.groupBy(by).agg(
        F.sum("w").alias("answers"),
        F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"),
        F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"),
    )
    n = F.col("answers")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = n * F.col("sxx") - F.col("sx") ** 2
    vy = n * F.col("syy") - F.col("sy") ** 2
    return sums.select(
        by, "answers",
        F.when((n >= 3) & (vx > 0) & (vy > 0), F.round(cov / F.sqrt(vx) / F.sqrt(vy), 6)).alias("spearman"),
    )


def long_metrics(wide: DataFrame, suite: str, keep: tuple = ()) -> DataFrame:
    """(keep..., suite, metric, value) from one wide row per configuration."""
    names = [c for c in wide.columns if c not in keep]
    return wide.select(
        *keep, F.lit(suite).alias("suite"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m"),
    ).select(*keep, "suite", "m.metric", "m.value")
