"""From retrieved passages to verdicts with a verbatim citation.

Requirements: scope, query_id, text, category, kind. Passages: scope, query_id, rank, chunk_id,
section, page, text. Term weights are looked up with one small equi-join per requirement; after that
a requirement and its passage share a row and every test is array work on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import matching as M
from ..functions import text as T
from .index import written

KEY = ["scope", "query_id"]


# --- term weights ------------------------------------------------------------------------
def idf_table(passages: DataFrame) -> DataFrame:
    """(scope, term, df, n, idf) over passage rows: a passage read for three requirements counts three
    times. Distinct terms are exploded per row and counted map-side first."""
    n = passages.groupBy("scope").agg(F.count("*").alias("n"))
    df = (
        passages.select("scope", T.tokens(F.col("text")).alias("toks"))
        .select("scope", F.explode(F.array_distinct("toks")).alias("term"))
        .groupBy("scope", "term")
        .agg(F.count("*").alias("df"))
    )
    return df.join(n, "scope").withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)


def max_idf(idf: DataFrame) -> DataFrame:
    return idf.groupBy("scope").agg(F.max("idf").alias("top_idf"))


def _weigh(terms: DataFrame, idf: DataFrame) -> DataFrame:
    """Add ``weight`` to (scope, term) rows; unseen terms take the largest weight of the scope."""
    return (
        terms.join(idf.select("scope", "term", "idf"), ["scope", "term"], "left")
        .join(max_idf(idf), "scope", "left")
        .withColumn("weight", F.coalesce("idf", "top_idf", F.lit(K.UNSEEN_IDF)))
        .drop("idf", "top_idf")
    )


def weighted_needles(requirements: DataFrame, idf: DataFrame) -> DataFrame:
    """(scope, query_id, needles): keywords in order with match keys and weights."""
    terms = requirements.select(*KEY, F.posexplode(T.keywords(F.col("text"))).alias("pos", "term"))
    # At most the keyword limit per requirement is collected.
    return (
        _weigh(terms, idf)
        .groupBy(*KEY)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("pos", "term", "weight", M.keyword_keys(F.col("term")).alias("keys")))
            ).alias("needles")
        )
    )


def decisive_terms(requirements: DataFrame, idf: DataFrame) -> DataFrame:
    """(scope, query_id, group_no, term): the rarest salient term of every coordinate group."""
    groups = T.let(
        T.coordinate_groups(F.col("text")),
        lambda g: F.when(F.size(g) > 0, g).otherwise(F.array("text")),
    )
    terms = (
        requirements.select(*KEY, F.posexplode(groups).alias("group_no", "part"))
        .select(*KEY, "group_no", F.posexplode(T.salient_terms(F.col("part"))).alias("pos", "term"))
    )
    return _weigh(terms, idf).groupBy(*KEY, "group_no").agg(
        F.max_by("term", F.struct("weight", -F.col("pos"))).alias("term")
    )


def armed(requirements: DataFrame, idf: DataFrame) -> DataFrame:
    """Requirements with ``needles`` and ``pivots`` ready for row-local matching."""
    pivots = decisive_terms(requirements, idf).groupBy(*KEY).agg(
        F.array_sort(
            F.collect_list(F.struct("group_no", "term", M.keyword_keys(F.col("term")).alias("keys")))
        ).alias("pivots")
    )
    none_needles = F.expr("cast(array() as array<struct<pos:int,term:string,weight:double,keys:array<string>>>)")
    none_pivots = F.expr("cast(array() as array<struct<group_no:int,term:string,keys:array<string>>>)")
    return (
        requirements.join(weighted_needles(requirements, idf), KEY, "left")
        .join(pivots, KEY, "left")
        .withColumn("needles", F.coalesce("needles", none_needles))
        .withColumn("pivots", F.coalesce("pivots", none_pivots))
        .withColumn(
            "asked",
            F.array_distinct(F.flatten(
                F.concat(F.transform("needles", lambda n: n["keys"]), F.transform("pivots", lambda p: p["keys"]))
            )),
        )
    )


# --- tests on one row --------------------------------------------------------------------
def weighted(needles: Column, keys: Column) -> Column:
    return F.round(M.weighted_coverage(needles, keys), 9)


def gate_open(pivots: Column, keys: Column) -> Column:
    """A decisive term is met, or nothing distinctive was named."""
    return (F.size(pivots) == 0) | M.any_met(pivots, keys)


def decisive_met(pivots: Column, keys: Column) -> Column:
    return (F.size(pivots) > 0) & M.any_met(pivots, keys)


def _closeness(sentence: Column) -> Column:
    return -F.abs(F.length(sentence) - K.SENTENCE_IDEAL_CHARS)


def best_sentence(needles: Column, passage: Column) -> Column:
    """struct<coverage, closeness, sentence>: best covering sentence, then length, then text."""
    def rate(nd, s):
        return T.let(
            M.text_keys(T.tokens(s)),
            lambda k: F.struct(
                F.round(M.coverage(nd, k), 9).alias("coverage"),
                _closeness(s).alias("closeness"), s.alias("sentence"),
            ),
        )

    return T.let(needles, lambda nd: F.array_max(F.transform(T.candidate_sentences(passage), lambda s: rate(nd, s))))


def best_evidence(needles: Column, pivots: Column, asked: Column, passage: Column) -> Column:
    """struct<gate, coverage, closeness, nth, decisive, quote> of the best sentence: one through the
    gate if there is any, then coverage, then length near the ideal, then the first. ``asked`` holds every key of
    the requirement: a sentence is cut down to the few keys it shares before any test looks at it."""
    def rate(req):
        def one(s, i):
            return T.let(
                F.array_intersect(req["asked"], M.text_keys(T.tokens(s))),
                lambda k: F.struct(
                    gate_open(req["pivots"], k).alias("gate"), weighted(req["needles"], k).alias("coverage"),
                    _closeness(s).alias("closeness"), (-i).alias("nth"),
                    decisive_met(req["pivots"], k).alias("decisive"), F.left(s, F.lit(K.QUOTE_MAX_CHARS)).alias("quote"),
                ),
            )

        return F.array_max(F.transform(T.candidate_sentences(passage), one))

    return T.let(F.struct(needles.alias("needles"), pivots.alias("pivots"), asked.alias("asked")), rate)


# --- verdicts ----------------------------------------------------------------------------
def evidence_rows(passages: DataFrame, ready: DataFrame) -> DataFrame:
    """One row per (requirement, passage) with the best sentence of the passage as ``ev``."""
    return passages.join(ready.select(*KEY, "needles", "pivots", "asked"), KEY).select(
        *KEY, "rank", "chunk_id", "section", "page",
        best_evidence(F.col("needles"), F.col("pivots"), F.col("asked"), F.col("text")).alias("ev"),
    )


def best_passages(evidence: DataFrame) -> DataFrame:
    """The winning passage per requirement; a passage that shows nothing at all cannot win."""
    standing = F.struct(
        F.col("ev.gate").alias("gate"), F.round("ev.coverage", 3).alias("c3"),
        (F.length("ev.quote") >= K.FRAGMENT_CHARS).alias("long"), (-F.col("rank")).alias("first"),
    )
    row = F.struct("chunk_id", "section", "page", "rank", "ev")
    return (
        evidence.withColumn("standing", standing)
        .filter("standing.gate or standing.c3 > 0 or standing.long")
        .groupBy(*KEY)
        .agg(F.max_by(row, "standing").alias("best"))
    )


def verdicts(requirements: DataFrame, passages: DataFrame) -> DataFrame:
    """One item per requirement: status, confidence and, unless missing, the cited sentence."""
    # Written, so that its true size is known when the join is planned: the passages, which are the
    # large side, then stay where they are while the requirements fit a broadcast.
    ready = written(armed(requirements, idf_table(passages)), "armed")
    best = best_passages(evidence_rows(passages, ready))
    judged = requirements.join(best, KEY, "left").withColumn(
        "coverage", F.coalesce("best.ev.coverage", F.lit(0.0))
    )
    through = F.coalesce(F.col("best.ev.gate"), F.lit(False))
    decisive = F.coalesce(F.col("best.ev.decisive"), F.lit(False))
    cover = F.col("coverage")
    status = (
        F.when(through & (cover >= K.STRONG_COVERAGE), "strong")
        .when(through & ((cover >= K.PARTIAL_COVERAGE) | decisive), "partial")
        .otherwise("missing")
    )
    confidence = (
        F.when(F.col("status") == "strong", F.least(F.lit(0.95), cover + 0.45))
        .when(F.col("status") == "partial", cover + 0.3)
        .otherwise(F.greatest(F.lit(0.10), cover / 2))
    )
    cited = F.col("status") != "missing"
    return (
        judged.withColumn("status", status)
        .withColumn("confidence", F.bround(F.round(confidence, 9), 2))
        .select(
            *[c for c in requirements.columns], "status", "confidence", "coverage",
            F.when(cited, F.col("best.ev.quote")).alias("evidence_quote"),
            F.when(cited, F.col("best.page")).alias("evidence_page"),
            F.when(cited, F.col("best.chunk_id")).alias("evidence_chunk_id"),
            F.when(cited, F.col("best.section")).alias("evidence_section"),
        )
    )


# --- citations ---------------------------------------------------------------------------
def locate(quote: Column, passage: Column) -> Column:
    """The passage's own characters for a quote, or null when it does not hold them."""
    needle = T.strip_chars(T.squeeze(quote), K.QUOTE_EDGE)

    def find(pair):
        at = F.instr(F.lower(pair["hay"]), F.lower(pair["needle"]))
        return F.when(
            (pair["needle"] != "") & (at > 0), F.substr(pair["hay"], at, F.length(pair["needle"]))
        )

    return T.let(F.struct(T.squeeze(passage).alias("hay"), needle.alias("needle")), find)


def verify_citations(items: DataFrame, passages: DataFrame) -> DataFrame:
    """Show the source's characters; an item whose quote no passage holds loses quote and status."""
    found = (
        items.filter("evidence_quote is not null and evidence_quote <> ''")
        .select(*KEY, "evidence_quote")
        .join(passages.select(*KEY, "rank", "text"), KEY)
        .select(*KEY, "rank", locate(F.col("evidence_quote"), F.col("text")).alias("span"))
        .filter("span is not null")
        .groupBy(*KEY)
        .agg(F.min_by("span", "rank").alias("span"))
    )
    quoted = F.col("evidence_quote").isNotNull() & (F.col("evidence_quote") != "")
    dropped = quoted & F.col("span").isNull()
    joined = items.join(found, KEY, "left").withColumn("dropped", dropped)
    for name in ("evidence_page", "evidence_chunk_id", "evidence_section"):
        joined = joined.withColumn(name, F.when(~F.col("dropped"), F.col(name)))
    return (
        joined.withColumn("status", F.when(F.col("dropped"), "missing").otherwise(F.col("status")))
        .withColumn("evidence_quote", F.when(quoted, F.col("span")).otherwise(F.col("evidence_quote")))
        .drop("span", "dropped")
    )


def heuristic_judge(items: DataFrame, passages: DataFrame) -> DataFrame:
    """(key, supported, score, gate): does the quote carry the decisive term and enough weight, weighed
    within the requirement's own passages? ``judges`` runs it beside others."""
    own = passages.withColumn("scope", F.concat_ws("|", "scope", "query_id"))
    asked = items.filter("evidence_quote is not null and evidence_quote <> ''").select(
        F.concat_ws("|", "scope", "query_id").alias("scope"), "query_id", "text", "evidence_quote",
        F.col("scope").alias("session"),
    )
    ready = armed(asked, idf_table(own))
    scored = ready.select(
        "session", "query_id", "needles", "pivots",
        M.text_keys(T.tokens(F.col("evidence_quote"))).alias("keys"),
    ).select(
        F.col("session").alias("scope"), "query_id",
        weighted(F.col("needles"), F.col("keys")).alias("score"),
        gate_open(F.col("pivots"), F.col("keys")).alias("gate"),
    )
    return scored.select(
        *KEY, (F.col("gate") & (F.col("score") >= K.JUDGE_COVERAGE)).alias("supported"),
        F.round("score", 3).alias("score"), "gate",
    )
