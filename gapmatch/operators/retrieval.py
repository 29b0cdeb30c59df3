"""Hybrid retrieval: query variants, dense and BM25 rankings, fusion, rerank, parents.

Scope is a key column of every step, so no step can mix two scopes. Chunks carry ``scope``,
``chunk_id``, ``parent_id``, ``section``, ``page``, ``text``, ``toks``, ``vec``; queries ``scope``,
``query_id``, ``text``. Only ids and scores travel until the few winners are known; texts join last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import matching as M
from ..functions import text as T
from ..storage import written
from .bm25 import Lexicon, bm25_top_k
from .topk import cosine, top_k
from .vectors import Embedder, hashed_embedder

Variants = Callable[[Column], Column]
Reranker = Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]
LEXICAL = "bm25"  #: name of the lexical ranking; dense ones are named by the number of their variant


# --- query variants ----------------------------------------------------------------------
def query_variants(requirement: Column, limit: int = K.MAX_VARIANTS) -> Column:
    """The query itself, its content words, and its content words with added phrases."""
    base = T.squeeze(requirement)
    kws = T.keywords(base, 10)
    bare = F.array_join(kws, " ")
    added = T.no_strings()
    for phrase, extra in K.EXPANSIONS.items():
        hit = F.lower(base).rlike(T.uni(rf"\b{phrase}\b"))
        added = F.concat(
            added, F.when(hit, F.array(*[F.lit(e) for e in extra])).otherwise(T.no_strings())
        )

    def build(v: Column) -> Column:
        use_bare = (F.size(v["kws"]) >= 2) & (F.lower(v["bare"]) != F.lower(v["base"]))
        widened = F.array_join(
            F.array_distinct(F.concat(F.slice(v["kws"], 1, 6), v["added"])), " "
        )
        all_three = F.array(
            v["base"], F.when(use_bare, v["bare"]), F.when(F.size(v["added"]) > 0, widened)
        )
        kept = F.filter(all_three, lambda q: q.isNotNull() & (T.strip(q) != ""))
        return F.slice(F.array_distinct(kept), 1, limit)

    parts = F.struct(base.alias("base"), kws.alias("kws"), bare.alias("bare"), added.alias("added"))
    return T.let(parts, build)


# --- rankings ----------------------------------------------------------------------------
def as_asked(requirement: Column) -> Column:
    """No variants: the query as it stands."""
    return F.array(requirement)


def dense_rankings(
    chunks: DataFrame, queries: DataFrame, embed: Embedder, variants: Variants = query_variants, k: int = K.CANDIDATE_K, **kw
) -> DataFrame:
    """(scope, query_id, ranking, chunk_id, score, rank), one ranking per query variant."""
    asked = queries.select("scope", "query_id", F.posexplode(variants(F.col("text"))).alias("v", "q")).select(
        "scope", F.concat_ws("|", F.col("v").cast("string"), "query_id").alias("query_id"),
        embed(F.col("q")).cast("array<float>").alias("vec"),
    )
    items = chunks.select("scope", F.col("chunk_id").alias("item_id"), "vec")
    return top_k(items, asked, cosine, k, **kw).select(
        "scope", F.regexp_replace("query_id", r"^\d+\|", "").alias("query_id"),
        F.substring_index("query_id", "|", 1).alias("ranking"),
        F.col("item_id").alias("chunk_id"), "score", "rank",
    )


def bm25_rankings(
    chunks: DataFrame, queries: DataFrame, lexicon: Lexicon | None = None, k: int = K.CANDIDATE_K, **kw
) -> DataFrame:
    """``lexicon`` holds stored term statistics; without it they are counted from the chunks."""
    found = bm25_top_k(chunks, queries, k, lexicon, **kw)
    return found.select(
        "scope", "query_id", F.lit(LEXICAL).alias("ranking"), F.col("item_id").alias("chunk_id"),
        "score", "rank",
    )


# --- fusion and rerank -------------------------------------------------------------------
def fuse(rankings: DataFrame, k: int = K.RRF_K) -> DataFrame:
    """(scope, query_id, chunk_id, score, rank) by reciprocal rank.

    A query with a single ranking is not fused: it keeps its order and its own scores, which are 0
    when that ranking is the lexical one.
    """
    per_chunk = rankings.groupBy("scope", "query_id", "chunk_id").agg(
        F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("rrf"),
        F.min("rank").alias("first_rank"),
        # equal scores keep the order of discovery: variants first, the lexical ranking last
        F.min(F.struct(F.when(F.col("ranking") == "bm25", "z").otherwise(F.col("ranking")).alias("by"), "rank")).alias("seen"),
        F.collect_set("ranking").alias("seen_in"),
        F.max(F.when(F.col("ranking") == "bm25", 0.0).otherwise(F.col("score"))).alias("own"),
    )
    # At most (variants + 1) * k candidates per query, so these windows are small.
    whole = Window.partitionBy("scope", "query_id")
    marked = per_chunk.withColumn(
        "n_rankings", F.size(F.array_distinct(F.flatten(F.collect_set("seen_in").over(whole))))
    )
    single = F.col("n_rankings") == 1
    scored = marked.withColumn("score", F.when(single, F.col("own")).otherwise(F.col("rrf")))
    order = whole.orderBy(
        F.when(single, F.col("first_rank")).otherwise(0),
        F.when(single, 0.0).otherwise(-F.col("score")),
        "seen", "chunk_id",
    )
    return scored.select(
        "scope", "query_id", "chunk_id", "score", F.row_number().over(order).alias("rank")
    )


def coverage_rerank(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Blend keyword coverage of the chunk with the retrieval score; ties keep the order."""
    asked = queries.select(
        "scope", "query_id", M.needles(T.keywords(F.col("text"))).alias("needles")
    )
    scored = (
        candidates.join(chunks.select("scope", "chunk_id", "toks"), ["scope", "chunk_id"])
        .join(asked, ["scope", "query_id"])
        .withColumn("keys", M.text_keys(F.col("toks")))
        .withColumn("cover", M.coverage(F.col("needles"), F.col("keys")))
        .withColumn(
            "blend",
            F.round(
                0.75 * F.col("cover") + 0.25 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")), 12
            ),
        )
    )
    order = Window.partitionBy("scope", "query_id").orderBy(F.desc("blend"), "rank")
    return (
        scored.withColumn("new_rank", F.row_number().over(order))
        .filter(F.col("new_rank") <= k)
        .select(
            "scope", "query_id", "chunk_id", F.col("blend").alias("score"),
            F.col("new_rank").alias("rank"),
        )
    )


def keep_order(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The reranker that changes nothing."""
    return candidates.filter(F.col("rank") <= k)


def all_rankings(
    chunks: DataFrame, queries: DataFrame, embed: Embedder | None = None, lexicon: Lexicon | None = None,
    variants: Variants = query_variants, k: int = K.CANDIDATE_K, **kw,
) -> DataFrame:
    """Dense and lexical rankings in one table. ``embed`` is what the index was built with."""
    dense = dense_rankings(chunks, queries, embed or hashed_embedder(), variants, k, **kw)
    return dense.unionByName(bm25_rankings(chunks, queries, lexicon, k, **kw))


def rank_chunks(
    chunks: DataFrame, queries: DataFrame, embed: Embedder | None = None, reranker: Reranker = coverage_rerank,
    rankings: DataFrame | None = None, k: int = K.CANDIDATE_K, **kw,
) -> DataFrame:
    """Ranked child chunks of every query, from ``rankings`` or from all of them.

    Candidates are written, so that their true size is known when the joins are planned: the chunks, which are the large
    side, then stay where they are while the candidates fit a broadcast.
    """
    if rankings is None:
        rankings = all_rankings(chunks, queries, embed, k=k, **kw)
    return reranker(written(fuse(rankings), "candidates"), chunks, queries, k)


# --- small to big ------------------------------------------------------------------------
def passages(
    ranked: DataFrame, chunks: DataFrame, parents: DataFrame, top: int = K.TOP_K
) -> DataFrame:
    """(scope, query_id, rank, chunk_id, parent_id, section, page, score, text).

    The best hit of every parent, in rank order, at most ``top``; below the noise floor only the
    single best passage is kept. The parent text joins after the cut, which is written for the same reason as candidates.
    """
    located = ranked.join(
        chunks.select("scope", "chunk_id", "parent_id", "section", "page"), ["scope", "chunk_id"]
    )
    per_parent = Window.partitionBy("scope", "query_id", "parent_id").orderBy("rank")
    per_query = Window.partitionBy("scope", "query_id")
    cut = (
        located.withColumn("nth", F.row_number().over(per_parent))
        .filter("nth = 1")
        .withColumn("place", F.row_number().over(per_query.orderBy("rank")))
        .filter(F.col("place") <= top)
        .withColumn("loud", F.count(F.when(F.col("score") >= K.SCORE_FLOOR, 1)).over(per_query))
        .filter((F.col("score") >= K.SCORE_FLOOR) | ((F.col("loud") == 0) & (F.col("place") == 1)))
        .withColumn("rank", F.row_number().over(per_query.orderBy("place")))
    )
    return written(cut, "cut").join(
        parents.select("scope", "parent_id", "text"), ["scope", "parent_id"]
    ).select(
        "scope", "query_id", "rank", "chunk_id", "parent_id", "section", "page", "score", "text"
    )


def retrieve(chunks: DataFrame, parents: DataFrame, queries: DataFrame, top: int = K.TOP_K, **kw) -> DataFrame:
    return passages(written(rank_chunks(chunks, queries, **kw), "ranked"), chunks, parents, top)


def parent_text(chunks: DataFrame, parents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Parent of given chunk ids (scope, chunk_id)."""
    return (
        wanted.join(chunks.select("scope", "chunk_id", "parent_id"), ["scope", "chunk_id"])
        .join(parents.select("scope", "parent_id", "text"), ["scope", "parent_id"])
        .select("scope", "chunk_id", "parent_id", "text")
    )
