"""Rankings over the stored index; the benchmark texts are the questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import grid as G
from ..operators import retrieval as R
from ..operators.index import written
from ..operators.topk import cosine, top_k
from ..operators.vectors import hashed_embedder
from .tables import global_index, index, probes, requirements, table


def _out(df):
    return df.withColumn("score", F.round("score", 6))


def _lexical(ix, asked):
    return R.bm25_rankings(ix.children, asked, lexicon=ix.lexicon)


def _ranked(ix, asked):
    return R.rank_chunks(ix.children, asked, lexicon=ix.lexicon)


def _scoped(spark, sf_dir):
    """The requirements and the part of the index that their sessions are in."""
    asked = requirements(spark, sf_dir)
    return index(spark, sf_dir, asked=asked), asked


def bm25_topk(spark, sf_dir):
    found = _lexical(global_index(spark, sf_dir), probes(spark, sf_dir))
    return _out(found.filter("rank <= 5")).select("query_id", "rank", "chunk_id", "score")


def bm25_scoped(spark, sf_dir):
    found = _lexical(*_scoped(spark, sf_dir))
    return _out(found).select("scope", "query_id", "rank", "chunk_id", "score")


def hashed_dense_topk(spark, sf_dir):
    ix, asked = _scoped(spark, sf_dir)
    found = R.dense_rankings(ix.children, asked, hashed_embedder())
    return _out(found).select("scope", "query_id", "ranking", "rank", "chunk_id", "score")


def dense_topk(spark, sf_dir):
    """Nearest vectors of every vector: the whole table asked of itself, inside one scope."""
    vecs = table(spark, sf_dir, "embeddings").select(
        F.lit("all").alias("scope"), F.col("vec_id").cast("string").alias("item_id"), F.col("embedding").alias("vec")
    )
    asked = vecs.select("scope", F.col("item_id").alias("query_id"), "vec")
    return _out(top_k(vecs, asked, cosine, 6)).filter("item_id <> query_id").select(
        F.col("query_id").cast("long").alias("vec_id"), "rank", F.col("item_id").cast("long").alias("near_id"), "score"
    )


def dense_label_quality(spark, sf_dir):
    """Do the nearest vectors carry the asker's label?"""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = dense_topk(spark, sf_dir)
    place = Window.partitionBy("vec_id").orderBy("rank")
    ranked = near.withColumn("place", F.row_number().over(place)).filter("place <= 5")
    hits = (
        ranked.join(labels, "vec_id")
        .join(labels.select(F.col("vec_id").alias("near_id"), F.col("label").alias("near_label")), "near_id")
        .groupBy("vec_id", "label")
        .agg(F.min(F.when(F.col("label") == F.col("near_label"), F.col("place"))).alias("first_rank"))
    )
    return hits.groupBy("label").agg(
        F.count("*").alias("n"),
        *[F.round(F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"hit_{k}")
          for k in (1, 3, 5)],
        F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def query_variants(spark, sf_dir):
    v = R.query_variants(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(v).alias("variant", "query"))


def rrf_fusion(spark, sf_dir):
    ix, asked = _scoped(spark, sf_dir)
    both = R.dense_rankings(ix.children, asked, hashed_embedder()).unionByName(_lexical(ix, asked))
    return _out(R.fuse(both))


def coverage_rerank(spark, sf_dir):
    """Rerank of the lexical ranking alone."""
    ix, asked = _scoped(spark, sf_dir)
    fused = R.fuse(_lexical(ix, asked))
    return _out(R.coverage_rerank(fused, ix.children, asked, 15))


def ranked_children(spark, sf_dir):
    return _out(_ranked(*_scoped(spark, sf_dir)))


def small_to_big(spark, sf_dir):
    ix, asked = _scoped(spark, sf_dir)
    found = R.retrieve(ix.children, ix.parents, asked, lexicon=ix.lexicon)
    return _out(found).withColumn("text_md5", F.md5("text")).drop("text")


def parent_lookup(spark, sf_dir):
    """Parent of the best lexical hit of every requirement."""
    ix, asked = _scoped(spark, sf_dir)
    best = _lexical(ix, asked).filter("rank = 1").select("scope", "chunk_id").distinct()
    return R.parent_text(ix.children, ix.parents, best).select("scope", "chunk_id", "parent_id", F.md5("text").alias("text_md5"))


def passage_digest(spark, sf_dir):
    """Top three passages of every requirement, cut to a readable length."""
    ix, asked = _scoped(spark, sf_dir)
    found = R.retrieve(ix.children, ix.parents, asked, lexicon=ix.lexicon).filter("rank <= 3")
    return found.select("scope", "query_id", "rank", "section", "page", F.left(T.squeeze(F.col("text")), F.lit(280)).alias("digest"))


def _relevant(ranked, chunks, asked):
    """A chunk is relevant if it holds the whole labelled passage."""
    wanted = asked.select("scope", "query_id", F.array(T.normalise(F.col("text"))).alias("wanted"))
    return E.first_relevant(ranked, chunks, wanted)


def bm25_hit_rate(spark, sf_dir):
    ix, asked = global_index(spark, sf_dir), probes(spark, sf_dir)
    return E.retrieval_metrics(_relevant(_lexical(ix, asked), ix.children, asked))


def retrieval_metrics(spark, sf_dir):
    ix, asked = global_index(spark, sf_dir), probes(spark, sf_dir)
    return E.retrieval_metrics(_relevant(_ranked(ix, asked), ix.children, asked))


def first_relevant_ranks(spark, sf_dir):
    ix, asked = global_index(spark, sf_dir), probes(spark, sf_dir)
    return _relevant(_ranked(ix, asked), ix.children, asked).select("query_id", "first_rank", "retrieved")


def retrieval_ablation(spark, sf_dir):
    """The metrics of every configuration in one table.

    Scoring the corpus is the costly part, so each chunking strategy is scored once, its rankings
    (a few rows per probe) are written, and the configurations select from them.
    """
    asked = probes(spark, sf_dir)
    scored: dict = {}
    out = None
    for name, choice in G.GRID.items():
        ix = global_index(spark, sf_dir, choice.strategy)
        if choice.strategy not in scored:
            scored[choice.strategy] = written(R.all_rankings(ix.children, asked, lexicon=ix.lexicon), "rankings")
        ranked = R.rank_chunks(ix.children, asked, reranker=choice.reranker, rankings=scored[choice.strategy].filter(choice.rankings))
        row = E.retrieval_metrics(_relevant(ranked, ix.children, asked)).select(
            F.lit(name).alias("config"), "*"
        )
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_scoped, bm25_hit_rate, hashed_dense_topk, dense_topk, dense_label_quality, query_variants,
        rrf_fusion, coverage_rerank, ranked_children, small_to_big, parent_lookup, passage_digest,
        first_relevant_ranks, retrieval_metrics, retrieval_ablation,
    )
}
