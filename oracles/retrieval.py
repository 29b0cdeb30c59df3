"""DuckDB statements for gapmatch.plans.retrieval_queries."""

from __future__ import annotations

from gapmatch.functions import fixed as K

from . import parts as P

ALL = "'all'"


def lexical(scope, queries):
    return P.child_ctes(scope) + [queries] + P.bm25_ctes()


def dense(scope, queries):
    return P.child_ctes(scope) + [queries] + P.dense_ctes()


def metrics(ranked: str) -> list[tuple[str, str]]:
    norm = f"lower({P.squeeze('text')})"
    return [
        ("wanted", f"SELECT scope, query_id, {norm} AS want FROM queries"),
        ("judged", f"SELECT r.scope, r.query_id, r.rank, contains(lower({P.squeeze('c.text')}), want) AS hit FROM {ranked} r "
                   "JOIN chunks c USING (scope, chunk_id) JOIN wanted w ON w.scope = r.scope AND w.query_id = r.query_id"),
        ("firsts", "SELECT query_id, min(rank) FILTER (hit) AS first_rank, count(j.rank) AS retrieved FROM wanted w "
                   "LEFT JOIN judged j USING (scope, query_id) GROUP BY query_id"),
    ]


SUMMARY = (
    "count(*) AS probes, count(first_rank) AS found, "
    + ", ".join(f"round(avg(coalesce((first_rank <= {k})::INT, 0)), 6) AS hit_rate_{k}" for k in (1, 3, 5))
    + ", round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr, round(avg(first_rank), 6) AS mean_first_rank FROM firsts"
)


def ablation(cfg: dict, strategy: str) -> str:
    chunks = P.child_ctes(ALL) if strategy == "parent_child" else P.fixed_child_ctes(ALL)
    ctes = chunks + [P.ALL_QUERIES] + P.bm25_ctes() + P.dense_ctes(multi=cfg.get("multi", True))
    both = P.BOTH if cfg.get("bm25", True) else P.BOTH.split(" UNION ALL ")[0]
    ctes += P.fused_ctes(both)
    if cfg.get("rerank", True):
        ctes += P.rerank_ctes()
    else:
        ctes.append(("rr", f"SELECT * FROM fu WHERE rank <= {K.CANDIDATE_K}"))
    return P.with_(ctes + metrics("rr"), f"SELECT {SUMMARY}")


OFF = {"all on": (), "rerank off": ("rerank",), "words off": ("bm25",), "variants off": ("multi",), "vectors alone": ("multi", "bm25", "rerank")}
CONFIGS = {name: (dict.fromkeys(off, False), "parent_child") for name, off in OFF.items()} | {"windows": ({}, "fixed")}
EMB = (
    "WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS near_id, "
    "round(list_cosine_similarity(a.v, b.v), 9) AS score FROM n a, n b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id "
    "ORDER BY score DESC, near_id::VARCHAR) AS rank FROM s QUALIFY rank <= 6), "
    "t AS (SELECT vec_id, rank, near_id, round(score, 6) AS score FROM r WHERE near_id <> vec_id)"
)
RANKED = P.ranked_ctes("source", P.SESSION_QUERIES)
RANKED_ALL = P.ranked_ctes(ALL, P.ALL_QUERIES)

ORACLES = {
    "bm25_topk": P.with_(lexical(ALL, P.ALL_QUERIES), "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM bm WHERE rank <= 5"),
    "bm25_scoped": P.with_(lexical("source", P.SESSION_QUERIES), "SELECT scope, query_id, rank, chunk_id, round(score, 6) AS score FROM bm"),
    "bm25_hit_rate": P.with_(lexical(ALL, P.ALL_QUERIES) + metrics("bm"), f"SELECT {SUMMARY}"),
    "hashed_dense_topk": P.with_(
        dense("source", P.SESSION_QUERIES), "SELECT scope, query_id, v::VARCHAR AS ranking, rank, chunk_id, round(score, 6) AS score FROM dn"),
    "dense_topk": EMB + " SELECT * FROM t",
    "dense_label_quality": EMB + ", " + """
        p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY rank) AS place FROM t QUALIFY place <= 5),
        h AS (SELECT p.vec_id, a.label, min(place) FILTER (a.label = b.label) AS fr FROM p JOIN embeddings a ON a.vec_id = p.vec_id
              JOIN embeddings b ON b.vec_id = p.near_id GROUP BY ALL)
        SELECT label, count(*) AS n, """ + ", ".join(f"round(avg(coalesce((fr <= {k})::INT, 0)), 6) AS hit_{k}" for k in (1, 3, 5))
        + ", round(avg(coalesce(1.0 / fr, 0)), 6) AS mrr FROM h GROUP BY label",
    "query_variants": f"SELECT item_id, generate_subscripts(l, 1)::INT - 1 AS variant, unnest(l) AS query FROM (SELECT item_id, {P.variants('text')} AS l FROM benchmark)",
    "rrf_fusion": P.with_(
        lexical("source", P.SESSION_QUERIES) + P.dense_ctes() + P.fused_ctes(P.BOTH),
        "SELECT scope, query_id, chunk_id, round(score, 6) AS score, rank FROM fu"),
    "coverage_rerank": P.with_(
        lexical("source", P.SESSION_QUERIES)
        + P.fused_ctes("SELECT scope, query_id, 'bm25' AS ranking, chunk_id, score, rank FROM bm") + P.rerank_ctes(),
        "SELECT scope, query_id, chunk_id, round(score, 6) AS score, rank FROM rr"),
    "ranked_children": P.with_(RANKED, "SELECT scope, query_id, chunk_id, round(score, 6) AS score, rank FROM rr"),
    "small_to_big": P.with_(
        RANKED + P.passage_ctes(),
        "SELECT scope, query_id, rank, chunk_id, parent_id, section, page::INT AS page, round(score, 6) AS score, md5(text) AS text_md5 FROM ps"),
    "parent_lookup": P.with_(
        lexical("source", P.SESSION_QUERIES),
        "SELECT DISTINCT b.scope, b.chunk_id, c.parent_id, md5(p.text) AS text_md5 FROM bm b JOIN chunks c USING (scope, chunk_id) "
        "JOIN parents p ON p.parent_id = c.parent_id WHERE b.rank = 1"),
    "passage_digest": P.with_(
        RANKED + P.passage_ctes(),
        f"SELECT scope, query_id, rank, section, page::INT AS page, {P.squeeze('text')}[1:280] AS digest FROM ps WHERE rank <= 3"),
    "first_relevant_ranks": P.with_(RANKED_ALL + metrics("rr"), "SELECT query_id, first_rank, retrieved FROM firsts"),
    "retrieval_metrics": P.with_(RANKED_ALL + metrics("rr"), f"SELECT {SUMMARY}"),
    "retrieval_ablation": " UNION ALL ".join(
        f"SELECT {P.q(n)} AS config, * FROM ({ablation(*c)})" for n, c in CONFIGS.items()),
}
