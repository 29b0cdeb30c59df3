"""DuckDB statements for gapmatch.plans.index_queries."""

from __future__ import annotations

from gapmatch.functions import fixed as K

from . import parts as P
from .retrieval import ORACLES as RANKINGS

DIGEST = f"""
    SELECT $KIND AS doc_kind, s.scope, s.n, s.length, s.floor, t.n_terms, t.sum_df, t.term_check, c.n_chunks, c.chunk_check, c.n_parents
    FROM (SELECT bs.scope, n, sum_len AS length, round(avg(raw) * {K.BM25_EPSILON}, 6) AS floor FROM br JOIN bs USING (scope)
          JOIN (SELECT scope, sum(len(toks))::BIGINT AS sum_len FROM bt GROUP BY scope) USING (scope) GROUP BY ALL) s
    JOIN (SELECT scope, count(*) AS n_terms, sum(df)::BIGINT AS sum_df,
              sum(('0x' || md5(term)[1:8])::BIGINT % 1000003 * df)::BIGINT AS term_check FROM bd_ GROUP BY scope) t USING (scope)
    JOIN (SELECT scope, count(*) AS n_chunks, sum(('0x' || md5(chunk_id || '|' || text)[1:8])::BIGINT)::BIGINT AS chunk_check,
              count(DISTINCT parent_id) AS n_parents FROM chunks GROUP BY scope) c USING (scope)"""
LEFT = "doc_id % 7 <> 3 AND source NOT IN ('src3', 'src11')"


def digest(kind: str, where: str = "true") -> str:
    ctes = P.child_ctes("source", kind, where) + [P.SESSION_QUERIES] + P.bm25_ctes()
    return P.with_(ctes, DIGEST.replace("$KIND", P.q(kind)))


POSTINGS = (
    P.child_ctes("source", "jd", P.POSTED) + [P.SESSION_QUERIES] + P.bm25_ctes() + P.dense_ctes(label="Job description")
    + P.fused_ctes(P.BOTH) + P.rerank_ctes() + P.passage_ctes())

ORACLES = {
    "posting_search": P.with_(
        POSTINGS, f"SELECT scope, query_id, rank, parent_id, section, {P.squeeze('text')}[1:280] AS digest FROM ps WHERE rank <= 3"),
    "index_upsert": f"SELECT * FROM ({digest('cv')}) UNION ALL SELECT * FROM ({digest('jd', P.POSTED)})",
    "index_purge": digest("cv", LEFT),
    "purged_rankings": P.with_(
        P.child_ctes("source", "cv", LEFT) + [P.SESSION_QUERIES] + P.bm25_ctes(),
        "SELECT scope, query_id, rank, chunk_id, round(score, 6) AS score FROM bm"),
    "bm25_postings": RANKINGS["bm25_topk"],
    "dense_cells": RANKINGS["dense_topk"],
}
