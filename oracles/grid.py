"""DuckDB statements for gapmatch.plans.grid_queries."""

from __future__ import annotations

from . import matching as M
from . import parts as P
from .matching import ITEMS
from .retrieval import CONFIGS, SUMMARY, metrics
from .sessions import SCORED
from .telemetry import AGREE


def measured(cfg: dict, strategy: str) -> str:
    """Retrieval and grounding of one configuration, each session asked for its own requirements."""
    chunks = P.child_ctes("source") if strategy == "parent_child" else P.fixed_child_ctes("source")
    ctes = chunks + [P.SESSION_QUERIES] + P.bm25_ctes() + P.dense_ctes(multi=cfg.get("multi", True))
    ctes += P.fused_ctes(P.BOTH if cfg.get("bm25", True) else P.BOTH.split(" UNION ALL ")[0])
    if cfg.get("rerank", True):
        ctes += P.rerank_ctes()
    else:
        ctes.append(("rr", f"SELECT * FROM fu WHERE rank <= {P.K.CANDIDATE_K}"))
    ctes += metrics("rr") + P.passage_ctes() + [ITEMS] + M.idf_ctes() + M.armed_ctes() + M.VERDICT + M.OUTCOMES
    return P.with_(ctes, f"SELECT * FROM (SELECT {SUMMARY}) a, (SELECT {M.GROUNDING}) b")


ORACLES = {
    "evaluation_grid": " UNION ALL ".join(f"SELECT {P.q(name)} AS config, * FROM ({measured(*c)})" for name, c in CONFIGS.items()),
    "scoring_repeats": P.with_(
        SCORED + [
            ("sa", "SELECT session_id, answer_id, any_value(rubric) AS rubric, sum(score)::BIGINT / 5.0::DOUBLE AS predicted FROM s4 GROUP BY session_id, question_id, answer_id"),
            ("ln", "SELECT rubric, predicted, (1 + length(c.text) % 5)::DOUBLE AS expected FROM sa JOIN conversations c ON c.conv_id = session_id AND c.turn = answer_id"),
        ],
        f"SELECT rubric, {AGREE}, count(*) AS repeated, 0.0::DOUBLE AS self_consistency FROM ln GROUP BY rubric"),
    "memo_fill": """
        WITH t AS (SELECT doc_id, text, doc_id IN (SELECT doc_id FROM labels) AS early FROM documents),
             d AS (SELECT text, bool_or(early) AS early FROM t GROUP BY text)
        SELECT run, CASE run WHEN 0 THEN count(*) FILTER (early) WHEN 1 THEN count(*) FILTER (NOT early) ELSE 0 END AS embedded,
               (SELECT count(*) FROM t) AS documents, (SELECT count(*) FROM t) AS with_vector
        FROM d, (VALUES (0), (1), (2)) r(run) GROUP BY run""",
}
