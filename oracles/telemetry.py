"""DuckDB statements for telemetry, contract, keyed-table and agreement queries."""

from __future__ import annotations

from gapmatch.functions import fixed as K

from . import parts as P
from .documents import ORACLES as DOCUMENTS
from .retrieval import ALL, SUMMARY, lexical, metrics
from .sessions import ITEMS, OKEY, SESSIONS

MODELS = [*K.USD_PER_MILLION, "unlisted-model"]
RATE = {n: "CASE model " + " ".join(f"WHEN {P.q(m)} THEN {r[n]}" for m, r in K.USD_PER_MILLION.items()) + " ELSE 0 END" for n in (0, 1)}
CALLS = ("cl", f"SELECT event_id AS call_id, user_id AS session_id, event_type AS stage, {MODELS}[event_id % 5 + 1] AS model, 'v' || k % 3 AS prompt_version, "
               "k * 10 AS prompt_tokens, floor(value)::INT AS completion_tokens, value AS latency_ms, k % 4 = 0 AS cache_hit, CASE WHEN event_type = 'error' "
               "THEN 'error' ELSE 'ok' END AS status FROM (SELECT *, (props::JSON ->> 'k')::INT AS k FROM events)")
CALLS_AT = ("cl", CALLS[1].replace("'ok' END AS status", "'ok' END AS status, ts AS created_at"))
PRICED = [CALLS, ("pc", f"SELECT *, ((prompt_tokens * ({RATE[0]})::DECIMAL(9, 2) + completion_tokens * ({RATE[1]})::DECIMAL(9, 2)) * 0.000001::DECIMAL(9, 6))::DECIMAL(18, 9) "
                        "AS cost FROM cl")]
LINES = ("ln", f"SELECT l_suppkey AS suite, l_orderkey || '/' || {OKEY} AS answer_id, (1 + floor(l_extendedprice / 25000))::DOUBLE AS expected, "
               "(2 + floor(l_quantity / 7))::DOUBLE AS predicted FROM lineitem")
AGREE = (
    "count(*) AS answers, round(avg(abs(predicted - expected)), 6) AS score_mae, round(avg(predicted - expected), 6) AS score_bias, "
    "round(avg((abs(predicted - expected) <= 1)::INT), 6) AS within_one"
)
METRIC_NAMES = ["probes", "found", "hit_rate_1", "hit_rate_3", "hit_rate_5", "mrr", "mean_first_rank"]


def long(suite, names, frm):
    return " UNION ALL ".join(f"SELECT '{suite}' AS suite, '{n}' AS metric, {n}::DOUBLE AS value FROM {frm}" for n in names)


def violations(rules):
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN NULL ELSE '{n}' END" for n, cond in rules.items()) + "], lambda q1_: q1_ IS NOT NULL)"


VERSIONS = ("vs", "SELECT source AS session_id, CASE WHEN doc_id // 20 % 4 = 3 THEN 'jd' ELSE 'cv' END AS kind, doc_id % 97 AS created_at, 'cv' || doc_id AS doc_key, "
                  "length(text)::INT AS n_chars FROM documents")
KEPT = "o_orderstatus <> 'P'"
TOPUP = {
    "sessions": "SELECT count(*) AS n, count(*) AS w FROM orders WHERE " + KEPT,
    "match_report": "SELECT count(*), count(*) FROM orders WHERE " + KEPT,
}
for _t in ("match_item", "cv_suggestion", "question", "answer", "evaluation"):
    TOPUP[_t] = f"SELECT count(*), count(*) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE {KEPT}"
TOPUP["llm_call"] = (
    "SELECT count(*), count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = user_id AND o_orderstatus = 'P')) FROM events"
)

RATES_SQL = "SELECT user_id AS caller, date_trunc('hour', ts) AS window_start, count(*) AS requests, count(*) > 1 AS over FROM events GROUP BY ALL"

ORACLES = {
    "stream_rate_windows": RATES_SQL,
    "stream_rate_tiers": """
        WITH asked AS (SELECT CASE WHEN user_id % 5 = 0 THEN user_id::VARCHAR ELSE event_type END AS caller,
                              ['auth', 'register', 'generate', 'upload', 'other'][event_id % 5 + 1] AS tier, ts FROM events),
             w AS (SELECT caller, tier, date_trunc(CASE tier WHEN 'auth' THEN 'minute' ELSE 'hour' END, ts) AS window_start, count(*) AS requests
                   FROM asked GROUP BY ALL)
        SELECT *, requests > CASE tier WHEN 'auth' THEN 5 WHEN 'register' THEN 10 WHEN 'generate' THEN 30 WHEN 'upload' THEN 40 ELSE 1000000000 END AS over FROM w""",
    "stream_chunks": P.with_(
        P.child_ctes() + [("es", "SELECT chunk_id, '[CV › ' || section || ']' || chr(10) || text AS et FROM chunks0")]
        + P.vector_ctes("es", "chunk_id", "cv", "et"),
        "SELECT doc_key, parent_id, chunk_id, section, md5(text) AS text_md5, len(list_filter(vec, lambda s1_: abs(s1_) > 1e-6))::INT AS n_dims "
        "FROM chunks0 LEFT JOIN cv USING (chunk_id)"),
    "spend_breach": P.with_(
        [CALLS_AT] + PRICED[1:] + [("rt", "SELECT model AS installation, call_id, created_at, sum(cost) OVER (PARTITION BY model ORDER BY created_at, call_id) AS spent FROM pc")],
        "SELECT installation, call_id, created_at, spent::DOUBLE AS spent_usd FROM rt WHERE spent >= 0.05 "
        "QUALIFY row_number() OVER (PARTITION BY installation ORDER BY created_at, call_id) = 1"),
    "stream_ingest": DOCUMENTS["ingest_status"],
    "status_stream": DOCUMENTS["documents_ready"],
    "cost_by_rate": P.with_(PRICED, "SELECT call_id, model, prompt_tokens, completion_tokens, cost::DOUBLE AS cost_usd FROM pc"),
    "spend_by_session": P.with_(PRICED, "SELECT session_id, count(*) AS calls, sum(cost)::DOUBLE AS cost_usd FROM pc GROUP BY session_id"),
    "spend_gate": P.with_(PRICED, "SELECT coalesce(sum(cost), 0)::DOUBLE AS spent_usd, coalesce(sum(cost), 0) >= 1.0 AS refused FROM pc"),
    "latency_p95": P.with_([CALLS], "SELECT stage, count(*) AS calls, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM cl GROUP BY stage"),
    "stage_rollup": P.with_(PRICED, "SELECT session_id, stage, count(*) AS calls, sum(cost)::DOUBLE AS cost_usd, round(avg(cache_hit::INT), 6) AS cache_rate, "
                                    "grouping(session_id, stage)::INT AS level FROM pc GROUP BY ROLLUP (session_id, stage)"),
    "errors_by_model": P.with_([CALLS], "SELECT model, prompt_version, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, round(avg((status = 'error')::INT), 6) "
                                        "AS error_rate, round(avg(cache_hit::INT), 6) AS cache_rate FROM cl GROUP BY ALL"),
    "unpriced": P.with_([CALLS], f"SELECT model, count(*) AS calls FROM cl WHERE model NOT IN {P.strings(K.USD_PER_MILLION)} GROUP BY model"),
    "call_log": """
        WITH t AS (SELECT conv_id || '-' || turn AS call_id, conv_id AS session_id, greatest(1, length(text) // 4)::INT AS pt, length(text) < 40 AS bad,
                   greatest(1, length(lower(text)) // 4)::INT AS ct FROM conversations)
        SELECT call_id, session_id, 'gpt-4o-mini' AS model, pt AS prompt_tokens, CASE WHEN bad THEN 0 ELSE ct END AS completion_tokens,
               CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, ((pt * 0.15 + CASE WHEN bad THEN 0 ELSE ct END * 0.60) * 0.000001)::DOUBLE AS cost_usd FROM t""",
    "rate_windows": RATES_SQL,
    "contract_quarantine": P.with_(
        [("cq", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_linestatus = 'O' THEN 'star' WHEN l_returnflag = 'R' THEN 'essay' ELSE "
                "'technical' END AS rubric, l_suppkey % 5 + 1 AS n, l_linenumber - 1 AS score, l_quantity / 8 AS overall FROM lineitem"),
         ("cv_", "SELECT *, CASE WHEN l_partkey % 50 = 0 THEN ['malformed'] ELSE "
          + violations({"rubric": "rubric IN ('star', 'technical')", "criteria_size": "n >= 3", "criterion_range": "score BETWEEN 1 AND 5",
                        "overall_score": "overall BETWEEN 1 AND 5"}) + " END AS v FROM cq")],
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, array_to_string(v, ',') AS violations FROM cv_ WHERE len(v) > 0"),
    "request_constraints": "SELECT conv_id, turn, array_to_string("
        + violations({"text_length": "length(text) BETWEEN 10 AND 8000", "duration": "length(text) * 9 BETWEEN 0 AND 7200"}) + ", ',') AS violations FROM conversations",
    "profile_whitelist": """
        SELECT c_custkey AS user_id, array_to_string(list_filter(['Current title: ' || c_name, CASE WHEN c_custkey % 3 = 0 THEN 'Seniority: senior' END,
               'Years of experience: ' || c_custkey % 41, 'Targeting: ' || c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'Languages: English' END],
               lambda c1_: c1_ IS NOT NULL), chr(10)) AS context FROM customer""",
    "current_documents": P.with_([VERSIONS], "SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY session_id, kind ORDER BY created_at DESC, doc_key DESC) = 1"),
    "upsert_latest": "SELECT doc_id, md5(CASE WHEN l.doc_id IS NOT NULL THEN lower(text) ELSE text END) AS text_md5 FROM documents d LEFT JOIN labels l USING (doc_id)",
    "erase_document": P.with_(
        P.child_ctes(), "SELECT scope, count(*) AS chunks, count(DISTINCT doc_key) AS documents FROM chunks0 ANTI JOIN (SELECT 'cv' || doc_id AS doc_key FROM labels "
                        "WHERE toxic = 1) t USING (doc_key) GROUP BY scope"),
    "erase_cascade": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", n AS n_rows, w AS with_session FROM ({s}) AS x(n, w)" for t, s in TOPUP.items()),
    "memo_misses": """
        WITH k AS (SELECT doc_id, sha256(concat('hashing', chr(0), '384', chr(0), text, chr(0))) AS memo_key FROM documents)
        SELECT doc_id, memo_key FROM k ANTI JOIN (SELECT memo_key FROM k SEMI JOIN labels USING (doc_id)) s USING (memo_key)""",
    "score_agreement": P.with_([LINES], f"SELECT suite, {AGREE} FROM ln GROUP BY suite"),
    "spearman": P.with_(
        [LINES, ("rk", "SELECT suite, rank() OVER (PARTITION BY suite ORDER BY expected) + (count(*) OVER (PARTITION BY suite, expected) - 1) / 2 AS ra, "
                       "rank() OVER (PARTITION BY suite ORDER BY predicted) + (count(*) OVER (PARTITION BY suite, predicted) - 1) / 2 AS rb FROM ln")],
        "SELECT suite, count(*) AS answers, CASE WHEN count(*) >= 3 THEN round(corr(ra, rb), 6) END AS spearman FROM rk GROUP BY suite"),
    "pairwise": """
        WITH b AS (SELECT l_orderkey AS o, l_linenumber AS n, max(l_quantity) AS p FROM lineitem GROUP BY ALL)
        SELECT x.o % 10 AS suite, count(*) AS checked, count(*) FILTER (NOT x.p > y.p) AS violations, round(avg((x.p > y.p)::INT), 6) AS pairwise_accuracy
        FROM b x JOIN b y ON y.o = x.o AND y.n = x.n + 1 GROUP BY 1""",
    "self_consistency": """
        WITH a AS (SELECT l_linenumber AS suite, l_orderkey, (10 + (40 * (l_quantity::INT - 1)) // 49) / 10.0::DOUBLE AS s FROM lineitem),
             d AS (SELECT suite, l_orderkey, stddev_pop(s) AS dev FROM a GROUP BY ALL HAVING count(*) > 1)
        SELECT suite, count(*) AS repeated, round(avg(dev), 6) AS self_consistency FROM d GROUP BY suite""",
    "metrics_sink": P.with_(
        lexical(ALL, P.ALL_QUERIES) + metrics("bm") + [LINES, ("m1", f"SELECT {SUMMARY}"), ("m2", f"SELECT {AGREE} FROM ln")],
        long("retrieval", METRIC_NAMES, "m1") + " UNION ALL " + long("scoring", ["answers", "score_mae", "score_bias", "within_one"], "m2")),
    "label_read": """
        SELECT source, count(*) AS documents, count(quality) AS labelled, count(*) FILTER (quality = 1 AND toxic = 0) AS n_strong,
               count(*) FILTER (quality = 0 AND toxic = 0) AS n_partial, count(*) FILTER (toxic = 1) AS n_missing
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
}
ORACLES["spend_breach_keyed"] = ORACLES["spend_breach"]
ORACLES["ingest_transitions"] = (
    "SELECT doc_key, CASE WHEN ingest_status = 'ready' THEN 'pending>processing>ready' ELSE 'pending>failed' END AS states, "
    f"ingest_status AS state FROM ({DOCUMENTS['ingest_status']})")


# --- payloads of every kind: (contract, table, key, {rule: condition}) -----------------------
PAYLOADS = [
    ("requirement", "benchmark", "item_id", {"text_length": "length(text) BETWEEN 3 AND 300", "category": "item_id % 4 <> 1"}),
    ("requirements", "customer", "c_custkey", {
        "list_size": "c_custkey % 25 <= 20", "text_length": "c_custkey % 25 = 0 OR length(c_name) BETWEEN 3 AND 300",
        "kind": "c_custkey % 25 = 0 OR c_custkey % 7 <> 0"}),
    ("match_item", "part", "p_partkey", {"requirement": "p_partkey % 9 > 0", "status": "p_partkey % 4 <> 0", "confidence": "p_size / 40 BETWEEN 0 AND 1"}),
    ("match_report", "orders", "o_orderkey", {"overall_score": "floor(o_totalprice / 4000) BETWEEN 0 AND 100", "summary": "o_orderkey % 6 > 0"}),
    ("question", "part", "p_partkey", {
        "category": "p_partkey % 5 <> 0", "text_length": "length(p_name || ' ' || p_type) >= 10", "difficulty": "p_partkey % 2 = 1 OR p_partkey % 8 BETWEEN 1 AND 5"}),
    ("questions", "supplier", "s_suppkey", {"list_size": "s_suppkey % 23 BETWEEN 1 AND 20"}),
    ("evaluation", "part", "p_partkey", {
        "rubric": "p_partkey % 3 <> 0", "criteria_size": "p_partkey % 5 + 1 >= 3", "criterion_range": "p_partkey % 7 BETWEEN 1 AND 5",
        "overall_score": "p_size / 8 BETWEEN 1 AND 5"}),
    ("scorecard", "orders", "o_orderkey", {
        "readiness_score": "floor(o_totalprice / 4500) BETWEEN 0 AND 100", "priority": "o_orderkey % 2 = 1 OR (o_orderkey % 4 <> 0 AND o_orderkey % 5 > 0)"}),
    ("rewrite", "customer", "c_custkey", {"bullet_length": "length(c_mktsegment) * (c_custkey % 60) BETWEEN 10 AND 400"}),
    ("letter", "documents", "doc_id", {"body_length": "length(text) >= 80"}),
    ("request:answer", "conversations", "conv_id", {"text_length": "length(text) BETWEEN 10 AND 8000", "duration": "length(text) * 9 BETWEEN 0 AND 7200"}),
    ("request:session", "customer", "c_custkey", {"title_length": "length(c_name) * (c_custkey % 12) BETWEEN 2 AND 160"}),
    ("request:document", "documents", "doc_id", {"text_length": "length(text) * CASE WHEN doc_id % 50 = 0 THEN 30 ELSE 1 END <= 200000"}),
]


def _payload_rows():
    for kind, name, key, rules in PAYLOADS:
        listed = f"CASE WHEN {key} % 41 = 0 THEN ['malformed'] ELSE {violations(rules)} END"
        yield f"SELECT {P.q(kind)} AS contract, {key} AS key, {listed} AS v FROM {name}"
    yield "SELECT 'diary', s_suppkey, ['unknown_contract'] FROM supplier"


ORACLES["contract_dispatch"] = (
    "SELECT contract, array_to_string(v, ',') AS violations, count(*) AS rows, sum(key)::BIGINT AS key_sum FROM ("
    + " UNION ALL ".join(_payload_rows()) + ") x WHERE len(v) > 0 GROUP BY ALL")
