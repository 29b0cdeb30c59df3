"""DuckDB statements for gapmatch.plans.document_queries."""

from __future__ import annotations

from gapmatch.functions import fixed as K

from . import parts as P

_clean = "fixed"
TURN_PAGES = [
    ("raw_turns", f"SELECT 'jd' || conv_id AS doc_key, conv_id, turn + 1 AS page, {P.strip('text')} AS text FROM conversations"),
    ("unsp", f"SELECT doc_key, conv_id, page, regexp_extract_all(text, {P.q(K.LETTER_SPACED)}) AS runs, string_split_regex(text, {P.q(K.LETTER_SPACED)}) AS gaps FROM raw_turns"),
    ("turns", "SELECT doc_key, conv_id, page::INT AS page, list_reduce(list_prepend('', list_transform(range(1, len(gaps) + 1), "
              "lambda t1_: gaps[t1_] || coalesce(replace(runs[t1_], ' ', ''), ''))), lambda t2_, t3_: t2_ || t3_) AS text FROM unsp"),
    ("guard", "SELECT doc_key, conv_id, count(*) AS page_count, sum(length(text))::BIGINT AS char_count FROM turns GROUP BY ALL"),
    ("judged", f"SELECT *, CASE WHEN page_count > {K.MAX_PAGES} THEN 'too_many_pages' WHEN char_count / page_count < "
               f"{K.PAGE_MIN_CHARS} THEN 'looks_scanned' ELSE '' END AS ingest_error FROM guard"),
    ("pg", "SELECT doc_key, page, text FROM turns SEMI JOIN (SELECT * FROM judged WHERE ingest_error = '') j USING (doc_key)"),
]

ORACLES = {
    "ingest_status": P.with_(
        [("tx", f"SELECT 'cv' || doc_id AS doc_key, {P.strip('text')} AS text FROM documents"),
         ("jd", f"SELECT *, CASE WHEN strlen(text) > {K.MAX_BYTES} THEN 'too_large' WHEN length(text) < {K.TEXT_MIN_CHARS} "
                "THEN 'too_short' ELSE '' END AS e FROM tx"),
         ("pg", "SELECT doc_key, 1 AS page, text FROM jd WHERE e = ''")]
        + P.parent_ctes() + P.window_ctes("parents", "parent_id")
        + [("cc", "SELECT doc_key, count(*) AS n FROM wn JOIN parents USING (parent_id) GROUP BY doc_key")],
        "SELECT doc_key, sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes, 1::BIGINT AS page_count, "
        "length(text)::BIGINT AS char_count, coalesce(n, 0) AS chunk_count, CASE WHEN e = '' THEN 'ready' ELSE 'failed' END "
        "AS ingest_status, e AS ingest_error FROM jd LEFT JOIN cc USING (doc_key)",
    ),
    "paged_guard": P.with_(TURN_PAGES[:5], "SELECT conv_id, page_count, char_count, ingest_error FROM judged"),
    "paged_sections": P.with_(
        TURN_PAGES + P.section_ctes(),
        "SELECT doc_key, s_idx::INT AS s_idx, section, page::INT AS page, md5(body) AS body_md5 FROM sx",
    ),
    "paged_fixed_chunks": P.with_(
        TURN_PAGES
        + [("full_text", "SELECT doc_key, string_agg(text, chr(10) ORDER BY page) AS text FROM pg GROUP BY doc_key"),
           ("offs", "SELECT doc_key, page, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_key ORDER BY page ROWS BETWEEN "
                    "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM pg")]
        + P.window_ctes("full_text", "doc_key")
        + [("vis", f"SELECT w.doc_key, c_idx, w.text, start + length(substring(f.text, start + 1, {K.CHILD_CHARS})) - length(regexp_replace("
                   f"substring(f.text, start + 1, {K.CHILD_CHARS}), {P.q(f'^[{P.WS}]+')}, '')) AS first FROM wn w JOIN full_text f USING (doc_key)")],
        "SELECT v.doc_key, v.doc_key || '-f' || c_idx || '-c0' AS chunk_id, max(page)::INT AS page, md5(any_value(v.text)) AS text_md5 "
        "FROM vis v JOIN offs o ON o.doc_key = v.doc_key AND o.at <= v.first GROUP BY v.doc_key, c_idx",
    ),
    "section_headings": P.with_(
        [P.DOC_PAGES] + P.section_ctes()[:2],
        f"SELECT doc_key, (ln - 1)::INT AS line_no, page::INT AS page, {P.strip('line')} AS heading FROM ph WHERE h",
    ),
    "sections": P.with_(
        [P.DOC_PAGES] + P.section_ctes(),
        "SELECT doc_key, s_idx::INT AS s_idx, section, page::INT AS page, length(body)::INT AS n_chars, md5(body) AS body_md5 FROM sx",
    ),
    "parent_child_chunks": P.with_(
        P.child_ctes(),
        "SELECT scope, doc_key, parent_id, chunk_id, section, page::INT AS page, md5(text) AS text_md5 FROM chunks0",
    ),
    "fixed_chunks": P.with_(
        P.fixed_child_ctes("source"),
        "SELECT scope, doc_key, chunk_id, page::INT AS page, md5(text) AS text_md5 FROM chunks0",
    ),
    "hash_vectors": P.with_(
        P.child_ctes() + [("es", "SELECT chunk_id, '[CV › ' || section || ']' || chr(10) || text AS et FROM chunks0")]
        + P.vector_ctes("es", "chunk_id", "cv", "et")
        + [("u", "SELECT chunk_id, unnest(range(384)) AS dim, unnest(vec) AS w FROM cv")],
        "SELECT chunk_id, count(*) AS n_dims, sum(dim)::BIGINT AS sum_dim, round(sum(w::DOUBLE * (dim + 1)), 4) AS \"check\" "
        "FROM u WHERE abs(w) > 1e-6 GROUP BY chunk_id",
    ),
    "documents_ready": f"""
        WITH d AS (SELECT source, CASE WHEN doc_id // 20 % 4 = 3 THEN 'jd' ELSE 'cv' END AS kind,
                   length({P.strip('text')}) >= {K.TEXT_MIN_CHARS} AS ok FROM documents),
             r AS (SELECT source, bool_or(ok AND kind = 'cv') AND bool_or(ok AND kind = 'jd') AS ready FROM d GROUP BY source)
        SELECT source AS session_id, ready, CASE WHEN ready THEN 'ready' ELSE 'created' END AS status FROM r""",
}
