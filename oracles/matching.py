"""DuckDB statements for gapmatch.plans.matching_queries."""

from __future__ import annotations

from gapmatch.functions import fixed as K

from gapmatch.plans.text_queries import LATIN

from . import parts as P

KIND = (
    f"CASE WHEN len({P.salient('text')}) > 0 THEN 'evidenceable' WHEN {P.match('text', K.TRAIT)} THEN 'behavioural' "
    "ELSE 'evidenceable' END"
)
ITEMS = ("posting", "SELECT scope, query_id, text, CASE WHEN query_id::INT % 3 = 2 THEN 'nice_to_have' ELSE 'must_have' END AS category, "
                    f"{KIND} AS kind FROM queries")
PASSAGES = P.ranked_ctes("source", P.SESSION_QUERIES) + P.passage_ctes() + [ITEMS]


def idf_ctes(source="ps", scope="scope", n="id"):
    return [
        (f"{n}_n", f"SELECT {scope} AS scope, count(*) AS n FROM {source} GROUP BY ALL"),
        (f"{n}_t", f"SELECT {scope} AS scope, unnest(list_distinct({P.tokens('text')})) AS term FROM {source}"),
        (n, f"SELECT scope, term, count(*) AS df, n, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM {n}_t JOIN {n}_n USING (scope) "
            "GROUP BY scope, term, n"),
        (f"{n}_m", f"SELECT scope, max(idf) AS top FROM {n} GROUP BY scope"),
    ]


def armed_ctes(source="posting", n="ar", i="id"):
    """``ar(scope, query_id, nd [struct(k, w)], pv [struct(t, k)])`` for source(scope, query_id, text)."""
    weight = f"coalesce(d.idf, m.top, {K.UNSEEN_IDF})"
    look = f"LEFT JOIN {i} d ON d.scope = x.scope AND d.term = x.term LEFT JOIN {i}_m m ON m.scope = x.scope"
    return [
        (f"{n}_k", f"SELECT scope, query_id, unnest(k) AS term, generate_subscripts(k, 1) AS pos FROM "
                   f"(SELECT scope, query_id, {P.keywords('text')} AS k FROM {source})"),
        (f"{n}_nd", f"SELECT x.scope, x.query_id, list(struct_pack(k := {P.keyword_keys('x.term')}, w := {weight}) ORDER BY pos) AS nd "
                    f"FROM {n}_k x {look} GROUP BY ALL"),
        (f"{n}_g", f"SELECT scope, query_id, unnest(g) AS part, generate_subscripts(g, 1) AS gno FROM (SELECT scope, query_id, "
                   f"CASE WHEN len({P.groups('text')}) > 0 THEN {P.groups('text')} ELSE [text] END AS g FROM {source})"),
        (f"{n}_s", f"SELECT scope, query_id, gno, unnest(s) AS term, generate_subscripts(s, 1) AS pos FROM "
                   f"(SELECT scope, query_id, gno, {P.salient('part')} AS s FROM {n}_g)"),
        (f"{n}_w", f"SELECT x.scope, x.query_id, gno, pos, x.term, {weight} AS w FROM {n}_s x {look}"),
        (f"{n}_d", f"SELECT scope, query_id, gno, term FROM {n}_w QUALIFY row_number() OVER (PARTITION BY scope, query_id, gno "
                   "ORDER BY w DESC, pos) = 1"),
        (f"{n}_pv", f"SELECT scope, query_id, list(struct_pack(t := term, k := {P.keyword_keys('term')}) ORDER BY gno) AS pv FROM {n}_d GROUP BY ALL"),
        (n, f"SELECT s.scope, s.query_id, coalesce(nd, []) AS nd, coalesce(pv, []) AS pv FROM {source} s LEFT JOIN {n}_nd USING (scope, query_id) "
            f"LEFT JOIN {n}_pv USING (scope, query_id)"),
    ]


MET = "list_filter({0}, lambda e_: list_has_any(e_.k, {1}))"
PLAIN = f"CASE WHEN len(nd) = 0 THEN 0.0::DOUBLE ELSE len({MET.format('nd', 'keys')})::DOUBLE / len(nd) END"
WEIGHTED = (
    "CASE WHEN len(nd) = 0 THEN 0.0::DOUBLE ELSE coalesce(list_sum(list_transform("
    + MET.format("nd", "keys") + ", lambda f_: f_.w)), 0) / list_sum(list_transform(nd, lambda h_: h_.w)) END"
)
DECISIVE = f"len({MET.format('pv', 'keys')}) > 0"
GATE = f"(len(pv) = 0 OR {DECISIVE})"

ARMED = PASSAGES + idf_ctes() + armed_ctes()
WHOLE = [("wk_", f"SELECT p.scope, p.query_id, p.rank, a.nd, a.pv, {P.text_keys(P.tokens('p.text'))} AS keys FROM ps p JOIN ar a USING (scope, query_id)")]
SENTENCES = (
    [("pt", "SELECT scope || '|' || query_id || '|' || rank AS pk, scope, query_id, rank, text FROM ps")]
    + P.sentence_ctes("pt", "pk")
    + [("cand", f"SELECT pk, pos, sentence FROM st UNION ALL SELECT pk, 0, {P.squeeze('text')} FROM pt ANTI JOIN st USING (pk)"),
       ("ck", f"SELECT pk, scope, query_id, rank, pos, sentence, {P.text_keys(P.tokens('sentence'))} AS keys FROM cand JOIN pt USING (pk)")]
)
BEST = SENTENCES + [
    ("rated", f"SELECT ck.*, {GATE} AS gate, {DECISIVE} AS decisive, round({WEIGHTED}, 9) AS cov FROM ck JOIN ar USING (scope, query_id)"),
    ("ev", "SELECT scope, query_id, rank, gate, decisive, cov, sentence[1:400] AS quote FROM rated QUALIFY row_number() OVER "
           "(PARTITION BY pk ORDER BY gate DESC, cov DESC, abs(length(sentence) - 140), pos) = 1"),
]
VERDICT = BEST + [
    ("win", "SELECT * FROM ev WHERE gate OR round(cov, 3) > 0 OR length(quote) >= 25 QUALIFY row_number() OVER (PARTITION BY scope, query_id "
            "ORDER BY gate DESC, round(cov, 3) DESC, length(quote) >= 25 DESC, rank) = 1"),
    ("vj", "SELECT p.scope, p.query_id, p.text, p.category, p.kind, w.rank, w.quote, coalesce(w.cov, 0) AS coverage, CASE WHEN gate AND cov >= 0.22 "
           "THEN 'strong' WHEN gate AND (cov >= 0.10 OR decisive) THEN 'partial' ELSE 'missing' END AS status FROM posting p "
           "LEFT JOIN win w USING (scope, query_id)"),
    ("items", "SELECT v.scope, v.query_id, v.text, category, kind, status, round_even((CASE status WHEN 'strong' THEN least(0.95, coverage + 0.45) "
              "WHEN 'partial' THEN coverage + 0.3 ELSE greatest(0.10, coverage / 2) END)::DECIMAL(18, 9), 2)::DOUBLE AS confidence, coverage, "
              "CASE WHEN status <> 'missing' THEN quote END AS evidence_quote, CASE WHEN status <> 'missing' THEN ps.page END AS evidence_page, "
              "CASE WHEN status <> 'missing' THEN ps.chunk_id END AS evidence_chunk_id, CASE WHEN status <> 'missing' THEN ps.section END "
              "AS evidence_section FROM vj v LEFT JOIN ps ON ps.scope = v.scope AND ps.query_id = v.query_id AND ps.rank = v.rank"),
]
ITEM_CTES = ARMED + VERDICT
REPORT = ITEM_CTES + [
    ("ri", "SELECT scope AS session_id, query_id::BIGINT AS order_key, text AS requirement, category, kind, status, confidence, evidence_quote FROM items"),
    ("rs", "SELECT session_id, sum(CASE WHEN kind <> 'evidenceable' THEN 0 WHEN category = 'must_have' THEN 2 ELSE 1 END * "
           "CASE status WHEN 'strong' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) AS earned, sum(CASE WHEN kind <> 'evidenceable' THEN 0 WHEN "
           "category = 'must_have' THEN 2 ELSE 1 END) AS total, count(*) FILTER (kind = 'evidenceable' AND status = 'strong') AS n_strong, "
           "count(*) FILTER (kind = 'evidenceable' AND status = 'partial') AS n_partial, count(*) FILTER (kind = 'evidenceable' AND status = 'missing') "
           "AS n_missing, count(*) FILTER (kind = 'evidenceable') AS n_scored, count(*) FILTER (kind <> 'evidenceable') AS n_behavioural "
           "FROM ri GROUP BY session_id"),
    ("sc", f"SELECT *, CASE WHEN total = 0 THEN 0 ELSE {P.half_even('50 * earned', 'total', 0)} END::BIGINT AS overall_score FROM rs"),
    ("rp", f"SELECT * EXCLUDE (earned, total), {P.band('overall_score', K.VERDICT_BANDS)} AS verdict, n_strong || ' of ' || n_scored || "
           "' requirements are backed by evidence; ' || n_missing || ' have none.' AS summary FROM sc"),
]


def listed(where: str, n: int) -> str:
    return (
        "(SELECT session_id, string_agg(requirement, ' | ' ORDER BY order_key) AS l FROM (SELECT * FROM ri WHERE " + where
        + f" QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY order_key) <= {n}) GROUP BY session_id)"
    )


EXPECTED = "CASE WHEN toxic = 1 THEN 'missing' WHEN quality = 0 THEN 'partial' ELSE 'strong' END"
MUST = "kind = 'evidenceable' AND status = 'missing' AND category = 'must_have'"
SQZ = P.squeeze("p.text")
NEEDLE = P.strip_chars(P.squeeze("evidence_quote"), K.QUOTE_EDGE)
CITED = ITEM_CTES + [
    ("typed", "SELECT * REPLACE (CASE WHEN status <> 'missing' THEN CASE WHEN query_id::INT % 5 = 0 THEN 'never written ' || evidence_quote "
              f"ELSE translate(evidence_quote, '{LATIN}', '{LATIN.upper()}') || '.' END END AS evidence_quote) FROM items"),
    ("tried", f"SELECT t.scope, t.query_id, p.rank, {SQZ} AS hay, {NEEDLE} AS needle FROM typed t JOIN ps p USING (scope, query_id) WHERE evidence_quote IS NOT NULL"),
    ("spans", "SELECT scope, query_id, substring(hay, instr(lower(hay), lower(needle)), length(needle)) AS span FROM tried WHERE needle <> '' AND "
              "contains(lower(hay), lower(needle)) QUALIFY row_number() OVER (PARTITION BY scope, query_id ORDER BY rank) = 1"),
]
LABELS = [
    ("lt", f"SELECT source AS scope, doc_id AS pos, unnest({P.salient('text')}) AS phrase, {EXPECTED} AS expected FROM documents JOIN labels USING (doc_id)"),
    ("lq", "SELECT q.scope, q.query_id, min_by(lt.expected, pos) AS expected FROM queries q LEFT JOIN lt ON lt.scope = q.scope AND contains(lower(q.text), phrase) GROUP BY ALL"),
]
OUTCOMES = LABELS + [
    ("cx", f"SELECT i.scope, i.query_id, bool_or(contains(lower({SQZ}), lower({P.squeeze('evidence_quote')}))) AS ctx FROM items i JOIN ps p USING (scope, query_id) GROUP BY ALL"),
    ("ob", f"SELECT i.scope, i.query_id, status AS predicted, expected, evidence_quote AS quote, contains(lower({P.squeeze('d.text')}), lower({P.squeeze('evidence_quote')})) "
           "AS src, ctx FROM items i JOIN lq USING (scope, query_id) LEFT JOIN cx USING (scope, query_id) "
           "LEFT JOIN documents d ON d.doc_id = try_cast(regexp_extract(evidence_chunk_id, '^cv(\\d+)-', 1) AS BIGINT)"),
]
GROUNDING = (
    "count(*) AS requirements, count(expected) AS labelled, round(avg(src::INT) FILTER (quote IS NOT NULL), 6) AS citation_validity, "
    "round(avg(ctx::INT) FILTER (quote IS NOT NULL), 6) AS citation_in_context, coalesce(round(avg((quote IS NULL)::INT) FILTER (predicted <> 'missing'), 6), 0) "
    "AS unsupported_verdict_rate, round(avg((predicted = expected)::INT), 6) AS status_accuracy, "
    "round(avg((abs({p} - {e}) <= 1)::INT) FILTER (expected IS NOT NULL), 6) AS status_within_one, "
    "round(avg((predicted <> 'missing')::INT) FILTER (expected = 'missing'), 6) AS false_evidence_rate, round(avg((predicted = 'missing')::INT) "
    "FILTER (expected = 'strong'), 6) AS missed_evidence_rate FROM ob"
)
GROUNDING_METRICS = ("requirements labelled citation_validity citation_in_context unsupported_verdict_rate status_accuracy status_within_one "
                     "false_evidence_rate missed_evidence_rate").split()
ORD = "(CASE {0} WHEN 'missing' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END)"
GROUNDING = GROUNDING.format(p=ORD.format("predicted"), e=ORD.format("expected"))

# --- requirement extraction ----------------------------------------------------------------
CAPS = P.only_capitals("t")
CLEAN = P.strip_chars(f"regexp_replace(line, {P.q(K.BULLET)}, '')", " .;")
EXTRACT = (
    [("dt", "SELECT 'cv' || doc_id AS doc_key, text FROM documents")] + P.reflow_ctes("dt", "doc_key") + [
        ("fl", f"SELECT doc_key, ln, line, {P.match('line', K.INCLUDE_HEADING)} AS op, {P.match('line', K.EXCLUDE_HEADING)} AS cl, "
               f"{P.match('line', K.SOFT_BUCKET)} AS soft, line LIKE '%:' AS lead FROM rl"),
        ("rg", "SELECT *, last_value(CASE WHEN op THEN 1 WHEN cl THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_key ORDER BY ln "
               "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reg FROM fl"),
        ("bk", "SELECT *, last_value(CASE WHEN op THEN CASE WHEN soft THEN 'nice_to_have' ELSE 'must_have' END WHEN NOT cl AND reg = 1 AND lead AND soft "
               "THEN 'nice_to_have' END IGNORE NULLS) OVER (PARTITION BY doc_key ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bucket FROM rg"),
        ("cln", f"SELECT *, {CLEAN} AS t FROM bk WHERE NOT op AND NOT cl"),
        ("p1", f"SELECT doc_key, ln, t, CASE WHEN {P.match('lower(t)', K.SOFT_BUCKET)} THEN 'nice_to_have' WHEN "
               + " OR ".join(f"contains(lower(t), '{w}')" for w in K.HARD_WORDS)
               + f" THEN 'must_have' ELSE coalesce(bucket, 'must_have') END AS category FROM cln WHERE reg = 1 AND NOT lead AND NOT {P.match('t', K.BENEFIT)} "
               f"AND length(t) BETWEEN 3 AND 260 AND NOT {CAPS} AND (length(t) >= 12 OR len({P.salient('t')}) > 0) AND len({P.keywords('t')}) >= 1"),
        ("p2", f"SELECT doc_key, ln, t, 'must_have' AS category FROM cln ANTI JOIN p1 USING (doc_key) WHERE coalesce(reg, 1) = 1 AND length(t) BETWEEN 20 AND 260 "
               f"AND regexp_matches(t, '\\p{{L}}') AND NOT {CAPS} AND (len({P.salient('t')}) > 0 OR {P.match('t', K.ASKING)}) AND len({P.keywords('t')}) >= 3"),
        ("pk_", f"SELECT *, array_to_string(list_sort({P.keywords('t')})[1:6], ' ') AS key FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2)"),
        ("du", "SELECT * FROM pk_ WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_key, key ORDER BY ln) = 1"),
        ("rx", f"SELECT doc_key, (row_number() OVER (PARTITION BY doc_key ORDER BY ln) - 1)::INT AS order_index, {P.clip('t', 220)} AS text, category FROM du "
               "QUALIFY order_index < 12"),
    ]
)

JUDGING = ITEM_CTES + [
    ("jp", "SELECT scope || '|' || query_id AS js, text FROM ps"),
    *idf_ctes("jp", "js", "ji"),
    ("jq", "SELECT scope || '|' || query_id AS scope, query_id, scope AS session, text, evidence_quote FROM items WHERE evidence_quote IS NOT NULL"),
    *armed_ctes("jq", "ja", "ji"),
    ("jk", f"SELECT q.session, q.query_id, nd, pv, {P.text_keys(P.tokens('evidence_quote'))} AS keys FROM jq q JOIN ja USING (scope, query_id)"),
    ("js_", f"SELECT session AS scope, query_id, round({WEIGHTED}, 9) AS s, {GATE} AS g FROM jk"),
]
ORACLES = {
    "idf": P.with_(PASSAGES + idf_ctes(), "SELECT scope, term, df, n, round(idf, 6) AS idf FROM id"),
    "weighted_coverage": P.with_(ARMED + WHOLE, f"SELECT scope, query_id, rank, round({PLAIN}, 6) AS coverage, round({WEIGHTED}, 6) AS weighted FROM wk_"),
    "pivot_gate": P.with_(ARMED + WHOLE, "SELECT scope, query_id, rank, array_to_string(list_transform(pv, lambda i_: i_.t), ' ') AS decisive_terms, "
                                         f"{GATE} AS gate, {DECISIVE} AS decisive FROM wk_"),
    "best_sentence": P.with_(
        ARMED + SENTENCES + [("bs_", f"SELECT ck.*, round({PLAIN}, 9) AS cov FROM ck JOIN ar USING (scope, query_id)")],
        "SELECT scope, query_id, rank, round(cov, 6) AS coverage, sentence[1:400] AS quote FROM bs_ QUALIFY row_number() OVER (PARTITION BY pk "
        "ORDER BY cov DESC, abs(length(sentence) - 140), sentence DESC) = 1"),
    "best_evidence": P.with_(ARMED + BEST, "SELECT scope, query_id, rank, gate, decisive, round(cov, 6) AS coverage, quote FROM ev"),
    "verdicts": P.with_(ITEM_CTES, "SELECT * EXCLUDE (text) REPLACE (round(coverage, 6) AS coverage, evidence_page::INT AS evidence_page) FROM items"),
    "match_report": P.with_(REPORT, f"SELECT rp.*, coalesce(l, '') AS must_missing FROM rp LEFT JOIN {listed(MUST, 3)} USING (session_id)"),
    "report_digest": P.with_(REPORT, "SELECT session_id, overall_score, verdict, coalesce(a.l, '') AS strong, coalesce(b.l, '') AS missing FROM rp LEFT JOIN "
                             + listed("status = 'strong'", 4) + " a USING (session_id) LEFT JOIN " + listed("status = 'missing'", 4) + " b USING (session_id)"),
    "citation_check": P.with_(
        CITED, "SELECT t.scope, t.query_id, CASE WHEN evidence_quote IS NOT NULL AND span IS NULL THEN 'missing' ELSE status END AS status, span AS evidence_quote, "
               "CASE WHEN span IS NOT NULL THEN evidence_page END::INT AS evidence_page, CASE WHEN span IS NOT NULL THEN evidence_chunk_id END AS evidence_chunk_id "
               "FROM typed t LEFT JOIN spans USING (scope, query_id)"),
    "kind_carry": P.with_([P.SESSION_QUERIES, ITEMS], "SELECT scope AS session_id, query_id::BIGINT AS order_key, CASE WHEN query_id::INT % 4 <> 0 THEN kind "
                                                      "ELSE 'behavioural' END AS kind FROM posting"),
    "requirement_extract": P.with_(EXTRACT, f"SELECT doc_key, order_index, text, category, {KIND} AS kind FROM rx"),
    "refused_postings": P.with_(EXTRACT, "SELECT doc_key, 'no_requirements' AS status FROM dt ANTI JOIN rx USING (doc_key)"),
    "label_match": P.with_([P.SESSION_QUERIES] + LABELS, "SELECT scope, query_id, expected FROM lq"),
    "grounding_metrics": P.with_(ITEM_CTES + OUTCOMES, f"SELECT scope, {GROUNDING} GROUP BY scope"),
    "grounding_disagreements": P.with_(
        ITEM_CTES + OUTCOMES, "SELECT scope, query_id, predicted, expected, quote FROM ob WHERE expected IS NOT NULL AND predicted <> expected"),
    "summary_consistency": P.with_(
        REPORT, "SELECT session_id, session_id[4:]::INT % 3 <> 0 AND n_scored = n_scored AS consistent FROM rp"),
    "judge_support": P.with_(
        JUDGING,
        f"SELECT scope, query_id, g AND s >= {K.JUDGE_COVERAGE} AS supported, round(s, 3) AS score FROM js_"),
    "letter_material": P.with_(
        REPORT + [
            ("lm", f"SELECT *, regexp_matches({P.strip('evidence_quote')}, {P.q(K.ACHIEVEMENT)}) AND NOT regexp_matches(evidence_quote, {P.q(K.DATE_RANGE)}) AND "
                   f"len({P.words('evidence_quote')}) >= 6 AS ach, len(list_distinct(list_filter({P.tokens('requirement')}, lambda z_: "
                   "z_ NOT IN ('that', 'the', 'of', 'and')))) <= 1 AND len(" + P.tokens("requirement") + ") > 0 AS rst FROM ri WHERE status = 'strong'"),
            ("lc", "SELECT * FROM lm WHERE NOT rst QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ach DESC, confidence DESC, order_key) <= 2"),
            ("la", "SELECT session_id, string_agg(printf('%s [%.2f] %s', requirement, confidence, evidence_quote), ' | ' ORDER BY ach DESC, confidence DESC, order_key) AS claims FROM lc GROUP BY 1"),
            ("lf", f"SELECT session_id, count(*) AS n, string_agg(requirement, ' | ' ORDER BY order_key) AS held FROM ri WHERE {MUST} GROUP BY 1"),
        ],
        "SELECT session_id, coalesce(claims, '') AS claims, coalesce(held, '') AS forbidden, coalesce(n, 0)::INT AS n_forbidden FROM rp LEFT JOIN la USING (session_id) LEFT JOIN lf USING (session_id)"),
    "bullet_gate": P.with_(
        REPORT + [
            ("bg", "SELECT *, regexp_replace(requirement, '\\b([A-Z]\\w+)', '[\\1]', 'g') AS bullet, list_transform(regexp_extract_all(requirement, '\\b[A-Z]\\w+')[1:3], "
                   "lambda u_: '[' || u_ || ']') AS ph FROM ri")],
        "SELECT session_id, order_key, len(ph)::INT AS n_placeholders, CASE WHEN status = 'strong' THEN 'already_evidenced' WHEN evidence_quote IS NULL AND "
        "len(list_filter(ph, lambda w_: contains(bullet, w_))) < 2 THEN 'finished_claim' ELSE '' END AS refusal FROM bg"),
}
SUPPORT = ORACLES["judge_support"]
ORACLES["grounding_rollup"] = P.with_(
    REPORT + OUTCOMES + [("gm", f"SELECT {GROUNDING}")],
    " UNION ALL ".join(f"SELECT 'grounding' AS suite, '{m}' AS metric, {m}::DOUBLE AS value FROM gm" for m in GROUNDING_METRICS)
    + " UNION ALL SELECT 'summary', 'summary_numeric_consistency', round(avg((session_id[4:]::INT % 3 <> 0)::INT), 6) FROM rp"
    + f" UNION ALL SELECT 'judge', 'judge_support_rate', (SELECT round(avg(supported::INT), 6) FROM ({SUPPORT}) x)",
)

OPINIONS = [
    ("vq", f"SELECT scope, query_id, {P.keywords('text')} AS asked, list_distinct({P.tokens('evidence_quote')}) AS have, evidence_quote FROM items WHERE evidence_quote IS NOT NULL"),
    ("vm", "SELECT *, len(list_filter(asked, lambda v1_: list_contains(have, v1_))) AS met FROM vq"),
    ("vh", f"SELECT q.scope, q.query_id, len(asked) AS n, met, coalesce(max(contains(lower({P.squeeze('p.text')}), lower({P.squeeze('evidence_quote')}))), false) AS held "
           "FROM vm q LEFT JOIN ps p USING (scope, query_id) GROUP BY ALL"),
    ("vo", "SELECT scope, query_id, 'verbatim' AS judge, false AS trustworthy, held AND round(met / greatest(n, 1), 3) >= 0.25 AS supported, round(met / greatest(n, 1), 3) AS score, "
           "CASE WHEN held THEN 'quoted word for word' ELSE 'not in a passage' END || ', ' || met || ' of ' || n || ' keywords' AS rationale FROM vh"),
    ("ho", f"SELECT scope, query_id, 'heuristic' AS judge, false AS trustworthy, g AND s >= {K.JUDGE_COVERAGE} AS supported, round(s, 3) AS score, "
           "'decisive term ' || CASE WHEN g THEN 'present' ELSE 'absent' END || ', weighted coverage ' || round(s, 3) AS rationale FROM js_"),
    ("oo", "SELECT * FROM vo UNION ALL SELECT * FROM ho"),
]
ORACLES["judge_opinions"] = P.with_(JUDGING + OPINIONS, "SELECT * FROM oo")
ORACLES["judge_rollup"] = P.with_(
    JUDGING + OPINIONS,
    "SELECT o.judge, o.trustworthy, count(*) AS judged, round(avg(o.supported::INT), 6) AS support_rate, round(avg(o.score), 6) AS mean_score, "
    "round(avg((o.supported = x.supported)::INT), 6) AS agreement, 'indicative only' AS note FROM oo o LEFT JOIN oo x "
    "ON x.scope = o.scope AND x.query_id = o.query_id AND x.judge <> o.judge GROUP BY o.judge, o.trustworthy")
