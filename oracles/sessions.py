"""DuckDB statements for gapmatch.plans.session_queries."""

from __future__ import annotations

from gapmatch.functions import fixed as K

from . import parts as P

OKEY = (
    "printf('%02d-%012d-%09d-%03d-%012d', l_linenumber, l_partkey, l_suppkey, l_quantity::INT, round(l_extendedprice * 100)::BIGINT)"
)
SESSIONS = ("sess", "SELECT o_custkey AS user_id, o_orderkey AS session_id, o_orderpriority || ' - ' || year(o_orderdate) AS title, "
                    "o_orderpriority AS target_role, o_orderdate AS created_at FROM orders")
ITEMS = ("ri", f"SELECT l_orderkey AS session_id, {OKEY} AS order_key, p_name || ' ' || p_type || ' ' || p_brand AS requirement, "
               "CASE WHEN l_linestatus = 'O' THEN 'must_have' ELSE 'nice_to_have' END AS category, CASE WHEN p_type = 'PROMO' THEN 'behavioural' "
               "ELSE 'evidenceable' END AS kind, CASE l_returnflag WHEN 'A' THEN 'strong' WHEN 'N' THEN 'partial' ELSE 'missing' END AS status, "
               "l_discount AS confidence, CASE WHEN l_returnflag <> 'R' THEN 'Designed and shipped every ' || p_name || ' of note' END AS evidence_quote "
               "FROM lineitem JOIN part ON l_partkey = p_partkey")
ANSWERS = ("ans", f"SELECT l_orderkey AS session_id, l_linenumber AS question_id, l_shipdate AS answered_at, {OKEY} AS answer_key, "
                  "10 + (40 * (l_quantity::INT - 1)) // 49 AS score10, 1 + l_quantity::INT % 5 AS depth, 1 + l_partkey % 5 AS relevance, "
                  "1 + l_suppkey % 5 AS correctness FROM lineitem")
LATEST = [ANSWERS, ("lat", "SELECT * FROM ans QUALIFY row_number() OVER (PARTITION BY session_id, question_id ORDER BY answered_at DESC, answer_key DESC) = 1")]
COMPS = LATEST + [
    ("cl", "SELECT session_id, unnest(['Depth', 'Relevance', 'Correctness']) AS name, unnest([depth, relevance, correctness]) AS s FROM lat"),
    ("comp", f"SELECT session_id, name, {P.half_even('sum(s)', 'count(*)', 2)} AS score FROM cl GROUP BY ALL"),
]
SCORES = [
    ITEMS,
    ("rs", "SELECT session_id, sum(CASE WHEN kind <> 'evidenceable' THEN 0 WHEN category = 'must_have' THEN 2 ELSE 1 END * CASE status WHEN 'strong' "
           "THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) AS earned, sum(CASE WHEN kind <> 'evidenceable' THEN 0 WHEN category = 'must_have' THEN 2 ELSE 1 END) "
           "AS total, count(*) FILTER (kind = 'evidenceable' AND status = 'strong') AS n_strong, count(*) FILTER (kind = 'evidenceable' AND status = "
           "'partial') AS n_partial, count(*) FILTER (kind = 'evidenceable' AND status = 'missing') AS n_missing, count(*) FILTER (kind = 'evidenceable') "
           "AS n_scored, count(*) FILTER (kind <> 'evidenceable') AS n_behavioural FROM ri GROUP BY session_id"),
    ("sc0", f"SELECT *, CASE WHEN total = 0 THEN 0 ELSE {P.half_even('50 * earned', 'nullif(total, 0)', 0)} END::BIGINT AS overall_score FROM rs"),
    ("sc", f"SELECT * EXCLUDE (earned, total), {P.band('overall_score', K.VERDICT_BANDS)} AS verdict FROM sc0"),
]
CARDS = SCORES + LATEST + [
    ("am", "SELECT session_id, count(*) AS answers, sum(score10) AS s10 FROM lat GROUP BY session_id"),
    ("cd0", f"SELECT session_id, overall_score, answers, {P.half_even('s10', '10 * answers', 1)} AS answer_mean, "
            f"{P.half_even('2 * overall_score * answers + 6 * s10', '5 * answers', 0)}::BIGINT AS readiness_score FROM sc JOIN am USING (session_id)"),
    ("cd", f"SELECT *, {P.band('readiness_score', K.READINESS_BANDS)} AS readiness_band FROM cd0"),
]
POINTS = CARDS + [
    SESSIONS,
    ("aa", "SELECT session_id, count(*) AS answers, sum(score10) AS s10 FROM ans GROUP BY session_id"),
    ("pts", f"SELECT user_id, s.session_id, title, target_role, created_at, sc.overall_score AS match_score, readiness_score, coalesce(aa.answers, 0) AS answers, "
            f"coalesce(s10, 0) AS s10, {P.half_even('s10', '10 * aa.answers', 2)} AS mean_answer_score FROM sess s LEFT JOIN sc USING (session_id) "
            "LEFT JOIN cd USING (session_id) LEFT JOIN aa USING (session_id)"),
]
PRIO = (
    "(CASE status WHEN 'missing' THEN 0 WHEN 'partial' THEN 1 WHEN 'strong' THEN 2 ELSE 3 END + CASE WHEN category = 'must_have' THEN 0 ELSE 1.5 END)"
)
BANK = "[" + ", ".join(P.q(b) for b in K.QUESTION_BANK) + "]"


def topup(n):
    return (
        f"SELECT session_id, 'behavioural' AS category, (have + i + 1)::INT AS place, {BANK}[(n + i) % 8 + 1] AS linked_requirement, 3 AS difficulty FROM "
        f"(SELECT session_id, n, have, unnest(range({n} - have)) AS i FROM (SELECT session_id, count(*) AS n, least({n}, count(*) FILTER (kind = "
        "'behavioural')) AS have FROM ri GROUP BY session_id))"
    )


def planned(nt, nb):
    return (
        f"SELECT session_id, 'technical' AS category, (row_number() OVER (PARTITION BY session_id ORDER BY {PRIO}, order_key))::INT AS place, requirement AS "
        f"linked_requirement, CASE WHEN status = 'missing' THEN 4 ELSE 3 END AS difficulty FROM ri WHERE kind = 'evidenceable' QUALIFY place <= {nt} UNION ALL "
        "SELECT session_id, 'behavioural', (row_number() OVER (PARTITION BY session_id ORDER BY order_key))::INT AS place, requirement, 3 FROM ri WHERE "
        f"kind = 'behavioural' QUALIFY place <= {nb} UNION ALL {topup(nb)}"
    )


QA = ("qa", "SELECT u.conv_id AS session_id, u.turn AS question_id, u.text AS question, a.turn AS answer_id, a.text AS answer FROM conversations u JOIN "
            "conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'")


def occ(phrase):
    return f"((length(low) - length(replace(low, {P.q(phrase)}, ''))) // {len(phrase)})"


FEATURES = [
    QA,
    ("qf0", f"SELECT *, lower(answer) AS low, {P.tokens('answer')} AS toks, {P.needles('question')} AS nd FROM qa"),
    ("qf", "SELECT session_id, answer_id, question_id, len(toks)::INT AS words, greatest(1, len(regexp_extract_all(answer, '[.!?]')))::INT AS sents, "
           f"len(regexp_extract_all(answer, {P.q(K.QUANTITY)}))::INT AS numbers, {occ(' i ')}::INT AS i_count, {occ(' we ')}::INT AS we_count, "
           f"CASE WHEN question = '' THEN 0.5 ELSE {P.coverage('nd', P.text_keys('toks'))} END AS cover, "
           + ", ".join("(" + " + ".join(f"contains(low, {P.q(m)})::INT" for m in ms) + f")::INT AS {n}" for n, ms in K.STAR_MARKERS.items())
           + ", (" + " + ".join(occ(p) for p in K.TRADE_OFF_PHRASES) + ")::INT AS trade_offs FROM qf0"),
]


def scale(v, lo, hi):
    return f"CASE WHEN {v} <= {lo} THEN 1 WHEN {v} >= {hi} THEN 5 ELSE round_even((1 + 4 * (({v})::DOUBLE - {lo}) / ({hi} - {lo}))::DECIMAL(18, 9), 0)::INT END"


STAR = [scale("situation", 0, 2), scale("task", 0, 2), scale("action", 0, 3), scale("(result + numbers)", 0, 3), scale("numbers", 0, 3)]
TECH = [
    scale("(cover * 5 + (numbers > 0)::INT)", 0.5, 4.0), scale("(words * (cover + 0.5))", 40, 260), scale("trade_offs", 0, 3),
    scale("(6 - abs(sents - 7) * 0.6::DOUBLE)", 1.0, 5.5), scale("cover", 0.1, 0.7),
]
NOTE = "CASE name " + " ".join(f"WHEN {P.q(k)} THEN {P.q(v)}" for k, v in K.COMMENTS.items()) + " END"
FOLLOW = "CASE name " + " ".join(f"WHEN {P.q(k)} THEN {P.q(v)}" for k, v in K.FOLLOW_UPS.items()) + " END"
SCORED = FEATURES + [
    ("s1", f"SELECT session_id, question_id, answer_id, CASE WHEN question_id = 0 THEN 'technical' ELSE 'star' END AS rubric, {scale('words', 25, 170)} AS ln, "
           f"CASE WHEN question_id = 0 THEN [{', '.join(TECH)}] ELSE [{', '.join(STAR)}] END AS raw FROM qf"),
    ("s2", f"SELECT session_id, question_id, answer_id, rubric, ln, unnest(raw) AS r, generate_subscripts(raw, 1) AS nth, unnest(CASE WHEN rubric = 'star' THEN "
           f"{list(K.STAR_CRITERIA)} ELSE {list(K.TECHNICAL_CRITERIA)} END) AS name FROM s1"),
    ("s3", f"SELECT *, greatest(1, least(5, {P.half_even('3 * r + ln', '4', 0)}::INT)) AS score FROM s2"),
    ("s4", f"SELECT *, row_number() OVER (PARTITION BY session_id, question_id ORDER BY score, nth) AS up, row_number() OVER (PARTITION BY session_id, "
           f"question_id ORDER BY score DESC, nth DESC) AS down, name || ' (' || score || '/5) — ' || {NOTE} AS label, {FOLLOW} AS fu FROM s3"),
]


def top(where, order, n, cols):
    return f"SELECT session_id, {cols}, row_number() OVER (PARTITION BY session_id ORDER BY {order}) AS pos FROM {where} QUALIFY pos <= {n}"


def points(status, best):
    direction, keep = ("DESC", "score >= 4") if best else ("ASC", "score <= 3")
    return SCORES[:1] + COMPS + [
        ("u1", top(f"(SELECT * FROM ri WHERE status = '{status}')", "order_key", 4, "0 AS tier, requirement AS label")),
        ("u2", f"SELECT session_id, 1 AS tier, printf('%s %.2f/5', name, score) AS label, pos FROM ("
               + top("comp", f"score {direction}, name", 2, "name, score") + f") WHERE {keep}"),
    ]


MERGE = "SELECT session_id, tier, label, (row_number() OVER (PARTITION BY session_id ORDER BY tier, pos))::INT AS place FROM (SELECT * FROM u1 UNION ALL BY NAME SELECT * FROM u2) QUALIFY place <= 6"
GAP = f"coalesce({P.salient('requirement')}[1], list_filter({P.tokens('requirement')}, lambda a1_: NOT ({P.is_stop('a1_')}))[1], '')"
TONE = P.band("readiness_score", K.TONE_BANDS)

ORACLES = {
    "question_priority": P.with_([ITEMS], planned(5, 3)),
    "question_topup": P.with_([ITEMS], topup(3)),
    "question_link": P.with_(
        [ITEMS, ("pl_", planned(2, 1))],
        "SELECT p.session_id, p.category, p.place, max(r.order_key) AS linked_item FROM pl_ p LEFT JOIN ri r ON r.session_id = p.session_id AND "
        "r.requirement = p.linked_requirement GROUP BY p.session_id, p.category, p.place"),
    "answer_features": P.with_(FEATURES, "SELECT * REPLACE (round(cover, 6) AS cover) FROM qf"),
    "answer_scores": P.with_(
        SCORED,
        "SELECT session_id, question_id, answer_id, any_value(rubric) AS rubric, string_agg(name || ':' || score, ';' ORDER BY nth) AS criteria, "
        "sum(score)::BIGINT / 5.0::DOUBLE AS overall_score, coalesce(string_agg(label, ' | ' ORDER BY down) FILTER (score >= 4 AND down <= 3), "
        "any_value(label) FILTER (down = 1)) AS strengths, coalesce(string_agg(label, ' | ' ORDER BY up) FILTER (score <= 3 AND up <= 3), "
        f"{P.q(K.IMPROVEMENT_DEFAULT)}) AS improvements, any_value(name) FILTER (up = 1) AS weakest, any_value(fu) FILTER (up = 1) AS follow_up FROM s4 GROUP BY ALL"),
    "latest_per_key": P.with_(LATEST, "SELECT session_id, question_id, answer_key, score10::BIGINT AS score10 FROM lat"),
    "order_match_scores": P.with_(SCORES, "SELECT * FROM sc"),
    "scorecard": P.with_(CARDS, "SELECT * FROM cd"),
    "competency_means": P.with_(COMPS, "SELECT session_id, name, score FROM comp"),
    "scorecard_strengths": P.with_(points("strong", True), MERGE),
    "scorecard_gaps": P.with_(points("missing", False), MERGE),
    "action_items": P.with_(
        [SESSIONS, ITEMS] + COMPS + [
            ("a0", top("(SELECT * FROM ri WHERE status = 'missing' AND category = 'must_have')", "order_key", 8, "0 AS tier, 'high' AS priority, requirement AS title")),
            ("a1", top("(SELECT * FROM comp WHERE score <= 3)", "score, name", 8, "1 AS tier, CASE WHEN score <= 2 THEN 'high' ELSE 'medium' END AS priority, name AS title")),
            ("a2", top("(SELECT * FROM ri WHERE status = 'partial')", "order_key", 8, "2 AS tier, 'medium' AS priority, requirement AS title")),
            ("a3", "SELECT session_id, tier, priority, title, (row_number() OVER (PARTITION BY session_id ORDER BY tier, pos))::INT AS place FROM "
                   "(SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2) QUALIFY place <= 8")],
        "SELECT * FROM a3 UNION ALL SELECT session_id, 3, 'low', 'Rehearse the strongest answers', 1 FROM sess ANTI JOIN a3 USING (session_id)"),
    "score_history": P.with_(
        LATEST + [
            ("hw", "SELECT *, CASE WHEN depth <= relevance AND depth <= correctness THEN 'Depth' WHEN relevance <= correctness THEN 'Relevance' ELSE 'Correctness' END "
                   "AS weakest, row_number() OVER (PARTITION BY session_id ORDER BY question_id) AS place, count(*) OVER (PARTITION BY session_id) AS answers, "
                   "sum(score10) OVER (PARTITION BY session_id) AS s10 FROM lat")],
        f"SELECT session_id, place::INT AS place, question_id, score10 / 10.0::DOUBLE AS score, weakest, answers, {P.half_even('s10', '10 * answers', 1)} AS mean FROM hw WHERE place <= 5"),
    "display_tone": P.with_(
        CARDS, f"SELECT {TONE} AS tone, {P.band('answer_mean / 5 * 100', K.TONE_BANDS)} AS answer_tone, count(*) AS sessions FROM cd GROUP BY ALL"),
    "session_points": P.with_(POINTS, "SELECT * EXCLUDE (s10) FROM pts"),
    "recurring_gaps": P.with_(
        [SESSIONS, ITEMS,
         ("mi", f"SELECT user_id, title, created_at, session_id, order_key, requirement, {GAP} AS gap_key FROM ri JOIN sess USING (session_id) WHERE status = 'missing' "
                "AND kind = 'evidenceable'"),
         ("gg", "SELECT user_id, gap_key, count(DISTINCT title) AS missing_in, min_by(requirement, (created_at, session_id, order_key)) AS label, "
                "string_agg(title, ' | ' ORDER BY created_at, session_id, order_key) FILTER (nth = 1) AS applications FROM (SELECT *, row_number() OVER (PARTITION BY "
                "user_id, gap_key, title ORDER BY created_at, session_id, order_key) AS nth FROM mi) mi WHERE gap_key <> '' "
                "GROUP BY ALL HAVING count(DISTINCT title) >= 2")],
        "SELECT user_id, gap_key, label, missing_in, applications, (row_number() OVER (PARTITION BY user_id ORDER BY missing_in DESC, label, gap_key))::INT AS place FROM gg QUALIFY place <= 8"),
    "competency_trend": P.with_(
        [SESSIONS] + COMPS + [
            ("tr", "SELECT user_id, name, count(*) AS points, min_by(score, (created_at, session_id)) AS first, max_by(score, (created_at, session_id)) AS latest, "
                   "string_agg(printf('%.2f', score), ',' ORDER BY created_at, session_id) AS series "
                   "FROM comp JOIN sess USING (session_id) GROUP BY ALL HAVING count(*) >= 2")],
        "SELECT *, round(latest - first, 2) AS delta FROM tr"),
    "progress_totals": P.with_(
        POINTS + [
            ("pt", "SELECT user_id, count(*) AS sessions_total, count(readiness_score) AS sessions_scored, sum(answers)::BIGINT AS answers_total, sum(s10) AS s10, "
                   "max(readiness_score) AS best_readiness, max_by(readiness_score, (created_at, session_id)) FILTER (readiness_score IS NOT NULL) AS latest_readiness, "
                   "min_by(readiness_score, (created_at, session_id)) FILTER (readiness_score IS NOT NULL) AS fr, sum(match_score) AS ms, count(match_score) AS mn "
                   "FROM pts GROUP BY user_id")],
        f"SELECT user_id, sessions_total, sessions_scored, answers_total, {P.half_even('s10', 'nullif(10 * answers_total, 0)', 2)} AS mean_answer_score, best_readiness, "
        f"latest_readiness, CASE WHEN sessions_scored >= 2 THEN latest_readiness - fr END AS readiness_delta, {P.half_even('ms', 'nullif(mn, 0)', 1)} AS mean_match, "
        "sessions_scored >= 3 AS has_trend FROM pt"),
    "session_overview": P.with_(
        CARDS + [SESSIONS],
        "SELECT s.user_id, s.session_id, s.title, coalesce(d.n, 0) AS documents, coalesce(q.n, 0) AS question_count, coalesce(a.n, 0) AS answered_count, sc.session_id IS "
        "NOT NULL AS has_analysis, cd.readiness_score FROM sess s LEFT JOIN sc USING (session_id) LEFT JOIN cd USING (session_id) LEFT JOIN (SELECT l_orderkey AS session_id, "
        "count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) d USING (session_id) LEFT JOIN (SELECT l_orderkey AS session_id, count(DISTINCT l_linenumber) AS n "
        "FROM lineitem GROUP BY 1) q USING (session_id) LEFT JOIN (SELECT l_orderkey AS session_id, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'R' "
        "GROUP BY 1) a USING (session_id)"),
    "newest_page": P.with_([SESSIONS], "SELECT user_id, session_id, title, (row_number() OVER (PARTITION BY user_id ORDER BY session_id DESC))::INT AS place FROM sess QUALIFY place > 2 AND place <= 5"),
    "owned_only": P.with_([SESSIONS], "SELECT user_id, session_id FROM sess SEMI JOIN (SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment = 'BUILDING') c USING (user_id)"),
    "order_letters": P.with_(
        [SESSIONS, ITEMS,
         ("ol", f"SELECT r.*, len(list_filter(list_distinct({P.tokens('requirement')}), lambda b1_: NOT list_contains({P.tokens('target_role')}, b1_))) <= 1 AND "
                f"len({P.tokens('requirement')}) > 0 AND len({P.tokens('target_role')}) > 0 AS rst FROM ri r JOIN sess USING (session_id) WHERE status = 'strong'"),
         ("oc", "SELECT *, round_even(confidence::DECIMAL(9, 4), 2) AS c2 FROM ol WHERE NOT rst QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY c2 DESC, order_key) <= 2"),
         ("oa", "SELECT session_id, string_agg(printf('%s [%.2f] %s', requirement, c2::DOUBLE, evidence_quote), ' | ' ORDER BY c2 DESC, order_key) AS claims FROM oc GROUP BY 1"),
         ("ofb", "SELECT session_id, count(*) AS n, string_agg(requirement, ' | ' ORDER BY order_key) AS held FROM ri WHERE kind = 'evidenceable' AND status = 'missing' AND category = 'must_have' GROUP BY 1")],
        "SELECT session_id, coalesce(claims, '') AS claims, coalesce(held, '') AS forbidden, coalesce(n, 0)::INT AS n_forbidden FROM sess LEFT JOIN oa USING (session_id) LEFT JOIN ofb USING (session_id)"),
    "gap_keys": P.with_([ITEMS], f"SELECT {GAP} AS gap_key, count(*) AS n FROM ri GROUP BY 1"),
}
