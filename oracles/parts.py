"""Building blocks of the DuckDB statements that state each query's result a second time."""

from __future__ import annotations

from gapmatch.functions import fixed as K

WS = K.BLANK


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def strip(e: str) -> str:
    return f"regexp_replace({e}, {q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def strip_chars(e: str, chars: str) -> str:
    return f"regexp_replace({e}, {q(f'^[{chars}]+|[{chars}]+$')}, '', 'g')"


def squeeze(e: str) -> str:
    return strip(f"regexp_replace({e}, {q(f'[{WS}]+')}, ' ', 'g')")


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, {q(f'[{WS}]+')}), lambda w_: w_ <> '')"


def match(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {q(K.wide(pattern))})"


def tokens(e: str) -> str:
    return (
        f"list_transform(regexp_extract_all({e}, {q(K.WORD)}), "
        f"lambda t_: CASE WHEN regexp_matches(t_, '[^ -~]') THEN translate(lower(t_), {q(K.FOLD_FROM)}, "
        f"{q(K.FOLD_TO)}) ELSE lower(t_) END)"
    )


def is_stop(t: str) -> str:
    return f"{t} IN {strings(K.STOPWORDS)}"


def first_seen(e: str) -> str:
    """Distinct elements in order of first use."""
    return f"list_filter({e}, lambda d_, i_: list_position({e}, d_) = i_)"


def keywords_of(toks: str, limit: int = K.KEYWORD_LIMIT) -> str:
    return (
        f"list_transform([{toks}], lambda a_: list_transform("
        f"[list_filter(a_, lambda k_: length(k_) >= 2 AND NOT ({is_stop('k_')}))], "
        f"lambda b_: {first_seen('b_')}[1:{limit}])[1])[1]"
    )


def keywords(e: str, limit: int = K.KEYWORD_LIMIT) -> str:
    return keywords_of(tokens(e), limit)


def salient(e: str) -> str:
    cleaned = (
        f"list_transform({words(e)}, lambda s_: "
        f"regexp_replace({strip_chars('s_', K.WORD_TRIM)}, '[.]+$', ''))"
    )
    named = f"list_filter({cleaned}, lambda n_: length(n_) >= 2 AND regexp_matches(n_, '\\p{{Lu}}'))"
    toks = f"flatten(list_transform({named}, lambda m_: {tokens('m_')}))"
    kept = (
        f"list_filter({toks}, lambda x_: length(x_) >= 2 AND NOT ({is_stop('x_')}) AND len(list_filter("
        f"string_split(x_, '-'), lambda p_: {is_stop('p_')})) = 0)"
    )
    return f"list_transform([{kept}], lambda y_: {first_seen('y_')})[1]"


def groups(e: str) -> str:
    """Coordinate groups; a coordinator needs a non-word character or an end on both sides."""
    word = rf"(?i)(^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(K.COORDINATORS)})($|[^\p{{L}}\p{{N}}_])"
    mark = "'\\1' || chr(1) || '\\2'"
    once = f"regexp_replace({e}, {q(word)}, {mark}, 'g')"
    twice = f"regexp_replace({once}, {q(word)}, {mark}, 'g')"
    cut = f"regexp_split_to_array({twice}, {q(K.wide(r'[,;()\[\]\x{01}]|\s+/\s+'))})"
    return f"list_filter(list_transform({cut}, lambda g_: {strip('g_')}), lambda h_: h_ <> '')"


def only_capitals(e: str) -> str:
    return f"(regexp_matches({e}, '\\p{{L}}') AND NOT regexp_matches({e}, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]'))"


def stem(t: str) -> str:
    pattern = rf"^(.{{{K.GREEK_STEM_MIN},}}?)(?:{'|'.join(K.GREEK_ENDINGS)})$"
    return (
        f"CASE WHEN regexp_matches({t}, {q(f'[{K.GREEK}]')}) "
        f"THEN regexp_replace({t}, {q(pattern)}, '\\1') ELSE {t} END"
    )


def synonyms(t: str) -> str:
    cases = " ".join(
        f"WHEN {q(k)} THEN [{', '.join(q('x:' + o) for o in v)}]" for k, v in K.SYNONYMS.items()
    )
    return f"CASE {t} {cases} ELSE [] END"


def keyword_keys(t: str) -> str:
    return (
        f"list_concat(['x:' || {t}, 's:' || {t}], {synonyms(t)}, "
        f"CASE WHEN length({t}) >= 5 THEN ['p:' || {t}[1:5]] ELSE [] END, "
        f"CASE WHEN {stem(t)} <> {t} THEN ['g:' || {stem(t)}] ELSE [] END)"
    )


def text_keys(toks: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(list_distinct({toks}), lambda v_: list_concat("
        f"['x:' || v_], CASE WHEN contains(v_, '/') THEN list_transform(string_split(v_, '/'), "
        f"lambda z_: 's:' || z_) ELSE [] END, "
        f"CASE WHEN length(v_) >= 5 THEN ['p:' || v_[1:5]] ELSE [] END, ['g:' || {stem('v_')}]))))"
    )


def clip(e: str, n: int) -> str:
    flat = squeeze(e)
    return (
        f"CASE WHEN length({flat}) <= {n} THEN {flat} ELSE "
        f"regexp_replace(substring({flat}, 1, {n - 1}), {q(f'[{WS}]+$')}, '') || '…' END"
    )


def half_even(num: str, den: str, scale: int) -> str:
    """Exact round-half-even of a quotient of integers."""
    a = f"(({num})::HUGEINT * {10 ** scale})"
    d = f"({den})::HUGEINT"
    return (
        f"((({a} // {d}) + CASE WHEN 2 * ({a} % {d}) > {d} OR (2 * ({a} % {d}) = {d} "
        f"AND ({a} // {d}) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / {10 ** scale})"
    )


def band(e: str, bands) -> str:
    whens = " ".join(f"WHEN {e} >= {f} THEN {q(n)}" for f, n in bands if f is not None)
    return f"CASE {whens} ELSE {q(bands[-1][1])} END"


def with_(ctes: list[tuple[str, str]], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({b})" for n, b in ctes) + "\n" + select


# --- reflow and sentences of (key, text) rows ---------------------------------------------
def reflow_ctes(source: str, key: str) -> list[tuple[str, str]]:
    """``rl(key, ln, line)``: whole lines of every text of ``source``."""
    heading = (
        f"(length(line) <= 70 AND (line LIKE '%:' OR ({only_capitals('line')} "
        f"AND len({words('line')}) <= 6)))"
    )
    return [
        ("raw_lines", f"SELECT {key}, unnest(l) AS raw, generate_subscripts(l, 1) AS ln FROM (SELECT "
                      f"{key}, regexp_split_to_array(text, {q(K.LINE_BREAK)}) AS l FROM {source})"),
        ("bare_lines", f"SELECT {key}, ln, {strip('raw')} AS line FROM raw_lines"),
        ("flag_lines", f"SELECT {key}, ln, line, line = '' OR {heading} AS apart, "
                       f"right(line, 1) IN ('.', '!', '?', ':', ';') AS closed, "
                       f"regexp_matches(line, '^[\\p{{Ll}}ªº]') AS low, "
                       f"{match('line', K.DANGLING)} AS dang FROM bare_lines"),
        ("joint_lines", f"SELECT *, coalesce(lag(NOT apart AND NOT closed) OVER w, false) AND NOT apart "
                        f"AND (low OR lag(dang) OVER w) AS joins FROM flag_lines "
                        f"WINDOW w AS (PARTITION BY {key} ORDER BY ln)"),
        ("island_lines", f"SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER "
                         f"(PARTITION BY {key} ORDER BY ln) AS isle FROM joint_lines"),
        ("rl", f"SELECT {key}, min(ln) AS ln, string_agg(line, ' ' ORDER BY ln) AS line "
               f"FROM island_lines WHERE line <> '' GROUP BY {key}, isle"),
    ]


def sentence_ctes(source: str, key: str) -> list[tuple[str, str]]:
    """``st(key, pos, sentence)`` with pos from 0."""
    split = (
        f"string_split(regexp_replace(line, {q(f'([.!?;])[{WS}]+')}, '\\1' || chr(2), 'g'), chr(2))"
    )
    return reflow_ctes(source, key) + [
        ("pieces", f"SELECT {key}, ln, unnest(p) AS piece, generate_subscripts(p, 1) AS pn "
                   f"FROM (SELECT {key}, ln, {split} AS p FROM rl)"),
        ("trimmed", f"SELECT {key}, ln, pn, {strip_chars('piece', K.SENTENCE_TRIM)} AS sentence FROM pieces"),
        ("st", f"SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY ln, pn) - 1 AS pos, sentence "
               f"FROM trimmed WHERE length(sentence) >= {K.SENTENCE_MIN_CHARS} "
               f"OR (sentence <> '' AND len({salient('sentence')}) > 0)"),
    ]


# --- sections, parents, children of pg(doc_key, page, text) --------------------------------
def section_ctes() -> list[tuple[str, str]]:
    bare = strip("line")
    heading = (
        f"length({bare}) > 2 AND length({bare}) < 60 AND ({match(bare, K.SECTION_HEADING)} OR "
        f"({only_capitals(bare)} AND right({bare}, 1) NOT IN ('.', ',') AND len({words(bare)}) <= 5))"
    )
    return [
        ("pl", f"SELECT doc_key, page, unnest(l) AS line, generate_subscripts(l, 1) AS ln FROM "
               f"(SELECT doc_key, page, regexp_split_to_array(text, {q(K.LINE_BREAK)}) AS l FROM pg)"),
        ("ph", f"SELECT *, ({heading}) AS h FROM pl"),
        ("pn", "SELECT *, sum(h::INT) OVER (PARTITION BY doc_key ORDER BY page, ln) AS sec FROM ph"),
        ("bd", f"SELECT doc_key, sec, {strip('string_agg(line, chr(10) ORDER BY page, ln)')} AS body "
               "FROM pn WHERE NOT h GROUP BY doc_key, sec"),
        ("hd", "SELECT doc_key, sec, page, line FROM pn WHERE h"),
        ("fs", f"SELECT b.doc_key, b.sec, coalesce(regexp_replace({strip('hd.line')}, ':+$', ''), 'Header') "
               "AS section, coalesce(hd.page, 1) AS page, b.body FROM bd b LEFT JOIN hd USING (doc_key, sec) "
               "WHERE b.body <> ''"),
        ("wide_docs", "SELECT doc_key FROM fs GROUP BY doc_key HAVING count(*) >= 2"),
        ("sx", "SELECT doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY sec) - 1 AS s_idx, section, "
               "page, body FROM fs SEMI JOIN wide_docs USING (doc_key) UNION ALL "
               "SELECT doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY page) - 1, "
               f"'Page ' || page, page, text FROM pg ANTI JOIN wide_docs USING (doc_key) WHERE {strip('text')} <> ''"),
    ]


def parent_ctes() -> list[tuple[str, str]]:
    full = f"length(buf) + length(ps[i]) > {K.PARENT_MAX_CHARS} AND buf <> ''"
    return section_ctes() + [
        ("pk", "SELECT doc_key, s_idx, string_split(body, chr(10) || chr(10)) AS ps, 1 AS i, '' AS buf, "
               f"[]::VARCHAR[] AS done FROM sx WHERE length(body) > {K.PARENT_MAX_CHARS} UNION ALL "
               f"SELECT doc_key, s_idx, ps, i + 1, CASE WHEN ({full}) OR buf = '' THEN ps[i] "
               f"ELSE buf || chr(10) || chr(10) || ps[i] END, "
               f"CASE WHEN {full} THEN list_append(done, {strip('buf')}) ELSE done END "
               "FROM pk WHERE i <= len(ps)"),
        ("pd", f"SELECT doc_key, s_idx, CASE WHEN {strip('buf')} <> '' THEN list_append(done, {strip('buf')}) "
               "ELSE done END AS parts FROM pk WHERE i = len(ps) + 1 UNION ALL "
               f"SELECT doc_key, s_idx, [body] FROM sx WHERE length(body) <= {K.PARENT_MAX_CHARS}"),
        ("pu", "SELECT doc_key, s_idx, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS p_idx FROM pd"),
        ("parents", "SELECT pu.doc_key, pu.doc_key || '-s' || s_idx || '-p' || p_idx AS parent_id, section, page, "
                    "pu.text FROM pu JOIN sx USING (doc_key, s_idx)"),
    ]


def window_ctes(source: str, key: str) -> list[tuple[str, str]]:
    """``wn(key, c_idx, start, text)``: child windows of (key, text)."""
    size, half = K.CHILD_CHARS, K.CHILD_CHARS // 2
    tail = f"substring(text, st + {half + 1}, {size - half})"
    cut = f"(length({tail}) - length(regexp_extract({tail}, '[^ ]*$')) - 1)"
    stop = (
        f"CASE WHEN st + {size} < n AND {cut} >= 0 THEN st + {half} + {cut} ELSE least(st + {size}, n) END"
    )
    return [
        ("wk", f"SELECT {key}, text, length(text) AS n, 0 AS st FROM {source} UNION ALL SELECT {key}, text, n, "
               f"greatest(st + 1, en - {K.CHILD_OVERLAP}) FROM (SELECT *, {stop} AS en FROM wk) WHERE en < n"),
        ("wp", f"SELECT {key}, st, CASE WHEN n <= {size} THEN text ELSE "
               f"{strip('substring(text, st + 1, en - st)')} END AS piece FROM (SELECT *, {stop} AS en FROM wk)"),
        ("wn", f"SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY st) - 1 AS c_idx, st AS start, "
               f"piece AS text FROM wp WHERE piece <> ''"),
    ]


DOC_PAGES = ("pg", "SELECT 'cv' || doc_id AS doc_key, 1 AS page, text FROM documents")


READY = f"length({strip('text')}) >= {K.TEXT_MIN_CHARS} AND strlen({strip('text')}) <= {K.MAX_BYTES}"


POSTED = "(doc_id // 20) % 4 = 3"


def child_ctes(scope: str = "source", kind: str = "cv", where: str = "true") -> list[tuple[str, str]]:
    """``chunks(scope, doc_key, parent_id, chunk_id, section, page, text, toks)``."""
    pages = ("pg", f"SELECT '{kind}' || doc_id AS doc_key, 1 AS page, text FROM documents WHERE {READY} AND ({where})")
    return [pages] + parent_ctes() + window_ctes("parents", "parent_id") + [
        ("scopes", f"SELECT '{kind}' || doc_id AS doc_key, {scope} AS scope FROM documents"),
        ("chunks0", "SELECT scope, p.doc_key, parent_id, parent_id || '-c' || c_idx AS chunk_id, section, page, "
                    "wn.text FROM wn JOIN parents p USING (parent_id) JOIN scopes s USING (doc_key)"),
        ("chunks", f"SELECT *, {tokens('text')} AS toks FROM chunks0"),
    ]


def fixed_child_ctes(scope: str = "source") -> list[tuple[str, str]]:
    return [("ft", f"SELECT 'cv' || doc_id AS doc_key, text FROM documents WHERE {READY}")] + window_ctes("ft", "doc_key") + [
        ("scopes", f"SELECT 'cv' || doc_id AS doc_key, {scope} AS scope FROM documents"),
        ("parents", "SELECT doc_key, doc_key || '-f' || c_idx AS parent_id, '' AS section, 1 AS page, text FROM wn"),
        ("chunks0", "SELECT scope, doc_key, parent_id, parent_id || '-c0' AS chunk_id, section, page, text "
                    "FROM parents JOIN scopes USING (doc_key)"),
        ("chunks", f"SELECT *, {tokens('text')} AS toks FROM chunks0"),
    ]


# --- retrieval ---------------------------------------------------------------------------
def bm25_ctes(k: int = K.CANDIDATE_K) -> list[tuple[str, str]]:
    """``bm(scope, query_id, chunk_id, score, rank)`` over chunks and queries(scope, query_id, text)."""
    k1, b = K.BM25_K1, K.BM25_B
    return [
        ("bt", "SELECT scope, chunk_id, CASE WHEN len(toks) > 0 THEN toks ELSE ['_'] END AS toks FROM chunks"),
        ("bs", "SELECT scope, count(*) AS n, sum(len(toks)) / count(*) AS avg_len FROM bt GROUP BY scope"),
        ("bf", "SELECT scope, chunk_id, len(toks) AS dl, unnest(toks) AS term FROM bt"),
        ("tf", "SELECT scope, chunk_id, dl, term, count(*) AS tf FROM bf GROUP BY ALL"),
        ("bd_", "SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL"),
        ("br", "SELECT scope, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM bd_ JOIN bs USING (scope)"),
        ("be", f"SELECT scope, avg(raw) * {K.BM25_EPSILON} AS floor FROM br GROUP BY scope"),
        ("bi", "SELECT scope, term, CASE WHEN raw < 0 THEN floor ELSE raw END AS idf FROM br JOIN be USING (scope)"),
        ("qt", f"SELECT scope, query_id, unnest(CASE WHEN len(t) > 0 THEN t ELSE ['_'] END) AS term FROM "
               f"(SELECT scope, query_id, {tokens('text')} AS t FROM queries)"),
        ("qc", "SELECT scope, query_id, term, count(*) AS times FROM qt GROUP BY ALL"),
        ("bsc", f"SELECT qc.scope, qc.query_id, tf.chunk_id, round(sum(times * idf * tf * {k1 + 1} / (tf + {k1} * "
                f"({1 - b} + {b} * dl / avg_len))), 9) AS score FROM qc JOIN bi USING (scope, term) "
                "JOIN tf USING (scope, term) JOIN bs USING (scope) GROUP BY ALL"),
        ("bm", "SELECT scope, query_id, chunk_id, score, row_number() OVER (PARTITION BY scope, query_id "
               f"ORDER BY score DESC, chunk_id) AS rank FROM bsc WHERE score > 0 QUALIFY rank <= {k}"),
    ]


def vector_ctes(source: str, key: str, name: str, text: str = "text") -> list[tuple[str, str]]:
    """``name(key, vec FLOAT[])``: unit vectors of hashed features."""
    n, dim = name, K.VECTOR_DIM
    return [
        (f"{n}_t", f"SELECT {key}, {tokens(text)} AS t FROM {source}"),
        (f"{n}_f", f"SELECT {key}, 'w:' || unnest(t) AS f, {K.WORD_WEIGHT}::DOUBLE AS w FROM {n}_t UNION ALL "
                   f"SELECT {key}, 'g:' || substring(x, i, 4), {K.GRAM_WEIGHT} FROM (SELECT {key}, x, "
                   f"unnest(range(1, length(x) - 2)) AS i FROM (SELECT {key}, unnest(t) AS x FROM {n}_t) "
                   f"WHERE length(x) >= 5) UNION ALL "
                   f"SELECT {key}, 'b:' || t[i] || '_' || t[i + 1], {K.PAIR_WEIGHT} FROM "
                   f"(SELECT {key}, t, unnest(range(1, len(t))) AS i FROM {n}_t)"),
        (f"{n}_u", f"SELECT f, ('0x' || md5(f)[1:8])::BIGINT % {dim} AS dim, "
                   f"CASE WHEN ('0x' || md5(f)[9:10])::BIGINT % 2 = 1 THEN 1 ELSE -1 END AS sign "
                   f"FROM (SELECT DISTINCT f FROM {n}_f)"),
        (f"{n}_d", f"SELECT {key}, dim, sum(sign * w) AS w FROM {n}_f JOIN {n}_u USING (f) GROUP BY ALL"),
        (f"{n}_m", f"SELECT {key}, map(list(dim), list(w)) AS m, sqrt(sum(w * w)) AS norm FROM {n}_d GROUP BY {key}"),
        (name, f"SELECT {key}, list_transform(range({dim}), lambda d_: (coalesce(m[d_], 0) / "
               f"CASE WHEN norm = 0 THEN 1 ELSE norm END)::FLOAT) AS vec FROM {n}_m"),
    ]


def variants(e: str) -> str:
    """List of query variants of a text."""
    base = squeeze(e)
    kws = keywords(base, 10)
    added = "list_concat([]::VARCHAR[], " + ", ".join(
        f"CASE WHEN {match(f'lower({base})', rf'\b{p}\b')} THEN [{q(a)}, {q(b)}] ELSE [] END"
        for p, (a, b) in K.EXPANSIONS.items()
    ) + ")"
    return (
        f"list_transform([struct_pack(b := {base}, k := {kws}, a := {added})], lambda v_: "
        "list_transform([list_filter([v_.b, CASE WHEN len(v_.k) >= 2 AND "
        "lower(array_to_string(v_.k, ' ')) <> lower(v_.b) THEN array_to_string(v_.k, ' ') END, "
        "CASE WHEN len(v_.a) > 0 THEN array_to_string(list_transform([list_concat(v_.k[1:6], v_.a)], "
        f"lambda j_: {first_seen('j_')})[1], ' ') END], lambda o_: o_ IS NOT NULL AND o_ <> '')], "
        f"lambda r_: {first_seen('r_')}[1:{K.MAX_VARIANTS}])[1])[1]"
    )


def dense_ctes(k: int = K.CANDIDATE_K, multi: bool = True, n: str = "dn", label: str = "CV") -> list[tuple[str, str]]:
    """``dn(scope, query_id, v, chunk_id, score, rank)``."""
    listed = variants("text") if multi else "[text]"
    return [
        ("emb_src", "SELECT chunk_id, CASE WHEN section = '' AND parent_id LIKE '%-f%' THEN text ELSE "
                    f"'[{label} › ' || section || ']' || chr(10) || text END AS et FROM chunks"),
        *vector_ctes("emb_src", "chunk_id", "cvec", "et"),
        ("cvu", "SELECT chunk_id, vec FROM emb_src LEFT JOIN cvec USING (chunk_id)"),
        (f"{n}_v", f"SELECT scope, query_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS v FROM "
                   f"(SELECT scope, query_id, {listed} AS l FROM queries)"),
        (f"{n}_k", f"SELECT *, query_id || '|' || v AS vk FROM {n}_v"),
        *vector_ctes(f"{n}_k", "vk", f"{n}_q"),
        (f"{n}_s", f"SELECT k.scope, k.query_id, k.v, c.chunk_id, round(coalesce(list_cosine_similarity("
                   f"q.vec::DOUBLE[], u.vec::DOUBLE[]), 0), 9) AS score FROM {n}_k k LEFT JOIN {n}_q q USING (vk) "
                   f"JOIN chunks c ON c.scope = k.scope JOIN cvu u ON u.chunk_id = c.chunk_id"),
        (n, f"SELECT *, row_number() OVER (PARTITION BY scope, query_id, v ORDER BY score DESC, chunk_id) AS rank "
            f"FROM {n}_s QUALIFY rank <= {k}"),
    ]


def fused_ctes(rankings: str, n: str = "fu") -> list[tuple[str, str]]:
    """``fu(scope, query_id, chunk_id, score, rank)`` from (scope, query_id, ranking, chunk_id, score, rank)."""
    return [
        (f"{n}_r", rankings),
        (f"{n}_c", f"SELECT scope, query_id, count(DISTINCT ranking) AS nr FROM {n}_r GROUP BY ALL"),
        (f"{n}_g", f"SELECT scope, query_id, chunk_id, round(sum(1.0::DOUBLE / ({K.RRF_K} + rank)), 12) AS rrf, "
                   f"min(rank) AS fr, min((CASE WHEN ranking = 'bm25' THEN 'z' ELSE ranking END, rank)) AS seen, max(CASE WHEN ranking = 'bm25' THEN 0 ELSE score END) AS own FROM {n}_r GROUP BY ALL"),
        (n, f"SELECT scope, query_id, chunk_id, CASE WHEN nr = 1 THEN own ELSE rrf END AS score, row_number() OVER "
            f"(PARTITION BY scope, query_id ORDER BY CASE WHEN nr = 1 THEN fr ELSE 0 END, "
            f"CASE WHEN nr = 1 THEN 0 ELSE -rrf END, seen, chunk_id) AS rank FROM {n}_g JOIN {n}_c USING (scope, query_id)"),
    ]


def needles(e: str) -> str:
    """List of key lists, one per keyword."""
    return f"list_transform({keywords(e)}, lambda nk_: {keyword_keys('nk_')})"


def coverage(nd: str, keys: str) -> str:
    return (
        f"CASE WHEN len({nd}) = 0 THEN 0.0::DOUBLE ELSE len(list_filter({nd}, lambda c_: "
        f"list_has_any(c_, {keys})))::DOUBLE / len({nd}) END"
    )


def rerank_ctes(k: int = K.CANDIDATE_K, src: str = "fu", n: str = "rr") -> list[tuple[str, str]]:
    return [
        (f"{n}_n", f"SELECT scope, query_id, {needles('text')} AS nd FROM queries"),
        (f"{n}_k", f"SELECT scope, chunk_id, {text_keys('toks')} AS keys FROM chunks SEMI JOIN {src} USING (scope, chunk_id)"),
        (f"{n}_s", f"SELECT f.scope, f.query_id, f.chunk_id, f.rank AS old, round(0.75 * ({coverage('nd', 'keys')}) + "
                   f"0.25 * least(1.0, greatest(0.0, score)), 12) AS score FROM {src} f JOIN {n}_n USING (scope, query_id) "
                   f"JOIN {n}_k USING (scope, chunk_id)"),
        (n, f"SELECT scope, query_id, chunk_id, score, row_number() OVER (PARTITION BY scope, query_id "
            f"ORDER BY score DESC, old) AS rank FROM {n}_s QUALIFY rank <= {k}"),
    ]


BOTH = (
    "SELECT scope, query_id, v::VARCHAR AS ranking, chunk_id, score, rank FROM dn UNION ALL "
    "SELECT scope, query_id, 'bm25', chunk_id, score, rank FROM bm"
)


def passage_ctes(src: str = "rr", n: str = "ps") -> list[tuple[str, str]]:
    """``ps(scope, query_id, rank, chunk_id, parent_id, section, page, score, text)``."""
    return [
        (f"{n}_1", f"SELECT r.*, c.parent_id, c.section, c.page, row_number() OVER (PARTITION BY r.scope, r.query_id, "
                   f"c.parent_id ORDER BY r.rank) AS nth FROM {src} r JOIN chunks c USING (scope, chunk_id)"),
        (f"{n}_2", f"SELECT * EXCLUDE (nth, rank), row_number() OVER (PARTITION BY scope, query_id ORDER BY rank) AS place "
                   f"FROM {n}_1 WHERE nth = 1 QUALIFY place <= {K.TOP_K}"),
        (f"{n}_3", f"SELECT *, count(*) FILTER (score >= {K.SCORE_FLOOR}) OVER (PARTITION BY scope, query_id) AS loud FROM {n}_2"),
        (n, f"SELECT scope, query_id, row_number() OVER (PARTITION BY scope, query_id ORDER BY place) AS rank, chunk_id, "
            f"parent_id, x.section, x.page, score, p.text FROM {n}_3 x JOIN parents p USING (parent_id) "
            f"WHERE score >= {K.SCORE_FLOOR} OR (loud = 0 AND place = 1)"),
    ]


SESSION_QUERIES = ("queries", "SELECT 'src' || (item_id % 20) AS scope, item_id::VARCHAR AS query_id, text FROM benchmark")
ALL_QUERIES = ("queries", "SELECT 'all' AS scope, item_id::VARCHAR AS query_id, text FROM benchmark")


def ranked_ctes(scope: str, queries, chunks=None) -> list[tuple[str, str]]:
    return (
        (chunks or child_ctes)(scope) + [queries] + bm25_ctes() + dense_ctes() + fused_ctes(BOTH) + rerank_ctes()
    )
