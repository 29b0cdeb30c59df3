"""The training-data operators over the test tables, at production parameters."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .cascade import quality_rules
from .kd_search import top_k
from .language import identify
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import best_fit_packing
from .period_runs import period_runs
from .quality import quality
from .suffix_dedup import remove_repeats
from .toxicity import toxicity
from .vector_dedup import near_vectors
from .warc import audit


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, sf_dir):
    """Graded ratings: one point for good form, one for not being toxic."""
    ratings = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("rating"))
    return quality(_table(spark, sf_dir, "documents"), ratings)


def op2_suffix_dedup(spark, sf_dir):
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op3_topk_search(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_packing(spark, sf_dir):
    return best_fit_packing(_table(spark, sf_dir, "documents"))


def op5_language(spark, sf_dir):
    return identify(_table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_dedup(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_warc_audit(spark, sf_dir):
    """The archive of all pages against a replica derived from it, with altered and lost records."""
    pages = _table(spark, sf_dir, "pages")
    replica = pages.filter("page_id % 211 <> 13").withColumn(
        "html", F.when(F.col("page_id") % 89 == 7, F.concat(F.lit("#"), F.expr("substr(html, 2)"))).otherwise(F.col("html")))
    return audit(pages, replica)


def op9_vector_dedup(spark, sf_dir):
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark, sf_dir):
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_quality_rules(spark, sf_dir):
    return quality_rules(_table(spark, sf_dir, "documents"))


def looped(doc_id: int, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by crc32 of its id, ends in a loop whose place and period the crc gives."""
    g, turn = divmod(zlib.crc32(str(doc_id).encode()), 10)
    n = len(words)
    if turn or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_period_runs(spark, sf_dir):
    found = period_runs(_table(spark, sf_dir, "documents"), looped)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_alignment(spark, sf_dir):
    return align(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_suffix_dedup, op3_topk_search, op4_packing, op5_language, op6_mixing, op7_near_dedup, op8_warc_audit, op9_vector_dedup, op10_toxicity,
    op11_quality_rules, op12_period_runs, op13_alignment)}

ORACLES = {
    "op3_topk_search": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
        )
        SELECT query_id, r::INTEGER AS "rank", vec_id, score FROM ranked WHERE r <= 5""",
    "op8_warc_audit": """
        WITH sides AS (
            SELECT 'ours' AS side, page_id, url, html FROM pages WHERE page_id IS NOT NULL UNION ALL
            SELECT 'theirs', page_id, url, CASE WHEN page_id % 89 = 7 THEN '#' || substr(html, 2) ELSE html END FROM pages WHERE page_id % 211 <> 13
        ), records AS (
            SELECT side, page_id, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
                'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ',
                octet_length(encode(coalesce(html, ''))), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record
            FROM sides
        ), digests AS (
            SELECT side, page_id, octet_length(encode(record))::BIGINT AS length, sha256(record) AS digest FROM records
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY side, page_id ORDER BY digest)::INTEGER AS nth FROM digests
        ), placed AS (
            SELECT o.page_id, o.nth, (sum(o.length) OVER (ORDER BY o.page_id, o.nth) - o.length)::BIGINT AS "offset", o.length, o.digest, t.digest AS theirs
            FROM numbered o LEFT JOIN numbered t ON t.side = 'theirs' AND t.page_id = o.page_id AND t.nth = o.nth WHERE o.side = 'ours'
        )
        SELECT page_id, nth, "offset", length, ("offset" // 1048576)::BIGINT AS leaf, digest,
            CASE WHEN theirs IS NULL THEN 'missing' WHEN theirs <> digest THEN 'corrupt' ELSE 'ok' END AS status
        FROM placed""",
    "op11_quality_rules": r"""
        WITH given AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce("text", '') AS t FROM documents WHERE doc_id IS NOT NULL
        ), parts AS (
            SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
                list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
            FROM given
        ), windows AS (
            SELECT r, i, list_slice(words, i, i + 7) AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM parts)
        ), repeated AS (
            SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
        ), covered AS (
            SELECT r, sum(least(8, n))::BIGINT AS n FROM (
                SELECT r, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8) AS n FROM repeated) GROUP BY r
        ), measured AS (
            SELECT doc_id, len(words)::BIGINT AS n_words, list_sum(list_transform(words, lambda w: length(w)))::BIGINT AS chars,
                len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
                len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) AS n_letter_words,
                len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)\s*$'))) AS n_dotted,
                len(list_filter(lines, lambda l: regexp_matches(l, '^\s*[-*•]'))) AS n_bullets
            FROM parts LEFT JOIN covered USING (r)
        ), judged AS (
            SELECT *, coalesce(chars, 0) AS word_chars, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT (2 * word_chars < 5 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words
                OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_letter_words < 7 * n_words OR 10 * n_dotted > 3 * n_lines
                OR 10 * n_bullets > 9 * n_lines) AS kept
        FROM judged""",
}
