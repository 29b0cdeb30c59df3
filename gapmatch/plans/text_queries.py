"""Text kernel over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matching as M
from ..functions import text as T
from .tables import spread, table


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _joined(arr, sep=" "):
    return F.array_join(arr, sep)


def tokens_per_doc(spark, sf_dir):
    toks = _docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("toks"))
    return toks.select(
        "doc_id", F.size("toks").alias("n_tokens"), F.size(F.array_distinct("toks")).alias("n_distinct"),
        F.md5(_joined("toks")).alias("tokens_md5"),
    )


def keywords(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _joined(T.keywords(F.col("text"))).alias("keywords"))


def salient_terms(spark, sf_dir):
    found = _docs(spark, sf_dir).select(
        "doc_id", T.salient_terms(F.col("text")).alias("terms"), T.requirement_kind(F.col("text")).alias("kind")
    )
    return found.select(
        "doc_id", F.size("terms").alias("n_terms"), F.md5(_joined("terms")).alias("terms_md5"), "kind"
    )


def coordinate_groups(spark, sf_dir):
    found = _docs(spark, sf_dir).select("doc_id", T.coordinate_groups(F.col("text")).alias("g"))
    return found.select("doc_id", F.size("g").alias("n_groups"), F.md5(_joined("g", "|")).alias("groups_md5"))


def language_share(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("lang", T.language(F.col("text")).alias("detected"))
    return found.groupBy("lang", "detected").agg(F.count("*").alias("n"))


def number_mentions(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.quantity_mentions(F.col("text")).alias("n_numbers"))


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("est_tokens"))


def reflowed_lines(spark, sf_dir):
    found = _docs(spark, sf_dir).select("doc_id", T.reflowed(F.col("text")).alias("l"))
    return found.select("doc_id", F.size("l").alias("n_lines"), F.md5(_joined("l", "\n")).alias("lines_md5"))


def sentence_table(spark, sf_dir):
    found = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    return found.select(
        "doc_id", "pos", F.length("s").alias("n_chars"), T.clip(F.col("s"), 80).alias("clipped"), F.md5("s").alias("sentence_md5")
    )


def normalise_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.normalise(F.col("text"))).alias("normal_md5"),
        T.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("memo_key"),
        F.octet_length("text").alias("size_bytes"),
    )


LATIN = "abcdefghijklmnopqrstuvwxyz"
AS_GREEK = "αβσδεφγηιζκλμνοπθρστυωωχυζ"


def greek_stems(spark, sf_dir):
    """Document words written in Greek letters, then stemmed: the tables hold no Greek of their own."""
    word = F.translate("w", LATIN, AS_GREEK)
    words = (
        _docs(spark, sf_dir)
        .select(F.explode(T.find_all(F.lower(F.col("text")), "[a-z]{2,}")).alias("w"))
        .groupBy(word.alias("word")).agg(F.count("*").alias("uses"))
    )
    return words.groupBy(T.greek_stem(F.col("word")).alias("stem")).agg(
        F.count("*").alias("forms"), F.sum("uses").alias("uses")
    )


def intent_routing(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


def match_keys(spark, sf_dir):
    """Keywords of each question met by its answer, by overlap of typed match keys."""
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    pairs = turns.filter("role = 'assistant'").withColumn("prev", F.col("turn") - 1).join(
        turns.filter("role = 'user'").select(
            "conv_id", F.col("turn").alias("prev"), F.col("text").alias("asked")
        ),
        ["conv_id", "prev"],
    )
    scored = pairs.select(
        "conv_id", "turn", M.needles(T.keywords(F.col("asked"))).alias("nd"),
        M.text_keys(T.tokens(F.col("text"))).alias("keys"),
    )
    return scored.select(
        "conv_id", "turn", F.size("nd").alias("n_keywords"), F.size("keys").alias("n_keys"),
        F.round(M.coverage(F.col("nd"), F.col("keys")), 6).alias("coverage"),
    )


def unspaced_text(spark, sf_dir):
    """Letter-spaced runs closed up."""
    fixed = _docs(spark, sf_dir).select("doc_id", "text", T.unspace(F.col("text")).alias("fixed"))
    return fixed.select(
        "doc_id", (F.length("text") - F.length("fixed")).alias("removed"), F.md5("fixed").alias("fixed_md5")
    )


def company_names(spark, sf_dir):
    """Employer in front of the dash of a "Company - Role" title, blank when it restates the role."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    titled = s.join(n, s.s_nationkey == n.n_nationkey).select(
        "s_suppkey",
        F.when(F.col("s_suppkey") % 3 == 0, F.concat("n_name", F.lit(" – "), "s_name"))
        .when(F.col("s_suppkey") % 3 == 1, F.concat("s_name", F.lit(" - "), "n_name"))
        .otherwise(F.col("s_name")).alias("title"),
        F.concat("s_name", F.lit(" Lead")).alias("role"),
    )
    return titled.select(
        "s_suppkey", T.company_from(F.col("title"), F.col("role")).alias("company"),
        T.restates_role(F.col("title"), F.col("role")).alias("restates"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        tokens_per_doc, keywords, salient_terms, coordinate_groups, language_share, number_mentions,
        token_estimate, reflowed_lines, sentence_table, normalise_hash, greek_stems, intent_routing,
        match_keys, unspaced_text, company_names,
    )
}
