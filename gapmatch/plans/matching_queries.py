"""Evidence, verdicts, reports and grounding of the benchmark requirements; one session per source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matching as M
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import evidence as V
from ..operators import judges as J
from ..operators import reports as P
from ..operators import requirements as Q
from ..operators.index import written
from .text_queries import LATIN
from .tables import documents, judged_items, passages, posting_items, report_items, spread, table


def idf(spark, sf_dir):
    return V.idf_table(passages(spark, sf_dir)).select("scope", "term", "df", "n", F.round("idf", 6).alias("idf"))


def _armed_passages(spark, sf_dir):
    found = passages(spark, sf_dir)
    ready = V.armed(posting_items(spark, sf_dir), V.idf_table(found))
    return found.join(ready.select("scope", "query_id", "needles", "pivots"), ["scope", "query_id"])


def weighted_coverage(spark, sf_dir):
    rows = _armed_passages(spark, sf_dir).select(
        "scope", "query_id", "rank", "needles", M.text_keys(T.tokens(F.col("text"))).alias("keys")
    )
    return rows.select(
        "scope", "query_id", "rank",
        F.round(M.coverage(F.col("needles"), F.col("keys")), 6).alias("coverage"),
        F.round(M.weighted_coverage(F.col("needles"), F.col("keys")), 6).alias("weighted"),
    )


def pivot_gate(spark, sf_dir):
    rows = _armed_passages(spark, sf_dir).select(
        "scope", "query_id", "rank", "pivots", M.text_keys(T.tokens(F.col("text"))).alias("keys")
    )
    return rows.select(
        "scope", "query_id", "rank",
        F.array_join(F.transform("pivots", lambda p: p["term"]), " ").alias("decisive_terms"),
        V.gate_open(F.col("pivots"), F.col("keys")).alias("gate"),
        V.decisive_met(F.col("pivots"), F.col("keys")).alias("decisive"),
    )


def best_sentence(spark, sf_dir):
    asked = posting_items(spark, sf_dir).select("scope", "query_id", M.needles(T.keywords(F.col("text"))).alias("nd"))
    rows = passages(spark, sf_dir).join(asked, ["scope", "query_id"]).select(
        "scope", "query_id", "rank", V.best_sentence(F.col("nd"), F.col("text")).alias("b")
    )
    return rows.select(
        "scope", "query_id", "rank", F.round("b.coverage", 6).alias("coverage"), F.left("b.sentence", F.lit(400)).alias("quote")
    )


def best_evidence(spark, sf_dir):
    found = passages(spark, sf_dir)
    ready = written(V.armed(posting_items(spark, sf_dir), V.idf_table(found)), "armed")
    return V.evidence_rows(found, ready).select(
        "scope", "query_id", "rank", F.col("ev.gate").alias("gate"), F.col("ev.decisive").alias("decisive"),
        F.round("ev.coverage", 6).alias("coverage"), F.col("ev.quote").alias("quote"),
    )


def verdicts(spark, sf_dir):
    items = V.verdicts(posting_items(spark, sf_dir), passages(spark, sf_dir))
    return items.drop("text").withColumn("coverage", F.round("coverage", 6))


def match_report(spark, sf_dir):
    return P.match_reports(report_items(spark, sf_dir)).withColumn("must_missing", F.array_join("must_missing", " | "))


def report_digest(spark, sf_dir):
    out = P.report_digest(report_items(spark, sf_dir))
    return out.withColumn("strong", F.array_join("strong", " | ")).withColumn("missing", F.array_join("missing", " | "))


def citation_check(spark, sf_dir):
    """Verdicts whose quotes were retyped (case, closing mark) or, for every fifth item, invented."""
    number = F.col("query_id").cast("int")
    typed = judged_items(spark, sf_dir).withColumn(
        "evidence_quote",
        F.when(
            F.col("status") != "missing",
            F.when(number % 5 == 0, F.concat(F.lit("never written "), "evidence_quote"))
            .otherwise(F.concat(F.translate("evidence_quote", LATIN, LATIN.upper()), F.lit("."))),
        ),
    )
    return V.verify_citations(typed, passages(spark, sf_dir)).select(
        "scope", "query_id", "status", "evidence_quote", "evidence_page", "evidence_chunk_id"
    )


def kind_carry(spark, sf_dir):
    """Every fourth position lost its extracted kind; the judged one fills in."""
    items = report_items(spark, sf_dir).withColumn("kind", F.lit("behavioural"))
    decided = report_items(spark, sf_dir).select(
        "session_id", "order_key", F.when(F.col("order_key") % 4 != 0, F.col("kind")).alias("kind")
    )
    return P.carry_kind(items, decided, ["session_id", "order_key"]).select("session_id", "order_key", "kind")


def requirement_extract(spark, sf_dir):
    return Q.extract(spread(documents(spark, sf_dir).select("doc_key", "text")), "doc_key")


def refused_postings(spark, sf_dir):
    docs = spread(documents(spark, sf_dir).select("doc_key", "text"))
    return P.refused_sessions(docs, Q.extract(docs, "doc_key"), "doc_key")


def labels(spark, sf_dir):
    """Label phrases of a session: every distinctive term of the whole texts of its labelled documents."""
    labelled = table(spark, sf_dir, "labels").select("doc_id", _expected().alias("expected"))
    return spread(documents(spark, sf_dir).select("scope", "doc_id", "text")).join(labelled, "doc_id").select(
        "scope", F.col("doc_id").alias("label_pos"), F.explode(T.salient_terms(F.col("text"))).alias("phrase"), "expected"
    )


def label_match(spark, sf_dir):
    """First label phrase that occurs in a requirement."""
    asked = posting_items(spark, sf_dir).select("scope", "query_id", F.col("text").alias("requirement"))
    return E.match_label(asked, labels(spark, sf_dir), ["scope", "query_id"]).select("scope", "query_id", "expected")


def _expected():
    return F.when(F.col("toxic") == 1, "missing").when(F.col("quality") == 0, "partial").otherwise("strong")


def _outcomes(spark, sf_dir):
    """The engine's own verdicts against the labels."""
    sources = documents(spark, sf_dir).select("doc_key", "text")
    return E.grounding_outcomes(judged_items(spark, sf_dir), passages(spark, sf_dir), sources, labels(spark, sf_dir))


def grounding_metrics(spark, sf_dir):
    return E.grounding_metrics(_outcomes(spark, sf_dir), "scope")


def grounding_disagreements(spark, sf_dir):
    return E.disagreements(_outcomes(spark, sf_dir)).select("scope", "query_id", "predicted", "expected", "quote")


def grounding_rollup(spark, sf_dir):
    """Metric rows of the whole suite: grounding, counts stated in summaries, support by the judge."""
    stated = summary_consistency(spark, sf_dir).agg(F.round(E.share(F.col("consistent")), 6).alias("summary_numeric_consistency"))
    judged = judge_support(spark, sf_dir).agg(F.round(E.share(F.col("supported")), 6).alias("judge_support_rate"))
    rows = E.long_metrics(E.grounding_metrics(_outcomes(spark, sf_dir)), "grounding")
    return rows.union(E.long_metrics(stated, "summary")).union(E.long_metrics(judged, "judge"))


def summary_consistency(spark, sf_dir):
    """Counts stated in the report summaries against the items; every third summary is off by one."""
    reports = P.match_reports(report_items(spark, sf_dir)).select(
        "session_id",
        F.when(F.substring("session_id", 4, 9).cast("int") % 3 == 0, F.concat(F.lit("1"), "summary")).otherwise(F.col("summary")).alias("summary"),
    )
    items = report_items(spark, sf_dir).filter("kind = 'evidenceable'").select("session_id", F.col("status").alias("predicted"))
    return E.numeric_consistency(reports, items)


def judge_support(spark, sf_dir):
    return V.heuristic_judge(judged_items(spark, sf_dir), passages(spark, sf_dir)).drop("gate")


def _opinions(spark, sf_dir):
    items, found = judged_items(spark, sf_dir), passages(spark, sf_dir)
    return written(J.heuristic_judged(items, found).unionByName(J.judged(items, found, [J.VERBATIM])), "opinions")


def judge_opinions(spark, sf_dir):
    """Two judges over one table of verdicts, with their reasons."""
    return _opinions(spark, sf_dir).withColumn("score", F.round("score", 3))


def judge_rollup(spark, sf_dir):
    return J.by_judge(_opinions(spark, sf_dir))


def letter_material(spark, sf_dir):
    sessions = posting_items(spark, sf_dir).select(F.col("scope").alias("session_id")).distinct().withColumn(
        "target_role", F.lit("that the of and")
    )
    return P.letter_lines(P.letter_material(report_items(spark, sf_dir), sessions))


def bullet_gate(spark, sf_dir):
    """Bullets made of the requirement with its first capitals bracketed as placeholders."""
    t = F.col("requirement")
    bullets = report_items(spark, sf_dir).select(
        "session_id", "order_key", "status", "evidence_quote",
        F.regexp_replace(t, r"\b([A-Z]\w+)", r"[$1]").alias("bullet"),
        F.transform(F.slice(T.find_all(t, r"\b[A-Z]\w+"), 1, 3), lambda w: F.concat(F.lit("["), w, F.lit("]"))).alias("placeholders"),
    )
    return P.gate_bullets(bullets).select("session_id", "order_key", F.size("placeholders").alias("n_placeholders"), "refusal")


QUERIES = {
    f.__name__: f
    for f in (
        idf, weighted_coverage, pivot_gate, best_sentence, best_evidence, verdicts, match_report, report_digest,
        citation_check, kind_carry, requirement_extract, refused_postings, label_match, grounding_metrics,
        grounding_disagreements, grounding_rollup, summary_consistency, judge_support, judge_opinions, judge_rollup, letter_material, bullet_gate,
    )
}
