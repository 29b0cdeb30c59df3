"""Call log analytics over events, contracts, keyed tables and erasure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import telemetry as L
from ..sources import contracts as C
from ..sources import store as W
from .tables import calls, document_kind, documents, index, order_key, order_sessions, spread, table


def _priced(spark, sf_dir):
    return L.price(calls(spark, sf_dir), L.rate_table(spark))


def _usd(df):
    return df.withColumn("cost_usd", F.col("cost_usd").cast("double"))


def cost_by_rate(spark, sf_dir):
    return _usd(_priced(spark, sf_dir).select("call_id", "model", "prompt_tokens", "completion_tokens", "cost_usd"))


def spend_by_session(spark, sf_dir):
    return _usd(L.by_session(_priced(spark, sf_dir)))


def spend_gate(spark, sf_dir):
    return L.spend_gate(_priced(spark, sf_dir), ceiling=1.0).withColumn("spent_usd", F.col("spent_usd").cast("double"))


def latency_p95(spark, sf_dir):
    return L.latency_by_stage(calls(spark, sf_dir))


def stage_rollup(spark, sf_dir):
    return _usd(L.stage_rollup(_priced(spark, sf_dir)))


def errors_by_model(spark, sf_dir):
    return L.errors_by_model(calls(spark, sf_dir))


def unpriced(spark, sf_dir):
    return L.unpriced(calls(spark, sf_dir), L.rate_table(spark))


def call_log(spark, sf_dir):
    """Log rows of question-answer exchanges priced as calls; an empty answer counts as an error."""
    turns = table(spark, sf_dir, "conversations")
    said = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.col("conv_id").alias("session_id"), F.lit("gpt-4o-mini").alias("model"),
        F.col("text").alias("prompt"), F.lower("text").alias("completion"),
        F.when(F.length("text") < 40, "too short to answer").alias("error"),
    )
    return _usd(L.log_calls(said, L.rate_table(spark))).drop("error")


def rate_windows(spark, sf_dir):
    """Requests per caller in fixed hours, against a ceiling scaled to the table."""
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("caller"), "ts")
    return L.request_windows(asked, "1 hour", 1)


# --- contracts ---------------------------------------------------------------------------
def contract_quarantine(spark, sf_dir):
    """Lines written as evaluation payloads, read back and checked; the reasons per line."""
    lines = spread(table(spark, sf_dir, "lineitem"))
    score = (F.col("l_linenumber") - 1).cast("int")
    one = F.struct(F.lit("Depth").alias("name"), score.alias("score"))
    payload = F.to_json(F.struct(
        F.when(F.col("l_linestatus") == "O", "star").when(F.col("l_returnflag") == "R", "essay").otherwise("technical").alias("rubric"),
        F.array_repeat(one, (F.col("l_suppkey") % 5).cast("int") + 1).alias("criteria"),
        (F.col("l_quantity") / 8).alias("overall_score"),
    ))
    rows = lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.when(F.col("l_partkey") % 50 == 0, F.substring(payload, 1, 20)).otherwise(payload).alias("payload"),
    )
    checked = C.check_json(rows, "evaluation")
    return C.quarantined(checked).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.array_join("violations", ",").alias("violations")
    )


def request_constraints(spark, sf_dir):
    """Conversation turns as answers; the duration is a function of the text."""
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", (F.length("text") * 9).alias("duration_seconds")
    )
    return C.check_request(rows, "answer").select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


def profile_whitelist(spark, sf_dir):
    """Customers as profiles; nation and balance stand in for what must not leave the table."""
    profiles = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("headline"),
        F.when(F.col("c_custkey") % 3 == 0, "senior").alias("seniority"), (F.col("c_custkey") % 41).alias("years_experience"),
        F.col("c_mktsegment").alias("target_roles"), F.when(F.col("c_custkey") % 2 == 0, "English").otherwise("").alias("languages"),
        F.col("c_nationkey").alias("nationality"), F.col("c_acctbal").alias("balance"),
    )
    return C.profile_context(profiles)


# --- keyed tables ------------------------------------------------------------------------
def _versions(spark, sf_dir):
    """Documents as uploads of sessions: several per (session, kind)."""
    return documents(spark, sf_dir).select(
        F.col("scope").alias("session_id"), document_kind().alias("kind"),
        (F.col("doc_id") % 97).alias("created_at"), "doc_key", F.length("text").alias("n_chars"),
    )


def current_documents(spark, sf_dir):
    return W.current_documents(_versions(spark, sf_dir))


def upsert_latest(spark, sf_dir):
    """Documents with a label arrive again in lower case and replace their first version."""
    stored = documents(spark, sf_dir).select("doc_key", "doc_id", "text")
    again = stored.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_key", "doc_id", F.lower("text").alias("text"))
    return W.upsert(stored, again, ["doc_key"]).select("doc_id", F.md5("text").alias("text_md5"))


def erase_document(spark, sf_dir):
    """Chunks left per scope after the documents labelled toxic are purged."""
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.concat(F.lit("cv"), "doc_id").alias("doc_key"))
    left = W.purge(index(spark, sf_dir).children.select("scope", "doc_key", "chunk_id"), gone, ["doc_key"])
    return left.groupBy("scope").agg(F.count("*").alias("chunks"), F.count_distinct("doc_key").alias("documents"))


def erase_cascade(spark, sf_dir):
    """Rows left in every table after the pending orders are erased with everything below them.

    Items and suggestions carry their session; answers and evaluations are reached through the questions.
    """
    sessions = order_sessions(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), order_key().alias("order_key"))
    lines = items.select("session_id", F.concat_ws("/", "session_id", "order_key").alias("item_id"))
    tables = {
        "sessions": sessions.select("session_id"),
        "match_report": sessions.select("session_id", F.col("session_id").alias("report_id")),
        "match_item": lines.select("session_id", F.col("session_id").alias("report_id"), "item_id"),
        "cv_suggestion": lines.select("session_id", "item_id", F.col("item_id").alias("suggestion_id")),
        "question": lines.select("session_id", F.col("item_id").alias("question_id")),
        "answer": lines.select(F.col("item_id").alias("question_id"), F.col("item_id").alias("answer_id")),
        "evaluation": lines.select(F.col("item_id").alias("answer_id"), F.col("item_id").alias("evaluation_id")),
        "llm_call": calls(spark, sf_dir).select("call_id", "session_id"),
    }
    tombstones = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("session_id"))
    left = W.erase_sessions(tables, tombstones)
    rows = [
        df.select(F.lit(name).alias("table"), (df["session_id"].isNotNull() if "session_id" in df.columns else F.lit(True)).alias("known"))
        for name, df in left.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), rows).groupBy("table").agg(F.count("*").alias("n_rows"), F.count_if("known").alias("with_session"))


def memo_misses(spark, sf_dir):
    """Texts whose vector is not stored yet: the labelled documents count as stored."""
    keyed = spread(documents(spark, sf_dir).select("doc_id", T.content_hash(F.lit("hashing"), F.lit("384"), F.col("text")).alias("memo_key")))
    stored = keyed.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("memo_key").distinct()
    return keyed.join(stored, "memo_key", "left_anti").select("doc_id", "memo_key")


QUERIES = {
    f.__name__: f
    for f in (
        cost_by_rate, spend_by_session, spend_gate, latency_p95, stage_rollup, errors_by_model, unpriced, call_log,
        rate_windows, contract_quarantine, request_constraints, profile_whitelist, current_documents, upsert_latest,
        erase_document, erase_cascade, memo_misses,
    )
}
