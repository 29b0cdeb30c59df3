"""How the test tables stand in for the engine's own: the only place that knows their columns."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as T
from ..operators import chunking as C
from ..operators import evidence as V
from ..operators import retrieval as R
from ..operators.scorecards import latest_per_key
from ..operators.chunk_store import ChunkStore, chunks_of
from ..operators.index import Index, build_index
from ..sources.documents import ready_documents
from ..storage import stamp, work_dir, written

SESSIONS = 20  # values of documents.source


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, doc_id, doc_key, text, pages): every document, one page each, scope = source."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("scope"), "doc_id",
        F.concat(F.lit("cv"), "doc_id").alias("doc_key"), "text",
        C.single_page(F.col("text")).alias("pages"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Spread a small file over the cores before heavy work; large inputs come split already."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < wanted
    return df.repartition(wanted) if few else df


def _changed(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """What tells a table from an earlier state of it."""
    return tuple(stamp(spark, f"{sf_dir}/{name}.parquet") for name in names)


@lru_cache(maxsize=16)
def _store(spark: SparkSession, sf_dir: str, _: tuple) -> ChunkStore:
    candidates = chunks_of(ready_documents(documents(spark, sf_dir)), "cv")
    held = ChunkStore(spark, f"{work_dir(spark)}/chunk-store-{uuid.uuid4().hex}").create(candidates)
    candidates.release()
    return held


def store(spark: SparkSession, sf_dir: str) -> ChunkStore:
    """The stored chunks of the documents that pass the guards; built on first use, as at ingestion."""
    return _store(spark, sf_dir, _changed(spark, sf_dir, "documents"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are postings, under keys of their own."""
    found = documents(spark, sf_dir).filter(document_kind() == "jd")
    return found.withColumn("doc_key", F.concat(F.lit("jd"), "doc_id"))


@lru_cache(maxsize=16)
def _two_sided(spark: SparkSession, sf_dir: str, changed: tuple) -> ChunkStore:
    held, docs = _store(spark, sf_dir, changed), ready_documents(postings(spark, sf_dir))
    posted = chunks_of(docs, "jd")
    held.upsert(docs.withColumn("doc_kind", F.lit("jd")), posted)
    posted.release()
    return held


def two_sided(spark: SparkSession, sf_dir: str) -> ChunkStore:
    """The same store with the postings beside the candidate documents."""
    return _two_sided(spark, sf_dir, _changed(spark, sf_dir, "documents"))


@lru_cache(maxsize=16)
def _fixed_index(spark: SparkSession, sf_dir: str, _: tuple) -> Index:
    return build_index(ready_documents(documents(spark, sf_dir)), "fixed")


def index(spark: SparkSession, sf_dir: str, strategy: str = "parent_child", asked: DataFrame | None = None) -> Index:
    """The stored index of the candidate documents; ``asked`` (scope, ...) limits it to the buckets of its scopes."""
    if strategy == "fixed":
        return _fixed_index(spark, sf_dir, _changed(spark, sf_dir, "documents"))
    return store(spark, sf_dir).index("cv", asked)


@lru_cache(maxsize=16)
def _global_index(spark: SparkSession, sf_dir: str, strategy: str, _: tuple) -> Index:
    if strategy == "fixed":
        return index(spark, sf_dir, strategy).under(F.lit("all")).with_lexicon()
    return store(spark, sf_dir).pooled("cv")


def global_index(spark: SparkSession, sf_dir: str, strategy: str = "parent_child") -> Index:
    return _global_index(spark, sf_dir, strategy, _changed(spark, sf_dir, "documents"))


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, query_id, text): each benchmark text is a requirement of exactly one session."""
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("src"), (F.col("item_id") % SESSIONS).cast("string")).alias("scope"),
        F.col("item_id").cast("string").alias("query_id"), "text",
    )


def posting_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements with category and kind."""
    number = F.col("query_id").cast("int")
    return requirements(spark, sf_dir).select(
        "scope", "query_id", "text",
        F.when(number % 3 == 2, "nice_to_have").otherwise("must_have").alias("category"),
        T.requirement_kind(F.col("text")).alias("kind"),
    )


@lru_cache(maxsize=8)
def _passages(spark: SparkSession, sf_dir: str, _: tuple) -> DataFrame:
    asked = requirements(spark, sf_dir)
    ix = index(spark, sf_dir, asked=asked)
    found = R.retrieve(ix.children, ix.parents, asked, lexicon=ix.lexicon)
    return written(found, "passages", ("scope", "query_id", "rank"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored evidence map: passages retrieved for every requirement."""
    return _passages(spark, sf_dir, _changed(spark, sf_dir, "documents", "benchmark"))


@lru_cache(maxsize=8)
def _judged_items(spark: SparkSession, sf_dir: str, _: tuple) -> DataFrame:
    return written(V.verdicts(posting_items(spark, sf_dir), passages(spark, sf_dir)), "items")


def judged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored match items of every session."""
    return _judged_items(spark, sf_dir, _changed(spark, sf_dir, "documents", "benchmark"))


def report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match items under the names the reports read."""
    return judged_items(spark, sf_dir).select(
        F.col("scope").alias("session_id"), F.col("query_id").cast("long").alias("order_key"),
        F.col("text").alias("requirement"), "category", "kind", "status", "confidence", "evidence_quote",
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, query_id, text): the same texts asked of all documents at once."""
    return requirements(spark, sf_dir).withColumn("scope", F.lit("all"))


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, question_id, question, answer_id, answer): user turn and the reply after it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("question_id"),
        F.col("text").alias("question"), (F.col("turn") + 1).alias("answer_id"),
    )
    said = turns.filter("role = 'assistant'").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("answer_id"),
        F.col("text").alias("answer"),
    )
    return asked.join(said, ["session_id", "answer_id"])


# --- customers, orders and lines as users, sessions and items ------------------------------
def order_key():
    """An orderable text key of a line: (order, line number) alone is not unique."""
    return F.format_string(
        "%02d-%012d-%09d-%03d-%012d", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"),
        F.round(F.col("l_extendedprice") * 100).cast("long"),
    )


def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, session_id, title, target_role, created_at); equal titles recur on purpose."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("session_id"),
        F.concat("o_orderpriority", F.lit(" - "), F.year("o_orderdate").cast("string")).alias("title"),
        F.col("o_orderpriority").alias("target_role"), F.col("o_orderdate").alias("created_at"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as match items: return flag = status, line status = category, part = requirement."""
    lines = spread(table(spark, sf_dir, "lineitem"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", "strong").when(flag == "N", "partial").otherwise("missing")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("session_id"), order_key().alias("order_key"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("requirement"),
        F.when(F.col("l_linestatus") == "O", "must_have").otherwise("nice_to_have").alias("category"),
        F.when(F.col("p_type") == "PROMO", "behavioural").otherwise("evidenceable").alias("kind"),
        status.alias("status"), F.col("l_discount").alias("confidence"),
        F.when(flag != "R", F.concat(F.lit("Designed and shipped every "), "p_name", F.lit(" of note"))).alias("evidence_quote"),
    )


def order_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as scored answers: line number = question, quantity = score."""
    whole = F.col("l_quantity").cast("int")
    return spread(table(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("question_id"),
        F.col("l_shipdate").alias("answered_at"), order_key().alias("answer_key"),
        (F.lit(10) + F.floor(40 * (whole - 1) / 49)).cast("long").alias("score10"),
        F.array(*[
            F.struct(F.lit(name).alias("name"), (F.lit(1) + (value % 5)).cast("int").alias("score"))
            for name, value in (("Depth", whole), ("Relevance", F.col("l_partkey")), ("Correctness", F.col("l_suppkey")))
        ]).alias("criteria"),
    )


def latest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(order_answers(spark, sf_dir), ["session_id", "question_id"], ["answered_at", "answer_key"])


def kinds(loaded: DataFrame) -> DataFrame:
    """Loaded documents (session_id, doc_id, ingest_error) as one kind or the other of their session."""
    return loaded.select(
        "session_id", document_kind().alias("kind"),
        F.when(F.col("ingest_error").isNull(), "ready").otherwise("failed").alias("ingest_status"),
    )


def document_kind():
    """Every fourth document of a session is a posting."""
    return F.when(F.floor(F.col("doc_id") / SESSIONS) % 4 == 3, "jd").otherwise("cv")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(table(spark, sf_dir, "events"))


def calls_of(events: DataFrame) -> DataFrame:
    """Events as model calls: user = session, type = stage, the JSON counter drives tokens and cache."""
    k = F.from_json("props", "k int")["k"]
    models = F.array(*[F.lit(m) for m in (*K.USD_PER_MILLION, "unlisted-model")])
    return events.select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("stage"),
        F.element_at(models, (F.col("event_id") % 5 + 1).cast("int")).alias("model"),
        F.concat(F.lit("v"), (k % 3).cast("string")).alias("prompt_version"),
        (k * 10).alias("prompt_tokens"), F.floor("value").cast("int").alias("completion_tokens"),
        F.col("value").alias("latency_ms"), (k % 4 == 0).alias("cache_hit"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("ts").alias("created_at"),
    )
