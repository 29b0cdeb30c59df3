"""Streaming jobs run over the table files until everything available is processed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..operators import telemetry as L
from ..operators.index import work_dir
from ..sources import documents as D
from ..streaming import jobs as J
from ..streaming.breaches import breach_events
from . import tables


def _base(spark, name):
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf_dir, name):
    return J.file_stream(spark, sf_dir, f"{name}.parquet", tables.table(spark, sf_dir, name).schema)


def _done(query):
    query.awaitTermination()


def stream_rate_windows(spark, sf_dir):
    base = _base(spark, "rates")
    asked = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("caller"), F.col("ts").cast("timestamp").alias("ts"))
    _done(J.request_rates(asked, base, "1 hour", 1))
    found = J.newest(spark, f"{base}/rates", ["caller", "window_start"])
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_rate_tiers(spark, sf_dir):
    """Four tiers of requests; users of every fifth id are signed in, the others share an address per event type."""
    base = _base(spark, "tiers")
    asked = _stream(spark, sf_dir, "events").select(
        L.caller_key(F.when(F.col("user_id") % 5 == 0, F.col("user_id")), F.col("event_type")).alias("caller"),
        F.element_at(F.array(*[F.lit(t) for t in (*K.RATE_TIERS, "other")]), (F.col("event_id") % 5 + 1).cast("int")).alias("tier"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    _done(J.request_tiers(asked, base))
    found = J.newest(spark, f"{base}/tiers", ["caller", "tier", "window_start"])
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def spend_breach(spark, sf_dir):
    base = _base(spark, "spend")
    rates = L.rate_table(spark)

    def priced(events):
        return L.price(tables.calls_of(events), rates).withColumn("installation", F.col("model"))

    _done(J.spend(priced(_stream(spark, sf_dir, "events")), base))
    hours = J.newest(spark, f"{base}/spend", ["installation", "hour"])
    found = L.first_breaches(hours, priced(tables.table(spark, sf_dir, "events")), 0.05)
    return found.withColumn("spent_usd", F.col("spent_usd").cast("double"))


def spend_breach_keyed(spark, sf_dir):
    """The same breaches from keyed state, without a second look at the calls."""
    base = _base(spark, "breaches")
    rates = L.rate_table(spark)
    calls = tables.calls_of(_stream(spark, sf_dir, "events")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    priced = L.price(calls, rates).withColumn("installation", F.col("model"))
    _done(J.start(breach_events(priced, 0.05, "0 seconds"), J.into(f"{base}/events"), base))
    found = spark.read.schema("installation string, call_id bigint, created_at timestamp, spent_usd decimal(18,9)").parquet(f"{base}/events")
    return found.select("installation", "call_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("spent_usd").cast("double").alias("spent_usd"))


def _ingested(spark, sf_dir):
    base = _base(spark, "ingest")
    docs = _stream(spark, sf_dir, "documents").select(F.concat(F.lit("cv"), "doc_id").alias("doc_key"), "text")
    _done(J.ingest(docs, base))
    return J.ingested(spark, base)


def ingest_transitions(spark, sf_dir):
    """States that every document went through when all arrive twice in one batch, first as an empty draft."""
    base = _base(spark, "transitions")
    arrived = _stream(spark, sf_dir, "documents").select(
        F.concat(F.lit("cv"), "doc_id").alias("doc_key"), F.explode(F.array(F.struct(F.lit(0).alias("nth"), F.lit("").alias("text")), F.struct(F.lit(1).alias("nth"), "text"))).alias("a"))
    _done(J.ingest(arrived.select("doc_key", "a.nth", "a.text"), base, order=("nth",)))
    steps = J.ingest_log(spark, base).groupBy("doc_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "step", "state"))), lambda s: s["state"]), ">").alias("states"))
    return steps.join(J.ingest_states(spark, base), "doc_key")


def stream_ingest(spark, sf_dir):
    return _ingested(spark, sf_dir)[0]


def stream_chunks(spark, sf_dir):
    """Index rows of the stream, with the number of dimensions their vectors use."""
    used = F.size(F.filter("vec", lambda w: F.abs(w) > 1e-6))
    return _ingested(spark, sf_dir)[2].select("doc_key", "parent_id", "chunk_id", "section", F.md5("text").alias("text_md5"), used.alias("n_dims"))


def status_stream(spark, sf_dir):
    base = _base(spark, "status")
    loaded = D.load_texts(_stream(spark, sf_dir, "documents").select("source", "doc_id", "text"))
    _done(J.session_status(tables.kinds(loaded.withColumnRenamed("source", "session_id")), base))
    return J.newest(spark, f"{base}/sessions", ["session_id"])


QUERIES = {f.__name__: f for f in (stream_rate_windows, stream_rate_tiers, spend_breach, spend_breach_keyed, stream_ingest, ingest_transitions, stream_chunks, status_stream)}
