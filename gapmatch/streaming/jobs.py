"""The incremental behaviours as Structured Streaming jobs.

Every job reads a file stream, aggregates with map-side combine (so a hot caller or installation is
no hot task) and hands each micro-batch to ``foreachBatch``, which writes it under its batch number.
A replayed batch overwrites its own folder, so results stay exact after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed as K
from ..operators import chunking as C
from ..operators.index import enrich
from ..operators.scorecards import latest_per_key
from ..operators.telemetry import request_windows, spend_hours, tier_windows
from ..operators.vectors import Embedder, hashed_embedder, unpack
from ..sources import documents as D
from ..storage import is_folder, save, written


def file_stream(spark: SparkSession, folder: str, name: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Rows of the Parquet files of a folder that match ``name``, as they arrive. If ``name`` is itself a folder, its
    files are the stream."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if is_folder(spark, f"{folder}/{name}"):
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def start(stream: DataFrame, write_batch, base: str, mode: str = "append", forever: bool = False) -> StreamingQuery:
    """Run a job; by default until all data available now is processed."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(write_batch).option("checkpointLocation", f"{base}/checkpoint")
    return (writer if forever else writer.trigger(availableNow=True)).start()


def into(folder: str):
    """Batch writer: one folder per batch, overwritten when a batch is replayed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id:09d}")

    return write


def newest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Latest state per key of an update-mode job."""
    rows = spark.read.parquet(folder)
    return latest_per_key(rows, keys, ["batch"]).drop("batch")


# --- jobs --------------------------------------------------------------------------------
STATES = ("pending", "processing", "ready", "failed")


def ingest(docs: DataFrame, base: str, label: str = "CV", embed: Embedder | None = None, keep: tuple = (), order: tuple = (), **kw) -> StreamingQuery:
    """Status rows and index chunks of documents (keep..., doc_key, text, order...) as they arrive.

    A key that stands several times in one batch counts once: the greatest by the ``order`` columns, then by hash of
    its text. Every batch is chunked once: parents are stored, children with tokens and vectors are cut from the stored
    parents, and the status counts the stored children. The log says of every document of a batch that it is pending,
    processing, and ready or failed; each state is a folder of the batch, so a replayed batch writes it again.
    """
    embedder = embed or hashed_embedder()

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def stored(rows: DataFrame, name: str) -> DataFrame:
            return save(rows, f"{base}/{name}/batch={batch_id:09d}", mode="overwrite")

        def logged(rows: DataFrame, state: str) -> None:
            marked = rows.select("doc_key", F.lit(STATES.index(state)).alias("step"), F.lit(state).alias("state"))
            marked.write.mode("overwrite").parquet(f"{base}/log/batch={batch_id:09d}/at={state}")

        once = latest_per_key(batch.withColumn("_code", F.xxhash64("text")), ["doc_key"], [*order, "_code"]).drop("_code")
        loaded = stored(D.load_texts(once).drop(*order), "loaded")
        logged(loaded, "pending")
        good = loaded.filter("ingest_error is null")
        logged(good, "processing")
        parents = stored(C.parent_chunks(good, keep=keep), "parents")
        children = stored(enrich(C.child_chunks(parents, label, keep=keep), embedder, keep, packed=True), "children")
        status = stored(D.ingest_status(loaded, chunks=children), "status")
        for state in ("ready", "failed"):
            logged(status.filter(F.col("ingest_status") == state), state)

    return start(docs, write, base, **kw)


def ingest_log(spark: SparkSession, base: str) -> DataFrame:
    """(doc_key, batch, step, state): every state of every document, in order of batch and step."""
    schema = "doc_key string, step int, state string, batch int, at string"
    return spark.read.schema(schema).parquet(f"{base}/log").drop("at")


def ingest_states(spark: SparkSession, base: str) -> DataFrame:
    """(doc_key, state): where each document stands, also while a batch is running."""
    return ingest_log(spark, base).groupBy("doc_key").agg(F.max_by("state", F.struct("batch", "step")).alias("state"))


def ingested(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status, parents, children) as they stand: a document that arrived again replaces its earlier rows."""
    rows = spark.read.parquet(f"{base}/status")
    batches = [r[0] for r in rows.select("batch").distinct().collect()]  # those that are done
    # Few documents arrive again: what they replaced is stored, so that its true size is known when the join is planned, and
    # the texts and vectors of all others stay where they are.
    last = rows.groupBy("doc_key").agg(F.max("batch").alias("last"))
    replaced = written(rows.select("doc_key", "batch").join(last, "doc_key").filter("batch < last").select("doc_key", "batch").distinct(), "replaced")

    def standing(name: str) -> DataFrame:
        held = spark.read.parquet(f"{base}/{name}").filter(F.col("batch").isin(batches) & F.col("doc_key").isNotNull())
        return held.join(replaced, ["doc_key", "batch"], "left_anti").drop("batch")

    return standing("status"), standing("parents"), standing("children").withColumn("vec", unpack("vec"))


def request_rates(requests: DataFrame, base: str, window: str, ceiling: int, lateness: str = "1 hour", **kw) -> StreamingQuery:
    """Requests (caller, ts) per fixed window with a flag over the ceiling; later rows than
    ``lateness`` are dropped and their windows' state released."""
    counted = request_windows(requests.withWatermark("ts", lateness), window, ceiling)
    return start(counted, into(f"{base}/rates"), base, "update", **kw)


def request_tiers(
    requests: DataFrame, base: str, tiers: dict[str, tuple[int, int]] = K.RATE_TIERS, lateness: str = "1 hour", **kw
) -> StreamingQuery:
    """Requests (caller, tier, ts) in the fixed window of their tier, flagged over its ceiling."""
    return start(tier_windows(requests.withWatermark("ts", lateness), tiers), into(f"{base}/tiers"), base, "update", **kw)


def spend(calls: DataFrame, base: str, **kw) -> StreamingQuery:
    """Spend per installation and hour of calls (installation, created_at, cost_usd), kept up to date.

    ``telemetry.first_breaches`` reads it with ``newest`` and places the ceiling: the answer is the same for any
    batching, and late calls count. State is one row per installation and hour.
    """
    return start(spend_hours(calls), into(f"{base}/spend"), base, "update", **kw)


def session_status(documents: DataFrame, base: str, **kw) -> StreamingQuery:
    """Status of every session (session_id, kind, ingest_status) as its documents become ready."""
    return start(D.session_readiness(documents), into(f"{base}/sessions"), base, "update", **kw)
