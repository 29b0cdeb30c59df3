"""Document sources, guards and the ingestion outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as T
from ..operators.chunking import child_count


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per pasted-text file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, content, upload_error) with size and magic-byte guards.

    The content column is only read from storage when a later step selects it. The reader passes over files without
    any bytes: they give no row.
    """
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(
        "path", F.col("length").alias("size_bytes"), "content",
        upload_error(F.col("length"), F.col("content")).alias("upload_error"),
    )


def upload_error(size: Column, content: Column) -> Column:
    return F.when(size > K.MAX_BYTES, "too_large").when(
        F.substring(content, 1, 4) != F.lit(b"%PDF"), "not_a_pdf"
    )


def fingerprint(text: Column) -> Column:
    """SHA-256 of the stored (stripped) text."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def text_error(text: Column) -> Column:
    """Why a stripped pasted text is refused; null when it is not. No text is a text without characters."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) > K.MAX_BYTES, "too_large").when(F.length(text) < K.TEXT_MIN_CHARS, "too_short")


def load_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add pages, sizes and ``ingest_error`` to pasted-text documents; failures stay as rows."""
    loaded = docs.withColumn(text, T.strip(F.col(text)))
    return loaded.select(
        "*",
        F.array(F.struct(F.lit(1).alias("number"), F.col(text).alias("text"))).alias("pages"),
        F.octet_length(text).cast("long").alias("size_bytes"),
        fingerprint(F.col(text)).alias("sha256"),
        F.length(text).cast("long").alias("char_count"),
        F.lit(1).cast("long").alias("page_count"),
        text_error(F.col(text)).alias("ingest_error"),
    )


def page_guard(pages: DataFrame, key: str) -> DataFrame:
    """(key, page_count, char_count, ingest_error) from page rows (key, number, text)."""
    cleaned = T.unspace(T.strip(F.col("text")))
    totals = pages.groupBy(key).agg(
        F.count("*").alias("page_count"), F.sum(F.length(cleaned)).cast("long").alias("char_count")
    )
    return totals.withColumn(
        "ingest_error",
        F.when(F.col("page_count") > K.MAX_PAGES, "too_many_pages").when(
            F.col("char_count") / F.col("page_count") < K.PAGE_MIN_CHARS, "looks_scanned"
        ),
    )


def load_pages(pages: DataFrame, key: str) -> DataFrame:
    """Documents that pass the page guards, with their ``pages`` array in order.

    The guard runs first on counts alone, so the arrays collected here hold at most the page limit.
    """
    ready = page_guard(pages, key).filter("ingest_error is null").select(key)
    cleaned = T.unspace(T.strip(F.col("text")))
    return (
        pages.join(ready, key)
        .groupBy(key)
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.col("number").cast("int").alias("number"), cleaned.alias("text")))
            ).alias("pages")
        )
    )


def ready_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pasted-text documents that pass the guards, under the columns they came with."""
    return docs.filter(text_error(T.strip(F.col(text))).isNull())


def ingest_status(loaded: DataFrame, key: str = "doc_key", chunks: DataFrame | None = None) -> DataFrame:
    """One row per document: counts, status and error. A failed document never fails the job.

    ``chunks`` are the stored chunks of the documents, if there are any yet; without them the count comes from
    the document's own row, so nothing is joined or shuffled.
    """
    failed = F.col("ingest_error").isNotNull()
    counted = child_count(F.col("pages"))
    if chunks is not None:
        loaded = loaded.join(chunks.groupBy(key).agg(F.count("*").alias("_chunks")), key, "left")
        counted = F.coalesce("_chunks", F.lit(0))
    return loaded.select(
        key, "sha256", "size_bytes", "page_count", "char_count",
        F.when(failed, F.lit(0)).otherwise(counted).cast("long").alias("chunk_count"),
        F.when(failed, "failed").otherwise("ready").alias("ingest_status"),
        F.coalesce("ingest_error", F.lit("")).alias("ingest_error"),
    )


def session_readiness(documents: DataFrame) -> DataFrame:
    """(session_id, ready, status): both kinds have to be ready before a match can run."""
    ready = F.col("ingest_status") == "ready"
    return documents.groupBy("session_id").agg(
        (F.max(ready & (F.col("kind") == "cv")) & F.max(ready & (F.col("kind") == "jd"))).alias("ready"),
        F.max(F.col("ingest_status") == "processing").alias("busy"),
    ).select(
        "session_id", "ready",
        F.when(F.col("ready"), "ready").when(F.col("busy"), "ingesting").otherwise("created").alias("status"),
    )
