"""Guards, sections and chunks over documents and over conversations read as paged documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators.vectors import unpack
from ..sources import documents as D
from .tables import documents, index, kinds, spread, table


def ingest_status(spark, sf_dir):
    return D.ingest_status(D.load_texts(spread(documents(spark, sf_dir).drop("pages", "scope"))))


def _turn_pages(spark, sf_dir):
    """Conversations as paged documents: one page per turn."""
    return spread(table(spark, sf_dir, "conversations")).select(
        "conv_id", (F.col("turn") + 1).alias("number"), "text"
    )


def paged_guard(spark, sf_dir):
    return D.page_guard(_turn_pages(spark, sf_dir), "conv_id").withColumn(
        "ingest_error", F.coalesce("ingest_error", F.lit(""))
    )


def _paged(spark, sf_dir):
    pages = _turn_pages(spark, sf_dir).withColumn(
        "doc_key", F.concat(F.lit("jd"), "conv_id")
    )
    return D.load_pages(pages, "doc_key")


def paged_sections(spark, sf_dir):
    cut = _paged(spark, sf_dir).select("doc_key", F.posexplode(C.sections(F.col("pages"))).alias("s_idx", "s"))
    return cut.select(
        "doc_key", "s_idx", F.col("s.section").alias("section"), F.col("s.page").alias("page"),
        F.md5("s.body").alias("body_md5"),
    )


def paged_fixed_chunks(spark, sf_dir):
    return C.fixed_chunks(_paged(spark, sf_dir)).select(
        "doc_key", "chunk_id", "page", F.md5("text").alias("text_md5")
    )


def section_headings(spark, sf_dir):
    return C.heading_lines(spread(documents(spark, sf_dir)))


def sections(spark, sf_dir):
    cut = spread(documents(spark, sf_dir)).select(
        "doc_key", F.posexplode(C.sections(F.col("pages"))).alias("s_idx", "s")
    )
    return cut.select(
        "doc_key", "s_idx", F.col("s.section").alias("section"), F.col("s.page").alias("page"),
        F.length("s.body").alias("n_chars"), F.md5("s.body").alias("body_md5"),
    )


def parent_child_chunks(spark, sf_dir):
    return index(spark, sf_dir).children.select(
        "scope", "doc_key", "parent_id", "chunk_id", "section", "page", F.md5("text").alias("text_md5")
    )


def fixed_chunks(spark, sf_dir):
    return index(spark, sf_dir, "fixed").children.select(
        "scope", "doc_key", "chunk_id", "page", F.md5("text").alias("text_md5")
    )


def hash_vectors(spark, sf_dir):
    """Stored vectors in sparse long form."""
    wide = index(spark, sf_dir).children.select("chunk_id", F.posexplode(unpack("vec")).alias("dim", "w"))
    return wide.filter("abs(w) > 1e-6").groupBy("chunk_id").agg(
        F.count("*").alias("n_dims"), F.sum("dim").cast("long").alias("sum_dim"),
        F.round(F.sum(F.col("w").cast("double") * (F.col("dim") + 1)), 4).alias("check"),
    )


def documents_ready(spark, sf_dir):
    """Sessions whose candidate and posting documents are both ready; source = session."""
    loaded = D.load_texts(spread(documents(spark, sf_dir).drop("pages")))
    return D.session_readiness(kinds(loaded.withColumnRenamed("scope", "session_id")))


QUERIES = {
    f.__name__: f
    for f in (
        ingest_status, paged_guard, paged_sections, paged_fixed_chunks, section_headings, sections,
        parent_child_chunks, fixed_chunks, hash_vectors, documents_ready,
    )
}
