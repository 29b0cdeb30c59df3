"""The chunk index as a store that lives on: two kinds of documents, pruned by scope, changed in place.

Parents, children and statistics are Parquet tables partitioned by the kind of document and a bucket of the scope. A
question names its scopes, so it reads only their buckets (partition filters); an upsert or a purge rewrites only the
buckets it touches, once: they are written beside the store and then take the place of the old ones. Term statistics are not counted anew: the chunks that go and come add
signed counts to the stored ones.

A change takes a part of the touched buckets after the other, so what is written beside the store is a part of it.

A document is replaced whole: its earlier chunks go even if its new text gives none, so text shifts leave nothing
stale. Repeating a finished change changes nothing. One that failed midway is repeated with ``recount=True``, which
counts the touched buckets from their chunks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as K
from ..storage import held_bytes, move, new_path, remove, save, settings, written
from . import bm25
from . import chunking as C
from .index import LABELS, Index, chunked, enrich
from .vectors import Embedder, hashed_embedder

BUCKETS = 64
PART = "16m"  # parents that become children in one task
ALONE = "128m"  # what opening a file counts for: no task reads two files of parents, which lie in different buckets
STEPS, STEP_BYTES = 4, 64 << 20  # parts of a change at most, and what a part holds at least
OPEN_FILES = "4"  # buckets that a task writes side by side; with more it sorts
PLACE = ["doc_kind", "bucket"]
KEYS = ["doc_kind", "scope", "doc_key"]
_PLACED = ", doc_kind string, bucket int"
SCHEMAS = {
    "parents": "scope string, doc_key string, parent_id string, section string, page int, text string" + _PLACED,
    "children": "scope string, doc_key string, parent_id string, chunk_id string, section string, page int, text string, "
                "toks array<string>, vec binary" + _PLACED,
    "terms": "scope string, term string, df bigint" + _PLACED,
    "scopes": "scope string, n bigint, length bigint, floor double" + _PLACED,
}


def scope_bucket(scope: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(scope), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Chunks:
    """Parents and children of documents, with their kind; not yet stored."""

    parents: DataFrame
    children: DataFrame
    kept: tuple[str, ...] = ()  # folders that the parents lie in

    def union(self, other: Chunks) -> Chunks:
        return Chunks(self.parents.unionByName(other.parents), self.children.unionByName(other.children), self.kept + other.kept)

    def release(self) -> None:
        """The parents' folders go, once a store holds the chunks."""
        for path in self.kept:
            remove(self.parents.sparkSession, path)


def chunks_of(docs: DataFrame, kind: str, embed: Embedder | None = None) -> Chunks:
    """Chunks of documents (scope, doc_key, pages) of one kind; the parents are stored so that they are cut once.

    They are stored by bucket, as texts, in small parts: children are cut and embedded where their parents lie, so no
    vector is shuffled. Documents are cut in as small parts: a bucket is split between what different tasks cut, so one
    that holds most texts takes many.
    """
    parents, _ = chunked(docs, label=LABELS[kind])
    placed = parents.withColumn("bucket", scope_bucket(F.col("scope")))
    path = new_path(docs.sparkSession, "parents")
    with settings(docs.sparkSession, spark_sql_adaptive_advisoryPartitionSizeInBytes=PART):
        parents = save(placed.hint("rebalance", "bucket"), path).drop("bucket")
    children = enrich(C.child_chunks(parents, LABELS[kind], keep=("scope",)), embed or hashed_embedder(), packed=True)
    return Chunks(*(df.withColumn("doc_kind", F.lit(kind)) for df in (parents, children)), (path,))


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- reading ---------------------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def buckets_of(self, scopes: DataFrame) -> list[int]:
        """Buckets of the scopes in a table: at most as many as the store has."""
        return sorted(r[0] for r in scopes.select(scope_bucket(F.col("scope"), self.buckets)).distinct().collect())

    def index(self, kind: str, asked: DataFrame | None = None) -> Index:
        """The index of one kind; ``asked`` (scope, ...) limits it to the buckets of its scopes."""
        here = F.col("doc_kind") == kind
        if asked is not None:
            here = here & F.col("bucket").isin(self.buckets_of(asked))
        parents, children, terms, scopes = (self.table(n).filter(here) for n in ("parents", "children", "terms", "scopes"))
        return Index(parents.drop(*PLACE), children.drop(*PLACE), lexicon(scopes, terms))

    def pooled(self, kind: str, scope: str = "all") -> Index:
        """The index of one kind with all scopes as one; the terms are the stored counts added up, not counted anew. Sizes
        come from the chunks, as the stored ones leave out chunks without a scope."""
        one, counts = self.index(kind).under(F.lit(scope)), self.table("terms").filter(F.col("doc_kind") == kind)
        stats = written(bm25.scope_stats(bm25.tokenised(one.children)), "scope_stats")
        df = written(counts.groupBy(F.lit(scope).alias("scope"), "term").agg(F.sum("df").alias("df")), "term_counts")
        return Index(one.parents, one.children, bm25.Lexicon(stats, written(bm25.weighed(df, stats), "term_stats")))

    # --- writing ---------------------------------------------------------------------------
    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", scope_bucket(F.col("scope"), self.buckets))

    def _write(self, df: DataFrame, name: str, at: str | None = None) -> DataFrame:
        """Store a table, in ``at`` or in the store itself, and read it back."""
        types = T.StructType.fromDDL(SCHEMAS[name])
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in types])
        path = f"{at or self.root}/{name}"
        # Parents and children lie by bucket already. Counts are rebalanced by place: few files a bucket, and a bucket with
        # most of the rows is split over tasks.
        if name in ("terms", "scopes"):
            df = df.hint("rebalance", *PLACE)
        # A task that reads files of many buckets has to sort its children, vectors and all, before it writes them.
        apart = {} if name in ("terms", "scopes") else {"spark_sql_files_openCostInBytes": ALONE}
        with settings(self.spark, spark_sql_maxConcurrentOutputFileWriters=OPEN_FILES, **apart):
            return save(df, path, *PLACE, mode="overwrite")

    def create(self, new: Chunks) -> ChunkStore:
        """The first content."""
        self._write(self._placed(new.parents), "parents")
        self._write(self._placed(new.children), "children")
        self._write(term_counts(self.table("children"), 1), "terms")
        self._write(with_floor(scope_sizes(self.table("children"), 1), self.table("terms")), "scopes")
        return self

    def upsert(self, docs: DataFrame, new: Chunks, recount: bool = False) -> None:
        """``docs`` (doc_kind, scope, doc_key) now have the chunks ``new`` and no others."""
        self._change(docs.select(*KEYS).union(new.children.select(*KEYS)).distinct(), new, recount)

    def purge(self, tombstones: DataFrame, recount: bool = False) -> None:
        """Documents (doc_kind, scope, doc_key) go, or whole sessions (scope), with what they added to the statistics."""
        if "doc_key" in tombstones.columns:
            gone = tombstones.select(*KEYS).distinct()
        else:
            gone = tombstones.select("scope").distinct()
        self._change(gone, None, recount)

    def _change(self, gone: DataFrame, new: Chunks | None, recount: bool) -> None:
        path = new_path(self.spark, "gone")
        gone = save(gone, path)
        kinds = ["doc_kind"] if "doc_kind" in gone.columns else []
        touched = self._placed(gone).select(*kinds, "bucket").distinct().collect()  # at most two kinds of every bucket
        for buckets in self._steps(sorted({r["bucket"] for r in touched})):
            here = F.col("bucket").isin(buckets)
            if kinds:
                here = here & F.col("doc_kind").isin(sorted({r["doc_kind"] for r in touched}))
            self._change_here(here, gone, new, recount)
        remove(self.spark, path)

    def _steps(self, buckets: list[int]) -> list[list[int]]:
        """Buckets in parts that take about as much of the disk, few if they take little."""
        held = {b: sum(held_bytes(self.spark, f"{self.root}/{n}/doc_kind={k}/bucket={b}") for n in ("parents", "children") for k in LABELS) for b in buckets}
        most, steps, size = max(STEP_BYTES, sum(held.values()) / STEPS), [], 0
        for b in buckets:
            if not steps or size + held[b] > most:
                steps, size = [*steps, []], 0
            steps[-1].append(b)
            size += held[b]
        return steps

    def _change_here(self, here: Column, gone: DataFrame, new: Chunks | None, recount: bool) -> None:
        """The change in some of the buckets."""
        keys = gone.columns
        beside = f"{self.root}/change-{uuid.uuid4().hex}"
        tables = {}
        for name in ("parents", "children"):
            left = self.table(name).filter(here).join(gone, keys, "left_anti")
            every = left.unionByName(self._placed(getattr(new, name)).filter(here).select(*left.columns)) if new else left
            tables[name] = self._write(every, name, beside)
        if recount:
            terms = term_counts(tables["children"], 1)
            scopes = scope_sizes(tables["children"], 1)
        else:
            # What the chunks add that neither go nor come stays as it is stored.
            went = self.table("children").filter(here).join(gone, keys, "left_semi")
            came = tables["children"].join(gone, keys, "left_semi")
            terms = added(self.table("terms").filter(here), term_counts(went, -1), term_counts(came, 1))
            scopes = summed(self.table("scopes").filter(here).drop("floor"), scope_sizes(went, -1), scope_sizes(came, 1))
        tables["terms"] = self._write(terms, "terms", beside)
        tables["scopes"] = self._write(with_floor(scopes, tables["terms"]), "scopes", beside)
        for name, rows in tables.items():
            self._adopt(name, rows, here, beside)
        remove(self.spark, beside)

    def _adopt(self, name: str, rows: DataFrame, here: Column, beside: str) -> None:
        """The partitions written beside the store take the place of those they were made from; what has no rows any
        more goes."""
        def places(df: DataFrame) -> set:
            return {f"{name}/doc_kind={r['doc_kind']}/bucket={r['bucket']}" for r in df.select(*PLACE).distinct().collect()}  # at most two kinds of every bucket

        full, old = places(rows), places(self.table(name).filter(here))
        for place in sorted(full):
            move(self.spark, f"{beside}/{place}", f"{self.root}/{place}")
        for place in sorted(old - full):
            remove(self.spark, f"{self.root}/{place}")


# --- statistics ------------------------------------------------------------------------------
def term_counts(children: DataFrame, sign: int) -> DataFrame:
    """(scope, term, df, doc_kind, bucket): chunks with the term, counted ``sign`` each."""
    toks = bm25.or_blank(F.col("toks"))
    each = children.select("scope", F.explode(F.array_distinct(toks)).alias("term"), *PLACE)
    return each.groupBy("scope", "term", *PLACE).agg((F.count(F.lit(1)) * sign).alias("df")).select("scope", "term", "df", *PLACE)


def scope_sizes(children: DataFrame, sign: int) -> DataFrame:
    """(scope, n, length, doc_kind, bucket): chunks and their tokens, counted ``sign`` each."""
    size = F.size(bm25.or_blank(F.col("toks")))
    return children.groupBy("scope", *PLACE).agg(
        (F.count(F.lit(1)) * sign).alias("n"), (F.sum(size) * sign).alias("length")).select("scope", "n", "length", *PLACE)


def added(*counts: DataFrame) -> DataFrame:
    """Term counts added up; a term that no chunk has any more is gone."""
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    return every.groupBy("scope", "term", *PLACE).agg(F.sum("df").alias("df")).filter("df > 0").select("scope", "term", "df", *PLACE)


def summed(*sizes: DataFrame) -> DataFrame:
    every = sizes[0]
    for more in sizes[1:]:
        every = every.unionByName(more)
    return every.groupBy("scope", *PLACE).agg(F.sum("n").alias("n"), F.sum("length").alias("length")).filter("n > 0").select(
        "scope", "n", "length", *PLACE)


def with_floor(scopes: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds the weight of terms that more than half of a scope's chunks have: it depends on all terms of the scope."""
    raw = terms.join(scopes, ["scope", *PLACE]).withColumn("raw", bm25.raw_idf(F.col("n"), F.col("df")))
    floors = raw.groupBy("scope", *PLACE).agg((F.avg("raw") * K.BM25_EPSILON).alias("floor"))
    return scopes.join(floors, ["scope", *PLACE]).select("scope", "n", "length", "floor", *PLACE)


def lexicon(scopes: DataFrame, terms: DataFrame) -> bm25.Lexicon:
    """What the lexical ranking reads, from the stored counts of one kind."""
    stats = scopes.select("scope", "n", (F.col("length") / F.col("n")).alias("avg_len"), "floor")
    raw = bm25.raw_idf(F.col("n"), F.col("df"))
    weighed = terms.select("scope", "term", "df").join(stats, "scope").select(
        "scope", "term", "df", F.when(raw < 0, F.col("floor")).otherwise(raw).alias("idf"))
    return bm25.Lexicon(stats.drop("floor"), weighed)
