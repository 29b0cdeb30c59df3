"""What stored tables, changes and searches take of the disk."""

import glob
import os
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gapmatch.operators import cells, chunk_store, chunking as C, topk, vectors
from gapmatch.operators.chunk_store import ChunkStore, chunks_of
from gapmatch.operators.postings import build_postings
from gapmatch.storage import work_dir, written
from gapmatch.streaming import jobs as J

CELLS = "pivots cells sizes parts blocks bounds centres known seed-pairs seed-scores open-pairs open-shelves".split()  # tables of a search
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def text(k, n=60):
    return " ".join(WORDS[(k * 7 + i * i) % len(WORDS)] + str((k + i) % 5) for i in range(n)) + f" only{k}"


def docs(spark, rows):
    return spark.createDataFrame(rows, "scope string, doc_key string, text string").withColumn("pages", C.single_page(F.col("text")))


def folders(spark):
    return set(os.listdir(work_dir(spark).removeprefix("file:")))


def codecs(path):
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/**/*.parquet", recursive=True)]
    return {m.row_group(g).column(c).compression for m in files for g in range(m.num_row_groups) for c in range(m.num_columns)}


def shuffled(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def test_written_tables_are_compressed_and_leave_no_shuffle_files(spark):
    before, old = folders(spark), shuffled(spark)
    df = written(spark.range(5000).withColumn("t", F.concat(F.lit("row "), "id")).repartition(7, "id"), "plain")
    (new,) = [n for n in folders(spark) - before if n.startswith("plain-")]
    assert codecs(f"{work_dir(spark)}/{new}") == {"ZSTD"}
    for _ in range(50):
        if not shuffled(spark) - old:
            break
        time.sleep(0.2)
    assert not shuffled(spark) - old and df.count() == 5000


def test_vectors_are_stored_as_whole_numbers():
    known = vectors.Features(384, "md5")
    rows = [text(k, 70).split() for k in range(40)] + [[], ["one"], ["again"] * 300]
    tokens = pa.array(rows, pa.list_(pa.string()))
    plain = vectors.unit_rows(tokens, known)
    stored = [code for sums in vectors._slices(tokens, known) for code in vectors._packed_sums(sums)]
    assert np.array_equal(vectors.stored_rows(stored), plain) and vectors.stored_rows(stored).dtype == np.float32
    assert stored[:42] == vectors._packed_rows(plain)[:42]
    assert {len(s) for s in stored} == {385, 770} and len(stored[42]) == 770


@pytest.mark.parametrize("dim", [6, 8])
def test_other_vectors_are_stored_as_they_are(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [rng.normal(size=dim).tolist(), [0.0] * dim, None, [1.0] * dim, (np.arange(dim) / 7).tolist(), [float("nan")] + [1.0] * (dim - 1), [1e30] * (dim - 1) + [1e-30]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, vec array<float>")
    back = df.select("k", vectors.unpack(vectors.pack("vec")).alias("vec"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_a_change_goes_part_by_part(spark, monkeypatch):
    rows = [(f"s{k % 9}", f"cv{k}", text(k)) for k in range(27)]
    new = chunks_of(docs(spark, rows), "cv")
    held = [ChunkStore(spark, f"{work_dir(spark)}/store-{uuid.uuid4().hex}", 8).create(new) for _ in range(2)]
    changed = docs(spark, [("s1", "cv1", "a short new text alpha0"), ("s2", "cv2", ""), ("s9", "cv99", text(99)), ("s4", "cv4", text(5))])
    late, parts, here = chunks_of(changed, "cv"), [], ChunkStore._change_here
    for store, least in zip(held, (1 << 30, 1)):
        monkeypatch.setattr(chunk_store, "STEP_BYTES", least)
        monkeypatch.setattr(ChunkStore, "_change_here", lambda self, *a: (parts.append(least), here(self, *a)))
        store.upsert(changed.withColumn("doc_kind", F.lit("cv")), late)
        store.purge(spark.createDataFrame([("s3",), ("s5",), ("s0",)], "scope string"))
    assert parts.count(1 << 30) == 2 and parts.count(1) > 3
    for name in ("parents", "terms", "scopes"):
        one, many = (sorted(map(str, s.table(name).collect())) for s in held)
        assert one == many and one
    one, many = (sorted(map(str, s.table("children").collect())) for s in held)
    assert one == many and codecs(f"{held[1].root}/children") == {"ZSTD"}


def test_chunks_leave_nothing_once_they_are_stored(spark):
    new = chunks_of(docs(spark, [("s1", "cv1", text(1))]), "cv")
    held = ChunkStore(spark, f"{work_dir(spark)}/store-{uuid.uuid4().hex}", 8).create(new)
    assert len(new.kept) == 1 and os.path.exists(new.kept[0].removeprefix("file:"))
    new.release()
    assert not os.path.exists(new.kept[0].removeprefix("file:")) and held.table("children").count() > 0


def test_pairs_of_vectors_and_blocks_are_no_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("all", str(k), [float(x) for x in rng.normal(size=16)]) for k in range(1500)] + [("two", str(k), [1.0] * 16) for k in range(5)]
    items = spark.createDataFrame(rows, "scope string, item_id string, vec array<float>").repartition(3)
    asked = items.withColumnRenamed("item_id", "query_id")
    want = sorted(map(str, topk.top_k(items, asked, topk.cosine, 4).collect()))
    for shelf in (1 << 22, 2000):
        monkeypatch.setattr(cells, "SHELF", shelf)
        before = folders(spark)
        found, pairs = cells.nearest(items, asked, 4)
        assert sorted(map(str, found.select("scope", "query_id", "item_id", "score", "rank").collect())) == want
        assert pairs.count() > 20 * 1500 and pairs.count() == pairs.distinct().count()
        for name in (n for n in folders(spark) - before if n.rsplit("-", 1)[0] in CELLS):
            held = sum(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{work_dir(spark)}/{name}/*.parquet"))
            assert held <= (4 if shelf > 2000 else 16) * 1505, name


def test_ids_that_repeat_are_asked_as_often(spark):
    rng = np.random.default_rng(4)
    rows = [("all", str(k % 25), [float(x) for x in rng.normal(size=4)]) for k in range(40)]
    items = spark.createDataFrame(rows, "scope string, item_id string, vec array<double>")
    asked = items.withColumnRenamed("item_id", "query_id")
    columns = ["scope", "query_id", "item_id", "score", "rank"]
    found, pairs = cells.nearest(items, asked, 5, most=1)
    want = topk.top_k(items, asked, topk.cosine, 5)
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, want.select(columns).collect())) and pairs.count() == 25


def test_streamed_vectors_are_stored_as_in_an_index_and_stay_where_they_are(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "out")
    for n, rows in enumerate([[(f"d{k}", text(k)) for k in range(6)] + [(None, text(9))], [("d1", text(11)), ("d2", "")]]):
        spark.createDataFrame(rows, "doc_key string, text string").coalesce(1).write.parquet(str(folder / f"n{n}"))
    stream = spark.readStream.schema("doc_key string, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    J.ingest(stream, base).awaitTermination()
    status, _, children = J.ingested(spark, base)
    assert spark.read.parquet(f"{base}/children").schema["vec"].dataType.simpleString() == "binary"
    assert {len(r.vec) for r in children.collect()} == {384} and {r.doc_key for r in children.collect()} == {"d0", "d1", "d3", "d4", "d5"}
    assert sorted(r.doc_key for r in status.collect()) == [f"d{k}" for k in range(6)]
    assert "Exchange hashpartitioning" not in children._jdf.queryExecution().executedPlan().toString()


def test_postings_are_compressed(spark):
    chunks = spark.createDataFrame([("s", f"c{k}", text(k).split()) for k in range(20)], "scope string, chunk_id string, toks array<string>")
    before = folders(spark)
    build_postings(chunks)
    (path,) = [n for n in folders(spark) - before if n.startswith("postings-")]
    assert codecs(f"{work_dir(spark)}/{path}") == {"ZSTD"}
