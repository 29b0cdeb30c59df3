"""Building the chunk store: features hashed once, tokens cut once, stored counts added up, postings of asked words."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from gapmatch.functions import fixed as K
from gapmatch.functions import text as T
from gapmatch.operators import bm25, vectors
from gapmatch.operators import chunking as C
from gapmatch.operators.chunk_store import ChunkStore, chunks_of
from gapmatch.operators.index import chunked, enrich
from gapmatch.operators.vectors import hashed_embedder
from gapmatch.storage import settings


def _documents(spark):
    rows = [(f"s{n % 3}" if n else None, f"d{n}", f"Profile\n\nthe engineer number{n} writes pipelines/{n}a in Python nαύ{n % 2} " * (n % 9 + 1)) for n in range(24)]
    return spark.createDataFrame(rows, "scope string, doc_key string, text string").withColumn("pages", C.single_page(F.col("text")))


def _plain_vector(tokens, dim):
    def bucket(feature):
        digest = hashlib.md5(feature.encode()).digest()
        return int.from_bytes(digest[:4], "big") % dim, 1.0 if digest[4] & 1 else -1.0

    out = [0.0] * dim
    found = [("w:" + t, 1.0) for t in tokens] + [(f"b:{a}_{b}", 0.6) for a, b in zip(tokens, tokens[1:])]
    found += [("g:" + t[i : i + 4], 0.35) for t in tokens if len(t) >= 5 for i in range(len(t) - 3)]
    for feature, weight in found:
        cell, sign = bucket(feature)
        out[cell] += sign * weight
    norm = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / norm for x in out]


def test_features_are_hashed_once_and_vectors_stay(monkeypatch):
    rows = [["alpha", "beta", "alphabet"], None, [], ["beta", "alpha", "nαύ"], ["alpha", "beta"]]
    known = vectors.Features(64, "md5")
    hashed, count = known.hashed, []
    known.hashed = lambda features: count.extend(features) or hashed(features)
    tokens = pa.array(rows, pa.list_(pa.string()))
    first = vectors.unit_rows(tokens, known)
    before = len(count)
    assert np.array_equal(first, vectors.unit_rows(tokens, known)) and len(count) == before
    np.testing.assert_allclose(first, [_plain_vector(r or [], 64) for r in rows], atol=1e-6)
    for name in ("WORDS", "GRAMS", "PAIRS"):
        monkeypatch.setattr(vectors, name, 1)  # forgets all the time
    monkeypatch.setattr(vectors, "SLICE", 1)
    assert np.array_equal(first, vectors.unit_rows(tokens, vectors.Features(64, "md5")))


def test_tokens_are_those_of_the_pattern(spark):
    rows = [("a/b c/d/e f/ /g C++ .NET x", ), ("A.b/-/c a//b ab/cd/", ), ("Αθήνα/X9 école Cafés", ), ("", ), (None, )]
    df = spark.createDataFrame(rows, "t string")
    plain = F.transform(T.find_all(F.col("t"), K.WORD), T.fold)
    assert df.filter(~plain.eqNullSafe(T.tokens(F.col("t")))).count() == 0


def test_vectors_from_tokens_equal_those_from_texts(spark):
    parents = C.parent_chunks(_documents(spark), keep=("scope",))
    children = C.child_chunks(parents, "CV", keep=("scope",))
    embed = hashed_embedder()
    by_text = enrich(children, lambda text: embed(text))
    by_tokens = enrich(children, embed)
    assert by_text.count() > 24
    assert by_text.exceptAll(by_tokens).count() == 0 and by_tokens.exceptAll(by_text).count() == 0


def test_pooled_statistics_equal_counted_ones(spark, tmp_path):
    held = ChunkStore(spark, str(tmp_path / "store")).create(chunks_of(_documents(spark), "cv"))
    one = held.pooled("cv")
    counted = bm25.lexicon(held.index("cv").under(F.lit("all")).children)

    def rows(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())

    assert rows(one.lexicon.stats) == rows(counted.stats)
    assert rows(one.lexicon.terms) == rows(counted.terms)
    assert one.children.select("scope").distinct().collect() == [("all",)]


def test_no_vector_is_shuffled_when_a_store_is_made(spark, tmp_path, monkeypatch):
    plans, write = [], ChunkStore._write

    def noted(self, df, name, at=None):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name, at)

    monkeypatch.setattr(ChunkStore, "_write", noted)
    held = ChunkStore(spark, str(tmp_path / "store")).create(chunks_of(_documents(spark), "cv"))
    assert all("Exchange" not in plan for name, plan in plans if name == "children")
    files = held.table("children").select("bucket", F.input_file_name().alias("f")).distinct()
    assert files.count() <= 3 * spark.sparkContext.defaultParallelism


def test_scores_of_a_block_are_those_of_the_formula():
    items = pd.DataFrame({"item_id": list("abc"), "toks": [["x", "y", "x"], ["z"], ["y", "q", "y", "x"]]})
    queries = pd.DataFrame({"query_id": ["1", "2", "3"], "terms": [["x", "y"], ["none"], ["z"]], "weights": [[1.5, 0.5], [2.0], [0.25]], "avg_len": [2.5] * 3})

    def plain(toks, terms, weights):
        damp = K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * len(toks) / 2.5)
        return sum(w * toks.count(t) * (K.BM25_K1 + 1) / (toks.count(t) + damp) for t, w in zip(terms, weights))

    wanted = [[plain(t, q.terms, q.weights) for t in items["toks"]] for q in queries.itertuples()]
    np.testing.assert_allclose(bm25.score_block(items, queries), wanted, atol=1e-12)


def _of_scopes(spark, folder, scopes=12):
    """Documents of several scopes in a file with a single row group."""
    rows = [(f"s{n % scopes}", f"d{n}", f"Profile\n\nWork on pipelines number {n} " * 12) for n in range(4 * scopes)]
    spark.createDataFrame(rows, "scope string, doc_key string, text string").coalesce(1).write.parquet(folder)
    return spark.read.parquet(folder).withColumn("pages", C.single_page(F.col("text")))


def test_documents_of_one_row_group_are_cut_in_many_tasks(spark, tmp_path):
    docs = _of_scopes(spark, str(tmp_path / "docs"))
    with settings(spark, spark_sql_adaptive_coalescePartitions_enabled="false"):
        for strategy in ("parent_child", "fixed"):
            parents, _ = chunked(docs, strategy)
            assert parents.select(F.spark_partition_id()).distinct().count() > 1


def test_no_task_makes_children_of_two_files_of_parents(spark, tmp_path):
    docs, root = _of_scopes(spark, str(tmp_path / "docs")), tmp_path / "store"
    with settings(spark, spark_sql_adaptive_coalescePartitions_enabled="false", spark_sql_shuffle_partitions="64"):
        made = chunks_of(docs, "cv")
    files = made.parents.select(F.input_file_name()).distinct().count()
    assert files > 4  # more than the cores, so that a task would take several
    ChunkStore(spark, str(root)).create(made)
    tasks = {p.name.split("-")[1] for p in (root / "children").rglob("part-*.parquet")}
    assert len(tasks) == files
