"""Searches over blocks against scores of every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapmatch.operators import bm25, cells, postings
from gapmatch.operators import topk


def rows_of(df):
    return sorted((r["scope"], r["query_id"], r["rank"], r["item_id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    weight = 1 / np.arange(1, 301)
    rows = []
    for scope, n in (("hot", 900), ("cold", 40), ("lonely", 1)):
        for k in range(n):
            toks = rng.choice(words, rng.integers(0, 40), p=weight / weight.sum()).tolist()
            rows.append((scope, f"{scope}{k:04d}", toks if k % 50 else []))
    rows += [("hot", f"copy{k:03d}", ["w250", "w251"]) for k in range(60)]  # ties
    rows += [("hot", "special", ["zz1", "w0"])]
    return spark.createDataFrame(rows, "scope string, chunk_id string, toks array<string>").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [("hot", "q1", "w1 w2 w3"), ("hot", "q2", "w250 w251"), ("hot", "q3", "nothing here"), ("hot", "q4", "w0 " * 5 + "w299"), ("cold", "q1", "w5 w80 w200"),
            ("lonely", "q1", "w1 w0"), ("nowhere", "q1", "w1"), ("hot", "q5", ""), ("cold", "q6", " ".join(f"w{k}" for k in range(300)))]
    return spark.createDataFrame(rows, "scope string, query_id string, text string")


@pytest.mark.parametrize("block", [64, 5000])
def test_postings_equal_all_pairs(chunks, queries, block):
    want = rows_of(bm25.bm25_top_k(chunks, queries, 15))
    found, pairs = postings.bm25_search(postings.build_postings(chunks, block=block), queries, 15)
    assert rows_of(found) == want and len(want) > 60
    pairs.count()


def test_postings_read_only_asked_terms_and_open_blocks(spark, chunks):
    held = postings.build_postings(chunks, block=64)
    asked = spark.createDataFrame([("hot", "q", "zz1 w0")], "scope string, query_id string, text string")
    found, pairs = postings.bm25_search(held, asked, 1)
    assert rows_of(found) == rows_of(bm25.bm25_top_k(chunks, asked, 1)) and len(rows_of(found)) == 1
    # Every block has the common word, but none of the others can reach the score of the rare one.
    assert held.rows.filter("scope = 'hot' and term = 'w0'").select("block").distinct().count() > 5 and pairs.count() == 1
    parts = {r[0] for r in asked.select(F.explode(F.split("text", " ")).alias("t")).select(postings.term_part(F.col("t"))).collect()}
    read = held.rows.filter(F.col("part").isin(list(parts)))
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert files and all(any(f"/part={p}/" in f for p in parts) for f in files)


def test_bounds_hold_under_another_mean_length(spark, chunks, queries):
    """Bounds are kept as frequency and length, so postings stay right when the statistics move."""
    held = postings.build_postings(chunks, block=64)
    more = chunks.union(spark.createDataFrame([("hot", f"new{k}", ["w9"] * 200) for k in range(30)], chunks.schema))
    moved = bm25.lexicon(more)
    found, _ = postings.bm25_search(postings.Postings(held.rows, moved), queries, 15)
    assert rows_of(found) == rows_of(bm25.bm25_top_k(chunks, queries, 15, moved))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    rows = [("hot", f"i{n:04d}", (centres[n % 12] + 0.05 * rng.normal(size=8)).tolist()) for n in range(1200)]
    rows += [("hot", f"same{n}", [1.0] * 8) for n in range(40)] + [("hot", "zero", [0.0] * 8)]
    rows += [("cold", f"c{n}", rng.normal(size=8).tolist()) for n in range(9)] + [("lonely", "l", [0.0, 1.0] * 4)]
    return spark.createDataFrame(rows, "scope string, item_id string, vec array<double>").repartition(4)


@pytest.mark.parametrize("most, block", [(256, 4096), (5, 50), (1, 30)])
def test_cells_equal_all_pairs(spark, vectors, most, block):
    rng = np.random.default_rng(9)
    asked = [(s, f"q{n}", rng.normal(size=8).tolist()) for s in ("hot", "cold", "lonely", "nowhere") for n in range(6)]
    asked += [("hot", "qs", [2.0] * 8), ("hot", "qz", [0.0] * 8)]
    queries = spark.createDataFrame(asked, "scope string, query_id string, vec array<double>")
    found, _ = cells.nearest(vectors, queries, 7, most, block)
    assert rows_of(found) == rows_of(topk.top_k(vectors, queries, topk.cosine, 7))


def test_far_cells_are_left_out(vectors):
    asked = vectors.filter("scope = 'hot' and item_id < 'i0100'").withColumnRenamed("item_id", "query_id")
    found, pairs = cells.nearest(vectors, asked, 5)
    assert rows_of(found) == rows_of(topk.top_k(vectors, asked, topk.cosine, 5))
    assert pairs.count() < 0.5 * 100 * 36  # 36 cells of 1241 vectors


def test_empty_sides(spark, vectors, chunks, queries):
    none = vectors.limit(0)
    assert cells.nearest(none, vectors.withColumnRenamed("item_id", "query_id").limit(3), 3)[0].collect() == []
    assert cells.nearest(vectors, none.withColumnRenamed("item_id", "query_id"), 3)[0].collect() == []
    assert postings.bm25_search(postings.build_postings(chunks), queries.limit(0))[0].collect() == []
    assert postings.bm25_search(postings.build_postings(chunks.limit(0)), queries)[0].collect() == []


def test_a_table_asked_of_itself_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [("all", str(k), [float(x) for x in rng.normal(size=4)]) for k in range(120)]
    vecs = spark.createDataFrame(rows, "scope string, item_id string, vec array<double>")
    asked = vecs.select("scope", F.col("item_id").alias("query_id"), "vec")
    plain = rows_of(topk.top_k(vecs, asked, topk.cosine, 3))
    assert rows_of(topk.top_k(vecs, asked, topk.cosine, 3, small=10)) == plain and len(plain) == 360
