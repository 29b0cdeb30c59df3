import math
import random

import numpy as np
import pytest
from helpers import chunks, value
from pyspark.sql import functions as F

from gapmatch.operators import bm25 as B
from gapmatch.operators import retrieval as R
from gapmatch.operators import topk
from gapmatch.operators.vectors import hashed_embedder


def rows_of(df):
    return sorted((r.scope, r.query_id, r["rank"], r.item_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture
def vectors(spark):
    """A hot scope with most of the rows, copies of one vector, and a scope nobody asks."""
    rng = np.random.default_rng(3)
    items = [("hot", f"i{n:04d}", [float(x) for x in (np.ones(4) if n % 3 == 0 else rng.normal(size=4))]) for n in range(600)]
    items += [("cold", f"c{n}", [float(x) for x in rng.normal(size=4)]) for n in range(5)] + [("lonely", "l0", [1.0, 0.0, 0.0, 0.0])]
    queries = [("hot", f"q{n}", [float(x) for x in rng.normal(size=4)]) for n in range(7)] + [("hot", "qc", [1.0] * 4), ("cold", "q0", [1.0, 2.0, 0.0, 0.0])]
    schema = "scope string, {0} string, vec array<double>"
    return (items, queries, spark.createDataFrame(items, schema.format("item_id")).repartition(5), spark.createDataFrame(queries, schema.format("query_id")))


def test_both_plans_equal_brute_force(spark, vectors, monkeypatch):
    items, queries, idf, qdf = vectors
    want = []
    for scope, qid, q in queries:
        scored = sorted((-round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 9), i) for s, i, v in items if s == scope)[:6]
        want += [(scope, qid, r + 1, i, round(-s, 6)) for r, (s, i) in enumerate(scored)]
    monkeypatch.setattr(topk, "ITEM_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    in_place = topk.top_k(idf, qdf, topk.cosine, 6)
    in_blocks = topk.top_k(idf, qdf, topk.cosine, 6, small=2)
    assert rows_of(in_place) == sorted(want)
    assert rows_of(in_blocks) == sorted(want)


def test_result_does_not_depend_on_partitions(spark, vectors):
    _, _, idf, qdf = vectors
    a = rows_of(topk.top_k(idf.repartition(1), qdf, topk.cosine, 3))
    assert a == rows_of(topk.top_k(idf.repartition(17), qdf, topk.cosine, 3))


def okapi(docs, query):
    """BM25 from its published formula."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else floor for t, v in raw.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in query) for d in docs]


def test_bm25_equals_the_formula(spark):
    rng = random.Random(1)
    vocab = ["kafka", "redis", "spark", "the", "of", "queue", "java"]
    docs = [[rng.choice(vocab) for _ in range(rng.randint(1, 12))] for _ in range(30)]
    query = ["the", "kafka", "kafka", "zzz", "spark"]
    table = chunks(spark, [("s", f"c{i:02d}", " ".join(d)) for i, d in enumerate(docs)] + [("other", "x", "kafka kafka")])
    asked = spark.createDataFrame([("s", "q", " ".join(query))], "scope string, query_id string, text string")
    got = B.bm25_top_k(table, asked, 10).orderBy("rank").collect()
    scores = okapi(docs, query)
    want = [i for s, i in sorted((-round(s, 9), i) for i, s in enumerate(scores) if s > 0)][:10]
    assert [r.item_id for r in got] == [f"c{i:02d}" for i in want]
    assert all(abs(r.score - scores[int(r.item_id[1:])]) < 1e-8 for r in got)


def test_vectors_are_unit_length_and_lexical(spark):
    embed = hashed_embedder(256)
    texts = ["Kafka topic design", "Designed every Kafka topic of the shop", "baked bread for the party", "12345"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", embed(F.col("t")).alias("v"))
    v = {r.i: np.array(r.v) for r in df.collect()}
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-5 and v[0] @ v[1] > v[0] @ v[2] and not v[3].any()


def test_variants(spark):
    got = value(spark, R.query_variants, "Strong experience with Kubernetes and cloud")
    assert got == ["Strong experience with Kubernetes and cloud", "kubernetes cloud", "kubernetes cloud k8s container orchestration aws azure"]
    assert value(spark, R.query_variants, "kafka") == ["kafka"]


def ranking(spark, rows):
    return spark.createDataFrame(rows, "scope string, query_id string, ranking string, chunk_id string, score double, rank int")


def test_fusion_rewards_agreement_and_skips_a_single_ranking(spark):
    two = ranking(spark, [("s", "q", "0", "a", .9, 1), ("s", "q", "0", "b", .8, 2), ("s", "q", "bm25", "c", 7., 1), ("s", "q", "bm25", "b", 6., 2)])
    got = R.fuse(two).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and abs(got[0].score - 2 / 62) < 1e-9
    one = ranking(spark, [("s", "q", "bm25", "z", 7., 1), ("s", "q", "bm25", "a", 6., 2)])
    assert [(r.chunk_id, r.score) for r in R.fuse(one).orderBy("rank").collect()] == [("z", 0.0), ("a", 0.0)]


def test_small_to_big_floor_and_scope(spark):
    ranked = spark.createDataFrame(
        [("s", "q", "p1-c0", .5, 1), ("s", "q", "p1-c1", .4, 2), ("s", "q", "p2-c0", .01, 3), ("t", "q", "p1-c0", .001, 1), ("t", "q", "p2-c0", .0005, 2)],
        "scope string, query_id string, chunk_id string, score double, rank int")
    kids = spark.createDataFrame([(s, f"{p}-c{c}", p, "X", 1) for s in "st" for p in ("p1", "p2") for c in (0, 1)],
                                 "scope string, chunk_id string, parent_id string, section string, page int")
    parents = spark.createDataFrame([(s, p, f"{s}{p}") for s in "st" for p in ("p1", "p2")], "scope string, parent_id string, text string")
    got = sorted((r.scope, r["rank"], r.chunk_id, r.text) for r in R.passages(ranked, kids, parents).collect())
    assert got == [("s", 1, "p1-c0", "sp1"), ("t", 1, "p1-c0", "tp1")]


def test_rerank_prefers_coverage(spark):
    table = chunks(spark, [("s", "a", "bread and butter"), ("s", "b", "Kafka with Redis")])
    asked = spark.createDataFrame([("s", "q", "Kafka Redis")], "scope string, query_id string, text string")
    cand = spark.createDataFrame([("s", "q", "a", .9, 1), ("s", "q", "b", .1, 2)], "scope string, query_id string, chunk_id string, score double, rank int")
    assert [r.chunk_id for r in R.coverage_rerank(cand, table, asked, 5).orderBy("rank").collect()] == ["b", "a"]
    assert [r.chunk_id for r in R.keep_order(cand, table, asked, 1).collect()] == ["a"]
