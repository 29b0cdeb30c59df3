"""What makes the chunk store cheap: features hashed side by side, vectors stored as one value, chunks never shuffled for a few candidates."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gapmatch.operators import bm25, topk, vectors
from gapmatch.operators import chunking as C
from gapmatch.operators import retrieval as R
from gapmatch.operators.chunk_store import ChunkStore, chunks_of
from gapmatch.operators.index import enrich
from gapmatch.storage import written


@pytest.fixture(scope="module")
def docs(spark):
    words = "engineer pipelines Python data nαύτης école C++ a/b reporting".split()
    rows = [(f"s{n % 3}" if n else None, f"d{n}", "Profile\n\n" + " ".join(words[(n * 5 + i * i) % 9] + str(i % 7) for i in range(40 + 15 * n)))
            for n in range(20)]
    return spark.createDataFrame(rows, "scope string, doc_key string, text string").withColumn("pages", C.single_page(F.col("text")))


@pytest.fixture(scope="module")
def held(spark, docs, tmp_path_factory):
    return ChunkStore(spark, str(tmp_path_factory.mktemp("cost") / "store")).create(chunks_of(docs, "cv"))


def test_heads_are_those_of_md5():
    draw = random.Random(5)
    texts = ["x" * n for n in range(150)] + ["ύ" * n for n in range(60)]
    texts += ["".join(draw.choices("abcé /+ύ😀", k=draw.randint(0, 70))) for _ in range(2 * vectors._HASHED)]
    for features in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), pa.array([], pa.string())):
        wanted = [hashlib.md5(f.encode()).digest()[:8] for f in features.to_pylist()]
        assert [bytes(row) for row in vectors._heads(features, "md5")] == wanted
    other = [hashlib.blake2b(f.encode(), digest_size=8).digest() for f in texts[:99]]
    assert [bytes(row) for row in vectors._heads(pa.array(texts[:99]), "blake2b")] == other


def test_vectors_are_stored_as_one_value_and_stay(spark, docs, held):
    stored = held.table("children")
    assert stored.schema["vec"].dataType.simpleString() == "binary"
    children = C.child_chunks(C.parent_chunks(docs, keep=("scope",)), "CV", keep=("scope",))
    plain = enrich(children, vectors.hashed_embedder()).select("chunk_id", "vec")
    unpacked = stored.select("chunk_id", vectors.unpack("vec").alias("vec"))
    assert plain.count() > 40
    assert plain.exceptAll(unpacked).count() == 0 and unpacked.exceptAll(plain).count() == 0
    own = enrich(children, lambda text: vectors.hashed_embedder()(text), packed=True).select("chunk_id", "vec")
    assert own.exceptAll(stored.select("chunk_id", "vec")).count() == 0


def test_cosine_takes_stored_vectors():
    rows = np.random.default_rng(3).normal(size=(5, 8)).astype(np.float32)
    rows[2] = 0
    items = pd.DataFrame({"vec": [r.tobytes() for r in rows]})
    listed = pd.DataFrame({"vec": [r.tolist() for r in rows]})
    assert np.array_equal(topk.cosine(items, listed), topk.cosine(listed, listed))


def test_joined_tokens_score_as_lists():
    items = pd.DataFrame({"item_id": list("abc"), "toks": [["x", "y", "x"], ["z"], ["y", "ύ", "y", "x"]]})
    queries = pd.DataFrame({"query_id": ["1", "2"], "terms": [["x", "y"], ["ύ"]], "weights": [[1.5, 0.5], [2.0]], "avg_len": [2.5] * 2})
    joined = items.assign(toks=items["toks"].map(" ".join))
    assert np.array_equal(bm25.score_block(joined, queries), bm25.score_block(items, queries))


def test_chunks_and_parents_stay_where_they_are(spark, held):
    asked = spark.createDataFrame([("s1", "q1", "engineer2 pipelines4"), ("s2", "q2", "école3 reporting1")], "scope string, query_id string, text string")
    asked = written(asked, "asked")  # a table of known size
    ix = held.index("cv", asked)
    found = R.retrieve(ix.children, ix.parents, asked, lexicon=ix.lexicon)
    ranked = R.rank_chunks(ix.children, asked, lexicon=ix.lexicon)
    assert {r["query_id"] for r in found.collect()} == {"q1", "q2"}
    for df in (found, ranked):
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_windows_do_not_depend_on_the_blocks(spark, monkeypatch):
    texts = [("ab cdefg 😀 ύx  " * 300,), ("x" * 3000,), ("word " * 102 + "\n" + " y" * 900,), ("short",), ("",)]
    df = spark.createDataFrame(texts, "text string")
    small = df.select(C.windows(F.col("text")).alias("w")).collect()
    monkeypatch.setattr(C, "_BLOCK", 4096)
    assert small == df.select(C.windows(F.col("text")).alias("w")).collect()
    assert C.K.CHILD_CHARS <= 512


def _packed(body, most):
    """Paragraphs packed one after the other, as plain Python."""
    if len(body) <= most:
        return [body]
    done, held = [], ""
    for part in body.split("\n\n"):
        if held and len(held) + len(part) > most:
            done.append(held.strip())
            held = part
        else:
            held = part if held == "" else held + "\n\n" + part
    return done + ([held.strip()] if held.strip() else [])


def test_folds_collect_no_texts(spark):
    bodies = ["\n\n\n\nabc", "a\n\n" * 1500, "   \n\n" * 900 + "x", "\n\n" * 3000, "ύ😀" * 900 + "\n\n" + "z " * 2500,
              "q" * 2100 + "\n\n" * 3 + "r" * 2300, "one two\n\n" * 700]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    made = df.select(C.parents(F.col("body")).alias("p"), C.windows(F.col("body")).alias("w"))
    assert [r["p"] for r in made.select("p").collect()] == [_packed(b, C.K.PARENT_MAX_CHARS) for b in bodies]
    # What a fold carries from step to step holds numbers only.
    states = [kind for kind in ("array<struct<start:int", "cast(array() as array<string>)") if kind in str(made._jdf.queryExecution().analyzed().toString())]
    assert states == []
