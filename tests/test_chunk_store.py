"""The chunk store against one built at once, and what its reads touch."""

import uuid

import pytest
from pyspark.sql import functions as F

from gapmatch.operators import chunking as C
from gapmatch.operators import retrieval as R
from gapmatch.operators.chunk_store import Chunks, ChunkStore, chunks_of, scope_bucket
from gapmatch.storage import stamp, work_dir

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def text(k, n=60):
    return " ".join(WORDS[(k * 7 + i * i) % len(WORDS)] + str((k + i) % 5) for i in range(n)) + f" only{k}"


def docs(spark, rows):
    """rows: (scope, doc_key, text)."""
    df = spark.createDataFrame(rows, "scope string, doc_key string, text string")
    return df.withColumn("pages", C.single_page(F.col("text")))


def new_store(spark, *chunks, buckets=8):
    held = ChunkStore(spark, f"{work_dir(spark)}/store-{uuid.uuid4().hex}", buckets)
    whole = chunks[0]
    for more in chunks[1:]:
        whole = whole.union(more)
    return held.create(whole)


def state(held):
    found = {}
    for name, columns in (("parents", ["doc_kind", "scope", "parent_id", "text"]), ("children", ["doc_kind", "scope", "chunk_id", "text"]),
                          ("terms", ["doc_kind", "scope", "term", "df"]), ("scopes", ["doc_kind", "scope", "n", "length", "floor"])):
        rows = held.table(name).select(*columns, "bucket").collect()
        found[name] = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    return found


FIRST = [("s%d" % (k % 6), f"cv{k}", text(k)) for k in range(24)]


@pytest.fixture(scope="module")
def first(spark):
    return chunks_of(docs(spark, FIRST), "cv")


def test_upsert_equals_a_rebuild(spark, first):
    held = new_store(spark, first)
    changed = [("s1", "cv1", "a short new text of cv1 alpha0"), ("s2", "cv2", ""), ("s9", "cv99", text(99))]
    df = docs(spark, changed)
    held.upsert(df.withColumn("doc_kind", F.lit("cv")), chunks_of(df, "cv"))
    posted = docs(spark, [("s1", "jd1", text(5)), ("s4", "jd2", text(6))])
    held.upsert(posted.withColumn("doc_kind", F.lit("jd")), chunks_of(posted, "jd"))
    final = [r for r in FIRST if r[1] not in ("cv1", "cv2")] + [changed[0], changed[2]]
    want = state(new_store(spark, chunks_of(docs(spark, final), "cv"), chunks_of(posted, "jd")))
    assert state(held) == want
    # A repeated batch changes nothing, nor does a recount.
    held.upsert(df.withColumn("doc_kind", F.lit("cv")), chunks_of(df, "cv"))
    assert state(held) == want
    held.upsert(df.withColumn("doc_kind", F.lit("cv")), chunks_of(df, "cv"), recount=True)
    assert state(held) == want


def test_purge_retracts_statistics(spark, first):
    held = new_store(spark, first)
    held.purge(spark.createDataFrame([("cv", "s1", "cv1"), ("cv", "s1", "cv7"), ("jd", "s0", "cv0"), ("cv", "s5", "nobody")], "doc_kind string, scope string, doc_key string"))
    held.purge(spark.createDataFrame([("s3",), ("unknown",)], "scope string"))
    final = [r for r in FIRST if r[1] not in ("cv1", "cv7") and r[0] != "s3"]
    rebuilt = new_store(spark, chunks_of(docs(spark, final), "cv"))
    assert state(held) == state(rebuilt)
    asked = spark.createDataFrame([("s1", "q", "alpha1 only13"), ("s3", "q", "only3"), ("s0", "q", "zeta4 only6")], "scope string, query_id string, text string")

    def ranked(store):
        ix = store.index("cv", asked)
        rows = R.bm25_rankings(ix.children, asked, lexicon=ix.lexicon).collect()
        return sorted((r["scope"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in rows)

    assert ranked(held) == ranked(rebuilt) and {r[0] for r in ranked(held)} == {"s0", "s1"}
    held.purge(spark.createDataFrame([(f"s{k}",) for k in range(6)], "scope string"))
    assert all(rows == [] for rows in state(held).values())


def test_a_question_reads_only_its_buckets(spark, first):
    held = new_store(spark, first)
    asked = spark.createDataFrame([("s1", "q", "alpha1 beta2")], "scope string, query_id string, text string")
    ix = held.index("cv", asked)
    bucket = asked.select(scope_bucket(F.col("scope"), 8)).first()[0]
    for df in (ix.children.select("chunk_id", "toks"), ix.parents):
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "doc_kind" in filters and "bucket" in filters
    files = {r[0] for r in ix.children.select(F.input_file_name()).distinct().collect()}
    assert files and all(f"doc_kind=cv/bucket={bucket}/" in f for f in files)
    assert held.index("jd", asked).children.count() == 0


def test_an_untouched_bucket_is_not_rewritten(spark, first):
    held = new_store(spark, first)
    before = {r[0] for r in held.table("children").select(F.input_file_name()).distinct().collect()}
    df = docs(spark, [("s1", "cv1", "another text")])
    held.upsert(df.withColumn("doc_kind", F.lit("cv")), chunks_of(df, "cv"))
    after = {r[0] for r in held.table("children").select(F.input_file_name()).distinct().collect()}
    touched = spark.range(1).select(scope_bucket(F.lit("s1"), 8)).first()[0]
    assert before - after and all(f"/bucket={touched}/" in f for f in before ^ after)


def test_empty_store(spark, first):
    empty = Chunks(first.parents.limit(0), first.children.limit(0))
    held = ChunkStore(spark, f"{work_dir(spark)}/store-{uuid.uuid4().hex}").create(empty)
    assert all(rows == [] for rows in state(held).values())
    held.upsert(spark.createDataFrame([], "doc_kind string, scope string, doc_key string"), empty)
    df = docs(spark, FIRST[:3])
    held.upsert(df.withColumn("doc_kind", F.lit("cv")), chunks_of(df, "cv"))
    assert state(held)["scopes"] == [r for r in state(ChunkStore(spark, f"{work_dir(spark)}/store-{uuid.uuid4().hex}").create(chunks_of(df, "cv")))["scopes"]]


def test_stamp_tells_a_changed_table(spark):
    path = f"{work_dir(spark)}/stamped-{uuid.uuid4().hex}"
    spark.range(3).write.parquet(path)
    one = stamp(spark, path)
    assert one == stamp(spark, path)
    spark.range(5).write.mode("append").parquet(path)
    assert one != stamp(spark, path)


def test_a_change_leaves_nothing_beside_the_store(spark, first):
    import os

    held = new_store(spark, first)
    held.upsert(docs(spark, [("s1", "cv1", text(1))]).withColumn("doc_kind", F.lit("cv")), chunks_of(docs(spark, [("s1", "cv1", text(1))]), "cv"))
    held.purge(spark.createDataFrame([("s2",)], "scope string"))
    assert sorted(n for n in os.listdir(held.root) if not n.startswith("change-")) == sorted(os.listdir(held.root)) == ["children", "parents", "scopes", "terms"]
