"""The fixity audit: trees built on their own, hot ids, and the SQL over hard pages."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gapmatch.llm import queries, warc

PAGES = "page_id long, url string, html string"


def statuses(rows):
    return {(r["page_id"], r["nth"]): r["status"] for r in rows if r["status"] != "ok"}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, f"http://x/{i}", "h" * (i % 50)) for i in range(2000)], PAGES)


def test_one_change_looks_at_one_leaf(pages):
    changed = pages.withColumn("html", F.when(F.col("page_id") == 777, F.lit("other")).otherwise(F.col("html")))
    ours = warc.written(warc.manifest(warc.digests(warc.records(pages)), 4096), "manifest")
    theirs = warc.written(warc.dealt(warc.digests(warc.records(changed)), ours), "replica")
    first = warc.tree(warc.leaf_digests(ours))
    second = warc.tree(warc.leaf_digests(theirs), len(first))
    assert len(first) > 2 and first[-1].collect() != second[-1].collect()
    odd = warc.mismatches(first, second)
    leaf = ours.filter("page_id = 777").first()["leaf"]
    assert [r["leaf"] for r in odd.collect()] == [leaf]
    # The same records are in the same leaves on both sides.
    assert sorted(map(tuple, ours.select("page_id", "nth", "leaf").collect())) == sorted(map(tuple, theirs.select("page_id", "nth", "leaf").collect()))


@pytest.mark.parametrize("rows", [40, 1 << 16])
def test_an_id_with_a_third_of_all_rows(spark, pages, monkeypatch, rows):
    monkeypatch.setattr(warc, "ROWS", rows)
    hot = spark.createDataFrame([(1000, f"u{k % 300}", "same" if k % 2 else f"page {k}") for k in range(900)], PAGES)
    every = pages.union(hot)
    got = warc.audit(every, every, 4096).collect()
    assert {r["status"] for r in got} == {"ok"} and len(got) == 2900
    assert sorted(r["nth"] for r in got if r["page_id"] == 1000) == list(range(1, 902))
    at = 0
    for r in sorted(got, key=lambda r: (r["page_id"], r["nth"])):
        assert r["offset"] == at and r["leaf"] == at // 4096
        at += r["length"]
    # Records before, among and after ours, one lost, one altered.
    more = spark.createDataFrame([(-5, "a", "b"), (99999, "a", "b")], PAGES)
    replica = every.filter("page_id <> 77").withColumn("html", F.when(F.col("page_id") == 3, F.lit("bad")).otherwise(F.col("html"))).union(more)
    assert statuses(warc.audit(every, replica, 4096).collect()) == {(3, 1): "corrupt", (77, 1): "missing", (-5, 1): "extra", (99999, 1): "extra"}


def test_a_leaf_crowded_by_strangers(spark, pages):
    crowd = spark.createDataFrame([(500, f"u{k}", "x") for k in range(200)], PAGES)
    got = warc.audit(pages, pages.union(crowd), 4096).collect()
    assert len(got) == 2200 and sum(r["status"] == "extra" for r in got) == 200
    few = warc.leaf_digests(warc.manifest(warc.digests(warc.records(pages)), 4096), most=3).collect()
    assert len(few) > 10 and sum(r["digest"].startswith("crowded ") for r in few) >= len(few) - 1  # the last leaf may be short


def test_query_equals_statement_on_hard_pages(spark, tmp_path):
    rows = [(i, None if i % 9 == 0 else f"http://x/{i}", "h" * (i % 40)) for i in range(700) if i not in (7, 96, 185, 13)]
    rows += [(7, "u", None), (96, "u", "#x"), (185, "u", ""), (274, "u", "#"), (13, "u", "lost"), (13, "u", "lost"), (224, "v", "lost too"), (5, None, None), (None, "u", "h")]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = queries.op8_warc_audit(spark, str(tmp_path))
    cur = con.execute(queries.ORACLES["op8_warc_audit"])
    order = [d[0] for d in cur.description]
    assert sorted(map(tuple, df.select(*order).collect()), key=repr) == sorted(cur.fetchall(), key=repr)
    found = {r["page_id"]: r["status"] for r in df.collect()}
    assert (found[7], found[96], found[13], found[224]) == ("ok", "ok", "missing", "missing") and found[452] == "corrupt"
