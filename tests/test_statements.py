"""One query of every area against its SQL statement (all of them: python tools/check.py)."""

import duckdb
import pytest

import __spark_entry__ as entry
from gapmatch.plans import registry
from oracles import statements

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split()
SAMPLE = ["tokens_per_doc", "unspaced_text", "retrieval_metrics", "parent_child_chunks", "hashed_dense_topk", "verdicts", "scorecard", "stage_rollup", "spearman", "stream_rate_windows"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_statement(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = db.execute(entry.oracle_sql()[name])
    assert plain(df.collect(), df.columns) == plain(cur.fetchall(), [d[0] for d in cur.description])


def test_every_query_has_a_statement():
    assert set(registry()) == set(statements())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
