"""Exact top-k of a score over (query, item) pairs that share a scope.

Every query has to be scored against every item of its scope, but those pairs are never rows: a
task scores one block of items against one block of queries with numpy, keeps k per query, and only
these survivors are shuffled and ranked. Two plans give the same rows:

* few queries (a limited fetch proves the bound): they ride along as a small closure, the items are
  scanned in place and **not shuffled at all**;
* many queries: items and queries are cut into blocks of bounded size inside each scope and
  co-grouped by (scope, item block, query block). A scope holding a third of all items is simply
  more blocks, so no task grows with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import stored_rows

SMALL_QUERY_SIDE = 4096
ITEM_BLOCK = 20_000
QUERY_BLOCK = 4096
CELLS = 4_000_000  # scores held at a time
DECIMALS = 9
OUT = "scope string, query_id string, item_id string, score double"

Scorer = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def _cut(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best of every query, ties by item id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[top], ids[top], score[top]


def best_of(items: pd.DataFrame, queries: pd.DataFrame, scorer: Scorer, k: int, floor: float | None):
    """(query row, item id, score) of the k best items of every query, scored a bounded slice at a time."""
    step = max(k, CELLS // len(queries))
    found = []
    for lo in range(0, len(items), step):
        part = items.iloc[lo : lo + step]
        scores = np.round(scorer(part, queries), DECIMALS)
        n = scores.shape[1]
        keep = scores >= np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1] if n > k else np.ones(scores.shape, bool)
        if floor is not None:
            keep &= scores > floor
        query, item = np.nonzero(keep)
        ids = part["item_id"].to_numpy(dtype=str)
        found.append(_cut(query, ids[item], scores[query, item], k))
    return _cut(*(np.concatenate(x) for x in zip(*found)), k)


def _frame(scope, queries: pd.DataFrame, query, ids, score) -> pd.DataFrame:
    names = queries["query_id"].to_numpy(dtype=object)
    return pd.DataFrame({"scope": scope, "query_id": names[query], "item_id": ids.astype(object), "score": score})


def _in_place(items: DataFrame, queries: pd.DataFrame, scorer, k, floor) -> DataFrame:
    by_scope = {scope: part.reset_index(drop=True) for scope, part in queries.groupby("scope")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for batch in batches:
            for scope, block in batch.groupby("scope"):
                asked = by_scope.get(scope)
                if asked is not None:
                    new = best_of(block, asked, scorer, k, floor)
                    old = best.get(scope)
                    best[scope] = _cut(*(np.concatenate(x) for x in zip(old, new)), k) if old else new
        for scope, kept in best.items():
            yield _frame(scope, by_scope[scope], *kept)

    return items.mapInPandas(run, OUT)


def _in_blocks(items: DataFrame, queries: DataFrame, scorer, k, floor) -> DataFrame:
    # Items and queries may come from one table: under names of their own, the two sides are told apart.
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])

    def blocks(df, size, name):
        counts = df.groupBy("scope").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
        return counts

    shape = blocks(items, ITEM_BLOCK, "n_item").join(blocks(queries, QUERY_BLOCK, "n_query"), "scope")
    placed_items = (
        items.join(shape, "scope")
        .withColumn("ib", F.pmod(F.xxhash64("item_id"), F.col("n_item")).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_query") - 1)))
        .drop("n_item", "n_query")
    )
    placed_queries = (
        queries.join(shape, "scope")
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("n_query")).cast("int"))
        .withColumn("ib", F.explode(F.sequence(F.lit(0), F.col("n_item") - 1)))
        .drop("n_item", "n_query")
    )

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"scope": [], "query_id": [], "item_id": [], "score": []})
        asked = right.reset_index(drop=True)
        return _frame(key[0], asked, *best_of(left, asked, scorer, k, floor))

    keys = ["scope", "ib", "qb"]
    return placed_items.groupBy(*keys).cogroup(placed_queries.groupBy(*keys)).applyInPandas(run, OUT)


def top_k(
    items: DataFrame, queries: DataFrame, scorer: Scorer, k: int, floor: float | None = None,
    small: int = SMALL_QUERY_SIDE,
) -> DataFrame:
    """(scope, query_id, item_id, score, rank): the k best items of every query, rank from 1.

    ``items`` has scope, item_id and whatever the scorer reads; ``queries`` scope, query_id likewise.
    Ids are strings. ``floor`` keeps only scores above it.
    """
    head = queries.limit(small + 1).toPandas()
    if len(head) <= small:
        survivors = _in_place(items, head, scorer, k, floor)
    else:
        survivors = _in_blocks(items, queries, scorer, k, floor)
    order = Window.partitionBy("scope", "query_id").orderBy(F.desc("score"), "item_id")
    return survivors.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cosine(items: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
    """Scorer over ``vec`` columns of equal length: arrays of numbers, or the values that an index stores."""

    def unit(column) -> np.ndarray:
        if isinstance(column.iloc[0], (bytes, bytearray)):
            m = stored_rows(column.tolist()).astype(np.float64)
        else:
            m = np.array(column.tolist(), dtype=np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm == 0, 1.0, norm)

    return unit(queries["vec"]) @ unit(items["vec"]).T
