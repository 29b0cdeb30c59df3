"""Connected components of an undirected link table, by alternating large and small stars.

Each round is two joins on a node's least neighbour; the rounds needed grow with the logarithm of the
longest path. Links and labels stay in Spark; each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

EDGES = "v long, m long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for every node that is not itself the least; small inputs only."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _contract(batches):
    """The links of each batch, reduced to a spanning forest."""
    for batch in batches:
        v, m = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(m)], ["v", "m"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("v", "m").union(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
    # Stored, so that the join shuffles both its sides and a node with very many links can be split.
    least = written(both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("low")), "least")
    return both.filter("m > v").join(least, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("v", "m").alias("v"), F.least("v", "m").alias("m"))
    least = written(down.groupBy("v").agg(F.min("m").alias("low")), "least")
    moved = down.join(least, "v").filter("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
    return moved.union(least.select("v", F.col("low").alias("m"))).distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """links (v, m): two linked ids, in any order, repeats allowed. Returns (v, m): each id that has a smaller
    one in its component, with the smallest. Ids that are the smallest, or have no links, are not returned."""
    edges = links.selectExpr("cast(v as bigint) v", "cast(m as bigint) m").filter("v <> m")
    edges = written(edges.mapInArrow(_contract, EDGES), name)
    while True:
        roles = edges.selectExpr("v n", "1 child", "0 parent").union(edges.selectExpr("m n", "0 child", "1 parent"))
        seen = roles.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
        if seen.filter("c > 1 or (c > 0 and p > 0)").isEmpty():
            return edges
        edges = written(_small_star(_large_star(edges)), name)
