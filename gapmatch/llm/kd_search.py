"""Exact top-k by inner product with a KD-tree per shard.

Every shard of vectors becomes a tree: median splits along the widest axis down to small leaves, with the tight
bounding box of every node. For a query q the largest inner product inside a box is the sum over axes of the
better of q * low and q * high. A query visits the nodes best bound first and stops when the best open bound is
below its kth score. The kth score is carried from shard to shard: each block of queries is answered in one
shard first, and starts in all others from the score it brings along.

Shards and query blocks both have bounded rows. A tree is built once, stored in the shared folder, and sent to
each query block; the k best of every (shard, block) pair are all that leaves a task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written
from .vector_dedup import unit_rows

SHARD = 1 << 15
BLOCK = 512
LEAF = 64
EXACT = float(1 << 53)


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(x * scale)


class Tree:
    """Points in leaf order, boxes of the nodes, children (-1 for a leaf) and the range of points of each node."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        low, high, child, span = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, which = todo.pop()
            node = len(low)
            if parent >= 0:
                child[parent][which] = node
            part = points[order[a:b]]
            low.append(part.min(0))
            high.append(part.max(0))
            child.append([-1, -1])
            span.append((a, b))
            wide = high[-1] - low[-1]
            axis = int(wide.argmax())
            if b - a > leaf and wide[axis] > 0:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], middle)]
                todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.points, self.ids = points[order], ids[order]
        self.low, self.high = np.array(low), np.array(high)
        self.child, self.span = np.array(child), np.array(span)

    def dump(self) -> bytes:
        sink = pa.BufferOutputStream()
        for x in (self.points, self.ids, self.low, self.high, self.child, self.span):
            pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(x)), sink)
        return sink.getvalue().to_pybytes()

    @classmethod
    def load(cls, body: bytes) -> Tree:
        tree, source = cls.__new__(cls), pa.BufferReader(body)
        tree.points, tree.ids, tree.low, tree.high, tree.child, tree.span = (pa.ipc.read_tensor(source).to_numpy() for _ in range(6))
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray):
        """The k best of every query that reach its floor: (query row, id, score). Ties go to the smaller id."""
        exact = max(np.abs(queries).max(initial=0) * np.abs(self.points).max(initial=0) * queries.shape[1], 0) < EXACT
        if not exact:  # products beyond 2^53: integer arithmetic
            queries, points = queries.astype(np.int64), self.points.astype(np.int64)
            low, high = self.low.astype(np.int64), self.high.astype(np.int64)
        else:
            points, low, high = self.points, self.low, self.high
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        out = []
        for q in range(len(queries)):
            bound = high @ up[q] + low @ down[q]
            best: list[tuple] = []  # (score, -id), least first
            least, open_ = floor[q], [(-bound[0], 0)]
            while open_:
                top, node = heapq.heappop(open_)
                if -top < least:
                    break
                if self.child[node, 0] >= 0:
                    for c in self.child[node]:
                        if bound[c] >= least:
                            heapq.heappush(open_, (-bound[c], int(c)))
                    continue
                a, b = self.span[node]
                score = points[a:b] @ queries[q]
                for i in np.flatnonzero(score >= least):
                    if self.ids[a + i] == own[q]:
                        continue
                    item = (int(score[i]), -int(self.ids[a + i]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    least = max(least, best[0][0])
            out += [(q, -i, s) for s, i in best]
        return out


def _trees(scale: float):
    def run(table: pa.Table) -> pa.Table:
        rows = []
        for n, at, x in unit_rows(table.column("x")):
            tree = Tree(scaled(x, scale), table.column("id").to_numpy()[at])
            rows.append((n, tree.dump()))
        return pa.table({"width": pa.array([r[0] for r in rows], pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()] * len(rows), pa.int64()),
                         "tree": pa.array([r[1] for r in rows], pa.binary())})
    return run


FOUND = pa.schema([("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _answer(k: int, scale: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: queries of one block (id, row, x, floor), right: the trees of one shard (one per vector length)."""
        out = []
        for body in right.column("tree") if len(left) else []:
            tree = Tree.load(body.as_buffer())
            got = [(at, x) for n, at, x in unit_rows(left.column("x")) if n == tree.points.shape[1]]
            if not got:
                continue
            at, x = got[0]
            ids, row = left.column("id").to_numpy()[at], left.column("row").to_numpy()[at]
            floor = left.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy()[at]
            out += [(ids[q], row[q], i, s) for q, i, s in tree.search(scaled(x, scale), ids, k, floor)]
        if not out:
            return FOUND.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FOUND)], schema=FOUND)
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """vectors and queries (vec_id, embedding). Returns (query_id, rank, vec_id, score): the k largest inner products of
    floor(scale * x), by falling score, then by smaller vec_id, without the query's own id; all if there are fewer.

    Vectors that are null, empty or hold null or non-finite components take no part, on either side; vectors of
    other lengths than the query's are no candidates. Repeated rows are candidates of their own; a query id that
    is repeated is answered for its first vector (in array order).
    """
    spark = vectors.sparkSession
    good = F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & (F.coalesce(F.size("x"), F.lit(0)) > 0)

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("x")).filter("id is not null").filter(good)

    items = usable(vectors)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, m = items.count(), usable(queries).count()
    shards = max(1, -(-n // shard), min(parts, n // 512))
    blocks = max(1, -(-m // block), min(parts // shards, m // 8))
    salt = F.pmod(F.xxhash64("id", "x"), F.lit(shards))
    trees = written(
        items.withColumn("shard", salt).groupBy("shard").applyInArrow(_trees(scale), "width int, shard long, tree binary"), "trees")
    asked = written(
        usable(queries).groupBy("id").agg(F.min("x").alias("x"))
        .select("id", "x", F.xxhash64("id").alias("row"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")), "queries")

    def answered(pairs: DataFrame) -> DataFrame:
        """pairs: the queries, with the shard each is to be answered in."""
        sent = pairs.select("block", "shard", "id", "row", "x", "floor")
        wanted = pairs.select(F.col("block").alias("to"), F.col("shard").alias("at")).distinct()
        wanted = wanted.join(trees, F.col("at") == trees["shard"]).select("to", "at", "tree")
        return sent.groupBy("block", "shard").cogroup(wanted.groupBy("to", "at")).applyInArrow(
            _answer(k, scale), "query_id long, row long, vec_id long, score long")

    home = F.pmod(F.col("block"), F.lit(shards))
    first = written(answered(asked.withColumn("shard", home).withColumn("floor", F.lit(None).cast("long"))), "first-answers")
    floors = first.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("c"), F.min("score").alias("least"))
    rest = (
        asked.join(floors, "id", "left").withColumn("floor", F.when(F.col("c") >= k, F.col("least")))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).filter(F.col("shard") != home)
    )
    everything = first.union(answered(rest)) if shards > 1 else first
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return everything.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
