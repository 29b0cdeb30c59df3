"""Exact nearest vectors over cells: a pivot, a radius, and the triangle inequality between angles.

Pivots are a bounded sample. A vector belongs to the pivot it has the least angle to; the cell's radius is the largest of
these angles. No vector of a cell is nearer to a query than the query's angle to the pivot less the radius, so cells are
searched best first and the others left out. Large cells are cut into blocks of bounded size.

Pairs of queries and blocks are never rows. A query goes to its best block, and then once to each shelf of blocks, as many as
fit a task's memory, with a list of those that can still win; a task scores a shelf against many queries, block by block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from . import topk
from .block_search import SLACK, meet, ranked

PIVOTS = 256  #: pivots of a scope at most
BLOCK = 4096  #: vectors in a block, about
ROWS = 4096  #: vectors that are compared with the pivots together
SHELF = 1 << 22  #: numbers of the vectors of a shelf, and of the queries that meet it, about
LEAST = 256  #: queries that meet a shelf together at least
WIDE = 1e-6  #: angles are widened by what cosines in double precision can be off


def _unit(vectors) -> np.ndarray:
    rows = np.array(vectors.tolist(), dtype=np.float64)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1.0, norm)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def pivots(items: DataFrame, most: int = PIVOTS) -> DataFrame:
    """(scope, block, cell, vec): up to ``most`` vectors of each scope, about the square root of its size, drawn by hash."""
    sizes = items.groupBy("scope").agg(
        F.least(F.lit(most), F.ceil(F.sqrt(F.count(F.lit(1))))).alias("wanted"), F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first"))
    code = F.xxhash64(F.lit(1), "item_id")
    drawn = F.pmod(code, F.lit(1 << 30)) < 2 * F.col("wanted") / F.col("n") * (1 << 30)
    sample = items.join(sizes, "scope").filter(drawn | (F.col("item_id") == F.col("first")))
    by = Window.partitionBy("scope").orderBy(code, "item_id")  # over the sample
    cells = sample.withColumn("cell", F.row_number().over(by).cast("int")).filter(F.col("cell") <= F.col("wanted"))
    return written(cells.select("scope", F.lit(0).cast("long").alias("block"), "cell", "vec"), "pivots")


def in_cells(items: DataFrame, held: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Items (scope, item_id, vec, block, shelf) and stored blocks (scope, block, cell, radius, shelf)."""
    def assign(cells: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        angle = _angles(_unit(rows["vec"]), _unit(cells["vec"]))
        return rows.assign(query_id=rows["query_id"].astype(object), cell=cells["cell"].to_numpy()[angle.argmin(1)], angle=angle.min(1))

    asking = items.select("scope", F.lit(0).cast("long").alias("block"), F.col("item_id").alias("query_id"), "vec")
    out = f"scope string, query_id string, vec {items.schema['vec'].dataType.simpleString()}, cell int, angle double"
    placed = written(meet(asking, held, assign, ROWS, out).withColumnRenamed("query_id", "item_id"), "cells")
    sizes = placed.groupBy("scope", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("parts"))
    key = F.col("cell").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("item_id"), "parts")
    blocked = placed.join(written(sizes, "sizes"), ["scope", "cell"]).withColumn("block", key)
    blocks = blocked.groupBy("scope", "block", "cell").agg(F.max("angle").alias("radius"), F.sum(F.size("vec")).alias("numbers"))
    upto = F.sum("numbers").over(Window.partitionBy("scope").orderBy("block"))  # over the blocks
    blocks = written(blocks.withColumn("shelf", F.floor((upto - F.col("numbers")) / SHELF).cast("long")), "blocks")
    return blocked.join(blocks.select("scope", "block", "shelf"), ["scope", "block"]).select("scope", "item_id", "vec", "block", "shelf"), blocks


def _numbers(df: DataFrame) -> DataFrame:
    """Vectors as numbers of the precision they came in."""
    kind = df.schema["vec"].dataType.simpleString()
    return df if kind in ("array<float>", "array<double>") else df.withColumn("vec", F.col("vec").cast("array<double>"))


def _bounded(centres: pd.DataFrame, of: pd.DataFrame):
    """(rows of ``of``, bounds of all blocks), a bounded slice of queries at a time. ``centres`` has a row for each block, in order."""
    _, cell = np.unique(centres["cell"].to_numpy(), return_inverse=True)
    first = np.unique(cell, return_index=True)[1]
    units, step = _unit(centres["vec"].iloc[first]), max(1, topk.CELLS // len(centres))
    for lo in range(0, len(of), step):
        angle = _angles(_unit(of["vec"].iloc[lo : lo + step]), units)
        yield lo, np.cos(np.maximum(0.0, angle[:, cell] - centres["radius"].to_numpy() - WIDE))


def _best_block(centres: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
    centres = centres.sort_values("at", ignore_index=True)
    best, top = (np.concatenate(x) for x in zip(*((bound.argmax(1), bound.max(1)) for _, bound in _bounded(centres, of))))
    return pd.DataFrame({"query_id": of["query_id"].to_numpy(dtype=object), "at": centres["at"].to_numpy()[best], "bound": top})


def _open_blocks(centres: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
    """A row for each query and shelf with blocks, besides the best one, that can still hold one of its k nearest."""
    centres = centres.sort_values(["shelf", "at"], ignore_index=True)
    at, shelf = centres["at"].to_numpy(), centres["shelf"].to_numpy()
    least = of["least"].to_numpy(dtype=np.float64)  # nan: fewer than k so far
    out = []
    for lo, bound in _bounded(centres, of):
        rows = slice(lo, lo + len(bound))
        still = ~(bound + SLACK < least[rows, None]) & (at != of["best"].to_numpy()[rows, None])
        query, block = np.nonzero(still)
        cuts = np.flatnonzero((np.diff(query) != 0) | (np.diff(shelf[block]) != 0)) + 1
        first = np.r_[0, cuts][: len(query)]
        out.append(pd.DataFrame({"query_id": of["query_id"].to_numpy(dtype=object)[rows][query[first]], "shelf": shelf[block[first]],
                                 "blocks": pd.Series(np.split(at[block], cuts) if len(query) else [], dtype=object)}))
    return pd.concat(out, ignore_index=True)


def _scorer(k: int):
    def score(rows: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        """The k best of the rows in its open blocks for each query, as far as they reach what it has."""
        rows = rows.sort_values("at", ignore_index=True)
        at, ids, units, asked = rows["at"].to_numpy(), rows["item_id"].to_numpy(dtype=str), _unit(rows["vec"]), _unit(of["vec"])
        least = np.nan_to_num(of["least"].to_numpy(dtype=np.float64), nan=-np.inf)
        wanted = np.concatenate(of["blocks"].tolist())
        asking = np.repeat(np.arange(len(of)), of["blocks"].map(len).to_numpy())
        order = np.argsort(wanted, kind="stable")
        wanted, asking = wanted[order], asking[order]
        found, held = [], 0
        for block in np.unique(wanted):
            who = asking[slice(*np.searchsorted(wanted, [block, block + 1]))]
            lo, hi = np.searchsorted(at, [block, block + 1])
            step = max(1, topk.CELLS // max(1, hi - lo))
            for part in (who[q : q + step] for q in range(0, len(who), step)):
                scores = np.round(asked[part] @ units[lo:hi].T, topk.DECIMALS)
                keep = scores >= least[part, None]
                crowded = np.flatnonzero(keep.sum(1) > k)
                if len(crowded):
                    keep[crowded] &= scores[crowded] >= np.partition(scores[crowded], hi - lo - k, axis=1)[:, hi - lo - k, None]
                query, item = np.nonzero(keep)
                found.append(topk._cut(part[query], ids[lo + item], scores[query, item], k))
                held += len(found[-1][0])
                if held > topk.CELLS // 4:
                    found = [topk._cut(*(np.concatenate(x) for x in zip(*found)), k)]
                    held = len(found[0][0])
        query, ids, scores = topk._cut(*(np.concatenate(x) for x in zip(*found)), k)
        return pd.DataFrame({"query_id": of["query_id"].to_numpy(dtype=object)[query], "item_id": ids.astype(object), "score": scores})

    return score


def nearest(items: DataFrame, queries: DataFrame, k: int, most: int = PIVOTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The k nearest items (scope, item_id, vec) of every query (scope, query_id, vec) by cosine, as (scope, query_id,
    item_id, score, rank), and the (scope, query_id, block) pairs that were scored."""
    items, asked = _numbers(items.select("scope", "item_id", "vec")), _numbers(queries.select("scope", "query_id", "vec"))
    held = pivots(items, most)
    placed, blocks = in_cells(items, held, block)
    # A pivot for each of its blocks: all meet every query, so they share the place 0.
    centres = written(blocks.select("scope", "cell", F.col("block").alias("at"), "shelf", "radius").join(held, ["scope", "cell"]), "centres")
    everyone = asked.withColumn("block", F.lit(0).cast("long"))
    best = meet(everyone, centres, _best_block, ROWS, "scope string, query_id string, at long, bound double")
    # One for each id, also of ids that repeat.
    seeds = written(best.groupBy("scope", "query_id").agg(F.min_by("at", F.struct(-F.col("bound"), F.col("at"))).alias("block")), "seed-pairs")
    score, within = _scorer(k), placed.withColumn("at", F.col("block"))
    pair = seeds.withColumn("blocks", F.array("block")).withColumn("least", F.lit(None).cast("double"))
    first = written(ranked(meet(pair.join(asked, ["scope", "query_id"]), within, score), k), "seed-scores")
    reached = first.filter(F.col("rank") == k).select("scope", "query_id", F.col("score").alias("least"))
    known = written(seeds.withColumnRenamed("block", "best").join(reached, ["scope", "query_id"], "left"), "known")
    out = "scope string, query_id string, shelf long, blocks array<bigint>"
    rest = meet(everyone.join(known, ["scope", "query_id"]), centres, _open_blocks, ROWS, out)
    rest = written(rest.withColumnRenamed("shelf", "block"), "open-shelves")
    width = items.select(F.max(F.size("vec"))).first()[0] or 1
    many = max(LEAST, min(SHELF // max(1, width), rest.count() // (2 * items.sparkSession.sparkContext.defaultParallelism)))
    open_ = rest.join(known.select("scope", "query_id", "least"), ["scope", "query_id"]).join(asked, ["scope", "query_id"])
    more = meet(open_, within.drop("block").withColumnRenamed("shelf", "block"), score, many)
    pairs = seeds.unionByName(rest.select("scope", "query_id", F.explode("blocks").alias("block")))
    return ranked(first.drop("rank").unionByName(more), k), pairs
