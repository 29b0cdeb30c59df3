"""MinHash near-duplicate groups by one-permutation hashing.

One hash per shingle fills all bins of a signature; empty bins are filled by optimal densification (each
empty bin tries the same pseudo-random sequence of bins until it meets a filled one). Bands of bins give
buckets, and every bucket gives a star: one candidate edge per member, to its smallest document. The stars'
components are the candidate families: two documents that share any bucket are in one family. Inside a
family full shingle sets are compared, tile against tile, so a pair that a star does not join directly is
compared too; each tile pair returns a spanning forest of its links, never its pairs.

Equal shingle sets are collapsed before the buckets, so copies cost nothing after the first step. A family
is cut into tiles by set size and hash, so a family with a third of all documents is many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import bytes_kernel as K
from .batches import bounded_batches, tidied, tidied_group
from .graph import components, forest

ROWS = 5  #: bins per band
BANDS = 30
#: A pair of similarity 0.85 shares none of 30 bands of 5 bins with probability 2.3e-8, one of 0.8 with 7e-6.
TILE_BYTES = 8 << 20
COLUMNS = 1 << 15


def densify(bins: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Optimal densification of (documents, bins); rows with no filled bin stay as they are."""
    n = bins.shape[1]
    out = bins.copy()
    rows, cols = np.nonzero(~filled & filled.any(1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        target = (K.mix(cols.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt), 7) % np.uint64(n)).astype(np.int64)
        hit = filled[rows, target]
        out[rows[hit], cols[hit]] = bins[rows[hit], target[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return out


def band_hashes(sets: np.ndarray, offsets: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) of sets given as sorted hashes with offsets."""
    docs, n = len(offsets) - 1, bands * rows
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    place = ((sets >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64) + doc * n
    bins = np.zeros(docs * n, np.uint64)
    filled = np.zeros(docs * n, bool)
    if len(sets):
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # sorted hashes: a bin's are neighbours
        bins[place[first]] = np.minimum.reduceat(K.mix(sets, 3), first)
        filled[place[first]] = True
    bins = densify(bins.reshape(docs, n), filled.reshape(docs, n)).reshape(docs, bands, rows)
    h = np.zeros((docs, bands), np.uint64)
    for k in range(rows):
        h = h * np.uint64(K.BASE) + bins[:, :, k]
    return K.mix(h, 4)


def _signatures(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets, _ = K.flat(batch.column(1))
            for a, b in K.document_slices(offsets):
                sets, places = K.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sums = [np.r_[np.uint64(0), np.cumsum(K.mix(sets, seed), dtype=np.uint64)] for seed in (5, 6)]
                k1, k2 = ((s[places[1:]] - s[places[:-1]]).view(np.int64) for s in sums)
                h = band_hashes(sets, places, bands, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b]), pa.array(np.diff(places)), pa.array(k1), pa.array(k2),
                     pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(h.ravel()))],
                    ["doc_id", "n_shingles", "k1", "k2", "bands"],
                )
    return run


def _family_sets(batches):
    """The set of each document, once for each pair of tiles it takes part in."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        data, offsets, _ = K.flat(batch.column(1))
        rest = [batch.column(k).to_pylist() for k in (2, 3, 4, 5)]
        for a, b in K.document_slices(offsets):
            sets, places = K.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out = []
            for d in range(a, b):
                family, size, salt, meets = (r[d] for r in rest)
                body = sets[places[d - a] : places[d - a + 1]].tobytes()
                own = (size << 32) + salt
                for other in sorted({(m["size"] << 32) + t for m in meets for t in range(m["tiles"])}):
                    out.append((family, min(own, other), max(own, other), int(own > other), ids[d], body))
                    if len(out) >= 64:
                        yield _rows(out)
                        out = []
            if out:
                yield _rows(out)


def _rows(out):
    names = ["family", "x", "y", "side", "doc_id", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, a bounded number of shingles at a time."""
    parts = [*a, *b]
    h = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, place, times = np.unique(h, return_inverse=True, return_counts=True)
    more = times > 1
    column = np.cumsum(more) - 1
    keep = more[place]
    place, owner = column[place[keep]], owner[keep]
    total = int(more.sum())
    out = np.zeros((len(a), len(b)), np.int64)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for start in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(place, [start, start + COLUMNS])
        grid = np.zeros((len(parts), min(COLUMNS, total - start)), np.float32)
        grid[owner[lo:hi], place[lo:hi] - start] = 1
        out += (grid[: len(a)] @ grid[len(a) :].T).astype(np.int64)
    return out


def _tile_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        same = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        ids, side = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("body")]
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            empty = np.zeros(0, np.int64)
            return pa.table({"v": empty, "m": empty})
        shared = shared_counts([sets[i] for i in left], [sets[i] for i in right])
        size = np.array([len(s) for s in sets])
        union = size[left][:, None] + size[right][None, :] - shared
        i, j = np.nonzero(100 * shared >= percent * union)
        v, m = forest(ids[left[i]], ids[right[j]])
        return pa.table({"v": v, "m": m})
    return run


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text). Returns (doc_id, n_shingles, component_id, kept).

    Linked are documents with 100 * |shared shingles| >= percent * |all shingles|, on the full sets of five-word
    shingles. Null and blank texts have no shingles and are linked with nothing. Rows without an id take no part.
    Rows repeated under one id are one document: all are returned, with one component.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).filter("doc_id is not null")
    signs = written(
        texts.mapInArrow(tidied(_signatures(bands, rows)), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "signatures"
    )
    key = ["n_shingles", "k1", "k2"]
    classes = written(signs.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    # The first document of a class stands for it; a repeated row of that document adds the same bucket entry again.
    firsts = signs.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    entries = firsts.select("doc_id", F.posexplode("bands").alias("band", "h"))
    heads = entries.groupBy("band", "h").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).filter("head < last").drop("last")
    stars = entries.join(heads, ["band", "h"]).filter("doc_id > head").select(F.col("doc_id").alias("v"), F.col("head").alias("m")).distinct()
    child = components(stars, "families")
    family = child.select(F.col("v").alias("doc_id"), F.col("m").alias("family")).union(
        child.select(F.col("m").alias("doc_id"), F.col("m").alias("family")).distinct())
    step = math.log(100 / percent)
    members = written(
        family.join(signs.select("doc_id", "n_shingles").distinct(), "doc_id")
        .withColumn("size", F.floor(F.log("n_shingles") / step + 1e-9).cast("long")), "members")
    most = F.greatest(F.lit(64), F.least(F.lit(1024), (2 * F.sqrt("c")).cast("long")))
    tiles = written(
        members.groupBy("family", "size").agg(F.count("*").alias("c"), F.max("n_shingles").alias("top"))
        .select("family", "size", F.ceil(F.col("c") / F.least(most, F.greatest(F.lit(1), F.lit(TILE_BYTES // 8) / F.col("top")))).alias("tiles")),
        "tiles")
    # Linked sets differ in size by less than one step: a document meets the tiles of its own step and of the next ones.
    near = (
        tiles.select("family", "size", F.explode(F.array(*[F.col("size") + k for k in (-1, 0, 1)])).alias("near"), "tiles")
        .groupBy("family", F.col("near").alias("size"))
        .agg(F.collect_list(F.struct("size", "tiles")).alias("meets"))
    )
    work = (
        members.join(tiles, ["family", "size"]).join(near, ["family", "size"])
        .select("doc_id", "family", "size", F.pmod(F.xxhash64("doc_id"), "tiles").alias("salt"), "meets")
    )
    bodies = texts.join(work, "doc_id").select("doc_id", "text", "family", "size", "salt", "meets")
    sent = bodies.mapInArrow(tidied(_family_sets), "family long, x long, y long, side int, doc_id long, body binary")
    links = sent.groupBy("family", "x", "y").applyInArrow(tidied_group(_tile_links(percent)), "v long, m long")
    comp = components(links, "near")
    found = (
        signs.select("doc_id", *key).join(classes, key, "left")
        .join(comp.select(F.col("v").alias("rep"), "m"), "rep", "left")
    )
    return found.select(
        "doc_id", "n_shingles", F.coalesce("m", "rep", "doc_id").alias("component_id"),
        (F.coalesce("m", "rep", "doc_id") == F.col("doc_id")).alias("kept"),
    )
