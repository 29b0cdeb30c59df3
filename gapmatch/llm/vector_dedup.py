"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the axes of the corpus' covariance, largest variance first.
For each label, vectors are laid into tiles along their leading axes. Two tiles are compared a block of axes
at a time: the products of the leading axes are accumulated, what is left is at most the product of the two
suffix norms, and a pair is dropped as soon as that cannot reach the threshold. Pairs that remain are decided
on the original vectors in double precision. A tile pair returns link counts and a spanning forest, no pairs.

Equal vectors of a label are one class; tiles whose leading coordinates are too far apart never meet; a label
with a third of all rows is many tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written
from .graph import components, forest

TILE = 1024  #: most vectors in a tile; fewer when that keeps all shuffle partitions busy
STEP = 16  #: axes accumulated between two tests
SLACK = 1e-9  #: rounding allowed to the rotated products; the decision itself has none
LEAD = 4  #: axes whose ranges keep tiles apart
CELLS = 64  #: cells of the leading axis in each direction


def unit_rows(column: pa.Array, width: int | None = None):
    """(row numbers, vectors as doubles) of the usable vectors of an array column, by length of vector."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values.cast(pa.float64())
    solid = values.is_valid().to_numpy(zero_copy_only=False)
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1]
    for n in np.unique(sizes[valid & (sizes > 0)]) if width is None else [width]:
        rows = np.flatnonzero(valid & (sizes == n))
        place = starts[rows][:, None] + np.arange(n)
        x = flat[place]
        good = solid[place].all(1) & np.isfinite(x).all(1)
        yield int(n), rows[good], x[good]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component (safe from overflow), then by their length."""
    top = np.abs(x).max(1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _moments(batches):
    """Sums of products of the axes, a row per vector length."""
    for batch in batches:
        for n, _, x in unit_rows(batch.column(0)):
            x = _scaled(x[np.abs(x).max(1) > 0])
            m = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([m.tolist()], pa.list_(pa.float64()))], ["width", "m"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length its axes, by falling variance. The sums are added in Spark, element by element."""
    sums = (
        vectors.select("x").mapInArrow(_moments, "width int, m array<double>")
        .select("width", F.posexplode("m").alias("k", "v")).groupBy("width", "k").agg(F.sum("v").alias("v"))
    )
    axes = {}
    for width, part in sums.toPandas().groupby("width"):  # (d + 1)(d + 2) numbers per vector length
        m = part.sort_values("k")["v"].to_numpy()
        n, mean, second = max(m[0], 1), m[1 : width + 1], m[width + 1 :].reshape(width, width)
        _, v = np.linalg.eigh(second / n - np.outer(mean, mean) / n**2)
        axes[int(width)] = np.ascontiguousarray(v[:, ::-1])
    return axes


def _place(axes):
    """Cell along the leading axis of every class."""
    def run(batches):
        for batch in batches:
            for n, rows, x in unit_rows(batch.column(2)):
                cells = np.floor((_scaled(x) @ axes[n][:, :1]).ravel() * CELLS).astype(np.int32)
                chosen = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*chosen.columns, pa.array(np.full(len(rows), n, np.int32)), pa.array(cells)], ["rep", "label", "x", "n", "width", "cell"])
    return run


def _links(axes, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side, ids, times = (table.column(c).to_numpy() for c in ("side", "rep", "n"))
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        width = table.column("width")[0].as_py()
        _, rows, x = next(unit_rows(table.column("x"), width))
        unit = _scaled(x)
        turned = unit @ axes[width]
        left = np.flatnonzero(side[rows] == 0)
        right = left if same else np.flatnonzero(side[rows] == 1)
        none = pa.table({"v": np.zeros(0, np.int64), "m": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        if not len(left) or not len(right):
            return none
        low = [turned[s, :LEAD].min(0) for s in (left, right)]
        high = [turned[s, :LEAD].max(0) for s in (left, right)]
        apart = np.maximum(0, np.maximum(low[0] - high[1], low[1] - high[0]))
        if 1 - (apart**2).sum() / 2 < threshold - SLACK:
            return none
        a, b = turned[left], turned[right]
        part = np.zeros((len(a), len(b)))
        rest = [np.sqrt(np.maximum((t * t)[:, ::-1].cumsum(1)[:, ::-1], 0)) for t in (a, b)]
        for k in range(0, width, STEP):
            part += a[:, k : k + STEP] @ b[:, k : k + STEP].T
            bound = part if k + STEP >= width else part + np.outer(rest[0][:, k + STEP], rest[1][:, k + STEP])
            open_ = bound >= threshold - SLACK
            i, j = open_.any(1), open_.any(0)
            if not i.any():
                return none
            if i.mean() < 0.5 or j.mean() < 0.5:  # rows and columns with nothing left are not carried on
                a, b, part, left, right = a[i], b[j], part[np.ix_(i, j)], left[i], right[j]
                rest, open_ = [rest[0][i], rest[1][j]], open_[np.ix_(i, j)]
        i, j = np.nonzero(open_)
        i, j = left[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        keep = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 16):
            p, q = x[i[s : s + (1 << 16)]], x[j[s : s + (1 << 16)]]
            p, q = p / np.abs(p).max(1, keepdims=True), q / np.abs(q).max(1, keepdims=True)
            keep[s : s + len(p)] = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1))) >= threshold
        i, j = i[keep], j[keep]
        ids, times = ids[rows], times[rows]
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, i, times[j])
        np.add.at(count, j, times[i])
        v, m = forest(ids[i], ids[j])
        got = np.flatnonzero(count)
        return pa.table({"v": np.r_[v, ids[got]], "m": np.r_[m, np.full(len(got), -1)], "links": np.r_[np.full(len(v), -1), count[got]]})
    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, tile: int | None = None) -> DataFrame:
    """vectors (vec_id, embedding, label). Returns (vec_id, n_links, component_id, kept), a row per row.

    Linked are vectors with the same non-null label and length whose cosine, in doubles, is at least ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite components, and unlabelled ones, are linked with
    nothing. Repeated rows are vectors of their own. Rows without an id take no part.
    """
    source = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("x"), "label").filter("vec_id is not null")
    usable = (
        F.col("label").isNotNull() & F.coalesce(F.size("x") > 0, F.lit(False))
        & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False))
    )
    rows = source.filter(usable)
    # Two 64-bit hashes name a vector; the label's own value stays in the key.
    named = rows.select("vec_id", "x", "label", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), F.reverse("x")).alias("h2"))
    key = ["label", "h1", "h2"]
    classes = written(named.groupBy(*key).agg(F.min_by("x", "vec_id").alias("x"), F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    axes = principal_axes(classes)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    placed = written(
        classes.select("rep", "label", "x", "n").mapInArrow(
            _place(axes), f"rep long, label {kinds['label']}, x {kinds['x']}, n long, width int, cell int"), "placed")
    if tile is None:
        parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tile = max(64, min(TILE, placed.count() // parts))
    group = ["label", "width"]
    # Neighbouring cells are gathered into bands of about one tile; a band over one tile is dealt over several.
    cells = placed.groupBy(*group, "cell").agg(F.count("*").alias("c"))
    order = W.partitionBy(*group).orderBy("cell")  # at most 2 * CELLS + 1 rows each
    cells = written(cells.withColumn("band", ((F.sum("c").over(order) - F.col("c")) / tile).cast("long")), "cells")
    bands = cells.groupBy(*group, "band").agg(
        F.min("cell").alias("low"), F.max("cell").alias("high"), F.ceil(F.sum("c") / tile).cast("long").alias("tiles"))
    # Bands meet if the distance between them allows the threshold: |p - q|^2 <= 2 - 2 t for vectors of length one.
    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) * CELLS + 1e-6
    other = bands.select(*group, *[F.col(c).alias("o_" + c) for c in ("band", "low", "high", "tiles")])
    meets = (
        bands.join(other, group).filter((F.col("o_low") - F.col("high") - 1 <= reach) & (F.col("low") - F.col("o_high") - 1 <= reach))
        .groupBy(*group, "band", "tiles").agg(F.collect_list(F.struct("o_band", "o_tiles")).alias("meets"))
    )
    here = cells.select(*group, "cell", "band").join(meets, [*group, "band"])
    own = F.struct("band", F.pmod(F.xxhash64("rep"), "tiles").alias("k"))
    at = placed.join(here, [*group, "cell"]).select("rep", *group, "x", "n", own.alias("own"), F.explode("meets").alias("o"))
    at = at.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o.o_tiles") - 1)).alias("k")).withColumn(
        "other", F.struct(F.col("o.o_band").alias("band"), "k"))
    pairs = at.select(*group, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                      (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "n", "x")
    found = written(pairs.groupBy("label", "width", "a", "b").applyInArrow(_links(axes, threshold), "v long, m long, links long"), "vector-links")
    comp = components(found.filter("links < 0").select("v", "m"), "vector-forest")
    counts = found.filter("links > 0").groupBy(F.col("v").alias("rep")).agg(F.sum("links").alias("links"))
    judged = classes.select(*key, "rep", "n").join(counts, "rep", "left").join(comp.select(F.col("v").alias("rep"), "m"), "rep", "left").select(
        *key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("m", "rep").alias("component_id"))
    named_all = source.select(
        "vec_id", "label", F.when(usable, F.xxhash64("x")).alias("h1"), F.when(usable, F.xxhash64(F.lit(1), F.reverse("x"))).alias("h2"))
    return named_all.join(judged, key, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
