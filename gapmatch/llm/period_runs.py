"""Periodic runs of words: stretches that repeat a period three times or more, found tile by tile.

Periods are cut into octaves (low, 2 low]. For each octave a document is laid out in tiles around boundaries 2 low
apart that overlap by half; a run's matches (words equal to the word a period further on) fill at least 2 low places,
so they contain a boundary. A tile gives, for every period of its octave, how far the matches reach to the right
and to the left of its boundary: two Z-functions. What reaches over the tile's edge goes on in the next tile;
intervals are shuffled by document and period and stitched there.

Tiles whose boundary has no period with eight matches in a row beside it hold no run: a vectorised probe leaves
them out before anything is moved. The rest travel as rows of word numbers, so a long document's tiles are solved
in many tasks. Documents without tiles are finished where they are read; their texts are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written
from . import bytes_kernel as K
from .batches import bounded_batches

TIMES = 3  #: periods in a run at least
LEAST = 24  #: words in a run at least
FIRST = LEAST // TIMES  #: the first octave holds the periods up to this one
PROBE = FIRST  #: matches in a row on one side of a boundary: half of the fewest a run has
CELLS = 1 << 20  #: comparisons made at a time

Rewrite = Callable[[int, list[bytes]], list[bytes]]
SPANS = "array<struct<start: bigint, period: bigint, length: bigint>>"
TILES = "array<struct<low: bigint, boundary: bigint, at: bigint, words: binary>>"


def octaves(longest: int):
    """(low, high, step): periods in (low, high], boundaries ``step`` apart, for documents of up to ``longest`` words."""
    low, high = 0, FIRST
    while longest >= max(LEAST, TIMES * (low + 1)):
        yield low, high, 2 * max(low, FIRST)
        low, high = high, 2 * high


def probed(codes: np.ndarray, longest: int):
    """(low, boundaries) of the tiles that can hold a run. Words of different documents must have different codes."""
    n = len(codes)
    padded = np.concatenate([-1 - np.arange(PROBE), codes, -1 - PROBE - np.arange(PROBE)])
    for low, high, step in octaves(longest):
        periods = np.arange(low + 1, min(high, longest // TIMES) + 1)
        grid = np.arange(0, n, step)
        found = []
        for part in np.split(grid, range(0, len(grid), max(1, CELLS // len(periods)))[1:]):
            further = np.minimum(part[:, None] + periods, n)
            i, k = np.nonzero(padded[part + PROBE][:, None] == padded[further + PROBE])
            a, b = part[i] + PROBE, further[i, k] + PROBE
            right, left = np.ones(len(a), bool), np.ones(len(a), bool)
            for t in range(1, PROBE):
                right &= padded[a + t] == padded[b + t]
            for t in range(1, PROBE + 1):
                left &= padded[a - t] == padded[b - t]
            found.append(np.unique(part[i[right | left]]))
        found = np.concatenate(found)
        if len(found):
            yield low, found


def z_function(s: list[int]) -> list[int]:
    """For each place, how many symbols from there on equal those at the beginning."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    a = b = 0
    for i in range(1, n):
        k = min(z[i - a], b - i) if i < b else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z


def _divisors(q: int):
    """q / p for each prime p of q."""
    rest, p = q, 2
    while p * p <= rest:
        if rest % p == 0:
            yield q // p
            while rest % p == 0:
                rest //= p
        p += 1
    if rest > 1:
        yield q // rest


def solved(words: list[int], at: int, low: int, high: int, step: int):
    """(period, matches to the left, to the right) at the boundary ``at`` of a tile: whole intervals long enough for a
    run and those that reach the tile's edge, without periods that repeat a smaller one."""
    right = z_function(words[at:])
    high = min(high, len(right) - 1)
    back = words[at - 1 :: -1] if at else []
    left = z_function([*back, -1, *words[at + high - 1 :: -1]]) if at and high else []
    for q in range(low + 1, high + 1):
        r = min(right[q], step)
        k = min(left[at + 1 + high - q], step) if at else 0
        if k + r and (k == step or r == step or k + r + q >= max(LEAST, TIMES * q)):
            # The run has the words [at, at + q) in it, as a whole number of smaller periods if it repeats one.
            if not any(right[d] >= q - d for d in _divisors(q)):
                yield q, k, r


def _solve(batches):
    for batch in batches:
        rows = []
        for key, low, boundary, at, words in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "boundary", "at", "words"))):
            high, step = max(2 * low, FIRST), 2 * max(low, FIRST)
            for q, k, r in solved(np.frombuffer(words, "<i4").tolist(), at, low, high, step):
                rows.append((key, q, boundary - k, boundary + r))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], ["key", "period", "first", "last"])


def stitched(pieces: DataFrame) -> DataFrame:
    """Intervals (key, period, first, last) of matches that touch or overlap, joined: the runs (key, start, period, length)."""
    by = W.partitionBy("key", "period").orderBy("first", "last")
    before = F.max("last").over(by.rowsBetween(W.unboundedPreceding, -1))
    opens = pieces.withColumn("opens", (F.coalesce(F.col("first") > before, F.lit(True))).cast("long"))
    whole = opens.withColumn("nth", F.sum("opens").over(by)).groupBy("key", "period", "nth").agg(F.min("first").alias("start"), F.max("last").alias("last"))
    runs = whole.select("key", "start", "period", (F.col("last") - F.col("start") + F.col("period")).alias("length"))
    return runs.filter(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those which a run (start, period, length) has after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, period, length in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _laid_out(rewrite: Rewrite | None, texts: bool):
    """Documents as rows: finished ones with the digest (and text) of all their words, others with their tiles."""
    def run(batches):
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets, _ = K.flat(batch.column("text"))
            bodies = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            ids = batch.column("doc_id").to_pylist()
            words = [body.split() for body in bodies]
            if rewrite:
                words = [rewrite(i, w) for i, w in zip(ids, words)]
            sizes = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(sizes)
            flat = list(chain.from_iterable(words))
            number = dict(zip(flat, range(len(flat))))
            codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
            doc = np.repeat(np.arange(len(words)), sizes)
            tiles: dict[int, list[dict]] = {}
            for low, boundaries in probed(doc * (len(flat) + 1) + codes, int(sizes.max(initial=0))):
                high, step = max(2 * low, FIRST), 2 * max(low, FIRST)
                for b in boundaries.tolist():
                    d = int(doc[b])
                    first, last = max(b - step, int(ends[d] - sizes[d])), min(b + step + high, int(ends[d]))
                    tiles.setdefault(d, []).append({
                        "low": low, "boundary": b - int(ends[d] - sizes[d]), "at": b - first, "words": codes[first:last].astype("<i4").tobytes()})
            columns = [], [], [], []
            for d, found in enumerate(words):
                body = None if d in tiles else collapsed(found, [])
                columns[0].append((task << 40) + row + d)
                columns[1].append(bodies[d] if d in tiles else body if texts else None)
                columns[2].append(None if d in tiles else _sha(body))
                columns[3].append(tiles.get(d))
            row += len(words)
            kind = pa.list_(pa.struct([("low", pa.int64()), ("boundary", pa.int64()), ("at", pa.int64()), ("words", pa.binary())]))
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.string(), kind))]
            yield pa.RecordBatch.from_arrays([arrays[0], batch.column("doc_id"), *arrays[1:]], ["key", "doc_id", "text", "sha", "tiles"])

    return run


FOUND = f"doc_id bigint, runs {SPANS}, best struct<start: bigint, period: bigint, length: bigint>, runs_sha256 string, collapsed_sha256 string"


def _finished(rewrite: Rewrite | None, texts: bool):
    span = pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, body, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = body.split()
                if rewrite:
                    words = rewrite(doc_id, words)
                runs = sorted((r["start"], r["period"], r["length"]) for r in found or ())
                listed = "".join(f"{s},{n},{p}\n" for s, p, n in runs)
                kept, best = collapsed(words, runs), strongest(runs)
                rows.append((doc_id, [dict(zip(("start", "period", "length"), r)) for r in runs], best and dict(zip(("start", "period", "length"), best)),
                             _sha(listed.encode()), _sha(kept), kept if texts else None))
            kinds = (pa.int64(), pa.list_(span), span, pa.string(), pa.string(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "runs", "best", "runs_sha256", "collapsed_sha256", "text"])

    return run


def period_runs(docs: DataFrame, rewrite: Rewrite | None = None, texts: bool = False) -> DataFrame:
    """docs (doc_id, text). Returns a row per row: (doc_id, runs, best, runs_sha256, collapsed_sha256[, text]).

    Words end at ASCII white space. ``runs`` are the maximal stretches of at least 24 words and three smallest periods,
    as (start, period, length) by start and period; ``best`` has the greatest length / period (ties: smallest start,
    then period; null without a run). ``text`` (with ``texts``) is what is left when every run keeps its first period,
    joined by single spaces, as bytes. ``rewrite`` (doc_id, words) may change the words first. A null or empty text has
    no words. Repeated rows are judged one by one, rows without an id take no part, an empty table gives no rows,
    further columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("doc_id is not null")
    schema = f"key bigint, doc_id bigint, text binary, sha string, tiles {TILES}"
    # Stored, so that a lost task cannot number its rows anew while others use the old numbers.
    laid = written(source.mapInArrow(_laid_out(rewrite, texts), schema), "run-tiles")
    tiled = laid.filter("sha is null")
    tiles = tiled.select("key", F.explode("tiles").alias("t")).select("key", "t.*").repartition("key", "low", "boundary")
    runs = stitched(tiles.mapInArrow(_solve, "key bigint, period bigint, first bigint, last bigint"))
    grouped = runs.groupBy("key").agg(F.collect_list(F.struct("start", "period", "length")).alias("runs"))  # one document's
    joined = tiled.select("key", "doc_id", "text").join(grouped, "key", "left").select("doc_id", "text", "runs")
    found = joined.mapInArrow(_finished(rewrite, texts), FOUND + ", text binary")
    empty = hashlib.sha256(b"").hexdigest()
    clean = laid.filter("sha is not null").select(
        "doc_id", F.array().cast(SPANS).alias("runs"), F.lit(None).cast("struct<start: bigint, period: bigint, length: bigint>").alias("best"),
        F.lit(empty).alias("runs_sha256"), F.col("sha").alias("collapsed_sha256"), "text")
    both = clean.unionByName(found)
    return both if texts else both.drop("text")
