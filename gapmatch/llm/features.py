"""Hashed text features for the classifiers, and the fit of a model on a bounded sample inside one task.

A text gives the set of its words (runs of letters; bytes over 127 count as letters), the set of their four-byte
beginnings, and a few bucketed statistics of its form. Each is hashed into ``BITS`` bits; every word feature
weighs the same however often it occurs, so a few marked words count in a long text as in a short one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytes_kernel as K
from .batches import bounded_batches

BITS = 20
HEAD = 4  #: bytes in the beginning of a word
FORM = 64  #: the first places are kept for statistics of form

_bytes = np.arange(256)
LETTER = (_bytes >= 128) | ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122))
UPPER = (_bytes >= 65) & (_bytes <= 90)
SIGN = ~LETTER & ~K.SPACE & ~((_bytes >= 48) & (_bytes <= 57))


def _places(h: np.ndarray) -> np.ndarray:
    return (FORM + h % np.uint64((1 << BITS) - FORM)).astype(np.int64)


def _piece(x: np.ndarray, doc_of: np.ndarray):
    """(document, hash) of the words and beginnings in a piece of text."""
    solid = LETTER[x]
    first, last = solid.copy(), solid.copy()
    edge = doc_of[1:] != doc_of[:-1]
    first[1:] &= ~solid[:-1] | edge
    last[:-1] &= ~solid[1:] | edge
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = K.TABLE[K.LOWER[x]]
    code[~solid] = 0
    up, down = K.powers(len(x))
    word = np.add.reduceat(code * up, starts) * down[starts]
    head = np.zeros(len(starts), np.uint64)
    for k in range(HEAD):
        inside = starts + k < ends
        head[inside] += code[starts[inside] + k] * K.power(k)
    doc = doc_of[starts]
    long = ends - starts > HEAD
    return doc, K.mix(word, 21), doc[long], K.mix(head[long], 22)


def hashed(data: np.ndarray, offsets: np.ndarray, form: bool = False):
    """(document, place) pairs, distinct and sorted, of a slice of documents; ``form`` adds the statistics."""
    docs = len(offsets) - 1
    found = []
    words = np.zeros(docs)
    for a in range(0, len(data), K.SLICE):  # a word across two pieces counts as two: a fixed rule, as slices start at documents
        b = min(a + K.SLICE, len(data))
        d, sizes = K.owners(offsets, a, b)
        doc_of = np.repeat(np.arange(d, d + len(sizes)), sizes)
        d1, w, d2, h = _piece(data[a:b], doc_of)
        words += np.bincount(d1, minlength=docs)
        found.append(np.unique(np.concatenate([d1, d2]) << BITS | _places(np.concatenate([w, h]))))
    keys = np.unique(np.concatenate(found)) if len(found) > 1 else (found[0] if found else np.zeros(0, np.int64))
    if form:
        size = np.maximum(np.diff(offsets), 1)

        def share(mask: np.ndarray) -> np.ndarray:
            total = np.r_[0, np.cumsum(mask[data])]
            return (total[offsets[1:]] - total[offsets[:-1]]) / size

        kinds = np.bincount(keys >> BITS, minlength=docs) / np.maximum(words, 1)
        # Distinct words fall as texts grow: compare with the square root of the length.
        spread = np.minimum(kinds * np.sqrt(np.maximum(words, 1)) / 2, 15)
        stats = [np.minimum(share(UPPER) * 30, 15), np.minimum(share(SIGN) * 60, 15), spread, np.minimum(np.log2(words + 1), 15)]
        extra = [(np.arange(docs) << BITS) | (k * 16 + v.astype(np.int64)) for k, v in enumerate(stats)]
        keys = np.unique(np.concatenate([keys, *extra]))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def feature_rows(form: bool):
    """(target, text) rows to (target, places) rows, in tasks."""
    def run(batches):
        for batch in batches:
            data, offsets, _ = K.flat(batch.column(1))
            for a, b in K.document_slices(offsets):
                doc, place = hashed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], form)
                edges = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(edges), pa.array(place.astype(np.int32)))], ["target", "places"])
    return run


def sparse(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, places) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    o = column.offsets.to_numpy()
    return (o - o[0]).astype(np.int64), column.values.to_numpy()[o[0] : o[-1]].astype(np.int64)


def totals(weights: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    c = np.r_[0.0, np.cumsum(weights[places])]
    return c[offsets[1:]] - c[offsets[:-1]]


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
        v = self.v[name] = 0.999 * self.v.get(name, 0) + 0.001 * g * g
        return x - self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def gradient(offsets: np.ndarray, places: np.ndarray, slope: np.ndarray) -> np.ndarray:
    return np.bincount(places, np.repeat(slope, np.diff(offsets)), 1 << BITS)


def fit_in_one_task(sample: DataFrame, form: bool, fit) -> bytes:
    """sample (target double, text), of a bounded number of rows. ``fit(target, offsets, places)`` returns bytes."""
    rows = sample.select(F.col("target").cast("double"), F.col("text").cast("binary").alias("text")).mapInArrow(
        feature_rows(form), "target double, places array<int>")

    def run(table: pa.Table) -> pa.Table:
        offsets, places = sparse(table.column("places"))
        return pa.table({"model": pa.array([fit(table.column("target").to_numpy(), offsets, places)], pa.binary())})

    found = rows.groupBy(F.lit(0).alias("one")).applyInArrow(run, "model binary").first()
    return bytes(found["model"]) if found else b""


def first_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of docs for a bounded number of ids, a row per id: of several the text with the least hash."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    return texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def scored(docs: DataFrame, form: bool, names: list[str], value) -> DataFrame:
    """docs (doc_id, text): ``value(offsets, places)`` gives a list of double arrays, named ``names``."""
    def run(batches):
        for batch in batches:
            data, offsets, _ = K.flat(batch.column(1))
            for a, b in K.document_slices(offsets):
                doc, place = hashed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], form)
                out = value(np.searchsorted(doc, np.arange(b - a + 1)), place)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, out)], ["doc_id", *names])

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).filter("doc_id is not null")
    return source.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} double" for n in names)]))


def fold(id_: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(parts))
