"""Hashed text vectors.

Features (words, character 4-grams, adjacent pairs) go to signed buckets of a fixed-width vector.
The vector is built per row from the token array in one Arrow UDF, which reads and writes Arrow's own
buffers. The all-SQL form would
explode some three hundred features per chunk and shuffle them back together; here the index build
stays a narrow stage whose cost grows with the text and nothing else.

An embedder is any function from a text Column to an ``array<float>`` Column: pass your own (for
example an iterator ``pandas_udf`` that loads a model once per executor) wherever one is accepted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import fixed as K
from ..functions import text as T

Embedder = Callable[[Column], Column]


SLICE = 2000  # rows assembled at a time; bounds the cell arrays of a batch
WORDS, GRAMS, PAIRS = 1 << 18, 1 << 18, 1 << 18  # words, pieces and pairs that a task remembers: some 100 MB
_HASHED = 8192  # features hashed side by side: their 16 words stay in a core's cache
_ONE_BLOCK = 55  # bytes that md5 takes in a single block
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def _md5_blocks(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of md5 (RFC 1321) of texts of one block each: ``rows`` are their bytes, 64 a text, those beyond
    the length being anything."""
    rows = np.where(np.arange(64) < lengths[:, None], rows, 0).astype(np.uint8)
    rows[np.arange(len(rows)), lengths] = 0x80
    words = np.ascontiguousarray(rows.view("<u4").T)
    words[14] = lengths * 8
    full = words.any(axis=1)
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(rows), x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            mixed, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, at = c ^ (b | ~d), 7 * i % 16
        mixed += a
        mixed += np.uint32(_SINES[i])
        if full[at]:
            mixed += words[at]
        turn = _TURNS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + ((mixed << np.uint32(turn)) | (mixed >> np.uint32(32 - turn)))
    return a + start[0], b + start[1]


def _md5_heads(features: pa.Array) -> np.ndarray:
    """The first eight digest bytes of features, a row each."""
    ends = np.frombuffer(features.buffers()[1], np.int32)[features.offset : features.offset + len(features) + 1].astype(np.int64)
    lengths = np.diff(ends)
    data = features.buffers()[2]
    data = np.concatenate([np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8), np.zeros(64, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(data, 64)
    out = np.zeros((len(features), 2), "<u4")
    for lo in range(0, len(features), _HASHED):
        part = slice(lo, lo + _HASHED)
        out[part, 0], out[part, 1] = _md5_blocks(windows[ends[:-1][part] - ends[0]], np.minimum(lengths[part], _ONE_BLOCK))
    out = out.view(np.uint8)
    for at in np.flatnonzero(lengths > _ONE_BLOCK).tolist():
        out[at] = np.frombuffer(hashlib.md5(features[at].as_py().encode("utf-8"), usedforsecurity=False).digest(), np.uint8)[:8]
    return out


def _heads(features: pa.Array, digest: str) -> np.ndarray:
    if digest == "md5":
        return _md5_heads(features)
    options = {"digest_size": 8} if digest == "blake2b" else {"usedforsecurity": False}
    make = getattr(hashlib, digest)
    raw = b"".join([make(f.encode("utf-8"), **options).digest()[:8] for f in features.to_pylist()])
    return np.frombuffer(raw, np.uint8).reshape(len(features), 8)


def _hasher(dim: int, digest: str):
    """features -> codes: the cell from the first four digest bytes, as ``~cell`` where the lowest bit of the fifth is 0."""

    def codes(features: list | pa.Array) -> np.ndarray:
        found = _heads(features if isinstance(features, pa.Array) else pa.array(features, pa.string()), digest)
        cell = found[:, :4].copy().view(">u4").reshape(-1).astype(np.int64) % dim
        return np.where(found[:, 4] & 1, cell, ~cell)

    return codes


def _cells(codes: np.ndarray, weight) -> tuple[np.ndarray, np.ndarray]:
    return np.where(codes < 0, ~codes, codes), np.where(codes < 0, -1.0, 1.0) * weight


class Features:
    """Cells and weights of words and word pairs, for one task. Each is hashed when it is first met and remembered: words
    and pieces until there are too many, pairs while there is room; what is remembered changes no vector."""

    def __init__(self, dim: int, digest: str):
        self.dim, self.hashed = dim, _hasher(dim, digest)
        self.gram: dict = {}
        self.forget()

    def forget(self) -> None:
        self.number: dict = {}
        self.pairs, self.pair_codes = pd.Index(np.zeros(0, np.int64)), np.zeros(0, np.int64)
        self.counts, self.cells, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def _gram_codes(self, grams: list) -> np.ndarray:
        if len(self.gram) > GRAMS:
            self.gram.clear()
        new = [g for g in dict.fromkeys(grams) if g not in self.gram]
        if new:
            self.gram.update(zip(new, self.hashed(["g:" + g for g in new]).tolist()))
        return np.array([self.gram[g] for g in grams], dtype=np.int64)

    def of_words(self, words: list) -> np.ndarray:
        """Numbers of distinct words; their features lie flattened in ``counts``, ``cells`` and ``weights``."""
        if len(self.number) > WORDS:
            self.forget()
        new = [w for w in words if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            grams = [w[i : i + 4] for w in new if len(w) >= 5 for i in range(len(w) - 3)]
            counts = np.array([len(w) - 2 if len(w) >= 5 else 1 for w in new])
            head = np.cumsum(counts) - counts  # the word itself comes before its grams
            codes, weight = np.zeros(counts.sum(), np.int64), np.full(counts.sum(), K.GRAM_WEIGHT)
            inner = np.ones(len(codes), bool)
            inner[head] = False
            codes[head], weight[head] = self.hashed(["w:" + w for w in new]), K.WORD_WEIGHT
            codes[inner] = self._gram_codes(grams)
            cells, weights = _cells(codes, weight)
            self.counts, self.cells, self.weights = (
                np.concatenate(x) for x in ((self.counts, counts), (self.cells, cells), (self.weights, weights)))
        return np.array([self.number[w] for w in words], dtype=np.int64)

    def of_pairs(self, words: pa.Array, left: np.ndarray, right: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, weights) of distinct pairs of words, given by place in ``words`` and by the numbers of both."""
        place = self.pairs.get_indexer(keys)
        new = np.flatnonzero(place < 0)
        codes = self.pair_codes[place] if len(self.pairs) else np.zeros(len(keys), np.int64)
        if len(new):
            first = pc.binary_join_element_wise(pa.scalar("b", words.type), words.take(pa.array(left[new])), ":")
            made = self.hashed(pc.binary_join_element_wise(first, words.take(pa.array(right[new])), "_"))
            codes[new] = made
            if len(self.pairs) < PAIRS:
                self.pairs, self.pair_codes = pd.Index(np.concatenate([self.pairs, keys[new]])), np.concatenate([self.pair_codes, made])
        return _cells(codes, K.PAIR_WEIGHT)


def _sums(code: np.ndarray, words: pa.Array, lengths: np.ndarray, known: Features) -> np.ndarray:
    """Sums of weights by cell of a slice of rows, given by the words of all rows as places in ``words`` and the rows' lengths: every
    distinct word and word pair is looked up once, then spread over the rows by index arithmetic."""
    dim = known.dim
    if not len(code):
        return np.zeros((len(lengths), dim))
    row = np.repeat(np.arange(len(lengths)), lengths)
    number = known.of_words(words.to_pylist())
    starts = np.cumsum(known.counts) - known.counts
    many, first = known.counts[number][code], starts[number][code]
    take = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    at, value = np.repeat(row, many) * dim + known.cells[take], known.weights[take]

    near = row[1:] == row[:-1]
    pair, distinct = pd.factorize(code[:-1][near] * len(words) + code[1:][near])
    if len(distinct):
        left, right = np.divmod(distinct, len(words))
        cell, weight = known.of_pairs(words, left, right, (number[left] << 32) + number[right])
        at = np.concatenate([at, row[:-1][near] * dim + cell[pair]])
        value = np.concatenate([value, weight[pair]])
    return np.bincount(at, value, len(lengths) * dim).reshape(len(lengths), dim)


def _units(sums: np.ndarray) -> np.ndarray:
    norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return (sums / np.where(norm == 0, 1.0, norm)).astype(np.float32)


def _slices(tokens: pa.ListArray, known: Features) -> Iterator[np.ndarray]:
    for lo in range(0, len(tokens), SLICE):
        part = tokens.slice(lo, SLICE)
        lengths = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = part.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        yield _sums(code, coded.dictionary, lengths, known)


def unit_rows(tokens: pa.ListArray, known: Features) -> np.ndarray:
    """float32 vectors of rows of tokens."""
    return np.concatenate([np.zeros((0, known.dim), np.float32), *(_units(sums) for sums in _slices(tokens, known))])


def hashed_embedder(dim: int = K.VECTOR_DIM, digest: str = "md5") -> Embedder:
    """Signed feature hashing to unit vectors.

    The digest is the only free choice. ``md5`` can be recomputed by any SQL engine; ``blake2b``
    takes an 8-byte digest. ``of_tokens`` of the embedder takes the tokens of a text in place of the text.
    """

    @F.arrow_udf("array<float>")
    def embed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Features(dim, digest)
        for tokens in parts:
            rows = unit_rows(tokens, known)
            ends = np.arange(0, rows.size + 1, dim, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))

    @F.arrow_udf("binary")
    def packed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Features(dim, digest)
        for tokens in parts:
            yield pa.array([code for sums in _slices(tokens, known) for code in _packed_sums(sums)], pa.binary())

    def of_text(text: Column) -> Column:
        return embed(T.tokens(text))

    of_text.of_tokens, of_text.packed_of_tokens = embed, packed
    return of_text


# --- stored vectors ----------------------------------------------------------------------
# A vector of hashed features is a row of small whole numbers over their norm. It is stored as these numbers, of one or two
# bytes each, if they give the same float32 numbers again, and as the float32 bytes otherwise. The number of bytes tells
# which: 4 for each dimension, 1 and 1 more, or 2 and 2 more; dimensions are a multiple of 4 for the last two.
WHOLE = 20  # the weights of features are whole in units of 1 / WHOLE
SMALLEST = 64  # the least of a row's whole numbers that is looked for


def _coded(rows: np.ndarray, whole: np.ndarray, good: np.ndarray) -> list:
    """Stored float32 rows, those that are ``good`` by the whole numbers they are multiples of, if these give them again."""
    top = np.abs(whole).max(axis=1, initial=0)
    good = good & (top < 1 << 15) & (rows.shape[1] % 4 == 0)
    good[good] = (_units(whole[good].astype(np.float64)) == rows[good]).all(axis=1)
    byte, two = whole.astype(np.int8), whole.astype("<i2")
    raw = np.ascontiguousarray(rows, "<f4")
    return [(byte[i].tobytes() + b"\0" if top[i] < 128 else two[i].tobytes() + b"\0\0") if ok else raw[i].tobytes() for i, ok in enumerate(good.tolist())]


def _packed_sums(sums: np.ndarray) -> list:
    """Stored vectors of sums of weights: whole numbers without a common factor."""
    whole = np.rint(sums * WHOLE).astype(np.int64)
    common = np.flatnonzero(~(np.abs(whole) == 1).any(axis=1))
    whole[common] //= np.maximum(np.gcd.reduce(whole[common], axis=1, keepdims=True), 1)
    return _coded(_units(sums), whole, np.ones(len(whole), bool))


def _packed_rows(rows: np.ndarray) -> list:
    """Stored vectors of float32 rows, whose whole numbers are looked for: the least of a row is 1, or 2, and so on."""
    size = np.abs(rows).astype(np.float64)
    least = np.where(size > 0, size, np.inf).min(axis=1, initial=np.inf)
    whole, good = np.zeros(rows.shape, np.int64), (rows == 0).all(axis=1)
    open_ = np.flatnonzero(np.isfinite(least) & np.isfinite(rows).all(axis=1) & (size.max(axis=1, initial=0) * SMALLEST < least * (1 << 31)))
    for q in range(1, SMALLEST + 1):
        tried = rows[open_] * (q / least[open_])[:, None]
        near = np.rint(tried)
        hit = (np.abs(tried - near) < 1e-3).all(axis=1)
        hit[hit] = (_units(near[hit]) == rows[open_][hit]).all(axis=1)
        whole[open_[hit]], good[open_[hit]] = near[hit].astype(np.int64), True
        open_ = open_[~hit]
    return _coded(rows, whole, good)


def stored_rows(stored) -> np.ndarray:
    """The float32 rows of stored vectors of one width."""
    sizes = np.array([len(v) for v in stored])
    kind, size = sizes % 4, sizes[0] if len(sizes) else 0
    out = np.empty((len(sizes), (size // 4, size - 1, size // 2 - 1)[size % 4]), np.float32)
    for k, form, more in ((0, "<f4", 0), (1, np.int8, 1), (2, "<i2", 1)):
        at = np.flatnonzero(kind == k)
        if len(at):
            rows = np.frombuffer(b"".join([stored[i] for i in at]), form).reshape(len(at), -1)
            out[at] = _units(rows[:, :-1].astype(np.float64)) if more else rows
    return out


@F.arrow_udf(types.BinaryType())
def pack(vectors: pa.Array) -> pa.Array:
    """``array<float>`` vectors as they are stored in an index, one value a row."""
    rows, codes = vectors.to_pylist(), [None] * len(vectors)
    for width in {len(v) for v in rows if v is not None}:
        at = [i for i, v in enumerate(rows) if v is not None and len(v) == width]
        for i, code in zip(at, _packed_rows(np.array([rows[i] for i in at], np.float32).reshape(len(at), width))):
            codes[i] = code
    return pa.array(codes, pa.binary())


@F.arrow_udf(types.ArrayType(types.FloatType()))
def unpack(stored: pa.Array) -> pa.Array:
    """Stored vectors as ``array<float>``."""
    return pa.array([None if v is None else stored_rows([v])[0] for v in stored.to_pylist()], pa.list_(pa.float32()))
