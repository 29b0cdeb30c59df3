"""Numpy kernels over blocks of UTF-8 bytes, used inside Spark tasks.

All hashes are 64-bit polynomials over a fixed random table, so equal strings get equal values in every
task. Work is cut into slices, so memory follows the slice, not the batch or the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 19  #: bytes worked on at a time: their arrays stay in a core's cache
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
SHINGLE = 5

_letters = np.arange(256, dtype=np.uint8)
LOWER = np.where((_letters >= 65) & (_letters <= 90), _letters + 32, _letters).astype(np.uint8)
SPACE = np.isin(_letters, [9, 10, 11, 12, 13, 32])
TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
WORD_TABLE = np.where(SPACE, np.uint64(0), TABLE[LOWER] | np.uint64(1))
_powers: dict[str, np.ndarray] = {}


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; those of a slice are kept."""
    if n > SLICE or len(_powers.get("up", ())) < n:
        up, down = (np.full(max(n, SLICE), np.uint64(b)) for b in (BASE, pow(BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n > SLICE:
            return up[:n], down[:n]
        _powers.update(up=up, down=down)
    return _powers["up"][:n], _powers["down"][:n]


def owners(offsets: np.ndarray, a: int, b: int) -> tuple[int, np.ndarray]:
    """(first document, bytes of each document from it on) of the bytes [a, b)."""
    first = int(np.searchsorted(offsets, a, "right")) - 1
    last = int(np.searchsorted(offsets, b, "left"))
    return first, np.diff(np.clip(offsets[first : last + 1], a, b))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & MASK)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets, validity) of a binary or string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0], valid


def document_slices(offsets: np.ndarray, limit: int = SLICE):
    """Ranges [a, b) of whole documents of at most ``limit`` bytes together (or one longer document)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def _word_cuts(data: np.ndarray, offsets: np.ndarray):
    """Cuts between words, so that each piece has about SLICE bytes (more only inside one longer word)."""
    pos, n = 0, len(data)
    while pos < n:
        end = min(pos + SLICE, n)
        if end < n:
            spaces = np.flatnonzero(SPACE[data[pos:end]])
            edge = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            cut = max(pos + int(spaces[-1]) + 1 if len(spaces) else pos, edge)
            while cut <= pos and end < n:  # inside one word: look further on
                far = min(end + SLICE, n)
                spaces = np.flatnonzero(SPACE[data[end:far]])
                at = int(np.searchsorted(offsets, end, "right"))
                cut = min(end + int(spaces[0]) + 1 if len(spaces) else far, int(offsets[at]) if at < len(offsets) else n)
                if len(spaces) == 0 and cut == far < n and far not in offsets:
                    cut, end = pos, far
            end = cut if cut > pos else n
        yield pos, end
        pos = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words of each document); A-Z are lower-cased, words end at ASCII white space."""
    found, places = [], []
    for a, b in _word_cuts(data, offsets):
        x = data[a:b]
        solid = ~SPACE[x]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        edges = offsets[(offsets >= a) & (offsets < b)] - a
        first[edges] = solid[edges]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        n = len(x)
        up, down = powers(n)
        found.append(mix(np.add.reduceat(WORD_TABLE[x] * up, starts) * down[starts]))
        places.append(starts + a)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(places), offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, offsets by document); fewer words than ``width`` are one shingle, none are none."""
    words, counts = word_hashes(data, offsets)
    n, ends = len(counts), np.cumsum(counts)
    begins = ends - counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    one = []
    for d in short:
        h = 0
        for w in words[begins[d] : ends[d]].tolist():
            h = (h * BASE + w) & MASK
        one.append((h + int(counts[d])) & MASK)
    parts, owner = [mix(np.array(one, np.uint64), 1)], [short]
    if len(words) >= width:
        h = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            h = h * np.uint64(BASE) + words[k : len(words) - width + 1 + k]
        doc = np.repeat(np.arange(n), counts)
        inside = doc[: len(h)] == doc[width - 1 :]
        parts.append(mix(h[inside], 2))
        owner.append(doc[: len(h)][inside])
    h, doc = np.concatenate(parts), np.concatenate(owner)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(n + 1))


def gram_hashes(x: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of the strings of the given lengths at every place, by doubling: a string is the pair of its halves."""
    have = {1: TABLE[x]}
    n = 1
    while 2 * n <= max(lengths):
        if len(x) >= 2 * n:
            have[2 * n] = have[n][:-n] * power(n) + have[n][n:]
        else:
            have[2 * n] = np.zeros(0, np.uint64)
        n *= 2
    out = {}
    for length in lengths:
        size = max(len(x) - length + 1, 0)
        h, done = None, 0
        for p in sorted((k for k in have if k & length), reverse=True):
            part = have[p][done : done + size]
            h = part.copy() if h is None else h * power(p) + part
            done += p
        out[length] = h
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x
