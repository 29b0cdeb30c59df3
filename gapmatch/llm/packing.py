"""Best-fit packing of documents into sequences by bin completion.

Lengths are whole numbers up to the capacity, so the whole problem is a histogram of at most ``capacity`` counts:
bounded at any corpus size. On it the packing is searched as patterns with multiplicities: best-fit decreasing
gives the first incumbent; branch and bound then completes the largest length with undominated fillings and cuts
branches whose waste shows they cannot beat the incumbent. A pattern used a million times is one row.

Pieces get their places in Spark: each takes a rank among the pieces of its length (within bounded groups whose
sizes are known), and ranks are ranges in the plan.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written
from . import bytes_kernel as K
from .batches import bounded_batches, tidied

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
WORDS = 1_000_000  #: words remembered by a worker, about 0.2 KB each
SIGNS = b".,;:!?"
TEXT = 1 << 18  #: bytes of text whose words are looked up together
COMPLETIONS = 4  #: fillings tried per largest length
BRANCHES = 24  #: lengths tried as the first of a filling
GROUP = 128  #: pieces ranked together at least


class _Tokens:
    """Token ids of texts. The tokenizer drops white space and never joins across it, so words are encoded once."""

    def __init__(self, path: str, words: int = WORDS):
        self.words = words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the one it has
        from tokenizers import Tokenizer

        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix or "\0"
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        self.folds = ids("AZ") == ids("az")
        self.signs = SIGNS if ids("az.") == ids("az") + ids(".") else b""
        self.clear()

    def clear(self) -> None:
        self.code: dict[bytes, int] = {}
        self.start, self.size, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each).

        Letters are one unit of the tokenizer, and a unit's last id tells that it is the last. Where that does not add
        up, a token belongs to the word in which it starts.
        """
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        units = np.cumsum([1 if w.isalpha() else len(ids) + 1 for w in words])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == units[-1] and (len(ids) == 0 or ends[-1] == len(ids)):
            return ids, np.diff(ends[units - 1], prepend=0)
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
        return ids, np.diff(np.searchsorted(starts, begins))

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.code)
        while n + len(words) > len(self.start):
            self.start, self.size = (np.resize(x, 2 * len(x)) for x in (self.start, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(words)] = sizes
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.code.update(zip(words, range(n, n + len(words))))
        self.used += len(ids)

    def _looked_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[codes]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[codes] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size

    def _learn(self, words: list[bytes]) -> None:
        """Letters and the signs that close them are units of the tokenizer: such a word is its letters' ids, then its signs'."""
        closed, plain, other = [], {}, {}
        for w in words:
            core = w.rstrip(self.signs) if self.signs else w
            text = core.decode("utf-8", "replace")
            if not text.isalpha():
                other[w] = w.decode("utf-8", "replace")
                continue
            if core not in self.code:
                plain[core] = text
            if len(core) < len(w):
                sign = w[len(core) :]
                closed.append((w, core, sign))
                if sign not in self.code:
                    other[sign] = sign.decode()
        for part in (x[a : a + 4000] for x in (list(plain.items()), list(other.items())) for a in range(0, len(x), 4000)):
            self._add([w for w, _ in part], *self._encoded([t for _, t in part]))
        if closed:
            pairs = np.array([(self.code[core], self.code[sign]) for _, core, sign in closed], np.int64)
            ids, sizes = self._looked_up(pairs.ravel())
            self._add([w for w, _, _ in closed], ids, sizes.reshape(-1, 2).sum(1))

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each)."""
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(codes < 0)
        if len(missed):
            new = list(dict.fromkeys(words[i] for i in missed.tolist()))
            if len(self.code) + len(new) > self.words:
                self.clear()
                missed = np.arange(len(words))
                new = list(dict.fromkeys(words))
            self._learn(new)
            codes[missed] = [self.code[words[i]] for i in missed.tolist()]
        return self._looked_up(codes)

    def _folded(self, body: bytes) -> bytes:
        """A-Z in lower case, if the tokenizer does so first; not where a special token may be spelt."""
        return body.lower() if self.folds and b"<|" not in body else body

    def texts(self, bodies: list[bytes]):
        """Ids of every text, many short texts (or one piece of a long one) at a time."""
        at = 0
        while at < len(bodies):
            if len(bodies[at]) > TEXT:
                yield np.concatenate([self.ids(p.split())[0] for p in _pieces(self._folded(bodies[at]))])
                at += 1
                continue
            words, counts, size = [], [], 0
            while at < len(bodies) and size + len(bodies[at]) <= TEXT:
                found = self._folded(bodies[at]).split()
                words += found
                counts.append(len(found))
                size += len(bodies[at])
                at += 1
            ids, each = self.ids(words)
            edges = np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(counts)]]
            yield from (ids[a:b] for a, b in zip(edges[:-1], edges[1:]))


def _pieces(body: bytes):
    """A long text in pieces that end at white space."""
    a = 0
    while a < len(body):
        b = a + TEXT
        while b < len(body) and body[b] not in b" \t\n\r\x0b\x0c":
            b += 1
        yield body[a:b]
        a = b


@lru_cache(maxsize=1)
def _tokens(path: str, words: int) -> _Tokens:
    return _Tokens(path, words)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False, words: int = WORDS) -> DataFrame:
    """docs (doc_id, text) as (doc_id, piece, start, length, ids_crc32[, ids]): token ids and a closing 0, cut at the capacity."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets, _ = K.flat(batch.column(1))
            tokens, rows = _tokens(tokenizer, words), []
            bodies = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            for doc, got in zip(ids, tokens.texts(bodies)):
                found = np.append(got, np.uint32(0)).astype("<u4")
                for k, s in enumerate(range(0, len(found), capacity)):
                    part = found[s : s + capacity]
                    rows.append((doc, k, s, len(part), zlib.crc32(part.tobytes())) + ((part.astype(np.int32).tolist(),) if with_ids else ()))
                if len(rows) >= 4096 or (with_ids and len(rows) >= 256):
                    yield _rows(rows, with_ids)
                    rows = []
            if rows:
                yield _rows(rows, with_ids)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).filter("doc_id is not null")
    return source.mapInArrow(tidied(run), PIECES + (", ids array<int>" if with_ids else ""))


def _rows(rows, with_ids):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 if with_ids else 5]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths of a sequence, how often)."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: []}
    room = np.zeros(capacity + 1, np.int64)  # sequences open at each residual
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            open_ = np.flatnonzero(room[length:capacity])
            if len(open_):
                gap = length + int(open_[0])
                lengths, many = bins[gap].pop()
                room[gap] -= many
            else:
                gap, lengths, many = capacity, (), left
            each = min(gap // length, left)
            take = min(many, left // each)
            if take < many and lengths:
                bins[gap].append((lengths, many - take))
                room[gap] += many - take
            rest = gap - each * length
            bins.setdefault(rest, []).append((lengths + (length,) * each, take))
            room[rest] += take
            left -= take * each
    return [b for group in bins.values() for b in group]


def completions(counts: np.ndarray, room: int, limit: int = COMPLETIONS) -> list[tuple[int, ...]]:
    """Undominated fillings of the room with the lengths left, fullest first.

    The first two lengths are branched on, the rest is the longest that fits, again and again. A filling is dominated
    if one of its lengths, or two of them together, can be exchanged for a longer single one that is left and fits.
    """
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0].tolist()
    lefts = np.cumsum(counts > 0)

    def rest_of(rest: int, chosen: dict[int, int]) -> int:
        at = bisect_right(have, rest) - 1
        while at >= 0:
            x = have[at]
            k = min(int(counts[x]) - chosen.get(x, 0), rest // x)
            if k > 0:
                chosen[x] = chosen.get(x, 0) + k
                rest -= k * x
            at = min(at - 1, bisect_right(have, rest) - 1)
        return rest

    def dominated(chosen: dict[int, int], slack: int) -> bool:
        kinds = sorted(chosen)[-12:]
        sums = {*kinds, *(a + b for i, a in enumerate(kinds) for b in kinds[i + (chosen[a] < 2) :])}
        for c in sums:
            low, high = (c if c in chosen else c - 1), min(c + slack, len(counts) - 1)
            if low < high and lefts[high] > lefts[low] and any(counts[x] > chosen.get(x, 0) for x in range(low + 1, high + 1)):
                return True
        return False

    found: dict[tuple[int, ...], int] = {}
    for first in have[: -BRANCHES - 1 : -1]:
        at = bisect_right(have, room - first) - 1
        for second in [0] if at < 0 else have[at : max(at - 2, -1) : -1] if at > 1 else have[: at + 1]:
            chosen = {first: 1}
            if second:
                if counts[second] <= chosen.get(second, 0):
                    continue
                chosen[second] = chosen.get(second, 0) + 1
            slack = rest_of(room - first - second, chosen)
            if not slack or not dominated(chosen, slack):
                found[tuple(x for x in sorted(chosen, reverse=True) for _ in range(chosen[x]))] = room - slack
        if sum(v == room for v in found.values()) >= limit:
            break
    if not found and have:
        chosen = {}
        slack = rest_of(room, chosen)
        found[tuple(x for x in sorted(chosen, reverse=True) for _ in range(chosen[x]))] = room - slack
    return sorted(found, key=lambda f: (-found[f], len(f)))[:limit] or [()]


def plan(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = 12000) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence, how often) that use every piece once, in as few sequences as found.

    ``counts[n]`` is the number of pieces of length n. The search ends when the incumbent meets the lower bound, or
    after ``nodes`` branches; then the incumbent stands.
    """
    counts = counts.astype(np.int64)
    lengths = np.arange(len(counts))
    total = int((counts * lengths).sum())
    # Pieces over half need a sequence each; what is left over must fit into their room or into more sequences.
    bound = max(-(-total // capacity), int(counts[capacity // 2 + 1 :].sum()))
    best = best_fit(counts, capacity)
    used = sum(m for _, m in best)
    stack = [(counts, (), 0, 0)]
    while stack and used > bound and nodes:
        nodes -= 1
        left, done, n, waste = stack.pop()
        if not left.any():
            if n < used:
                best, used = [], n
                while done:
                    done, pattern = done
                    best.append(pattern)
            continue
        rest = int((left * lengths).sum())
        if n + -(-rest // capacity) >= used or waste > (used - 1) * capacity - total:
            continue
        largest = int(np.flatnonzero(left)[-1])
        head = left.copy()
        head[largest] -= 1
        for filling in reversed(completions(head, capacity - largest)):
            pattern = (largest, *filling)
            kinds, times = np.unique(pattern, return_counts=True)
            many = int((left[kinds] // times).min())
            after = left.copy()
            after[kinds] -= times * many
            stack.append((after, (done, (pattern, many)), n + many, waste + many * (capacity - sum(pattern))))
    return best


def _slots(patterns, capacity: int):
    """By length: first ranks, first sequence numbers and offsets of the ranges of ranks, ascending."""
    at: dict[int, list[tuple[int, int, int]]] = {}
    next_rank = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for lengths, many in patterns:
        offset = 0
        for n in lengths:
            at.setdefault(n, []).append((int(next_rank[n]), sequence, offset))
            next_rank[n] += many
            offset += n
        sequence += many
    return {n: np.array(rows, np.int64) for n, rows in at.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds (sequence_id, offset) to a stored table of pieces (doc_id, piece, length, ...), each of 1 to ``capacity``."""
    spark = parts.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = max(GROUP, int(counts.sum()) // (4 * tasks))  # pieces ranked together: a part of one task's share
    salts = np.maximum(1, -(-counts // group))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.lit(salts.tolist()).cast("array<long>"), F.col("length").cast("int") + 1)))
    base: dict[int, np.ndarray] = {}
    sizes = salted.groupBy("length", "_salt").count().toPandas()  # at most capacity + 4 * tasks rows
    for length, rows in sizes.groupby("length"):
        n = np.zeros(int(salts[length]) + 1, np.int64)
        n[rows["_salt"].to_numpy() + 1] = rows["count"].to_numpy()
        base[int(length)] = n.cumsum()
    slots = spark.sparkContext.broadcast((base, _slots(plan(counts, capacity), capacity)))  # bounded by the two tables above
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece")).cast("long") - 1)
    kept = [c for c in parts.columns]

    def run(batches):
        base, slots = slots_.value
        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy() for c in ("length", "_salt", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[rows[0]])
                r, s = base[n][salt[rows]] + rank[rows], slots[n]
                at = np.searchsorted(s[:, 0], r, "right") - 1
                sequence[rows], offset[rows] = s[at, 1] + r - s[at, 0], s[at, 2]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    slots_ = slots
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(run, fields + ", sequence_id long, offset long")


def best_fit_packing(
    docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False, words: int = WORDS
) -> DataFrame:
    """docs (doc_id, text). Returns a row per piece: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Null and empty texts are the closing 0 alone. Rows repeated under one id are packed one by one. Rows without an
    id take no part. An empty table gives no rows. ``words`` bounds what a worker remembers of the tokenizer's answers:
    a smaller number costs time, not results.
    """
    bounded_batches(docs.sparkSession)
    return pack(written(pieces(docs, tokenizer, capacity, with_ids, words), "pieces"), capacity)
