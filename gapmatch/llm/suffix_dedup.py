"""Removal of repeated byte strings by distributed prefix doubling.

A byte position gets the rank of the string that starts there; a rank at length 2h is the pair of two ranks
at length h, and Spark brings equal pairs together. Positions whose rank is unique at one length are dropped
before the next, and the last pair overlaps so that it ends exactly at the threshold. Ranks are 64-bit names
(hashes) of the pairs, so no global sort of all positions is needed.

Length 16 is ranked at sampled positions only: in every 50-byte window the position with the least 16-byte
name stands for it, so equal windows have equal representatives. Neighbouring windows with one representative
are a run. Round one compares (name of the representative, name of the whole run): a run met whole in an
earlier document is settled, a representative met in no other document settles the run as unique. Only the
rest (the edges of matches) is ranked position by position, as pairs (rank 32 at p, rank 32 at p + 18).

At the ends of a passage a run holds bytes of the surrounding text, so its name differs from document to document. A
representative with many runs in one block is therefore sent as a mark alone, and a representative with a mark, or
with many runs in all, is crowded: its open windows are dealt by their own names, each once a block.

Texts are packed once into compressed blocks in the shared folder; rows between rounds are packed by
(block, bucket), so Spark moves few large rows. A run that repeats inside a block is sent once.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import bytes_kernel as K
from .batches import bounded_batches, tidied, tidied_group, trim

LENGTH = 50
GRAM = 16
LONGEST = 32  #: windows in one run at most
BLOCK = 4 << 20  #: bytes of text in a block (a longer document is a block of its own)
BUCKET_BYTES = 4 << 20  #: bytes of text whose runs a bucket of round one should hold, on average
ENTRIES = 1 << 16  #: runs of one representative that round one should hold, in all blocks
RUNS = (4, 64)  #: runs of one representative that a block sends, at least and at most
CROWD = 1 << 12  #: open runs of one representative that one bucket of round two ranks
PART = 1 << 20  #: windows of crowded representatives named together
MARK = np.uint64(0)  #: stands for the runs of a representative
SIX = np.uint64(16)


def _pack(batches):
    """Documents as blocks: ids (ascending), lengths, and the bytes of all texts, compressed."""
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        ids = batch.column(0).to_numpy()
        data, offsets, _ = K.flat(batch.column(1))
        for a, b in K.document_slices(offsets, BLOCK):
            order = a + np.argsort(ids[a:b], kind="stable")
            body = b"".join(data[offsets[d] : offsets[d + 1]].tobytes() for d in order)
            row = [secrets.randbits(62), ids[order].tolist(), np.diff(offsets)[order].tolist(), len(body), zip_.compress(body)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()))],
                ["block", "ids", "lengths", "size", "body"])


class _Block:
    def __init__(self, block: int, ids, lengths, body: bytes, length: int):
        self.block, self.length = block, length
        self.ids = np.asarray(ids, np.int64)
        self.offsets = np.r_[0, np.cumsum(np.asarray(lengths, np.int64))]
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8) if body else np.zeros(0, np.uint8)

    def runs(self):
        """(name of representative, name of run, first window, windows, document id) of every run, in order."""
        gap, parts = self.length - 1, []
        for s in range(0, max(len(self.data) - gap, 0), K.SLICE):
            seg = self.data[s : s + K.SLICE + gap]
            n = len(seg) - gap
            d, sizes = K.owners(self.offsets, s, s + n)
            last = np.repeat(self.offsets[d + 1 : d + 1 + len(sizes)], sizes) - self.length
            valid = np.arange(s, s + n) <= last
            g = K.gram_hashes(seg, (GRAM, 32))
            name = window_names(g[32], self.length)
            low = K.sliding_min(K.mix(g[GRAM]), self.length - GRAM + 1)
            new = np.ones(n, bool)
            new[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1]) | (last[1:] != last[:-1])
            start = np.flatnonzero(new)
            count = np.diff(np.r_[start, n])
            start, count = start[valid[start]], count[valid[start]]
            pieces = -(-count // LONGEST)
            if len(start) and pieces.max() > 1:
                k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start, left = np.repeat(start, pieces) + k * LONGEST, np.repeat(count, pieces) - k * LONGEST
                count = np.minimum(left, LONGEST)
            run = K.mix((name[start] * np.uint64(K.BASE) + name[start + count - 1]) * np.uint64(K.BASE) + count.astype(np.uint64), 8)
            parts.append((K.mix(low[start], 9), run, start + s, count))
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, run, start, count = (np.concatenate(p) for p in zip(*parts))
        doc = self.ids[np.searchsorted(self.offsets, start, "right") - 1]
        return key >> SIX, run >> SIX, start, count, doc

    def entries(self, buckets: int, most: int):
        """Distinct (representative, run) pairs, each with its earliest document, ordered by bucket and document.
        Of a representative with more than ``most`` runs there is one entry, a mark with the earliest document of all.

        Returns (key, run, doc, bucket) of the entries and, of every run of the block, its entry."""
        key, run, start, count, doc = self.runs()
        order = np.lexsort((doc, run, key))
        k, r, d = key[order], run[order], doc[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        first = np.flatnonzero(new)
        k, r, d = k[first], r[first], d[first]
        heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        runs = np.diff(np.r_[heads, len(k)])
        many = np.repeat(runs > most, runs)
        r[many] = MARK
        d[many] = np.repeat(np.minimum.reduceat(d, heads) if len(k) else d, runs)[many]
        keep = ~many
        keep[heads] = True
        at = (np.cumsum(keep) - 1)[np.cumsum(new) - 1]
        k, r, d = k[keep], r[keep], d[keep]
        bucket = (k % np.uint64(buckets)).astype(np.int64)
        place = np.lexsort((r, k, d, bucket))
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))
        entry = np.empty(len(order), np.int64)
        entry[order] = rank[at]
        return (k[place], r[place], d[place], bucket[place]), entry, (key, run, start, count, doc)


def window_names(rank: np.ndarray, length: int) -> np.ndarray:
    """Names of the strings of ``length`` bytes: the pair of the ranks at p and at p + length - 32."""
    n = max(len(rank) - (length - 32), 0)
    return K.mix(rank[:n], 10) * np.uint64(K.BASE) + rank[length - 32 : length - 32 + n]


def _run_windows(text: np.ndarray, count: np.ndarray, length: int):
    """Texts of runs of ``count`` windows, one after another: the run, the place in it and the name of every window."""
    begin = np.cumsum(count + length - 1) - (count + length - 1)
    which = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    name = np.empty(len(which), np.uint64)
    at = begin[which] + step
    for s in range(0, len(text), K.SLICE):
        names = window_names(K.gram_hashes(text[s : s + K.SLICE + length - 1], (32,))[32], length)
        lo, hi = np.searchsorted(at, [s, s + K.SLICE])
        name[lo:hi] = names[at[lo:hi] - s]
    return which, step, name


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def _spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged ranges of overlapping or touching ranges."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.r_[first[1:] - 1, len(start) - 1]] if len(start) else reach


def _blocks(batches, length: int, extra: int = 0):
    for batch in batches:
        for i in range(batch.num_rows):
            row = [batch.column(k)[i].as_py() for k in range(4 + extra)]
            made = _Block(*row[:4], length), *row[4:]
            del row
            yield made
            del made
            trim()


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


SENT = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("body", pa.binary())])


def _send_entries(length: int, buckets: int, most: int):
    """Round one, out: the entries of each block by bucket."""
    def run(batches):
        for (block,) in _blocks(batches, length):
            (key, name, doc, bucket), _, _ = block.entries(buckets, most)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                s = slice(edges[b], edges[b + 1])
                ids = zstandard.compress(np.diff(doc[s], prepend=0).astype("<i8").tobytes(), 1)
                rows.append((block.block, b, np.uint32(edges[b + 1] - edges[b]).tobytes() + _six(key[s]) + _six(name[s]) + ids))
            if rows:
                yield _out(rows, SENT)
    return run


def _judge(crowd: int):
    """Round one, at a bucket: for every entry 1 (met whole in an earlier document), 2 (rank it further), 3 (rank it
    further by windows, the representative is crowded) or 0."""
    return lambda table: _verdicts(table, crowd)


def _verdicts(table: pa.Table, crowd: int) -> pa.Table:
    keys, names, docs, sizes = [], [], [], []
    for body in table.column("body"):
        raw = np.frombuffer(body.as_buffer(), np.uint8)
        n = int(raw[:4].view("<u4")[0])
        keys.append(_unsix(raw[4 : 4 + 6 * n]))
        names.append(_unsix(raw[4 + 6 * n : 4 + 12 * n]))
        docs.append(np.cumsum(np.frombuffer(zstandard.decompress(raw[4 + 12 * n :].tobytes()), "<i8")))
        sizes.append(n)
    key, name, doc = np.concatenate(keys), np.concatenate(names), np.concatenate(docs)
    order = np.lexsort((doc, name, key))
    k, r, d = key[order], name[order], doc[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new_run = new_key | np.r_[True, r[1:] != r[:-1]]
    mark = r == MARK
    met = ~mark & (d > d[np.flatnonzero(new_run)][np.cumsum(new_run) - 1])
    heads = np.flatnonzero(new_key)
    of_key = np.cumsum(new_key) - 1
    earliest = np.minimum.reduceat(d, heads)
    open_key = np.add.reduceat((~met & (d > earliest[of_key])).astype(np.int64), heads) > 0
    crowded = (np.add.reduceat(mark.astype(np.int64), heads) > 0) | (open_key & (np.add.reduceat((~met).astype(np.int64), heads) > crowd))
    verdict = np.empty(len(order), np.uint8)
    verdict[order] = np.where(met, 1, np.where(crowded[of_key], 3, np.where(open_key[of_key], 2, 0)))
    edges = np.r_[0, np.cumsum(sizes)]
    rows = [
        (block, bucket, verdict[edges[i] : edges[i + 1]].tobytes())
        for i, (block, bucket) in enumerate(zip(table.column("block").to_pylist(), table.column("bucket").to_pylist()))
        if verdict[edges[i] : edges[i + 1]].any()
    ]
    return pa.Table.from_batches([_out(rows, SENT)] if rows else [], SENT)


EDGE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("count", "<i8")])


def _tag(kind: bytes, *arrays: np.ndarray) -> bytes:
    """Replies for a block: ranges (R), places of windows sent by name (P) or those of them that are repeats (M)."""
    return kind + np.stack(arrays).astype("<i8").tobytes() if kind == b"R" else kind + zstandard.compress(np.stack(arrays).astype("<i8").tobytes(), 1)


def _untag(body: bytes) -> np.ndarray:
    return np.frombuffer(body[1:] if body[:1] == b"R" else zstandard.decompress(body[1:]), "<i8")


def _crowded_windows(block: _Block, key, start, count, doc):
    """The windows of runs of crowded representatives, a bounded number at a time.

    Yields the ranges that repeat an earlier document of the block, and of the rest the distinct windows (name,
    representative, document) and, of every place, (number of its window, start)."""
    order = np.argsort(key, kind="stable")
    key, start, count, doc = key[order], start[order], count[order], doc[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    part = (np.cumsum(count) - count)[heads] // PART  # a representative stays whole
    cuts = [*heads[np.r_[True, part[1:] != part[:-1]]].tolist(), len(key)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        text = np.concatenate([block.data[s : s + c + block.length - 1] for s, c in zip(start[lo:hi].tolist(), count[lo:hi].tolist())])
        which, step, name = _run_windows(text, count[lo:hi], block.length)
        k, d, at = key[lo:hi][which], doc[lo:hi][which], start[lo:hi][which] + step
        order = np.lexsort((at, d, k, name))
        name, k, d, at = name[order], k[order], d[order], at[order]
        new = np.r_[True, (name[1:] != name[:-1]) | (k[1:] != k[:-1])]
        first, number = np.flatnonzero(new), np.cumsum(new) - 1
        again = d > d[first][number]
        yield at[again], (name[first], k[first], d[first]), (number[~again], at[~again])


def _send_edges(length: int, buckets: int, most: int):
    """Round two, out: settled ranges (bucket -1 downwards, spread), the bytes of the runs still open, and the windows
    of crowded representatives (by name, in buckets of their own)."""
    def run(batches):
        for block, replies in _blocks(batches, length, 1):
            (key, name, first, bucket), entry, (run_key, _, start, count, doc) = block.entries(buckets, most)
            verdict = np.zeros(len(key), np.uint8)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for r in replies:
                verdict[edges[r["bucket"]] : edges[r["bucket"] + 1]] = np.frombuffer(r["body"], np.uint8)
            settled = (verdict[entry] == 1) | ((doc > first[entry]) & (name[entry] != MARK))
            rows, own = [], -1 - block.block % buckets
            if settled.any():
                a, b = _spans(start[settled], (start + count + length - 1)[settled])
                rows.append((block.block, own, _tag(b"R", a, b)))
            left = np.flatnonzero(~settled & (verdict[entry] == 2))
            left = left[np.argsort(bucket[entry[left]], kind="stable")]
            where = bucket[entry[left]]
            for part in np.split(left, np.flatnonzero(np.diff(where)) + 1) if len(left) else []:
                head = np.zeros(len(part), EDGE)
                head["key"], head["doc"], head["start"], head["count"] = run_key[part], doc[part], start[part], count[part]
                text = b"".join(block.data[s : s + c + length - 1].tobytes() for s, c in zip(start[part], count[part]))
                rows.append((block.block, int(bucket[entry[part[0]]]), np.uint32(len(part)).tobytes() + zstandard.compress(head.tobytes() + text, 1)))
            if rows:
                yield _out(rows, SENT)
            left = np.flatnonzero(~settled & (verdict[entry] == 3))
            sent = 0
            for again, (window, rep, since), (number, at) in _crowded_windows(block, run_key[left], start[left], count[left], doc[left]) if len(left) else []:
                rows = [(block.block, own, _tag(b"P", np.diff(number + sent, prepend=0), np.diff(at, prepend=0)))]
                if len(again):
                    rows.append((block.block, own, _tag(b"R", *_spans(np.sort(again), np.sort(again) + length))))
                where = (K.mix(window, 11) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                    body = np.zeros(len(part), CROWDED)
                    body["name"], body["key"], body["doc"], body["number"] = window[part], rep[part], since[part], part + sent
                    rows.append((block.block, buckets + int(where[part[0]]), zstandard.compress(body.tobytes(), 1)))
                sent += len(window)
                yield _out(rows, SENT)
    return run


CROWDED = np.dtype([("name", "<u8"), ("key", "<u8"), ("doc", "<i8"), ("number", "<i8")])


def _meet_windows(sent: list[tuple[int, bytes]]) -> list[tuple]:
    """Round two, at a bucket of windows by name: of every block the windows that an earlier document has."""
    items = [np.frombuffer(zstandard.decompress(body), CROWDED) for _, body in sent]
    owner = np.repeat(np.array([block for block, _ in sent]), [len(i) for i in items])
    item = np.concatenate(items)
    order = np.lexsort((item["doc"], item["key"], item["name"]))
    n, k, d = item["name"][order], item["key"][order], item["doc"][order]
    new = np.r_[True, (n[1:] != n[:-1]) | (k[1:] != k[:-1])]
    met = order[d > d[np.flatnonzero(new)][np.cumsum(new) - 1]]
    met = met[np.argsort(owner[met], kind="stable")]
    parts = np.split(met, np.flatnonzero(np.diff(owner[met])) + 1) if len(met) else []
    return [(int(owner[p[0]]), 0, _tag(b"M", np.sort(item["number"][p]))) for p in parts]


def _rank_edges(length: int, buckets: int):
    """Round two, at a bucket: every open position gets its rank at the full length; the later ones are repeats."""
    def run(table: pa.Table) -> pa.Table:
        rows, heads, texts, owner, crowded = [], [], [], [], []
        for block, bucket, body in zip(*(table.column(c).to_pylist() for c in ("block", "bucket", "body"))):
            if bucket < 0:
                rows.append((block, bucket, body))
                continue
            if bucket >= buckets:
                crowded.append((block, body))
                continue
            n = int(np.frombuffer(body[:4], "<u4")[0])
            raw = zstandard.decompress(body[4:])
            heads.append(np.frombuffer(raw[: n * EDGE.itemsize], EDGE))
            texts.append(raw[n * EDGE.itemsize :])
            owner.append(np.full(n, block))
        if crowded:
            rows += _meet_windows(crowded)
        if heads:
            head, owner = np.concatenate(heads), np.concatenate(owner)
            which, step, name = _run_windows(np.frombuffer(b"".join(texts), np.uint8), head["count"], length)
            key, doc = head["key"][which], head["doc"][which]
            order = np.lexsort((doc, name, key))
            k, r, d = key[order], name[order], doc[order]
            new = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]
            again = np.zeros(len(order), bool)
            again[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
            where, start = owner[which[again]], (head["start"][which] + step)[again]
            order = np.argsort(where, kind="stable")
            where, start = where[order], start[order]
            for part in np.split(np.arange(len(where)), np.flatnonzero(np.diff(where)) + 1) if len(where) else []:
                a, b = _spans(start[part], start[part] + length)
                rows.append((int(where[part[0]]), 0, _tag(b"R", a, b)))
        return pa.Table.from_batches([_out(rows, SENT)] if rows else [], SENT)
    return run


def _ranges(replies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged ranges of a block from all replies."""
    none = np.zeros(0, np.int64)
    found = [_untag(r).reshape(2, -1) for r in replies if r[:1] == b"R"]
    met = np.concatenate([none, *(_untag(r) for r in replies if r[:1] == b"M")])
    for r in replies:
        if r[:1] == b"P" and len(met):
            number, at = np.cumsum(_untag(r).reshape(2, -1), axis=1)
            at = at[np.isin(number, met)]
            found.append(np.stack([at, at + length]))
    return _spans(*np.concatenate(found, axis=1)) if found else (none, none)


DONE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                  ("kept_sha256", pa.string()), ("kept", pa.string())])


def _cut(length: int, texts: bool):
    def run(batches):
        for block, replies in _blocks(batches, length, 1):
            a, b = _ranges(replies or [], length)
            # Ranges lie inside documents, but those of two documents may touch: count them by document.
            rows = []
            for d, doc_id in enumerate(block.ids.tolist()):
                lo, hi = block.offsets[d], block.offsets[d + 1]
                first = max(int(np.searchsorted(b, lo, "right")), 0)
                last = int(np.searchsorted(a, hi, "left"))
                keep, removed, at = [], 0, lo
                for s, e in zip(np.maximum(a[first:last], lo).tolist(), np.minimum(b[first:last], hi).tolist()):
                    keep.append(block.data[at:s].tobytes())
                    removed, at = removed + e - s, e
                kept = b"".join([*keep, block.data[at:hi].tobytes()])
                rows.append((doc_id, int(hi - lo), int(removed), last - first, hashlib.sha256(kept).hexdigest(),
                             kept.decode("utf-8", "ignore") if texts else None))
            if rows:
                yield _out(rows, DONE)
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """docs (doc_id, text). Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), a row per row.

    Removed is each byte covered by a string of ``length`` bytes (33 to 64) that also starts in a document with a
    smaller id. Null is the empty text; rows under one id do not count as earlier than each other; rows without an
    id take no part. ``texts`` adds the remaining text; a character that lost some of its bytes is left out of it.
    """
    if not 33 <= length <= 64:
        raise ValueError("length must be from 33 to 64")
    spark = docs.sparkSession
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).filter("doc_id is not null")
    blocks = written(source.mapInArrow(tidied(_pack), "block long, ids array<long>, lengths array<long>, size long, body binary"), "blocks")
    total, count = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    buckets = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    most = min(max(ENTRIES // max(count, 1), RUNS[0]), RUNS[1])
    plain = blocks.select("block", "ids", "lengths", "body")
    sent = "block long, bucket long, body binary"
    first = written(plain.mapInArrow(tidied(_send_entries(length, buckets, most)), sent).groupBy("bucket").applyInArrow(tidied_group(_judge(CROWD)), sent), "ranks")
    first = first.groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias("replies"))
    open_ = plain.join(first, "block").select("block", "ids", "lengths", "body", "replies")
    second = written(open_.mapInArrow(tidied(_send_edges(length, buckets, most)), sent).groupBy("bucket").applyInArrow(tidied_group(_rank_edges(length, buckets)), sent), "repeats")
    second = second.groupBy("block").agg(F.collect_list(F.col("body")).alias("replies"))
    done = plain.join(second, "block", "left").select("block", "ids", "lengths", "body", "replies")
    out = done.mapInArrow(tidied(_cut(length, texts)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return out if texts else out.drop("kept")
