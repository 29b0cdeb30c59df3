"""Alignment of two tokenizers over a corpus: which ids stand for the same bytes, and how often.

Both tokenizers cut a text at places where neither joins anything across: before a single space between two other
characters. A unit between such places is encoded once by a worker. Inside it the cumulative ends of both id lists
go into dictionaries end -> index; the sorted common keys slice both lists into groups, and every pair of ids of one
group is a link.

A block of documents keeps its distinct (document, unit) pairs and tells in how many of its documents each id pair is
linked. Spark adds these counts by id pair, finds each id's highest, and sends the totals of its pairs back to every
block, where they are summed by unit and document. Texts are encoded once and never shuffled.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import accumulate, count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import bytes_kernel as K
from .batches import bounded_batches

FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
BLOCK = 1 << 24  #: bytes of text in a block, about
REMEMBERED = 3 << 26  #: bytes of units, links and listed groups a worker remembers between blocks, about
EXPANDED = 1 << 20  #: links worked on at a time
JOINT = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"
SIGNS = ".,;:!?"


def byte_alphabet() -> dict[str, int]:
    """The byte of every letter of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _place(path: str) -> str:
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def sliced(a: list[int], b: list[int], ends_a: dict[int, int], ends_b: dict[int, int]) -> list[tuple[list[int], list[int]]]:
    """The groups of two id lists over the same bytes, given their dictionaries end -> ids up to it: both lists are cut
    where tokens of both end."""
    found, i, j = [], 0, 0
    for end in sorted(ends_a.keys() & ends_b.keys()):
        p, q = ends_a[end], ends_b[end]
        found.append((a[i:p], b[j:q]))
        i, j = p, q
    return found


def byte_pairs(path: str, letters: dict[str, int]):
    """A faster encoder of the same ids as a byte-level tokenizer's file, or None if its merges are not in order of
    their ids (then ranks are not ids) or it does more than to split and merge."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    special = {t["content"] for t in spec["added_tokens"]}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if not plain or model.get("ignore_merges") or model.get("dropout") or any(x >= y for x, y in zip(merged, merged[1:])) or len(merged) + 256 != len(vocabulary):
        return None
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("byte-pairs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizers:
    """Two tokenizers: the first is given a space and the text, the second adds that space itself."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the one it has
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(_place(first))
        self.first.encode_special_tokens = True
        letters = byte_alphabet()
        pairs = byte_pairs(_place(first), letters)
        self.first_ids = pairs.encode_ordinary if pairs else lambda text: self.first.encode(text, add_special_tokens=False).ids
        self.second = sentencepiece.SentencePieceProcessor(model_file=_place(second))
        named = self.first.get_vocab()
        self.bytes_a = [b""] * (max(named.values()) + 1)
        for token, i in named.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = ([len(x) for x in each] for each in (self.bytes_a, self.bytes_b))
        self.names_a, self.names_b = ([str(i) for i in range(len(each))] for each in (self.bytes_a, self.bytes_b))
        self.width = len(pieces)
        # A piece with a space inside would join units; letters that no piece has side by side are never joined.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.joined = {p[i : i + 2] for i, p in enumerate(pieces) if not self.second.is_byte(i) for i in range(len(p) - 1)}

    def units(self, text: str) -> list[str]:
        return JOINT.split(text) if self.cuts else [text]

    def closed(self, unit: str) -> int:
        """Where the signs begin that close a unit, if neither tokenizer joins them to the letter before; else 0."""
        at = len(unit.rstrip(SIGNS))
        return at if 0 < at < len(unit) and unit[at - 1].isalpha() and unit[at - 1 : at + 1] not in self.joined else 0

    def encoded(self, units: list[str]) -> list[tuple[list[int], list[int], bytes]]:
        """(first ids, second ids, bytes) of units after a space."""
        spaced = [" " + u for u in units]
        return [(self.first_ids(s), b, s.encode()) for s, b in zip(spaced, self.second.encode(units, num_threads=1))]

    def encoded_signs(self, letter: str, signs: str) -> tuple[list[int], list[int], bytes]:
        """The same of closing signs: the second tokenizer needs a letter before them."""
        return self.first_ids(signs), self.second.encode(letter + signs)[len(self.second.encode(letter)) :], signs.encode()

    def aligned(self, ids: list[tuple[list[int], list[int], bytes]]):
        """(listed groups, sizes, links) of each unit: whether both encodings are whole, ids of each, groups, links."""
        all_a = b"".join([self.bytes_a[x] for a, _, _ in ids for x in a])
        all_b = b"".join([self.bytes_b[x] for _, b, _ in ids for x in b])
        whole = all_a == all_b == b"".join([t for _, _, t in ids])
        names_a, names_b, sizes_a, sizes_b, width = self.names_a, self.names_b, self.sizes_a, self.sizes_b, self.width
        for a, b, target in ids:
            ends_a = dict(zip(accumulate([sizes_a[x] for x in a]), count(1)))
            ends_b = dict(zip(accumulate([sizes_b[x] for x in b]), count(1)))
            # If all bytes together are right, those of a unit are if they are as many as its own.
            good = len(target) in ends_a and len(target) in ends_b if whole else (
                b"".join([self.bytes_a[x] for x in a]) == b"".join([self.bytes_b[x] for x in b]) == target)
            if not good:
                yield b"", (0, 0, 0, 0, 0), []
                continue
            text, links = [], []
            for own_a, own_b in sliced(a, b, ends_a, ends_b):
                if len(own_a) == 1 == len(own_b):
                    text.append(names_a[own_a[0]] + "|" + names_b[own_b[0]])
                    links.append(own_a[0] * width + own_b[0])
                else:
                    text.append(",".join([names_a[x] for x in own_a]) + "|" + ",".join([names_b[y] for y in own_b]))
                    links += [x * width + y for x in own_a for y in own_b]
            yield ";".join(text).encode(), (1, len(a), len(b), len(text), len(links)), links


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    if size <= len(values):
        return values
    out = np.zeros((max(size, 2 * len(values)), *values.shape[1:]), values.dtype)
    out[: len(values)] = values
    return out


class _Units:
    """What a worker remembers of units: by number, their sizes, links and listed groups."""

    def __init__(self, first: str, second: str):
        self.tokenizers = Tokenizers(first, second)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.used = self.n_links = 0
        self._sizes, self._links, self._first = np.zeros((1024, 5), np.int64), np.zeros(4096, np.int64), np.zeros(1024, np.int64)
        self._uses = np.zeros(1024, np.int64)

    def trim(self, most: int) -> None:
        """Forget what was used once since the last time, or more if the rest is over half of ``most`` bytes."""
        n, least = len(self.texts), 2
        cost = np.array([len(t) for t in self.texts]) + 8 * self._sizes[:n, 4] + 260
        while cost[self._uses[:n] >= least].sum() > most // 2:
            least *= 2
        kept = np.flatnonzero(self._uses[:n] >= least)
        uses, sizes = self._uses[kept] // 2, self._sizes[kept]
        links = self._links[spread(self._first[kept], sizes[:, 4])]
        names = list(self.number)
        names, texts = [names[i] for i in kept.tolist()], [self.texts[i] for i in kept.tolist()]
        self.clear()
        self.number, self.texts = dict(zip(names, range(len(names)))), texts
        self._uses, self._sizes, self._links = (_grown(x, 1024) for x in (uses, sizes, links))
        self._first = _grown(np.cumsum(sizes[:, 4]) - sizes[:, 4], 1024)
        self.n_links, self.used = len(links), int(cost[kept].sum())

    def _add(self, units: list[str], found) -> None:
        texts, sizes, links = [], [], []
        for text, size, own in found:
            texts.append(text)
            sizes.append(size)
            links += own
        n = len(self.texts)
        self._sizes, self._first, self._uses = (_grown(x, n + len(units)) for x in (self._sizes, self._first, self._uses))
        self._links = _grown(self._links, self.n_links + len(links))
        self._sizes[n : n + len(units)] = sizes
        each = self._sizes[n : n + len(units), 4]
        self._first[n : n + len(units)] = self.n_links + np.cumsum(each) - each
        self._links[self.n_links : self.n_links + len(links)] = links
        self.n_links += len(links)
        self.texts += texts
        self.number.update(zip(units, range(n, n + len(units))))
        self.used += sum(map(len, units)) + sum(map(len, texts)) + 8 * len(links) + 250 * len(units)

    def _learn(self, units: list[str]) -> None:
        parts = {u: at for u in units if (at := self.tokenizers.closed(u))}
        plain = [u for u in units if u not in parts]
        plain = list(dict.fromkeys(plain + [c for u, at in parts.items() if (c := u[:at]) not in self.number]))
        for part in (plain[a : a + 2000] for a in range(0, len(plain), 2000)):
            self._add(part, self.tokenizers.aligned(self.tokenizers.encoded(part)))
        # Closing signs are stored under a key that no unit has: a space never follows another character than white space in a unit.
        signs = {u[at:]: u[at - 1] for u, at in parts.items() if "\0 " + u[at:] not in self.number}
        if signs:
            self._add(["\0 " + x for x in signs], self.tokenizers.aligned([self.tokenizers.encoded_signs(letter, x) for x, letter in signs.items()]))

        def composed():
            for u, at in parts.items():
                core, sign = self.number[u[:at]], self.number["\0 " + u[at:]]
                one, two = self._sizes[core].tolist(), self._sizes[sign].tolist()
                if not (one[0] and two[0]):
                    yield b"", (0, 0, 0, 0, 0), []
                    continue
                a, b = int(self._first[core]), int(self._first[sign])
                yield self.texts[core] + b";" + self.texts[sign], (1, *(x + y for x, y in zip(one[1:], two[1:]))), [
                    *self._links[a : a + one[4]].tolist(), *self._links[b : b + two[4]].tolist()]

        if parts:
            self._add(list(parts), list(composed()))

    def numbers(self, units: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.number.get, units, repeat(-1)), np.int64, len(units))
        missed = np.flatnonzero(found < 0).tolist()
        if missed:
            self._learn(list(dict.fromkeys([units[i] for i in missed])))
            found[missed] = [self.number[units[i]] for i in missed]
        self._uses[: len(self.texts)] += np.bincount(found, minlength=len(self.texts))
        return found

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, first link, links) by unit."""
        return self._sizes[: len(self.texts)], self._first[: len(self.texts)], self._links[: self.n_links]


@lru_cache(maxsize=1)
def _units(first: str, second: str) -> _Units:
    return _Units(first, second)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every stretch, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


DOCS = "doc_ids array<bigint>, sizes array<array<bigint>>, shas array<string>"
BLOCKS = f"block bigint, {DOCS}, unit_ends binary, units binary, times binary, link_ends binary, links binary, pairs array<bigint>, n_docs array<bigint>"


def _packed(values: np.ndarray) -> bytes:
    """Steps between whole numbers, lowest bytes first, compressed; ``_unpacked`` gives the numbers back."""
    steps = np.diff(values, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + pa.compress(steps.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], 4 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<i4").ravel(), dtype=np.int64)


class _Block:
    def __init__(self, known: _Units):
        self.known, self.size = known, 0
        self.ids, self.sizes, self.shas, self.codes = [], [], [], []

    def add(self, ids: list, bodies: list[bytes | None]) -> None:
        units, counts = [], []
        for body in bodies:
            try:
                found = self.known.tokenizers.units(body.decode()) if body else []
            except UnicodeDecodeError:
                found = []
            units += found
            counts.append(len(found))
            self.size += len(body or b"")
        codes = self.known.numbers(units)
        sizes, _, _ = self.known.tables()
        texts, at = self.known.texts, 0
        for n in counts:
            own = codes[at : at + n]
            at += n
            if not n or not sizes[own, 0].all():
                own = own[:0]
            self.codes.append(np.unique(own, return_counts=True))
            self.sizes.append(sizes[own, 1:].sum(0).tolist())
            self.shas.append(hashlib.sha256(b";".join([texts[c] for c in own.tolist()])).hexdigest() if len(own) else "")
        self.ids += ids

    def row(self, block: int) -> pa.RecordBatch:
        sizes, first, links = self.known.tables()
        ends = np.cumsum([len(c) for c, _ in self.codes])
        codes, times = (np.concatenate([x[k] for x in self.codes]).astype(np.int64) for k in (0, 1))
        own, unit = np.unique(codes, return_inverse=True)
        n_links = sizes[own, 4]
        pairs, link = np.unique(links[spread(first[own], n_links)], return_inverse=True)
        link_ends = np.cumsum(n_links)
        n_docs = np.zeros(len(pairs), np.int64)
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        work = np.cumsum(n_links[unit])
        a = 0
        while a < len(ends):  # whole documents, a bounded number of links together
            done = work[ends[a - 1] - 1] if a and ends[a - 1] else 0
            reach = np.searchsorted(work, done + EXPANDED, "right")
            b = max(a + 1, int(np.searchsorted(ends, reach, "right")))
            s = slice(ends[a - 1] if a else 0, ends[b - 1])
            each = n_links[unit[s]]
            seen = np.unique(np.repeat(doc[s], each) * len(pairs) + link[spread(link_ends[unit[s]] - each, each)]) if len(each) else np.zeros(0, np.int64)
            n_docs += np.bincount(seen % max(len(pairs), 1), minlength=len(pairs))
            a = b
        packed = [_packed(x) for x in (ends, unit, times, link_ends, link)]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), *[pa.binary()] * 5, *[pa.list_(pa.int64())] * 2]
        values = [block, self.ids, self.sizes, self.shas, *packed, pairs, n_docs]
        names = ["block", "doc_ids", "sizes", "shas", "unit_ends", "units", "times", "link_ends", "links", "pairs", "n_docs"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


def _blocks(first: str, second: str, block_bytes: int, remembered: int):
    def run(batches):
        known, task, n = _units(first, second), TaskContext.get().partitionId(), 0
        block = _Block(known)
        for batch in batches:
            data, offsets, valid = K.flat(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for a, b in K.document_slices(offsets, 1 << 20):
                block.add(ids[a:b], [data[offsets[i] : offsets[i + 1]].tobytes() if valid[i] else None for i in range(a, b)])
                if block.size >= block_bytes or known.used > remembered:
                    yield block.row((task << 32) + n)
                    n += 1
                    if known.used > remembered:
                        known.trim(remembered)
                    block = _Block(known)
        if block.ids:
            yield block.row((task << 32) + n)

    return run


def _answered(key, left, right):
    """The rows of one block's documents, given its pairs' totals."""
    row = {name: left.column(name)[0] for name in left.column_names}
    ends, unit, times, link_ends, link = (_unpacked(row[n].as_py()) for n in ("unit_ends", "units", "times", "link_ends", "links"))
    order = np.argsort(right.column("pair").to_numpy())
    values = np.stack([right.column(c).to_numpy()[order] for c in ("best", "n")]) if len(order) else np.zeros((2, 0), np.int64)
    totals = np.zeros((2, len(ends)), np.int64)
    for k in range(2):
        by_link = np.r_[0, np.cumsum(values[k][link])]
        by_unit = by_link[link_ends] - by_link[np.r_[0, link_ends[:-1]]] if len(link_ends) else np.zeros(0, np.int64)
        by_entry = np.r_[0, np.cumsum(by_unit[unit] * times)]
        totals[k] = by_entry[ends] - by_entry[np.r_[0, ends[:-1]]]
    sizes = np.array(row["sizes"].as_py(), np.int64).reshape(len(ends), 4)
    arrays = [row["doc_ids"].values, *(pa.array(np.ascontiguousarray(c)) for c in (*sizes.T, *totals)), row["shas"].values]
    return pa.Table.from_arrays(arrays, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


ROWS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def encoded(docs: DataFrame, first: str = FIRST, second: str = SECOND, block_bytes: int = BLOCK, remembered: int = REMEMBERED) -> DataFrame:
    """docs (doc_id, text) as a stored table of blocks: what each document holds and how many hold each id pair."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("doc_id is not null")
    # Stored, so that a lost task cannot cut its blocks anew while others use the old numbers.
    return written(source.mapInArrow(_blocks(first, second, block_bytes, remembered), BLOCKS), "token-blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n): in how many documents each id pair (first id * size of the second vocabulary + second id) is linked."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).select("p.pairs", "p.n_docs")
    return each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n_docs").alias("n"))


def vocabulary_links(blocks: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """(a, b, n, best): every linked id pair, its documents, and whether that is its first id's highest count."""
    width = Tokenizers(first, second).width
    pairs = pair_counts(blocks).withColumn("a", F.expr(f"pair div {width}"))
    pairs = written(pairs, "pair-counts")  # read twice below
    top = pairs.groupBy("a").agg(F.max("n").alias("top"))
    return pairs.join(top, "a").select("a", (F.col("pair") % width).alias("b"), "pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, first: str = FIRST, second: str = SECOND, block_bytes: int = BLOCK, remembered: int = REMEMBERED) -> DataFrame:
    """docs (doc_id, text). Returns a row per row: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    Sizes of both encodings, groups between common ends, links of ids within a group; ``n_best`` counts the links whose
    id pair is linked in as many documents as any pair of its first id, ``count_sum`` adds the documents of all links'
    pairs. A null or empty text, or one that an encoding does not give back byte by byte, has no tokens: zeros and ''.
    Repeated rows count as documents of their own; rows without an id take no part; an empty table gives no rows;
    further columns are ignored. ``block_bytes`` and ``remembered`` bound memory and change no result.
    """
    blocks = encoded(docs, first, second, block_bytes, remembered)
    counts = vocabulary_links(blocks, first, second).select("pair", "n", F.col("best").cast("long").alias("best"))
    asked = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    answers = asked.join(counts, "pair").select("of", "pair", "n", "best")
    left = blocks.drop("pairs", "n_docs")
    return left.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_answered, ROWS)
