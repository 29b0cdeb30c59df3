"""Language identification, word first.

Each known word adds its log frequency in every language. A word never seen is scored by the longest character
n-grams of it that are known: four letters, else three, two, one. The counts are gathered in Spark from a bounded
sample of labelled documents; the model is a table of words and n-grams by language.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded_batches, free_names, tidied
from .features import fold

PER_LANGUAGE = 1500  #: labelled documents in the sample, about, for each language
SEEN = 2  #: times a word or n-gram is met in the sample to be known
ORDERS = (4, 3, 2, 1)
REMEMBERED = 200_000  #: words backed off that a task remembers
PIECE = 1 << 20
WORD = re.compile(r"[^\W\d_]+")


def _words(text: str):
    """Lists of lower-case words, a bounded piece of the text at a time."""
    a = 0
    while a < len(text):
        b = a + PIECE
        while b < len(text) and text[b].isalpha():
            b += 1
        yield WORD.findall(text[a:b].lower())
        a = b


def _grams(word: str, order: int) -> list[str]:
    marked = f"<{word}>" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def _count(batches):
    for batch in batches:
        found: dict[tuple[str, int], Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for words in _words(text):
                found.setdefault((lang, 0), Counter()).update(words)
        for (lang, _), words in list(found.items()):
            for order in ORDERS:
                grams = found.setdefault((lang, order), Counter())
                for word, n in words.items():
                    for g in _grams(word, order):
                        grams[g] += n
        rows = [(lang, order, g, n) for (lang, order), grams in found.items() for g, n in grams.items()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "kind", "gram", "n"])


class Model:
    """Log frequencies: for each order (0: whole words) the row of each gram, and the rows."""

    def __init__(self, counts: pd.DataFrame, languages: list[str]):
        self.languages = languages
        self.row: dict[int, dict[str, int]] = {}
        self.table: dict[int, np.ndarray] = {}
        column = {name: i for i, name in enumerate(languages)}
        for kind in (0, *ORDERS):
            part = counts[counts["kind"] == kind]
            grams = part["gram"].unique()
            self.row[kind] = {g: i for i, g in enumerate(grams)}
            n = np.full((len(grams), len(languages)), 0.5)
            np.add.at(n, (part["gram"].map(self.row[kind]).to_numpy(int), part["lang"].map(column).to_numpy(int)), part["n"].to_numpy(float))
            self.table[kind] = np.log(n / n.sum(0)) if len(grams) else n

    def backed_off(self, word: str) -> np.ndarray:
        for order in ORDERS:
            known = [r for r in map(self.row[order].get, _grams(word, order)) if r is not None]
            if known:
                return self.table[order][known].mean(0)
        return np.zeros(len(self.languages))


class _Scorer:
    """Scores texts by a model; of words the model does not know, a bounded number is remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, model.row[0]
        self.clear()

    def clear(self) -> None:
        self.extra: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)))

    def _backed_off(self, words: list[str]) -> np.ndarray:
        """Sum of the scores of unknown words."""
        new = set(words).difference(self.extra)
        if len(self.extra) + len(new) > REMEMBERED:
            self.clear()
            new = set(words)
        for w in new:
            at = self.extra[w] = len(self.extra)
            if at == len(self.rows):
                self.rows = np.resize(self.rows, (2 * at, self.rows.shape[1]))
            self.rows[at] = self.model.backed_off(w)
        return self.rows[np.fromiter(map(self.extra.__getitem__, words), np.int64, len(words))].sum(0)

    def total(self, text: str) -> np.ndarray | None:
        """Sum over all words, or None if there is no letter."""
        out = None
        for words in _words(text):
            if not words:
                continue
            at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
            met = at >= 0
            part = self.model.table[0][at[met]].sum(0)
            if not met.all():
                part = part + self._backed_off([words[i] for i in np.flatnonzero(~met).tolist()])
            out = part if out is None else out + part
        return out


def _guess(text: str | None, scorer: _Scorer) -> tuple[str | None, float]:
    languages = scorer.model.languages
    total = scorer.total(text) if text is not None and languages else None
    if total is None:
        return "und" if text is not None and not languages and any(_words(text)) else None, 0.0
    best = int(total.argmax())  # ties: the language with more labelled documents
    return languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model of docs (doc_id, text, lang), with every language that is not null, outside the held-out fold. Sampled
    by hash of the id, one text of each id and language, so reruns agree."""
    labelled = docs.select(F.col("doc_id").cast("long"), "text", "lang").filter("doc_id is not null and lang is not null").filter(
        fold(F.col("doc_id"), 3) != 1)
    sizes = labelled.select("lang", "doc_id").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model(pd.DataFrame({"lang": [], "kind": [], "gram": [], "n": []}), [])
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in sizes], "lang string, share double")
    drawn = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample = labelled.join(F.broadcast(shares), "lang").filter(drawn & F.col("text").isNotNull())
    sample = sample.groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")
    counts = sample.mapInArrow(tidied(_count), "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    return Model(counts.filter(F.col("n") >= SEEN).toPandas(), languages)  # bounded by the sample


def predicted(docs: DataFrame, model: Model) -> tuple[DataFrame, str, str]:
    """All columns of docs (text, ...) with two more, and the names of these (free ones): language and score.

    Language is null for a null text or one without letters, and ``und`` for any other if nothing could be learnt.
    """
    names = free_names(docs.columns, "lang_pred", "score")
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")  # bounded by the sample
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches):
        scorer = _Scorer(shared.value)
        for batch in batches:
            got = [_guess(t.as_py(), scorer) for t in batch.column(at)]
            more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return docs.mapInArrow(tidied(run), schema), *names


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """docs (doc_id, text, lang). Returns (doc_id, held_out, lang_pred, score), a row per row.

    ``lang_pred`` is a learned language, or ``und`` with score 0 for a null text, a text without letters, or when
    no document is labelled. ``score`` is the share of the best language in the posterior. Only texts are looked at
    in a prediction. Rows without an id take no part.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    found, _, _ = predicted(source, learn(docs, per_language))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), "score")
