"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector on hashed text is shared by all grades; ordered thresholds cut the line into grades:
P(rating <= k) = sigmoid(threshold_k - w . x). From the tails come the expected grade and the probability of
reaching a wanted grade, which selects documents. Fitted in numpy by full-batch Adam on a bounded sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as X

SAMPLE = 8000  #: rated texts in the sample at most
FOLDS = 5
CLEAR = 4.0  #: standard errors that make a word usable


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: the first, then steps that are always positive."""
    return np.cumsum(np.r_[raw[:1], np.exp(raw[1:])])


def fit_ordinal(target: np.ndarray, offsets: np.ndarray, places: np.ndarray, rounds: int = 150, rate: float = 0.05, decay: float = 2e-4):
    """Returns (weights, thresholds, grades); a single grade has no thresholds.

    Words get a weight if, at one of the cuts between grades, the share of their texts above it differs from that of
    all by ``CLEAR`` standard errors (rare words would only be learnt by heart); the statistics of form always do.
    """
    grades, y = np.unique(target, return_inverse=True)
    w, n = np.zeros(1 << X.BITS), len(y)
    if len(grades) < 2:
        return w, np.zeros(0), grades
    times = np.bincount(places, minlength=1 << X.BITS)
    usable = np.zeros(1 << X.BITS, bool)
    for cut in range(len(grades) - 1):
        over = (y > cut) - (y > cut).mean()
        off = np.bincount(places, np.repeat(over, np.diff(offsets)), 1 << X.BITS)
        usable |= (times >= 3) & (np.abs(off) >= CLEAR * over.std() * np.sqrt(times + 1))
    usable[: X.FORM] = True
    keep = usable[places]
    offsets, places = np.r_[0, np.cumsum(keep)][offsets], places[keep]
    below = np.cumsum(np.bincount(y))[:-1] / n
    start = np.log(below / (1 - below))
    raw = np.r_[start[:1], np.log(np.maximum(np.diff(start), 0.05))]
    adam = X.Adam(rate)
    for adam.t in range(1, rounds + 1):
        cut = np.r_[-np.inf, _cuts(raw), np.inf]
        z = X.totals(w, offsets, places)
        with np.errstate(over="ignore"):
            hi, lo = _sigmoid(cut[y + 1] - z), _sigmoid(cut[y] - z)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) * np.isfinite(cut[y + 1]), lo * (1 - lo) * np.isfinite(cut[y])
        slope = (dhi - dlo) / p / n
        at = np.bincount(y, -dhi / p, len(grades))[:-1] / n + np.bincount(y, dlo / p, len(grades))[1:] / n
        later = at[::-1].cumsum()[::-1]  # a threshold moves all that follow it
        step = later * np.r_[1.0, np.exp(raw[1:])]
        w = adam.step("w", w, X.gradient(offsets, places, slope) + decay * w)
        raw = adam.step("c", raw, step)
    return w, _cuts(raw), grades


def tails(model, offsets, places) -> list[np.ndarray]:
    """P(rating >= grade) for every grade but the lowest."""
    w, cuts, _ = model
    z = X.totals(w, offsets, places)
    return [_sigmoid(z - c) for c in cuts]


def quality(docs: DataFrame, ratings: DataFrame, wanted: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text), ratings (doc_id, rating). Returns (doc_id, held_out, expected_grade, tail, keep).

    ``tail`` is the probability of a rating of at least ``wanted`` (by default the best grade rated), ``keep`` whether
    it is 0.5 or more. The sample is drawn by hash of the id outside the held-out fold, at most ``sample`` ratings, each with one text of its id. Null
    and empty texts have the features of their form only. With one grade rated, or none, everything is kept, and
    the expected grade is that grade, or null. Rows without an id take no part; null ratings are none.
    """
    spark = docs.sparkSession
    rated = ratings.select(F.col("doc_id").cast("long"), F.col("rating").cast("double")).filter("doc_id is not null and rating is not null")
    rated = rated.filter(X.fold(F.col("doc_id"), FOLDS) != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "rating").limit(sample)
    chosen = X.first_texts(docs, rated).join(F.broadcast(rated), "doc_id").select(F.col("rating").alias("target"), "text")  # at most ``sample`` rows

    def fit(target, offsets, places) -> bytes:
        w, cuts, grades = fit_ordinal(target, offsets, places)
        return np.r_[len(grades), grades, cuts, w].astype(np.float64).tobytes()

    model = spark.sparkContext.broadcast(np.frombuffer(X.fit_in_one_task(chosen, True, fit), np.float64))

    def value(offsets, places):
        m = model.value
        k, rows = (int(m[0]), len(offsets) - 1) if len(m) else (0, len(offsets) - 1)
        grades, cuts = m[1 : 1 + k], m[1 + k : max(2 * k, 1)]
        if k < 2:
            return [np.full(rows, grades[0] if k else np.nan), np.ones(rows)]
        over = tails((m[2 * k :], cuts, grades), offsets, places)
        expected = grades[0] + sum(t * g for t, g in zip(over, np.diff(grades)))
        at = k - 1 if wanted is None else int(np.searchsorted(grades, wanted))
        return [expected, np.ones(rows) if at == 0 else np.zeros(rows) if at == k else over[at - 1]]

    found = X.scored(docs, True, ["expected_grade", "tail"], value)
    return found.select(
        "doc_id", (X.fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.nanvl("expected_grade", F.lit(None)).alias("expected_grade"),
        "tail", (F.col("tail") >= 0.5).alias("keep"))
