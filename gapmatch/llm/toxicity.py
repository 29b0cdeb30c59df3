"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are labels; all other texts of the sample are unlabelled and hold toxic ones too. With
the class prior p the risk of the unlabelled part as negatives is corrected by what its positives cost,
R = p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]), and where the corrected part falls below zero its gradient is
turned round. The model is a linear one on hashed word features, fitted in numpy by full-batch Adam.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as X

POSITIVES = 3000  #: confirmed toxic texts in the sample at most
UNLABELLED = 6000  #: unlabelled texts in the sample at most
FOLDS = 5
CLEAR = 4.0  #: standard deviations that make a feature usable


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(
    target: np.ndarray, offsets: np.ndarray, places: np.ndarray, prior: float,
    rounds: int = 200, rate: float = 0.1, decay: float = 1e-4, turned: float = 1.0, clear: float = CLEAR,
):
    """target 1 for positives, 0 for unlabelled. Returns (weights, bias), the mean over the second half of the rounds.

    Only features whose frequency among the positives differs clearly from that among the unlabelled get a weight: by
    ``clear`` standard deviations of a Poisson count (rare words would only be learnt by heart). Where the negative
    part falls below zero its gradient is turned round, scaled by ``turned``.
    """
    positive = target == 1
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    times = [np.bincount(places, np.repeat(part.astype(float), np.diff(offsets)), 1 << X.BITS) for part in (positive, ~positive)]
    due = n_p * (times[1] + 0.5) / (n_u + 1)
    common = (times[0] + times[1] >= 3) & (np.abs(times[0] - due) >= clear * np.sqrt(due + 1))
    keep = common[places]
    offsets, places = np.r_[0, np.cumsum(keep)][offsets], places[keep]
    w, b, adam = np.zeros(1 << X.BITS), np.array([np.log(prior / (1 - prior))]), X.Adam(rate)
    mean_w, mean_b, half = np.zeros_like(w), 0.0, rounds // 2
    for adam.t in range(1, rounds + 1):
        adam.rate = rate * 0.5 * (1 + np.cos(np.pi * adam.t / (rounds + 1)))
        s = _sigmoid(X.totals(w, offsets, places) + b[0])
        # Logistic loss: l(f) = -log s, l(-f) = -log(1 - s); their slopes are s - 1 and s.
        loss = -np.log(np.maximum(1 - s, 1e-12))
        negative = loss[~positive].sum() / n_u - prior * loss[positive].sum() / n_p
        up = np.where(positive, prior * (s - 1) / n_p, 0.0)
        rest = np.where(positive, -prior * s / n_p, s / n_u)
        slope = up + rest if negative >= 0 else -turned * rest
        w = adam.step("w", w, X.gradient(offsets, places, slope) + decay * w)
        b = adam.step("b", b, np.array([slope.sum()]))
        if adam.t > half:
            mean_w += w / (rounds - half)
            mean_b += b[0] / (rounds - half)
    return mean_w, float(mean_b)


def toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic). Returns (doc_id, held_out, score, predicted), a row per row of docs.

    The sample is drawn by hash of the id from rows outside the held-out fold, at most ``positives`` texts labelled
    1 and ``unlabelled`` texts of any kind (their labels are not looked at), one text of each id. ``prior`` is the share of toxic texts;
    by default their share among the labelled rows outside the fold. Null and empty texts have no features and get
    the score of the bias alone. With no toxic label to learn from every score is 0. Rows without an id take no part.
    """
    spark = docs.sparkSession
    learn = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic is not null").filter(
        X.fold(F.col("doc_id"), FOLDS) != 0)
    if prior is None:
        prior = learn.agg(F.avg("toxic")).first()[0] or 0.0
    draw = F.xxhash64("doc_id")
    toxic = learn.filter("toxic = 1").select("doc_id").distinct().orderBy(draw, "doc_id").limit(positives)
    ids = docs.select(F.col("doc_id").cast("long")).filter("doc_id is not null").filter(X.fold(F.col("doc_id"), FOLDS) != 0)
    other = ids.distinct().orderBy(draw, "doc_id").limit(unlabelled)
    chosen = toxic.withColumn("target", F.lit(1.0)).union(other.withColumn("target", F.lit(0.0)))
    sample = X.first_texts(docs, chosen).join(F.broadcast(chosen), "doc_id").select("target", "text")  # at most positives + unlabelled rows
    body = X.fit_in_one_task(sample, False, lambda t, o, p: _model(t, o, p, prior)) if prior > 0 else b""
    model = spark.sparkContext.broadcast(np.frombuffer(body, np.float32).astype(np.float64))  # 2 ** BITS + 1 numbers

    def value(offsets, places):
        m = model.value
        if not len(m):
            return [np.zeros(len(offsets) - 1)]
        return [_sigmoid(X.totals(m[:-1], offsets, places) + float(m[-1]))]

    found = X.scored(docs, False, ["score"], value)
    return found.select("doc_id", (X.fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _model(target, offsets, places, prior: float) -> bytes:
    if not (target == 1).any():
        return b""
    w, b = fit_nnpu(target, offsets, places, min(prior, 0.99))
    return np.r_[w, b].astype(np.float32).tobytes()
