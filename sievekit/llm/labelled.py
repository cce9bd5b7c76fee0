"""Labelled rows for the classifiers: the held-out fold and bounded, hash-drawn samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _draw(salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 24)) / F.lit(float(1 << 24))


def labelled(labels: DataFrame, label: str, training: Column) -> DataFrame:
    """(doc_id, y, part) of every training row.

    A row with a null id or label isn't used; an id with several labels counts
    once, with its largest label. part is a hash in [0, 1) for splits of the rows.
    """
    rows = labels.where(training & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    return rows.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y")).withColumn("part", _draw("part"))


def sample(labels: DataFrame, label: str, training: Column, most: int) -> tuple[DataFrame, dict[int, float]]:
    """About `most` of labelled()'s rows of each class, and how many rows each sampled row stands for.

    Rows are drawn by a hash of the id, so that a rerun draws the same rows. The
    result has 2 * most rows in the mean at any size of the input, which bounds
    what may be broadcast.
    """
    rows = labelled(labels, label, training)
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = F.lit(False)
    for y, n in counts.items():
        wanted = wanted | ((F.col("y") == y) & (_draw("drawn") < most / n))
    return rows.where(wanted), {y: max(1.0, n / most) for y, n in counts.items()}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last belongs to the constant."""
    scale = x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum() * len(y)
    for _ in range(50):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w / np.append(scale, 1.0)


def rising_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A logistic regression in which no feature speaks against class 1: the most negative is left out until none is."""
    kept = list(range(x.shape[1]))
    while kept:
        w = logistic(x[:, kept], y, weight)
        worst = int(np.argmin(w[:-1]))
        if w[worst] >= 0:
            break
        del kept[worst]
    else:
        w = logistic(x[:, :0], y, weight)
    out = np.zeros(x.shape[1] + 1)
    out[kept], out[-1] = w[:-1], w[-1]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
