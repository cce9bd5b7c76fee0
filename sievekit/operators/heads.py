"""A classification head of two layers, fitted to rows where they lie.

In every round each task takes the shared weights through its own rows, in
mini-batches with dropout and class weights, several times over each Arrow batch,
and the weights are averaged by the tasks' numbers of rows. A task holds one Arrow
batch; what goes to the driver is a few rows of the weights' size. The round with
the best balanced accuracy on the validation rows counts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tasks that add up the weights of all others.
SUMS = 16


class Head:
    """Weights of a hidden layer of rectified units and an output layer; classes in the order of the outputs."""

    def __init__(self, size: int, classes: list, hidden: int, seed: int = 42):
        draw = np.random.default_rng(seed)
        self.classes, self.shapes = classes, ((size, hidden), (hidden,), (hidden, len(classes)), (len(classes),))
        self.weights = [draw.uniform(-1, 1, s) / s[0] ** 0.5 if len(s) == 2 else np.zeros(s) for s in self.shapes]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return softmax(np.maximum(x @ w1 + b1, 0) @ w2 + b2)

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def unflat(self, values: np.ndarray) -> list[np.ndarray]:
        parts = np.split(values, np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1])
        return [p.reshape(s).copy() for p, s in zip(parts, self.shapes)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Steps:
    """Adam steps on the weighted cross entropy, with dropout on the hidden layer."""

    def __init__(self, head: Head, class_weights: np.ndarray, dropout: float, rate: float, decay: float, seed: int):
        self.head, self.cost, self.dropout, self.rate, self.decay = head, class_weights, dropout, rate, decay
        self.draw, self.n = np.random.default_rng(seed), 0
        self.first, self.second = ([np.zeros(s) for s in head.shapes] for _ in range(2))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w1, b1, w2, b2 = self.head.weights
        hidden = np.maximum(x @ w1 + b1, 0)
        mask = (self.draw.random(hidden.shape) >= self.dropout) / (1 - self.dropout)
        out = softmax((hidden * mask) @ w2 + b2)
        out[np.arange(len(y)), y] -= 1
        out *= (self.cost[y] / self.cost[y].sum())[:, None]
        back = (out @ w2.T) * mask * (hidden > 0)
        return [x.T @ back + self.decay * w1, back.sum(axis=0), (hidden * mask).T @ out + self.decay * w2, out.sum(axis=0)]

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        self.n += 1
        for i, g in enumerate(self.gradients(x, y)):
            self.first[i] = 0.9 * self.first[i] + 0.1 * g
            self.second[i] = 0.999 * self.second[i] + 0.001 * g**2
            self.head.weights[i] = self.head.weights[i] - self.rate * (self.first[i] / (1 - 0.9**self.n)) / (np.sqrt(self.second[i] / (1 - 0.999**self.n)) + 1e-8)


def _arrays(batch: pa.RecordBatch, features: str) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(features))
    return np.asarray(lists.flatten(), float).reshape(len(lists), -1)


def fit_head(train: DataFrame, validation: DataFrame, label: str, features: str, hidden: int = 64, dropout: float = 0.3, rounds: int = 12, passes: int = 10, rate: float = 1e-3, decay: float = 1e-4, batch: int = 64, seed: int = 42) -> Head:
    """The head for the labels that occur in train, in ascending order.

    Class weights are total / (classes * rows of the class). Rows with a null
    label or features don't count. Validation rows of other labels are left
    out; without any validation rows the last round counts.
    """
    train = train.select(F.col(label).alias("__y"), F.col(features).cast("array<double>").alias("__x")).where("__y is not null and __x is not null").persist()
    counts = {r["__y"]: r.n for r in train.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    if not counts:
        raise ValueError("no row to fit to")
    classes = sorted(counts)
    cost = np.array([sum(counts.values()) / (len(classes) * counts[c]) for c in classes])
    place = {c: i for i, c in enumerate(classes)}
    held = validation.select(F.col(label).alias("__y"), F.col(features).cast("array<double>").alias("__x")).where("__x is not null").where(F.col("__y").isin(classes)).persist()
    head = Head(len(train.select("__x").first()[0]), classes, hidden, seed)
    best, kept = -1.0, head.weights
    for k in range(rounds):
        sums = _round(train, head, place, cost, dropout, rate, decay, batch, passes, seed + k)
        head.weights = head.unflat(sums[1:] / sums[0])
        score = _balanced(held, head, place)
        if score is None or score > best:
            best, kept = score or best, head.weights
    train.unpersist(), held.unpersist()
    head.weights = kept
    return head


def _round(train: DataFrame, head: Head, place: dict, cost: np.ndarray, dropout: float, rate: float, decay: float, size: int, passes: int, seed: int) -> np.ndarray:
    """The number of rows, and the tasks' new weights times their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Head.__new__(Head)
        mine.__dict__ = head.__dict__ | {"weights": [w.copy() for w in head.weights]}
        steps, n = Steps(mine, cost, dropout, rate, decay, seed), 0
        for b in batches:
            x, y = _arrays(b, "__x"), np.array([place[v] for v in b.column(0).to_pylist()])
            for _ in range(passes):
                for at in np.array_split(steps.draw.permutation(len(y)), max(1, len(y) // size)):
                    steps.step(x[at], y[at])
            n += len(y)
        if n:
            yield pa.RecordBatch.from_pydict({"values": [np.concatenate([[n], mine.flat() * n]).tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(0):
                part = np.frombuffer(v.as_buffer(), float)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"values": [total.tobytes()]})

    parts = train.mapInArrow(run, "values binary").repartition(SUMS).mapInArrow(add, "values binary").collect()  # at most SUMS rows of the weights' size
    return np.sum([np.frombuffer(r["values"], float) for r in parts], axis=0)


def _balanced(rows: DataFrame, head: Head, place: dict) -> float | None:
    """Mean recall of the classes that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.array([place[v] for v in b.column(0).to_pylist()])
            if len(y):
                right = head.probabilities(_arrays(b, "__x")).argmax(axis=1) == y
                yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "hit": pa.array(right.astype(float))})

    return rows.mapInArrow(run, "y int, hit double").groupBy("y").agg(F.avg("hit").alias("recall")).agg(F.avg("recall")).first()[0]


def scored(rows: DataFrame, head: Head, features: str) -> DataFrame:
    """Adds pred_class, confidence and entropy to every row, whatever its label: classes that the head doesn't know are forced into those that it does."""

    names = [c for c in rows.columns if c not in ("pred_class", "confidence", "entropy")]
    kind = "string" if isinstance(head.classes[0], str) else "integer"
    out = rows.select(*names).schema.add("pred_class", kind).add("confidence", "double").add("entropy", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                p = head.probabilities(_arrays(b, features))
                made = [pa.array([head.classes[i] for i in p.argmax(axis=1)], pa.string() if kind == "string" else pa.int32()), pa.array(p.max(axis=1)), pa.array(-(np.clip(p, 1e-12, 1) * np.log(np.clip(p, 1e-12, 1))).sum(axis=1))]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "pred_class", "confidence", "entropy"])

    return rows.select(*names).where(F.col(features).isNotNull()).mapInArrow(run, out)
