"""A linear classifier by squared hinge loss, solved where the rows lie.

With y = -1 or 1, standardised features x and a last feature of 1 for the constant,
it minimises |w|**2 / 2 + sum of c * max(0, 1 - y w.x)**2, where c is the cost of a
row: `cost`, times total / (2 * rows of the class) if classes are balanced. The
problem has one solution. A trust-region Newton method finds it: each step solves
for the Newton direction by conjugate gradients inside a radius, which grows and
shrinks by how well the quadratic model foretold the loss. Loss, gradient and
curvature are sums over rows, which tasks form and a few tasks add up; up to
DENSE features the curvature is summed once a step as a matrix, beyond that each
product with a vector is a pass over the rows. What goes to the driver is a few
rows of the gradient's (or that matrix's) size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.sources.shared import drop, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tasks that add up the sums of all others, and features up to which curvature is kept as a matrix.
SUMS, DENSE = 16, 512


@dataclass(frozen=True)
class LinearModel:
    """Weights over features as they come, and the constant."""

    weights: np.ndarray
    constant: float
    objective: float

    def margin(self, features: str) -> Column:
        """w.x + b of an array column; null features or another length have none."""
        table = F.array(*[F.lit(float(w)) for w in self.weights])
        products = F.zip_with(F.col(features).cast("array<double>"), table, lambda x, w: x * w)
        return F.when(F.size(features) == len(self.weights), F.aggregate(products, F.lit(float(self.constant)), lambda a, x: a + x))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column(0)
    x = np.asarray(lists.flatten(), float).reshape(len(lists), -1)
    return x, np.asarray(batch.column(1), float), np.asarray(batch.column(2), float)


def _summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(x, y, cost) over all batches of rows (features, y, cost)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                one = part(*_arrays(b))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"values": [total.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(0):
                one = np.frombuffer(v.as_buffer(), float)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"values": [total.tobytes()]})

    parts = rows.mapInArrow(run, "values binary").repartition(SUMS).mapInArrow(add, "values binary").collect()  # at most SUMS rows
    return np.sum([np.frombuffer(r["values"], float) for r in parts], axis=0)


def _scaling(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations (over n) of the features; a constant feature has the deviation 1."""
    sums = _summed(rows, lambda x, y, c: np.r_[len(x), x.sum(axis=0)])
    mean = sums[1:] / sums[0]
    squares = _summed(rows, lambda x, y, c: ((x - mean) ** 2).sum(axis=0)) / sums[0]
    deviation = np.sqrt(squares)
    return mean, np.where(deviation > 10 * np.finfo(float).eps * np.abs(mean), deviation, 1.0)


def fit_squared_hinge(train: DataFrame, label: str, features: str, cost: float = 1.0, balanced: bool = True, tolerance: float = 1e-9, steps: int = 200) -> LinearModel:
    """The classifier of label 1 against all others. Rows with a null label or features don't count; both classes must occur."""
    rows = train.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.when(F.col(label) == 1, 1.0).otherwise(-1.0).alias("y"))
    rows = stored(rows, "margin-rows")
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(counts) < 2:
        raise ValueError("both classes must occur")
    costs = {y: cost * (sum(counts.values()) / (2 * n) if balanced else 1.0) for y, n in counts.items()}
    rows_ = rows.withColumn("c", F.when(F.col("y") > 0, costs[1.0]).otherwise(costs[-1.0]))
    mean, deviation = _scaling(rows_)
    scaled = lambda x: np.column_stack([(x - mean) / deviation, np.ones(len(x))])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        def part(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
            x = scaled(x)
            short = np.maximum(0, 1 - y * (x @ w))
            return np.r_[(c * short**2).sum(), -2 * (x.T @ (c * y * short))]

        sums = _summed(rows_, part)
        return float(w @ w / 2 + sums[0]), w + sums[1:]

    def curvature(w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        def active(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = scaled(x)
            inside = y * (x @ w) < 1
            return x[inside], c[inside]

        def matrix(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
            x, c = active(x, y, c)
            return 2 * ((x * c[:, None]).T @ x).ravel()

        def product(v: np.ndarray) -> np.ndarray:
            def part(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
                x, c = active(x, y, c)
                return 2 * (x.T @ (c * (x @ v)))

            return v + _summed(rows_, part)

        if len(w) > DENSE:
            return product
        whole = _summed(rows_, matrix).reshape(len(w), len(w))
        return lambda v: v + whole @ v

    w, value = minimised(loss, curvature, len(mean) + 1, tolerance, steps)
    drop(rows)
    weights = w[:-1] / deviation
    return LinearModel(weights, float(w[-1] - weights @ mean), value)


def minimised(loss: Callable, curvature: Callable, size: int, tolerance: float, steps: int) -> tuple[np.ndarray, float]:
    """The minimum of a convex function with a given gradient and curvature, by steps inside a trust region."""
    w = np.zeros(size)
    value, gradient = loss(w)
    first = radius = float(np.linalg.norm(gradient))
    for _ in range(steps):
        if np.linalg.norm(gradient) <= tolerance * first or radius < 1e-15:
            break
        step, residual = _inside(gradient, curvature(w), radius)
        foretold = (step @ residual - gradient @ step) / 2
        after, slope = loss(w + step)
        gain = (value - after) / foretold if foretold > 0 else 0.0
        length = float(np.linalg.norm(step))
        radius = min(radius, length) / 4 if gain < 0.25 else max(radius, 2 * length) if gain > 0.75 else radius
        if after < value:
            w, value, gradient = w + step, after, slope
        elif foretold <= 1e-14 * max(1.0, abs(value)):
            break  # what is left is below the precision of the sums
    return w, value


def _inside(gradient: np.ndarray, product: Callable[[np.ndarray], np.ndarray], radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(step, residual) of the Newton equation by conjugate gradients, cut where the step would leave the radius."""
    step, residual = np.zeros_like(gradient), -gradient
    direction = residual.copy()
    norm = residual @ residual
    enough = 1e-6 * np.sqrt(norm)
    for _ in range(2 * len(gradient)):
        if np.sqrt(norm) <= enough:
            break
        bent = product(direction)
        alpha = norm / (direction @ bent)
        if np.linalg.norm(step + alpha * direction) > radius:
            a, b, c = direction @ direction, 2 * step @ direction, step @ step - radius**2
            alpha = (-b + np.sqrt(max(b * b - 4 * a * c, 0.0))) / (2 * a)
            return step + alpha * direction, residual - alpha * bent
        step, residual = step + alpha * direction, residual - alpha * bent
        norm, before = residual @ residual, norm
        direction = residual + norm / before * direction
    return step, residual
