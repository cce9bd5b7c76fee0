import numpy as np
import pytest

from sievekit.operators import margins


def rows(n=400, d=6, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d)) * np.array([1, 10, 0.1, 1, 5, 2])[:d] + np.array([0, 100, 3, 0, 0, -7])[:d]
    x[:, 3] = 4.0  # constant
    y = ((x[:, 0] + (x[:, 1] - 100) / 10 + draw.normal(size=n)) > 0.8).astype(int)
    return x, y


def solved(x, y, cost=1.0, balanced=True):
    """The same objective by plain gradient descent with backtracking, to a gradient of 1e-9."""
    deviation = x.std(axis=0)
    x = np.column_stack([(x - x.mean(axis=0)) / np.where(deviation > 1e-12, deviation, 1.0), np.ones(len(x))])
    s = np.where(y == 1, 1.0, -1.0)
    c = cost * (np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y != 1).sum())) if balanced else np.ones(len(y)))
    f = lambda w: w @ w / 2 + (c * np.maximum(0, 1 - s * (x @ w)) ** 2).sum()
    g = lambda w: w - 2 * x.T @ (c * s * np.maximum(0, 1 - s * (x @ w)))
    w, rate = np.zeros(x.shape[1]), 1e-3
    for _ in range(200_000):
        d = g(w)
        if np.linalg.norm(d) < 1e-9:
            break
        while f(w - rate * d) > f(w) - rate / 2 * (d @ d) and rate > 1e-12:
            rate /= 2
        w, rate = w - rate * d, rate * 1.3
    return f(w), x @ w


@pytest.mark.parametrize("dense,cost,balanced", [(512, 1.0, True), (0, 1.0, True), (512, 0.01, False)])
def test_objective_and_margins_equal_another_solver(spark, monkeypatch, dense, cost, balanced):
    monkeypatch.setattr(margins, "DENSE", dense)
    x, y = rows()
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "i long, x array<double>, y int").repartition(3)
    more = spark.createDataFrame([(-1, None, 1), (-2, [1.0] * 6, None)], df.schema)
    model = margins.fit_squared_hinge(df.unionByName(more), "y", "x", cost, balanced)
    value, margin = solved(x, y, cost, balanced)
    assert abs(model.objective - value) <= 1e-6 * value
    found = {r.i: r.m for r in df.select("i", model.margin("x").alias("m")).collect()}
    assert np.allclose([found[i] for i in range(len(y))], margin, atol=1e-5)


def test_null_or_short_features_have_no_margin(spark):
    model = margins.LinearModel(np.array([1.0, 2.0]), 0.5, 0.0)
    df = spark.createDataFrame([([1.0, 1.0],), ([1.0],), (None,)], "x array<double>")
    assert sorted(str(r.m) for r in df.select(model.margin("x").alias("m")).collect()) == ["3.5", "None", "None"]


def test_one_class_is_an_error(spark):
    with pytest.raises(ValueError):
        margins.fit_squared_hinge(spark.createDataFrame([([1.0], 1)], "x array<double>, y int"), "y", "x")
