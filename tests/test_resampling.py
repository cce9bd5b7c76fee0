import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.operators import resampling


def cdf(n, p):
    return np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])


@pytest.mark.parametrize("n,p", [(1, 0.5), (7, 0.1), (60, 0.93), (300, 0.4), (0, 0.3), (5, 1.0)])
def test_binomial_quantile_inverts_the_distribution(n, p):
    u = np.r_[0.0, np.random.default_rng(1).random(400), 1 - 1e-9]
    want = [n if p >= 1 else min(n, int(np.searchsorted(cdf(n, p), x, side="right"))) for x in u]
    assert resampling.binomial_quantile(n, p, u).tolist() == want


def test_binomial_quantile_of_very_many_draws():
    n, p = 10**12, 0.3
    k = resampling.binomial_quantile(n, p, np.random.default_rng(2).random(4000))
    z = (k - n * p) / math.sqrt(n * p * (1 - p))
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05


def test_draws_keep_each_class_and_have_the_moments_of_the_multinomial(spark):
    rows = [("a", "xyzzz"[i % 5], 1) for i in range(50)] + [("b", "x", 1)] * 7 + [(None, "x", 1), (None, "y", 1), ("c", "x", 30), ("c", "y", 10)]
    df = spark.createDataFrame(rows, "c string, cell string, size int")
    draws = resampling.multinomial_cells(df, "c", ["cell"], 500, "size").toPandas()
    for c, n in (("a", 50), ("b", 7), ("c", 40)):
        sums = draws[draws["c"] == c].groupby("rep")["n"].sum()
        assert len(sums) == 500 and set(sums) == {n}
    assert set(draws[draws["c"].isna()].groupby("rep")["n"].sum()) == {2}
    z = draws[(draws["c"] == "a") & (draws["cell"] == "z")].set_index("rep")["n"].reindex(range(500), fill_value=0)
    assert abs(z.mean() - 30) < 0.6 and abs(z.var() - 12) < 3
    y = draws[(draws["c"] == "a") & (draws["cell"] == "y")].set_index("rep")["n"].reindex(range(500), fill_value=0)
    assert abs(np.cov(z, y)[0, 1] + 6) < 2.5
    assert resampling.multinomial_cells(df.limit(0), "c", ["cell"], 5).collect() == []


@pytest.mark.parametrize("range_rows", [1 << 14, 40])
def test_auroc_of_every_replicate_equals_pairs(spark, monkeypatch, range_rows):
    """Continuous scores, ties across batches, and scores that a third of the rows share."""
    monkeypatch.setattr(resampling, "RANGE_ROWS", range_rows)
    draw = random.Random(3)
    rows = [(i, draw.randrange(2), draw.choice([0.5, 0.5, 0.25, draw.random(), draw.random(), round(draw.random(), 1)])) for i in range(400)] + [(900, 1, None), (901, None, 0.7), (902, 1, math.nan)]
    reps = 120
    df = spark.createDataFrame(rows, "k long, y int, s double").repartition(3)
    found = {r.rep: r.auroc for r in resampling.auroc_replicates(df, "k", "y", "s", reps).collect()}
    used = [(k, y == 1, s) for k, y, s in rows if s is not None and not math.isnan(s)]
    weights = resampling.poisson_weights([str(k) for k, _, _ in used], 0, reps)
    y, s = np.array([u[1] for u in used]), np.array([u[2] for u in used])
    above = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :])
    for rep in range(reps):
        p, n = weights[:, rep] * y, weights[:, rep] * ~y
        assert math.isclose(found[rep], p @ above @ n / (p.sum() * n.sum()), rel_tol=1e-12)
    assert len(found) == reps


def test_weights_are_those_of_the_replicates(spark):
    df = spark.createDataFrame([(i,) for i in range(30)], "k long")
    sums = {r.rep: r.n for r in resampling.replicates(df, F.col("k"), [], 40).collect()}
    weights = resampling.poisson_weights([str(i) for i in range(30)], 0, 40)
    assert {rep: int(n) for rep, n in enumerate(weights.sum(axis=0)) if n} == sums


def test_auroc_without_a_second_class_or_rows(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.6)], "k long, y int, s double")
    assert resampling.auroc_replicates(df, "k", "y", "s", 8).collect() == []
    assert resampling.auroc_replicates(df.limit(0), "k", "y", "s", 8).collect() == []
