"""Learners, heads, kernels and resampling against numbers worked out otherwise."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.functions import kernels
from sievekit.operators import forests, heads, learning, metrics, resampling


def points(n=400, seed=0):
    draw = np.random.default_rng(seed)
    x = draw.normal(0, 1, (n, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] + [5, 0, 0, 0, 0, 0]
    return x, ((x[:, 1] > 0) ^ (x[:, 2] > 0)).astype(int)


def test_gradients_equal_finite_differences():
    head = heads.Head(5, [0, 1, 2], 4)
    draw = np.random.default_rng(1)
    x, y, cost = draw.normal(size=(9, 5)), draw.integers(0, 3, 9), np.array([1.0, 2.0, 0.5])
    steps = heads.Steps(head, cost, 0.0, 1e-3, 0.0, 0)

    def loss():
        return float((cost[y] * -np.log(head.probabilities(x)[np.arange(9), y])).sum() / cost[y].sum())

    for w, g in zip(head.weights, steps.gradients(x, y)):
        for at in list(np.ndindex(w.shape))[:6]:
            kept = w[at]
            w[at] = kept + 1e-6
            above = loss()
            w[at] = kept - 1e-6
            assert (above - loss()) / 2e-6 == pytest.approx(g[at], abs=1e-6)
            w[at] = kept


def test_head_learns_what_no_line_divides(spark):
    x, y = points()
    rows = spark.createDataFrame([(i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y))] + [(1000, None, 1), (1001, [0.0] * 6, None)], "k int, x array<double>, y int").repartition(3)
    head = heads.fit_head(rows.where("k < 300 or k > 900"), rows.where("k between 300 and 349"), "y", "x", rounds=8, passes=25, rate=1e-2)
    got = heads.scored(rows, head, "x").collect()
    assert len(got) == 401 and head.classes == [0, 1]  # a row without a label is scored, one without features isn't
    held = [r for r in got if 350 <= r.k < 400]
    assert np.mean([r.pred_class == r.y for r in held]) > 0.85
    p = head.probabilities(np.array([r.x for r in held]))
    assert np.allclose([r.confidence for r in held], p.max(axis=1)) and np.allclose([r.entropy for r in held], -(p * np.log(np.clip(p, 1e-12, 1))).sum(axis=1))


def test_head_weighs_classes(spark):
    draw = np.random.default_rng(3)
    rows = [([float(v)], "rare" if i % 20 == 0 else "often") for i, v in enumerate(draw.normal(0, 1, 600) + 1.5 * (np.arange(600) % 20 == 0))]
    df = spark.createDataFrame(rows, "x array<double>, y string")
    head = heads.fit_head(df, df, "y", "x", hidden=8, rounds=6, rate=1e-2)
    recall = {r.y: r.r for r in heads.scored(df, head, "x").groupBy("y").agg(F.avg((F.col("pred_class") == F.col("y")).cast("double")).alias("r")).collect()}
    assert recall["rare"] > 0.5 and recall["often"] > 0.5


def test_components_equal_numpy(spark):
    x, _ = points()
    rows = learning.as_vectors(spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "k int, x array<double>"), "x")
    model = learning.fit_components(rows, 3)
    got = np.array([r.components.toArray() for r in model.transform(rows).orderBy("k").collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(z @ axes[:3].T), atol=1e-6)
    two = learning.fused(learning.fit_channels(rows.drop("vector"), {"x": 2}), rows.drop("vector")).orderBy("k").collect()
    assert np.allclose(np.abs([r.components for r in two]), np.abs(got[:, :2]), atol=1e-6)


def test_linear_svm_finds_the_better_half_plane(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(0, 1, (500, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.3 > 0).astype(int)
    rows = learning.as_vectors(spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y)], "x array<double>, y int"), "x")
    got = learning.margins(learning.fit_linear_svm(rows, "y"), rows).collect()
    assert np.mean([r.pred == r.y for r in got]) > 0.97 and all(r.pred == (r.score >= 0) for r in got)


def test_probe_names_the_telling_column(spark):
    draw = random.Random(2)
    rows = [(draw.random(), v := draw.random(), int(v > 0.5)) for _ in range(400)]
    got = {r.feature: r.importance for r in learning.probe_importances(spark.createDataFrame(rows, "a double, b double, y int"), ["a", "b"], "y", trees=30).collect()}
    assert got["b"] > 0.8 and sum(got.values()) == pytest.approx(1)


def test_weights_are_poisson(spark):
    limits = [int(x, 16) / 2**64 for x in resampling.poisson_limits()]
    assert np.allclose(limits, np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), atol=1e-9)
    rows = spark.range(300).select(F.col("id"), (F.col("id") % 3 == 0).alias("hit"))
    reps = resampling.replicates(rows, F.col("id"), ["hit"], 402)
    per = {r.rep: r.n for r in reps.groupBy("rep").agg(F.sum("n").alias("n")).collect()}
    assert set(per) == set(range(402)) and np.mean(list(per.values())) == pytest.approx(300, abs=4) and np.var(list(per.values())) == pytest.approx(300, rel=0.25)
    rates = reps.groupBy("rep").agg(resampling.share(F.col("hit")).alias("v"))
    got = resampling.interval(rates, "v").first()
    assert got["mean"] == pytest.approx(1 / 3, abs=0.01) and got["std"] == pytest.approx(math.sqrt(2 / 9 / 300), rel=0.15) and got.n_reps == 402
    assert sorted(map(tuple, reps.collect())) == sorted(map(tuple, resampling.replicates(rows.repartition(5), F.col("id"), ["hit"], 402).collect()))


def test_clusters_are_drawn_whole(spark):
    rows = spark.range(60).select((F.col("id") % 6).alias("g"), F.col("id").alias("k"))
    reps = resampling.replicates(rows, F.col("g"), ["g"], 40).collect()
    assert reps and all(r.n % 10 == 0 for r in reps)


def test_sweep_over_ranges_equals_one_pass(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RANGES", 5)
    draw = random.Random(8)
    rows = [(draw.choice(["a", "b", None]), draw.choice([0, 1, None]), draw.choice([round(draw.random(), 2), 0.5, None]), draw.randrange(1, 4)) for _ in range(600)]
    got = {(r.g, r.score): (r.p, r.n, r.tp, r.fp, r.pos, r.neg) for r in metrics.sweep(spark.createDataFrame(rows, "g string, y_true int, score double, w int"), by=["g"], weight="w").collect()}
    for g in ("a", "b", None):
        mine = [(y, s, w) for h, y, s, w in rows if h == g and s is not None]
        total = lambda keep: (sum(w for y, s, w in mine if y == 1 and keep(s)), sum(w for y, s, w in mine if y != 1 and keep(s)))
        scores = {s for _, s, _ in mine}
        assert {s for h, s in got if h == g} == scores
        for s in scores:
            assert got[g, s] == (*total(lambda x: x == s), *total(lambda x: x >= s), *total(lambda x: True))


def test_mcnemar_of_large_counts(spark):
    cases = [(0, 0), (1, 0), (3, 9), (15, 2), (20, 20), (700, 820), (49_000, 50_000), (10**9, 10**9 + 10**5)]
    rows = spark.createDataFrame(cases, "a long, b long").select("a", "b", metrics.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        n, k = r.a + r.b, min(r.a, r.b)
        if n <= 2000:
            exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        else:  # the normal approximation with its continuity correction
            exact = math.erfc((abs(r.a - r.b) - 1) / math.sqrt(2 * n))
        assert r.p == pytest.approx(exact, rel=1e-9 if n <= 2000 else 2e-3), (r.a, r.b)


def test_kernels_take_batches():
    draw = np.random.default_rng(4)
    images = draw.uniform(-1, 1, (5, 16, 24))
    named = {"dct": kernels.log_dct, "fft": kernels.spectrum, "tiles": kernels.tile_energy, "bank": lambda g: kernels.high_pass_response(g, True), **{m: (lambda g, m=m: kernels.fingerprint(g, 8, m)) for m in ("both", "residual", "spectrum")}, **kernels.VARIANTS, **kernels.PERTURBATIONS}
    for name, kernel in named.items():
        together = kernel(images)
        for i in range(5):
            assert np.allclose(together[i], kernel(images[i])), name


def test_kernel_values():
    draw = np.random.default_rng(6)
    g = draw.uniform(-1, 1, (8, 8))
    y, x = np.mgrid[:8, :8]
    for k, l in ((0, 0), (1, 2), (7, 5)):
        scale = (math.sqrt(1 / 8) if k == 0 else 0.5) * (math.sqrt(1 / 8) if l == 0 else 0.5)
        c = scale * (g * np.cos(np.pi * (2 * y + 1) * k / 16) * np.cos(np.pi * (2 * x + 1) * l / 16)).sum()
        assert kernels.log_dct(g)[k, l] == pytest.approx(math.log(abs(c) + 1e-8), abs=1e-9)
        f = (g * np.exp(-2j * np.pi * (k * y + l * x) / 8)).sum()
        assert kernels.spectrum(g)[(k + 4) % 8, (l + 4) % 8] == pytest.approx(math.log1p(abs(f)), abs=1e-9)
    ramp = np.tile(np.arange(12.0), (12, 1))
    assert np.allclose(kernels.resize(ramp, 12, 24)[:, 6:-6], (np.arange(24)[6:-6] + 0.5) / 2 - 0.5)  # cubics keep straight lines
    assert np.allclose(kernels.luminance(np.array([[[1.0, 0, 0], [0, 1, 0], [0, 0, 1]]])), [[0.299, 0.587, 0.114]])
    falling, rising = np.tile(np.arange(18.0, 0, -1), (16, 1)), np.tile(np.arange(18.0), (16, 1))
    assert kernels.difference_hash(falling) == 0 and kernels.difference_hash(rising) == -1
    flat = np.full((8, 8), 0.25)
    assert np.allclose(kernels.jpeg(flat, 90, -1, 1), flat, atol=2 / 255) and len(np.unique(kernels.jpeg(g, 1, -1, 1).round(9))) < 64
    assert np.allclose(kernels.residual(flat, 8), 0) and np.allclose(kernels.tile_energy(np.ones((16, 16))), 0)


def test_permuted_columns_hold_the_same_values(spark):
    rows = spark.createDataFrame([(i, float(i), float(-i)) for i in range(300)], "k long, a double, b double")
    got = learning.permuted(rows, ["a", "b"], "k").toPandas()
    for c, other in (("a", "b"), ("b", "a")):
        one = got[got["permuted"] == c].sort_values("k")
        assert sorted(one[c]) == sorted(float(i if c == "a" else -i) for i in range(300))
        assert (one[other] == [-float(i) if c == "a" else float(i) for i in range(300)]).all()
        assert (one[c].abs() == one["k"]).mean() < 0.1


def test_held_out_probe_blames_the_telling_column_and_source(spark):
    draw = random.Random(8)
    rows = [(i, "big" if i % 3 == 0 else f"s{i % 2}", float(i % 3 == 0) + draw.random() / 4, draw.random(), int(i % 3 == 0)) for i in range(600)]
    rows += [(1000, "big", None, 0.5, 1), (1001, "big", 0.5, 0.5, None)]
    got = learning.held_out_probe(spark.createDataFrame(rows, "k long, source string, a double, b double, y int"), ["a", "b"], "y", "k", "source", trees=20).collect()
    value = {(r.kind, r.name): (r.n, r.value) for r in got}
    assert len(got) == len(value) == 2 + 2 + 2 + 3
    assert value["metric", "balanced_accuracy"] == (120, 1.0) and value["metric", "auroc"] == (120, 1.0)
    assert value["permutation", "a"][1] > 0.3 > 0.02 > abs(value["permutation", "b"][1])
    assert value["importance", "a"][1] > 0.9
    assert value["source", "big"] == (40, 1.0) and value["source", "s0"][1] == value["source", "s1"][1] == 0.0


def test_forest_counts_cells_and_not_rows(spark):
    rows = spark.range(40000).select((F.col("id") % 100).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 100 >= 60).cast("int").alias("y"))
    gains, scored = forests.forest(rows, ["a", "b"], "y", 20, 1, rows.distinct())
    assert gains[0] > 0.95 and sum(gains) == pytest.approx(1)
    assert all((r.chance >= 0.5) == (r.y == 1) for r in scored.collect())
    again, _ = forests.forest(rows.repartition(7), ["a", "b"], "y", 20, 1)
    assert np.allclose(gains, again)
