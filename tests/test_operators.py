import random

import pytest
from pyspark.sql import functions as F

from sievekit.functions.hashing import hash_fraction
from sievekit.operators import auditing, learning, metrics, resampling, splitting


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_labels_and_predictions(spark):
    rows = frame(spark, [("real",), ("fake",), ("FAKE",), ("Real",), (None,)], "label string")
    assert [r[0] for r in rows.select(metrics.is_fake_label(F.col("label"))).collect()] == [False, True, True, False, False]
    numbers = frame(spark, [("0",), ("1",), ("-1",), ("1",), (None,)], "p string")
    assert [r[0] for r in numbers.select(metrics.is_fake_prediction(numbers, "p")).collect()] == [False, True, False, True, False]
    names = frame(spark, [("real",), ("fake",)], "p string")
    assert [r[0] for r in names.select(metrics.is_fake_prediction(names, "p")).collect()] == [False, True]
    assert metrics.drop_errors(numbers, "p").count() == 4


def test_detection_and_ranking(spark):
    rows = frame(spark, [(0, 0, 0.1), (0, 0, 0.2), (1, 1, 0.9), (1, 1, 0.8)], "y_true int, pred int, score double")
    got = metrics.detection(rows).first()
    assert (got.n, got.accuracy, got.macro_f1, got.balanced_accuracy) == (4, 1.0, 1.0, 1.0)
    assert tuple(metrics.ranking(rows).first())[:2] == (1.0, 1.0)
    one = frame(spark, [(0, 0, 0.5)], "y_true int, pred int, score double")
    assert metrics.ranking(one).first().auroc is None and metrics.youden(one).count() == 0


def test_auroc_with_ties_equals_pair_counts(spark):
    draw = random.Random(3)
    rows = [(int(draw.random() < 0.4), round(draw.random(), 1)) for _ in range(500)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    got = metrics.ranking(frame(spark, rows, "y_true int, score double")).first()
    assert got.auroc == pytest.approx(brute, abs=1e-12)
    tp = fp = 0
    area = 0.0
    for s in sorted({s for _, s in rows}, reverse=True):
        p, n = sum(x == s for x in pos), sum(x == s for x in neg)
        tp, fp = tp + p, fp + n
        area += p / len(pos) * tp / (tp + fp)
    assert got.auprc == pytest.approx(area, abs=1e-12)


def test_attribution_and_slices(spark):
    rows = frame(spark, [(0, 0)] * 4 + [(1, 0)] * 2, "true_class int, pred_class int")
    assert metrics.attribution(rows).first().balanced_accuracy == 0.5
    data = [("A", "A")] * 4 + [("B", "B")] * 3 + [("S", "D")] + [("D", "D")] * 2
    folded = metrics.slice_fold(frame(spark, data, "true_class string, pred_class string"), ["A", "B", "S"])
    got = metrics.attribution(folded).first()
    assert (got.n, got.top1) == (8, 7 / 8)
    recalls = {r["class"]: r.recall for r in metrics.per_class(folded).collect()}
    assert recalls["S"] == 0
    assert tuple(metrics.attribution(folded.where("false")).first()) == (0, 0.0, 0.0, 0.0)


def test_entropy_rates_and_drops(spark):
    rows = frame(spark, [([0.5, 0.5], 0.9), ([1.0, 0.0], 0.2), ([0.7, 0.3], 0.6)], "p array<double>, c double")
    e = [r[0] for r in rows.select(metrics.entropy(F.col("p"))).collect()]
    assert e[0] > e[2] > e[1]
    assert rows.agg(*metrics.false_known_rates(F.col("c"))).first().fkr_50 == pytest.approx(2 / 3)
    assert rows.where("false").agg(*metrics.false_known_rates(F.col("c"))).first().fkr_50 == 0
    clean = frame(spark, [("a", "x", "x", 0.8), ("b", "y", "y", 0.9)], "path string, truth string, pred string, confidence double")
    bad = frame(spark, [("a", "x", 0.6), ("b", "z", 0.5)], "source_path string, pred string, confidence double")
    got = metrics.robustness(clean, bad, "path", "source_path").first()
    assert (got.flip_rate, got.accuracy_clean) == (0.5, 1.0) and got.confidence_drop == pytest.approx(0.3)


def test_cascade(spark):
    detector = frame(spark, [("a1", "A", 1), ("a2", "A", 0), ("b1", "B", 1), ("r1", "real", 1), ("of1", "OF", 1)], "k string, true_class string, detected int")
    attributor = frame(spark, [("a1", "A"), ("a2", "A"), ("b1", "A"), ("r1", "B"), ("of1", "A")], "k string, pred_class string")
    rows = metrics.cascade(detector, attributor, "k", ["A", "B"], "real").collect()
    known = [r for r in rows if r.known_fake]
    assert len(known) == 3 and sum(r.detected for r in known) == 2 and sum(r.end_to_end_correct for r in known) == 1
    assert [r.k for r in rows if r.out_of_set_fake] == ["of1"]
    with pytest.raises(ValueError):
        metrics.cascade(detector, attributor.where("k <> 'a1'"), "k", ["A"], "real")
    with pytest.raises(ValueError):
        metrics.cascade(detector.union(detector), attributor, "k", ["A"], "real")


def test_mcnemar_against_exact_sums(spark):
    from math import comb

    cases = [(0, 0), (1, 0), (3, 9), (40, 60), (200, 260), (900, 1000)]
    rows = frame(spark, cases, "a long, b long").select(metrics.mcnemar(F.col("a"), F.col("b"))).collect()
    for (a, b), r in zip(cases, rows):
        n = a + b
        exact = 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(min(a, b) + 1)) / 2**n)
        assert r[0] == pytest.approx(exact, rel=1e-9)


def test_split_counts_and_stability(spark):
    rows = [(f"a{i}", 0) for i in range(20)] + [(f"b{i}", 1) for i in range(10)]
    got = {r.k: r.split for r in splitting.assign_splits(frame(spark, rows, "k string, y int"), "k", "y").collect()}
    assert sum(got[f"a{i}"] == "test" for i in range(20)) == 4 and sum(got[f"a{i}"] == "val" for i in range(20)) == 2
    fewer = {r.k: r.split for r in splitting.assign_splits(frame(spark, rows[:-1], "k string, y int"), "k", "y").collect()}
    assert all(fewer[f"a{i}"] == got[f"a{i}"] for i in range(20))


def test_groups_stay_together(spark):
    rows = [("p1", "x", "source:a"), ("p2", "y", "source:a"), ("p3", "x", "source:b"), *((f"s{i}", "x", f"s{i}") for i in range(4))]
    split = splitting.assign_splits(frame(spark, rows, "k string, y string, g string"), "k", "y", "g", seed=7)
    got = {r.k: r.split for r in split.collect()}
    assert got["p1"] == got["p2"]
    assert splitting.assert_no_straddle(split, "k", "g") == 2
    broken = split.withColumn("split", F.when(F.col("k") == "p1", "x").otherwise(F.col("split")))
    with pytest.raises(ValueError):
        splitting.assert_no_straddle(broken, "k", "g")


def test_hash_fraction_equals_python(spark):
    import hashlib

    keys = ["a", "ñ", "", "x/y.png"]
    got = [r[0] for r in frame(spark, [(k,) for k in keys], "k string").select(hash_fraction(5, F.col("k"))).collect()]
    assert got == [int(hashlib.sha256(f"5:{k}".encode()).hexdigest()[:16], 16) / 2**64 for k in keys]


def test_round_robin_is_balanced_and_order_free(spark):
    rows = [(f"r{s}-{i}", f"R{s}") for s in (1, 2) for i in range(5)]
    take = lambda x: sorted(r.k for r in splitting.sample_round_robin(frame(spark, x, "k string, s string"), "k", "s", ["R1", "R2"], 4).collect())
    first = take(rows)
    assert first == take(rows[::-1]) and sum(k.startswith("r1") for k in first) == 2


def test_populations(spark):
    rows = frame(spark, [("A",), ("B",), ("OF",)], "y string")
    got = splitting.populations(rows, "y", {"train": ["A", "B"], "oos": ["OF"]}).collect()
    assert [(r.is_train, r.is_oos) for r in got] == [(True, False), (True, False), (False, True)]
    with pytest.raises(ValueError):
        splitting.populations(rows, "y", {"train": ["A"], "oos": ["A"]})
    with pytest.raises(ValueError):
        splitting.populations(rows, "y", {"train": ["missing"]})


def test_banded_pairs_equal_all_pairs(spark):
    draw = random.Random(1)
    base = [draw.getrandbits(63) for _ in range(60)]
    rows = []
    for i, b in enumerate(base):
        rows.append((len(rows), b))
        for _ in range(9):
            x = b
            for _ in range(draw.randrange(0, 10)):
                x ^= 1 << draw.randrange(63)
            rows.append((len(rows), x))
    first = {}
    for i, x in rows:
        first.setdefault(x, i)
    keys = sorted((i, x) for x, i in first.items())
    brute = {(a, b, (x ^ y).bit_count()) for n, (b, y) in enumerate(keys) for a, x in keys[:n] if (x ^ y).bit_count() <= 6}
    got = {tuple(r) for r in auditing.banded_pairs(frame(spark, rows, "id long, sig long"), "id", "sig", 64, 6).collect()}
    assert got == brute


def test_coupling(spark):
    rows = [("1", "real", "train"), ("1", "fake", "test"), ("2", "real", "val"), ("2", "fake", "test"), ("3", "real", "val"), ("3", "fake", "val"), ("4", "real", "test")]
    got = {r.g: r.coupling for r in auditing.coupling(frame(spark, rows, "g string, label string, split string"), "g", "label", "real", "fake").collect()}
    assert got == {"1": "train_fit_leak", "2": "straddling", "3": "same_side", "4": "single"}


def test_bridges_are_groups_whose_kinds_lie_in_different_sets_of_splits(spark):
    rows = [("1", "real", "train"), ("1", "fake", "test"), ("2", "real", "val"), ("2", "real", "test"), ("2", "fake", "test"), ("2", "fake", "val"), ("3", "real", "val"), ("3", "fake", "val"), ("4", "real", "test"), ("4", "real", "val")]
    got = {r.g: (r.coupling, r.bridge) for r in auditing.coupling(frame(spark, rows, "g string, label string, split string"), "g", "label", "real", "fake").collect()}
    assert got == {"1": ("train_fit_leak", True), "2": ("straddling", False), "3": ("same_side", False), "4": ("single", False)}


def test_lineage_and_near_misses(spark):
    rows = frame(spark, [("v1", "o1"), ("v2", "o2"), ("v3", "o3"), ("o9", None)], "path string, src string")
    side = frame(spark, [("o1", "Val:1"), ("o2", "Val:1"), ("o9", "Val:9")], "path string, grp string")
    got = {r.path: r.grp for r in auditing.resolve_groups(rows, side, "path", "src", "grp").collect()}
    assert got == {"v1": "Val:1", "v2": "Val:1", "v3": "v3", "o9": "Val:9"}
    left, right = frame(spark, [("/a/x.png",), ("/a/y.png",)], "path string"), frame(spark, [("/b/x.png",)], "path string")
    assert [r.path for r in auditing.near_misses(left, right, "path").collect()] == ["/a/x.png"]
    later = auditing.latest_sidecar([side, frame(spark, [("o1", "new"), ("o2", " ")], "path string, grp string")], "path", "grp")
    assert {r.path: r.grp for r in later.collect()} == {"o1": "new", "o2": "Val:1", "o9": "Val:9"}


def test_union_reconcile_and_resume(spark):
    a, b = frame(spark, [(1, "x")], "k long, v string"), frame(spark, [(2, "y")], "k long, v string")
    assert auditing.union_checked(a, b, "k").count() == 2
    with pytest.raises(ValueError):
        auditing.union_checked(a, a, "k")
    with pytest.raises(ValueError):
        auditing.union_checked(a, b.withColumn("w", F.lit(1)), "k")
    got = sorted((r.issue, r.k) for r in auditing.reconcile(frame(spark, [(1,), (2,)], "k long"), frame(spark, [(2,), (2,), (3,)], "k long"), "k").collect())
    assert got == [("extra", 3), ("missing", 1), ("repeated", 2)]
    assert [r.k for r in auditing.append_missing(a, a.union(b), "k").collect()] == [2]


def test_cluster_bootstrap_moves_groups_whole(spark):
    rows = frame(spark, [("a", 0, "id1"), ("b", 0, "id1"), ("c", 0, "id2"), ("d", 0, "id3"), ("e", 0, "id4")], "k string, y int, g string")
    reps = resampling.cluster_bootstrap(rows, "y", "g", 20)
    for r in reps.groupBy("rep").agg(F.sum((F.col("g") == "id1").cast("int")).alias("n"), F.count_distinct("k").alias("k")).collect():
        assert r.n % 2 == 0
    plain = resampling.stratified_bootstrap(rows, "y", "k", 7)
    assert {r["count"] for r in plain.groupBy("rep").count().collect()} == {5}


def test_summary(spark):
    got = metrics.summary(frame(spark, [(1.0,), (None,)], "v double"), "v").first()
    assert (got.n, got["std"], got.low) == (1, 0.0, 1.0)


def test_component_rank_is_clamped(spark):
    draw = random.Random(0)
    rows = learning.as_vectors(frame(spark, [([draw.random() for _ in range(40)],) for _ in range(15)], "x array<double>"), "x")
    model = learning.fit_components(rows, 64)
    assert len(model.transform(rows).first().components) == 14


def test_least_bytes_are_those_of_hex_minima():
    import hashlib

    from sievekit.plans import audits

    for text in ("a b c d e a b c", "one", "", "é  x\ny z"):
        words = text.split(" ")
        runs = [hashlib.md5(" ".join(words[i : i + 3]).encode()).hexdigest() for i in range(max(len(words) - 2, 1))]
        assert audits._least_bytes(hashlib.md5, 7, text).tolist() == [int(min(h[4 * k : 4 * k + 8] for h in runs)[6:], 16) for k in range(7)]
