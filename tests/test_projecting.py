import pytest
from pyspark.sql import functions as F

from sievekit.operators import projecting as p


def test_filters_and_names(spark):
    rows = spark.createDataFrame([("GAN_a", "x"), ("Diff", None), (None, "gan")], "source_dataset string, generator string")
    assert p.mentions(rows, "gan").count() == 1 and p.mentions(rows.drop("source_dataset"), "GAN").count() == 1
    assert p.has_prefix(rows, "source_dataset", "Di").count() == 1
    got = rows.select(p.named(F.col("generator"), {"x": "X"}).alias("n"), p.one_real_class(F.col("generator"), ["gan"]).alias("r")).collect()
    assert [r.n for r in got] == ["X", None, "gan"] and [r.r for r in got] == ["x", None, "real"]
    assert p.encoded(rows.where("generator = 'x'"), "generator", ["w", "x"]).first().y == 1
    with pytest.raises(KeyError):
        p.encoded(rows.where("generator = 'gan'"), "generator", ["x"])


def test_arrays_and_metadata(spark):
    row = spark.createDataFrame([([0.2, 0.5, 0.5],)], "v array<double>").select(p.first_maximum(F.col("v")).alias("m"), p.fake_score(F.col("v"), ["real", "a", "b"], ["real"]).alias("f")).first()
    assert (row.m, row.f) == (1, 1.0)
    images = spark.createDataFrame([("a.PNG", 4, 2), ("b.jpg", -1, -1), ("c", 3, 0)], "filename string, width int, height int")
    got = p.metadata_features(images).collect()
    assert [(r.aspect, r.is_png, r.is_jpeg) for r in got] == [(2.0, 1, 0), (None, 0, 0)]
    uses = spark.createDataFrame([("s", i) for i in range(5)], "s string, i int")
    assert [(r.turn, r.use) for r in p.occurrences(uses, "s", "i", 2).orderBy("i").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_lookups(spark):
    rows = spark.createDataFrame([("p1", "a", "old"), ("p2", "b", "old"), ("p3", None, "old")], "full_path string, source_path string, blip_caption string")
    captions = spark.createDataFrame([("a", "ca"), ("p3", "c3")], "full_path string, blip_caption string")
    assert {r.full_path: r.blip_caption for r in p.captions_of(rows, captions).collect()} == {"p1": "ca", "p2": "", "p3": "c3"}
    truth = spark.createDataFrame([("p1", "A")], "full_path string, label string")
    assert p.resolved_truth(rows.withColumn("label", F.lit("wrong")), truth, "full_path", "label").first().label == "A"
    more, n = p.external_predictions(rows, truth, "full_path", "label")
    assert n == 1 and more.count() == 3
    assert p.external_predictions(rows, truth.where("false"), "full_path", "label")[1] == 0
    test, rest = p.restrict_to(rows, truth, "full_path")
    assert (test.count(), rest.count()) == (1, 2)
    with pytest.raises(ValueError):
        p.restrict_to(rows, truth.where("false"), "full_path")
    with pytest.raises(ValueError):
        p.assert_same_rows(rows, truth, ["full_path"])
    p.assert_same_rows(rows, rows, ["full_path"])
    assert p.unreadable(rows, truth, "full_path", "blip_caption").first().n == 2


def test_modes_and_choices(spark):
    rows = spark.createDataFrame([("A", "true"), ("B", None), ("C", "False")], "true_generator string, in_set string")
    assert [r.in_set for r in p.in_set(rows, "true_generator", ["B"], ["A"]).collect()] == [True, True, False]
    assert [r.in_set for r in p.in_set(rows.drop("in_set"), "true_generator", None, ["A"]).collect()] == [True, False, False]
    assert p.evaluation_mode(rows.withColumn("pred_generator", F.lit("A"))) == "attribution"
    with pytest.raises(ValueError):
        p.evaluation_mode(rows)
    assert not p.smallest_class(rows, "true_generator") and p.smallest_class(rows.union(rows), "true_generator")
    scores = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "i int, s double")
    assert p.best_of(scores, "s", "i").first().i == 2
    assert "| 1 | 0.5 |" in p.datasheet_markdown(scores, "T")
