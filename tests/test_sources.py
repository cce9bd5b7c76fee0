import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.functions import kernels
from sievekit.operators import projecting
from sievekit.sources import headers, readers
from sievekit.streaming import incremental


def test_csv_schema_and_export(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("full_path,score,y_true,note\na,0.5,1,x\nb,,0,\n")
    rows = readers.read_csv(spark, str(path), readers.FREQUENCY, ("full_path", "score"))
    assert rows.dtypes == [("full_path", "string"), ("score", "double"), ("y_true", "int"), ("note", "string")]
    assert [r.score for r in rows.collect()] == [0.5, None]
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(path), readers.FREQUENCY, ("pred",))
    readers.write_csv(rows, str(tmp_path / "out"), single=True)
    assert readers.read_strings(spark, str(tmp_path / "out")).count() == 2


def test_annotations_are_scoped_by_split(spark, tmp_path):
    for split, image in (("Val", 100), ("Train", 200)):
        (tmp_path / f"{split}_poly.json").write_text(json.dumps({"images": [{"id": image, "file_name": f"{split}.jpg"}], "annotations": [{"id": 5, "image_id": image, "category_id": int(split == "Train"), "bbox": [1, 2, 3, 4]}]}))
    got = {(r.split, r.annotation_id): (r.image_id, r.file_name, r.label) for r in readers.read_annotations(spark, str(tmp_path)).collect()}
    assert got == {("Val", 5): (100, "Val.jpg", "real"), ("Train", 5): (200, "Train.jpg", "fake")}


def test_group_map_from_metadata(spark):
    rows = spark.createDataFrame([("o1", "s1", "a"), ("o2", "s1", "a"), ("o3", "s2", "b")], "output_path string, source_image string, source_identity string")
    got = {r.full_path: r.source_image_id for r in readers.generation_groups(rows).collect()}
    assert got == {"o1": "a", "o2": "a", "s1": "a", "o3": "b", "s2": "b"}
    with pytest.raises(ValueError):
        readers.generation_groups(rows.union(spark.createDataFrame([("o1", "s1", "z")], rows.schema)))


def test_small_helpers(spark, tmp_path):
    row = spark.createDataFrame([("True", [-2, 3, 10, 50])], "b string, box array<int>").select(readers.read_boolean(F.col("b")).alias("b"), readers.clamp_box(F.col("box"), F.lit(6), F.lit(20)).alias("c")).first()
    assert row.b is True and tuple(row.c) == (0, 3, 6, 20)
    assert readers.resolve_config({"a": ["${X}/y"]}, {"X": "z"}) == {"a": ["z/y"]}
    with pytest.raises(KeyError):
        readers.resolve_config("${MISSING}", {})
    assert readers.signature({"a": b"1"}, {"n": 1}) != readers.signature({"a": b"2"}, {"n": 1})
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert readers.cached_features(spark, str(tmp_path / "c"), "k", make).count() == 3
    assert readers.cached_features(spark, str(tmp_path / "c"), "k", make).count() == 3 and len(calls) == 1
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{"n": 1}')
    (tmp_path / "m" / "b.json").write_text("{broken")
    assert [json.loads(r.document) for r in readers.metrics_rows(spark, str(tmp_path / "m")).collect()] == [{"n": 1}]


def test_kernels():
    draw = np.random.default_rng(0)
    grey = draw.random((24, 40))
    m = kernels.dct_matrix(8)
    assert np.allclose(m @ m.T, np.eye(8))
    assert np.isclose(np.linalg.norm(kernels.fingerprint(grey)), 1)
    bank = kernels.high_pass_bank()
    assert bank.shape == (30, 5, 5) and np.allclose(bank.sum(axis=(1, 2)), 0)
    assert np.allclose(kernels.high_pass_response(np.ones((9, 9))), 0)
    assert kernels.centre_crop(grey, 32).shape == (32, 32) and kernels.tile_energy(grey).shape == (8, 8)
    assert np.allclose(kernels.resize(np.ones((3, 5)), 7, 2), 1) and np.allclose(kernels.resize(grey, 24, 40), grey)
    assert -(2**63) <= kernels.difference_hash(grey) < 2**63
    assert {v(grey).shape for v in kernels.VARIANTS.values()} == {(8, 8)}
    assert {p(grey).shape for p in kernels.PERTURBATIONS.values()} == {(24, 40)}


def test_streaming_group_splits_and_log(spark, tmp_path):
    spark.createDataFrame([("k1", "g1"), ("k2", "g2"), ("k1", "g1")], "k string, g string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, g string").parquet(str(tmp_path / "in"))
    for at in ("c1", "c2"):  # a second run over the same rows adds nothing
        query = incremental.group_splits(stream, "g").writeStream.foreachBatch(incremental.append_new(str(tmp_path / "log"), "k")).option("checkpointLocation", str(tmp_path / at)).start()
        query.processAllAvailable()
        query.stop()
    rows = spark.read.parquet(str(tmp_path / "log"))
    assert rows.count() == 2 and set(rows.columns) == {"k", "g", "split"}


def test_captions_labels_and_metrics_files(spark, tmp_path):
    (tmp_path / "captions.csv").write_text("full_path\tblip_caption\na/b/1.png\ta cat\n")
    assert readers.read_captions(spark, str(tmp_path / "captions.csv")).count() == 1
    rows = spark.createDataFrame([("x/real/1.png",), ("x/fake/2.png",)], "path string")
    assert [r[0] for r in rows.select(readers.folder_label(rows["path"])).collect()] == ["real", "fake"]
    assert json.loads(readers.metrics_json(spark.createDataFrame([(1, None, 0.5)], "n int, name string, auroc double"))) == {"n": 1, "name": None, "auroc": 0.5}


def test_image_folders(spark, tmp_path):
    part = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    size = (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"\x08\x00\x00\x00\x00"
    header = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", size) + part(b"IDAT", zlib.compress(bytes(8) * 5)) + part(b"IEND", b"")
    for name, data in (("real/a.png", header), ("real/deep/b.png", header), ("fake/c.png", b"broken"), ("fake/note.txt", b"")):
        path = tmp_path / "images" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    got = {r.filename: (r.width, r.height) for r in readers.scan_images(spark, str(tmp_path / "images")).collect()}
    assert got == {"a.png": (7, 5), "b.png": (7, 5), "c.png": (-1, -1)}
    assert {r.filename for r in readers.scan_images(spark, str(tmp_path / "images"), exclude="^b").collect()} == {"a.png", "c.png"}


def test_config_files(tmp_path):
    (tmp_path / "c.json").write_text('{"root": "${ROOT}/x", "sizes": [1, 2]}')
    assert readers.read_config(str(tmp_path / "c.json"), {"ROOT": "/data"}) == {"root": "/data/x", "sizes": [1, 2]}
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("root: ${ROOT}/x\nsizes: [1, 2]\n")
    assert readers.read_config(str(tmp_path / "c.yaml"), {"ROOT": "/data"}) == {"root": "/data/x", "sizes": [1, 2]}
    with pytest.raises(KeyError):
        readers.read_config(str(tmp_path / "c.yaml"), {})


def test_table_signature_knows_rows_and_not_their_order(spark, tmp_path):
    rows = [(i, f"t{i}", None if i % 7 else i / 3, [i, None], {"k": f"v{i}"}, bytes([i])) for i in range(60)]
    schema = "a long, b string, c double, d array<int>, e map<string, string>, f binary"
    key = lambda rows, parts, parameters={"n": 1}: readers.table_signature(spark.createDataFrame(rows, schema).repartition(parts), parameters)  # noqa: E731, B006
    first = key(rows, 1)
    assert first == key(rows[::-1], 5)
    assert key(rows, 1, {"n": 2}) != first
    others = [rows[:-1], rows + rows[:1], [*rows[:-1], (59, "t59", 0.0, [59, None], {"k": "v59"}, bytes([59]))], [*rows[:-1], (59, "t59", None, [59], {"k": "v59"}, bytes([59]))], [(*r[:1], r[1] + "x", *r[2:]) if r[0] == 5 else r for r in rows]]
    assert len({first, *(key(o, 2) for o in others)}) == 1 + len(others)
    assert readers.table_signature(spark.createDataFrame(rows, schema).withColumnRenamed("a", "z"), {"n": 1}) != first
    # a null, the mark for it, and values that run together
    two = lambda *r: readers.table_digest(spark.createDataFrame([r], "a string, b string")).first()
    assert len({tuple(two(*r)) for r in ((None, "x"), ("-", "x"), ("", "-x"), ("1:a", "b"), ("1", "a:b"))}) == 5
    assert tuple(readers.table_digest(spark.createDataFrame([], schema)).first()) == (0, "0", "0")
    # a cache is made anew for another table only
    made = []
    for part in (rows, rows[::-1], rows[:-1]):
        df = spark.createDataFrame(part, schema)
        readers.cached_features(spark, str(tmp_path / "c"), readers.table_signature(df, {}), lambda df=df: made.append(1) or df.select("a"))
    assert len(made) == 2


def test_metrics_files_of_every_kind_become_rows(spark, tmp_path):
    files = {
        "a/detection_metrics.json": {"overall": {"accuracy": 0.5, "balanced_accuracy": 0.25, "macro_f1": 1, "auroc": 0.75, "other": 3}, "per_generator": {"x": {"accuracy": 1}}},
        "dct/metrics.json": {"mode": "random", "test": {"balanced_accuracy": 0.5, "macro_f1": 0.5}},
        "b/attribution_metrics.json": {"in_set": {"top1_accuracy": 0.1, "macro_f1": 0.2, "balanced_accuracy": 0.3}, "out_of_set": {"n": 0}},
        "b/finetune_metrics.json": {"test": {"top1_accuracy": 0.4, "macro_f1": 0.5, "balanced_accuracy": 0.6}},
        "c/logo_summary.json": {"gen.x": {"n_held_out": 7, "mean_confidence": 0.5, "mean_entropy": 0.1, "forced_label_distribution": {"p": 3, "q": 4}}},
        "c/out_of_set_summary.json": {"m": {"in_set": {"mean_confidence": 0.5, "n": 3}, "out_of_set": {"mean_confidence": 0.25, "n": 0}}},
        "d/cascade_metrics.json": {"known_fake": {"n": 5, "n_detected": 4, "conditional_attribution": None, "end_to_end_attribution": {"top1_accuracy": 0.5}}},
        "e/renamed.json": {"overall": {"accuracy": 0.125}},
        "e/other.json": {"something": 1},
        "e/list.json": [1, 2],
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(content, indent=1))
    (tmp_path / "e" / "broken.json").write_text("{")
    got = {}
    for r in readers.metrics_report(spark, str(tmp_path)).collect():
        got.setdefault((r.file.split(f"{tmp_path}/")[1], r.kind), {})[r.path] = r.value
    assert got == {
        ("a/detection_metrics.json", "detection"): {"overall.accuracy": 0.5, "overall.balanced_accuracy": 0.25, "overall.macro_f1": 1.0, "overall.auroc": 0.75},
        ("dct/metrics.json", "svm"): {"test.balanced_accuracy": 0.5, "test.macro_f1": 0.5},
        ("b/attribution_metrics.json", "attribution"): {"in_set.top1_accuracy": 0.1, "in_set.macro_f1": 0.2, "in_set.balanced_accuracy": 0.3},
        ("b/finetune_metrics.json", "attribution"): {"test.top1_accuracy": 0.4, "test.macro_f1": 0.5, "test.balanced_accuracy": 0.6},
        ("c/logo_summary.json", "leave_one_out"): {"gen.x.n_held_out": 7.0, "gen.x.mean_confidence": 0.5, "gen.x.mean_entropy": 0.1, "gen.x.forced_label_distribution.p": 3.0, "gen.x.forced_label_distribution.q": 4.0},
        ("c/out_of_set_summary.json", "out_of_set"): {"m.in_set.mean_confidence": 0.5, "m.in_set.n": 3.0, "m.out_of_set.mean_confidence": 0.25, "m.out_of_set.n": 0.0},
        ("d/cascade_metrics.json", "cascade"): {"known_fake.n": 5.0, "known_fake.n_detected": 4.0, "known_fake.end_to_end_attribution.top1_accuracy": 0.5},
        ("e/renamed.json", "detection"): {"overall.accuracy": 0.125},
        ("e/broken.json", "unparsable"): {None: None},
    }


def _jpeg(width, height, before=b"", frame=0xC0):
    size = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03"
    return b"\xff\xd8" + before + bytes([0xFF, frame]) + (2 + len(size)).to_bytes(2, "big") + size


def test_headers_are_read_without_the_images(spark, tmp_path):
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    png = lambda w, h, extra=0: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x00\x00\x00\x00") + chunk(b"IDAT", zlib.compress(bytes(w + 1) * h)) + chunk(b"IEND", b"") + bytes(extra)
    segment = lambda kind, n: bytes([0xFF, kind]) + (n + 2).to_bytes(2, "big") + bytes(n)
    files = {
        "a.png": (png(7, 5), (7, 5)),
        "big.png": (png(300, 200, 5_000_000), (300, 200)),
        "a.jpg": (_jpeg(640, 480), (640, 480)),
        "thumb.jpeg": (_jpeg(33, 44, segment(0xE1, 60_000) + segment(0xE1, 60_000) + b"\xff\xff" + segment(0xFE, 3), 0xC2) + bytes(3_000_000), (33, 44)),
        "a.gif": (b"GIF89a" + (9).to_bytes(2, "little") + (8).to_bytes(2, "little") + bytes(9), (9, 8)),
        "a.bmp": (b"BM" + bytes(12) + (40).to_bytes(4, "little") + (11).to_bytes(4, "little") + (-12).to_bytes(4, "little", signed=True) + bytes(9), (11, 12)),
        "empty.png": (b"", (-1, -1)),
        "cut.png": (png(7, 5)[:20], (-1, -1)),
        "cut.jpg": (_jpeg(640, 480)[:7], (-1, -1)),
        "text.jpg": (b"no picture", (-1, -1)),
        "scan.jpg": (b"\xff\xd8" + segment(0xDA, 4), (-1, -1)),
        "loop.jpg": (b"\xff\xd8" + b"\xff\xe0\x00\x00" * 3000, (-1, -1)),
    }
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for i, (name, (data, _)) in enumerate(files.items()):
        (tmp_path / "deep" / ("er" if i % 2 else "") / name).write_bytes(data)
    (tmp_path / "note.txt").write_text("x")
    del files["empty.png"]  # Spark doesn't list it
    rows = headers.scan_headers(spark, str(tmp_path)).collect()
    assert {r.filename: (r.width, r.height) for r in rows} == {n: size for n, (_, size) in files.items()}
    assert all(r.length == len(files[r.filename][0]) and r.n_read <= (30_000 if r.filename == "loop.jpg" else 4096 + 6 * 64) for r in rows)
    same = {r.filename: (r.width, r.height) for r in readers.scan_images(spark, str(tmp_path), "*.png").collect()}
    assert same == {n: size for n, (_, size) in files.items() if n.endswith("png")}
    assert {r.filename for r in headers.scan_headers(spark, str(tmp_path), exclude="^[^b]").collect()} == {"big.png"}


@pytest.mark.parametrize("cuts", [[40], [1, 2, 17, 40], [13, 13, 40]])
def test_stream_states_equal_the_batch_after_any_cut_and_restart(spark, tmp_path, cuts):
    draw = random.Random(2)
    rows = [(i, draw.choice(["a", "a", "a", "b", None]), draw.randrange(12)) for i in range(40)]
    schema = "i long, source string, content int"
    want = {r.i: (r.turn, r.use) for r in projecting.occurrences(spark.createDataFrame(rows, schema), "source", "i", 3).collect()}
    made = {"uses": lambda s: incremental.numbered_uses(s, "source", "i", 3), "first": lambda s: incremental.first_copies(s, ["content"])}
    low = 0
    for k, high in enumerate(cuts):  # each part is a run of its own, which ends
        spark.createDataFrame(rows[low:high], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        low = high
        for name, make in made.items():
            stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"at-{name}")).trigger(availableNow=True).start()
            query.awaitTermination()
    uses = spark.read.parquet(str(tmp_path / "uses")).collect()
    assert len(uses) == len(rows) and {r.i: (r.turn, r.use) for r in uses} == want
    first = spark.read.parquet(str(tmp_path / "first")).collect()
    assert sorted(r.content for r in first) == sorted({c for _, _, c in rows})
    cut_of = lambda i: next(k for k, high in enumerate(cuts) if i < high)
    assert all(cut_of(r.i) == min(cut_of(i) for i, _, c in rows if c == r.content) for r in first)
