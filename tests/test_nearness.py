import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sievekit.operators import auditing, nearness, splitting
from sievekit.plans import audits

BITS, WIDTH = 112, 56


def flipped(draw, signature, n, bits=BITS):
    for b in draw.sample(range(bits), n):
        signature ^= 1 << b
    return signature


def planted(n, near, seed=1, hot=0):
    """n random signatures, `near` copies of some of them with up to 9 bits changed, and `hot` that share a block's bits."""
    draw = random.Random(seed)
    rows = [draw.getrandbits(BITS) for _ in range(n)]
    rows += [flipped(draw, rows[draw.randrange(n)], draw.randrange(0, 10)) for _ in range(near)]
    block = (1 << 20) - 1
    rows += [(draw.getrandbits(BITS) & ~block) | 12345 for _ in range(hot)]
    return [(i, draw.choice(["train", "train", "val", "test", "unseen"]), s & (1 << WIDTH) - 1, s >> WIDTH) for i, s in enumerate(rows)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, split string, low long, high long")


def brute(rows, distance=6):
    classes = {}
    for i, split, low, high in rows:
        classes.setdefault((low, high, split), []).append(i)
    evaluation, out = ("val", "test", "unseen"), []
    for (x, xs), (y, ys) in itertools.permutations(classes.items(), 2):
        d = (x[0] ^ y[0]).bit_count() + (x[1] ^ y[1]).bit_count()
        if d <= distance and x[2] != y[2] and x[2] in evaluation and (y[2] not in evaluation or (min(xs), x[2]) < (min(ys), y[2])):
            out.append((min(xs), x[2], len(xs), min(ys), y[2], len(ys), d, len(xs) * len(ys)))
    return sorted(out)


@pytest.mark.parametrize("cap", [64, 2, 0])
def test_cross_split_pairs_equal_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(nearness, "CAP", cap)
    rows = planted(250, 120, hot=80)
    rows += [(i + 1000, s, low, high) for i, s, low, high in rows[:30]] + [(5000, "val", None, 1), (5001, None, rows[0][2], rows[0][3])]
    found = nearness.cross_split(table(spark, rows), "id", ["low", "high"], BITS, width=WIDTH)
    want = brute([r for r in rows if r[1] and r[2] is not None])
    assert found.columns == ["a", "split_a", "n_a", "b", "split_b", "n_b", "distance", "n_pairs"]
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 30


def test_pairs_of_narrow_signatures_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearness, "CAP", 5)
    draw = random.Random(4)
    rows = sorted({draw.getrandbits(20) for _ in range(300)})
    found = nearness.within(spark.createDataFrame(list(enumerate(rows)), "id long, w long"), ["id"], ["w"], 20, 3)
    want = [(i, j, (x ^ y).bit_count()) for (i, x), (j, y) in itertools.combinations(enumerate(rows), 2) if (x ^ y).bit_count() <= 3]
    assert sorted((r.a.id, r.b.id, r.distance) for r in found.collect()) == want


def test_joined_rows_grow_with_the_table_not_with_its_square(spark, monkeypatch):
    """A tenth of the rows share a block, so that without refining they would all meet in one bucket."""
    monkeypatch.setattr(nearness, "CAP", 16)
    per_row = []
    for n in (600, 6000):
        rows = table(spark, planted(n, n // 10, hot=n // 10))
        steps = nearness.joined(rows, ["low", "high"], BITS, 6, F.col("split") != "train", WIDTH)
        per_row.append(sum(pairs.count() for pairs, _ in steps) / n)
    assert per_row[1] < 3 * per_row[0] and per_row[1] < 60


def test_empty_table(spark):
    assert nearness.cross_split(table(spark, []), "id", ["low", "high"], BITS, width=WIDTH).collect() == []


def test_reconstruction_marks_other_classes_unseen(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i < 60 else "z") for i in range(80)] + [(90, None)], "id long, c string")
    whole = splitting.reconstruct(rows, "id", "c", F.col("c").isin("a", "b"))
    alone = {r.id: r.split for r in splitting.assign_splits(rows.where("c in ('a', 'b')"), "id", "c").collect()}
    assert {r.id: r.split for r in whole.collect()} == alone | {r.id: "unseen" for r in rows.where("c is null or c = 'z'").collect()}


def test_cross_split_signs_texts_once_and_shuffles_none(spark, monkeypatch, tmp_path):
    rows = [(i, f"a b c d {i}" if i % 5 else None, "de" if i % 2 else "fi") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(nearness, "cross_split", lambda rows, *_, **__: rows)
    found = audits.near_dup_cross_split(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "MapInArrow" not in plan
    # rows without text have no signature, and take part in the ranking of the split
    assert {r.doc_id for r in found.where("low is null and high is null").collect()} == {i for i, t, _ in rows if t is None}
    whole = {r.doc_id: r.split for r in audits.audited_split(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {r.doc_id: r.split for r in found.collect()} == whole


def test_least_bytes_of_a_text_longer_than_a_piece(monkeypatch):
    text = " ".join(str(i % 97) for i in range(400))
    whole = audits._least_bytes(hashlib.sha256, 14, text).tolist()
    monkeypatch.setattr(audits, "RUNS", 7)
    assert audits._least_bytes(hashlib.sha256, 14, text).tolist() == whole


def test_nearest_pairs_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(v):
        made.add(1)
        return True

    pairs = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1).alias("distance")).where(F.udf(seen, "boolean")("a"))
    found = auditing.nearest_pairs(pairs).collect()
    assert made.value == 300 and len(found) == 200 and {r.n_pairs for r in found} == {300}


def test_bucket_of_200_rows_is_joined_without_more_copies(spark):
    steps = nearness.joined(table(spark, planted(10, 0, hot=200)), ["low", "high"], BITS, 6, None, WIDTH)
    assert len(steps) == 1
