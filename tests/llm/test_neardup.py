import random
import re

from sievekit.llm import neardup
from sievekit.llm.components import components


def brute(rows):
    def shingles(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, len(s), least[find(x)], i == least[find(x)]) for x, (i, s) in enumerate(sets))


def variants():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(5))
    texts = [None, "", " \n", "one two", "ONE  two", "one two three", "five words stand here now", "five words stand here now"]
    for _ in range(12):
        base = [word() for _ in range(draw.randrange(6, 300))]
        texts += [" ".join(base)] * draw.randrange(1, 3)
        for _ in range(draw.randrange(1, 14)):
            copy = base[:]
            for _ in range(draw.randrange(1, 2 + len(base) // 40)):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if draw.random() < 0.5:
                base = copy
    draw.shuffle(texts)
    return list(enumerate(texts))


def test_components_equal_brute_force(spark):
    rows = variants()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, node string, bands int")
    assert neardup.near_duplicates(empty).collect() == []
    same = "a b c d e f g h"
    rows = [(7, same, "x"), (7, same, "x"), (None, same, "y"), (9, "another text of six words", "z"), (None, "alone with null as its id", "z"), (7, "other text but the same id again", "q")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted(
        [("7", "7", True)] * 3 + [("None", "7", False), ("9", "9", True), ("None", "None", True)]
    )


def test_star_contraction(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(50, 50), (60, 61), (62, 61), (61, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 61: 60, 62: 60}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_fewest_matches_keep_pairs_at_the_threshold():
    limits = neardup.fewest_matches()
    assert [n for n, _ in limits] == list(range(neardup.BATCH, neardup.HASHES + 1, neardup.BATCH))
    assert all(k < 0.75 * n for n, k in limits) and limits[-1][1] > 0.5 * limits[-1][0]


def test_units_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE", 1)
    monkeypatch.setattr(neardup, "UNIT_MEMBERS", 4)
    monkeypatch.setattr(neardup, "UNIT_OUTSIDERS", 2)
    monkeypatch.setattr(neardup, "FIRST", 1)
    rows = variants()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)
