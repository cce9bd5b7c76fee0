import collections
import random
import re

import pytest

from sievekit.llm import divergence

WORDS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    counts, seen, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = WORDS.findall((text or "").translate(LOWER))
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= 10]
        of = sorted(s for g, s in groups if g == lang)
        shares = {}
        for s in [*of, None]:
            c = {t: sum(counts[lang, x][t] for x in (of if s is None else [s])) for t in kept}
            n = sum(c.values())
            shares[s] = {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        for s in of:
            pairs = sorted((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in of if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            more = sorted((-f(shares[s][t], shares[None][t]), t.encode(), t) for t in kept if counts[lang, s][t] and shares[s][t] > shares[None][t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(more[:10])]
    return sorted(out, key=str)


def docs():
    draw = random.Random(5)
    word = lambda: draw.choice(["Ab", "aB", "c", "dé", "DÉ", "漢字", "e1f", "g-h", "zz", "Ünder", "x", "y", "🙂", "ﬀ", "long" * 20]) + draw.choice(["", "a", "b", "c"])
    rows = [(draw.choice(["en", "en", "de", None, ""]), draw.choice(["s1", "s2", "S3", "é", None, "s10", "hot", "hot", "hot"]), " ".join(word() for _ in range(draw.randrange(0, 40)))) for _ in range(300)]
    rows += [("fr", "a", "one two"), ("fr", "b", None), ("fr", "b", ""), ("en", "wordless", "12 34"), ("it", "alone", "uno " * 50), *[("pt", s, "um dois tres") for s in "ab" for _ in range(6)]]
    return rows + rows[:20]


@pytest.mark.parametrize("block,bucket,held", [(256, 1 << 16, 1 << 19), (2, 20, 7)])
def test_equals_brute_force_over_all_terms(spark, monkeypatch, block, bucket, held):
    for name, value in (("BLOCK", block), ("BUCKET", bucket), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    rows = docs()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n long, term string").repartition(5)
    found = sorted((tuple(r) for r in divergence.audit(table).collect()), key=str)
    assert found == brute(rows)


def test_empty_table(spark):
    out = divergence.audit(spark.createDataFrame([], "lang string, source string, text string"))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.collect() == []


def test_shares_of_large_counts_are_exact(spark):
    n, total, v = 3 * 10**15 + 1, 9 * 10**15, 12345
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence.share(*[divergence.F.col(c) for c in ("n", "total", "v")]).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * v)
