import hashlib
import random
import re

import pytest

from sievekit.llm import secrets


def brute(text):
    out, base = [], []
    for place, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), place, f"{r.kind}:{m.start()}:{m.end()}"))
                base += [out[-1]] if r.base else []
    return ",".join(x[2] for x in sorted(out)), hashlib.sha256(",".join(x[2] for x in sorted(base)).encode()).hexdigest()


def texts():
    draw = random.Random(9)
    bits = ["password: ", "PassWord = '", "secret=", "token", "api_key:", "APIKEY=", '"', " ", "\n", "é🙂", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "abc", "=", ":", "/+", "ghp_" + "a1" * 20, "xoxb-1234567890-ab", "-----BEGIN RSA PRIVATE KEY-----"]
    made = ["".join(draw.choice(bits) for _ in range(draw.randrange(1, 40))) for _ in range(80)]
    return [None, "", "plain words", "password=short", "token=secret: abcdefghijkl", "x" * 5000, "token=abcdefgh " * 300, *made]


def test_spans_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.joined(secrets.F.col("found")).alias("spans"))
    assert {r.doc_id: r.spans for r in got.collect()} == {i: brute(t)[0] for i, t in rows}


def test_query_columns(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in secrets.op10_secret_scan(spark, str(tmp_path)).collect():
        assert (r.spans, r.base_sha256) == brute(rows[r.doc_id][1])


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_queries_hold_for_every_match(rule):
    query = secrets.trigram_query(rule.pattern)
    for text in texts():
        for m in re.finditer(rule.pattern, text or ""):
            assert any(all(t in m[0].lower() for t in part) for part in query)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, rules long")
    assert secrets.scan(empty).collect() == []
    secret = "token=abcdefgh"
    rows = spark.createDataFrame([(1, secret, "x"), (1, secret, "x"), (1, "none", "y"), (None, secret, "z")], "doc_id long, text string, found string")
    assert sorted(len(r.found) for r in secrets.scan(rows).collect()) == [0, 1, 1, 1]
