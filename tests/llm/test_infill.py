import hashlib
import random
import re

import pytest

from sievekit.llm import infill

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    head, middle, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(head), len(middle), f"<S>{tail}<P>{head}<M>{middle}"
    return len(units), "psm", len(head), len(middle), f"<P>{head}<S>{tail}<M>{middle}"


def texts():
    draw = random.Random(3)
    letters = "abcXYZ  \n.,<>P0é漢🙂\x00\r​"
    made = ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 900))) for _ in range(120)]
    return [None, "", "a", "é", "x" * 300_000, "🙂" * 4000, "ab " * 2000, "a <P> b", "<S", "S><M", "<" * 50, *made]


@pytest.mark.parametrize("every,block,step", [(256, 1 << 20, 1 << 10), (1, 7, 1), (5, 64, 3)])
def test_every_cut_lies_where_its_unit_begins(monkeypatch, every, block, step):
    monkeypatch.setattr(infill, "BLOCK", block)
    monkeypatch.setattr(infill, "STEP", step)
    for text in texts():
        text = (text or "")[:2000]
        units, data = UNIT.findall(text), (text or "").encode()
        index = infill.Checkpoints(data, every)
        assert (index.n_units, index.n_points) == (len(units), len(text))
        for k in range(0, len(units) + 1, 1 + len(units) // 50):
            head = "".join(units[:k])
            assert index.find(k) == (len(head.encode()), len(head))


def test_outputs_and_round_trip(spark):
    rows = list(enumerate(texts())) + [(None, "some text"), (7, "a <P> b"), (3, "é")]
    out = infill.transform(spark.createDataFrame([(i, t, "old", 1) for i, t in rows], "doc_id long, text string, form string, other int"))
    assert out.columns == ["doc_id", "other", *infill.MADE]
    found = infill.restore(out).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(((r.doc_id, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) for r in found), key=key) == sorted(((i, *brute(i, t), t or "") for i, t in rows), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_other_sentinels_and_shares(spark):
    plan = infill.Plan("\\E[", "(.", "|", cut=100, suffix_first=100, seed=9)
    docs = spark.createDataFrame([(1, "one two three <P>"), (2, "four | five")], "doc_id long, text string")
    found = {r.doc_id: r for r in infill.restore(infill.transform(docs, plan), plan).collect()}
    assert (found[1].form, found[2].form) == ("spm", "plain")
    assert (found[1].text, found[2].text) == ("one two three <P>", "four | five")
