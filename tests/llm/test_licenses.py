import random
import re

import pytest

from sievekit.llm import licenses


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "cc by", "CC-BY cc.by xcc by cc bye", "All Rights Reserved. GNU General Public License", "cc by cc by all rights reserved cc by",
    "é cc by ñ", "general public\nlicense general public licenses", "ALL RİGHTS RESERVED all\x00rights reserved", "K cc by",
]


def test_base_equals_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in licenses.scan(rows).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(TEXTS[r.doc_id])
        assert 0.0 <= r.score <= 1.0
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


@pytest.mark.parametrize(
    ("expression", "named", "verdict"),
    [
        ("MIT", {"mit"}, True),
        ("MIT OR GPL-2.0-only", {"mit", "gpl-2.0-only"}, True),
        ("MIT AND GPL-2.0-only", {"mit", "gpl-2.0-only"}, False),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0", {"gpl-2.0-only", "apache-2.0"}, True),
        ("(MIT OR GPL-3.0-only) AND (BSD-3-Clause)", {"mit", "gpl-3.0-only", "bsd-3-clause"}, True),
        ("MIT OR", {"mit"}, None),
        ("(MIT", {"mit"}, None),
        ("", set(), None),
        ("MIT this file is", {"mit"}, True),
    ],
)
def test_expressions(expression, named, verdict):
    assert licenses.evaluate(expression) == (named, verdict)


def test_tags_and_edges(spark):
    rows = spark.createDataFrame([(1, "// SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "old")], "doc_id long, text string, labels string")
    (row,) = licenses.scan(rows).collect()
    assert row.labels == "apache-2.0,mit" and row.permissive is True and row.expressions == ["mit apache-2.0 or"]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tags_need_a_colon_and_known_identifiers(spark):
    texts = [
        "See the SPDX license identifier in every file", "SPDX-License-Identifier: frobnicate", "# SPDX-License-Identifier: (MIT OR frobnicate) AND Zlib",
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\n# SPDX-License-Identifier: mit",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.permissive, r.unknown) for r in licenses.scan(rows).collect()}
    assert got == {0: ("", None, []), 1: ("", None, ["frobnicate"]), 2: ("mit,zlib", True, ["frobnicate"]), 3: ("gpl-2.0-only,mit", False, [])}


@pytest.mark.parametrize(("expression", "verdict"), [("frob OR MIT", True), ("frob OR GPL-3.0-only", None), ("frob AND GPL-3.0-only", False), ("frob AND MIT", None)])
def test_unknown_identifiers_leave_a_verdict_open(expression, verdict):
    assert licenses.evaluate(expression)[1] is verdict


def test_labels_and_score_equal_brute_force(spark):
    draw, pieces = random.Random(8), [*licenses.BASE_PHRASES, *licenses.NOTICE_PHRASES]
    parts = [*pieces, *(p.upper().replace(" ", "-") for p in pieces), "free", "cc", "by", "general", "the", "license", "2", "0", "\n", "é", "gnu"]
    texts = [" ".join(draw.choice(parts) for _ in range(draw.randrange(0, 8))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = {p: (label, licenses.BASE_WEIGHTS[label]) for p, label in licenses.BASE_PHRASES.items()} | licenses.NOTICE_PHRASES
    for r in licenses.scan(rows).collect():
        line = " " + " ".join(re.findall("[a-z0-9é]+", texts[r.doc_id].lower())) + " "
        found: dict = {}
        for phrase, (label, weight) in weights.items():
            if f" {phrase} " in line:
                found[label] = max(found.get(label, 0), weight)
        doubt = 1.0
        for weight in found.values():
            doubt *= 1 - weight
        assert r.labels == ",".join(sorted(found)) and abs(r.score - (1 - doubt)) < 1e-12


@pytest.mark.parametrize(
    "text,labels,allowed",
    [
        ("SPDX-License-Identifier: MIT.", "mit", True),
        ("see (SPDX-License-Identifier: Apache-2.0), and more", "apache-2.0", True),
        ("/* SPDX-License-Identifier: MIT */", "mit", True),
        ("SPDX-License-Identifier: MIT/Apache-2.0", "apache-2.0,mit", True),
        ("SPDX-License-Identifier: GPL-2.0-only/LGPL-2.0", "gpl-2.0-only,lgpl-2.0", False),
        ("SPDX-License-Identifier: EUPL-1.0 AND AFL-2.1", "afl-2.1,eupl-1.0", False),
        ("SPDX-License-Identifier: CC-BY-2.5-", "cc-by,cc-by-2.5", True),
        ("é\nspdx-license-identifier : ISC\n漢 SPDX-License-Identifier: Zlib\r\n", "isc,zlib", True),
        ("SPDX License Identifier MIT", "", None),
        ("the SPDX-License-Identifier: tag", "", None),
    ],
)
def test_tags_are_read_where_the_automaton_meets_them(text, labels, allowed):
    found = licenses.scan_text(text, licenses.automaton())
    assert (found[5], found[8]) == (labels, allowed)


def test_identifier_lists_are_apart():
    assert not licenses.PERMISSIVE & licenses.RESTRICTED
    assert {"mit", "cc-by-2.5", "afl-2.1"} <= licenses.PERMISSIVE and {"lgpl-2.0", "eupl-1.0", "gfdl-1.3-no-invariants-only"} <= licenses.RESTRICTED
