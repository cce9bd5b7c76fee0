"""Every query over odd tables: nulls in all columns, empty and very long texts, repeated rows and ids, extra columns."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievekit.llm import common, registry


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice(["ba", "de", "li", "mo", "ru"]) for _ in range(draw.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(draw.randrange(1, 120))) for i in range(40)]
    rows += [(None, text(30)), (None, None), (7, None), (7, ""), (7, rows[7][1]), rows[3], rows[3], (50, text(60_000)), (51, "x" * 200_000), (52, "\n" * 500), (53, "é🙂\x00​" * 50), (54, "token=abcdefgh1 a@b.cd 1.2.3.4 cc by")]
    full = [(i, t, None if k % 5 else "en", "s", k, "old", float(k), [k], "x") for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, ids array<int>, node string"
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(3, None, None), (3, 1, 0), (None, 1, 1)]
    pages = [(1, "http://a/b", "<p>", 1), (1, "http://a/b", "<p>", 1), (None, None, None, 2), (2, "u", "", None), (3, "u\nv", "y" * 100_000, 3)]
    odd, empty = (tmp_path_factory.mktemp(n) for n in ("odd", "empty"))
    for folder, cut in ((odd, None), (empty, 0)):
        spark.createDataFrame(full[:cut], schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(labels[:cut], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame(pages[:cut], "page_id long, url string, html string, row int").write.parquet(str(folder / "pages.parquet"))
        spark.createDataFrame([(1, rows[5][1]), (None, "a b c"), (2, None), (3, "")][:cut], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(odd), str(empty), len(full), len(pages)


def test_contents_over_odd_tables(spark, folders):
    """What each query says of the odd rows: empty texts, repeated rows, the long ones, and the one with finds."""
    odd = folders[0]
    rows = {name: registry.QUERIES[name](spark, odd).collect() for name in registry.QUERIES if name != "pipeline" and not name.startswith(("op8", "op12", "op13"))}
    of = lambda name, i: [r for r in rows[name] if r.doc_id == i]
    for name in rows:
        ids = sorted(str(r.doc_id) for r in rows[name])
        assert ids == sorted(["None"] * 2 + ["7"] * 4 + ["3"] * 3 + [str(i) for i in [*range(40), *range(50, 55)] if i not in (3, 7)]), name
        assert len({tuple(x for x in r if not isinstance(x, float)) for r in of(name, 3)}) == 1, name
    for name in ("op1_quality_classifier", "op5_toxicity"):
        assert all(0 <= r.score <= 1 for r in rows[name]) and len({r.score for r in of(name, 3)}) == 1
    assert sorted(r.n_tokens == 0 for r in of("op2_bpe", 7)) == [False, False, True, True]
    assert {r.component_id for r in of("op3_minhash_neardup", 7)} == {7} and sorted(r.n_shingles for r in of("op3_minhash_neardup", 7))[:2] == [0, 0]
    assert sorted(r.n_shingles == 0 for r in of("op3_minhash_neardup", None)) == [False, True]
    assert [(r.n_base, r.base_labels) for r in of("op4_license_scan", 54)] == [(1, "cc-by")] and {r.first_word for r in of("op4_license_scan", 52)} == {None}
    assert [(r.n_email, r.n_ip) for r in of("op6_private_spans", 54)] == [(1, 1)]
    assert [(r.n_words, r.base_failed) for r in of("op7_quality_rules", 52)] == [(0, True)] and [r.n_words for r in of("op7_quality_rules", 50)] == [60_000]
    # row 5 is the benchmark's item; the item without an id counts for nothing
    leaks = {r.doc_id for r in rows["op9_decontamination"] if r.contaminated}
    assert leaks == {5}
    assert [r.n_assign for r in of("op10_secret_scan", 54)] == [1]
    assert sorted(r.n for r in of("op11_fill_in_middle", 7))[:2] == [0, 0] and {r.form for r in of("op11_fill_in_middle", 7) if not r.n} == {"plain"}
    assert [r.n for r in of("op11_fill_in_middle", 51)] == [1] and [r.n for r in of("op11_fill_in_middle", 52)] == [500]
    pages = {(r.page_id, r.url): r for r in registry.QUERIES["op12_main_text"](spark, odd).collect()}
    assert pages[2, "u"].text == pages[None, None].text == "" and pages[3, "u\nv"].n_chars == 100_000
    groups = registry.QUERIES["op13_source_divergence"](spark, odd).collect()
    # one source a language, so terms only; null languages are the empty one
    assert {(r.lang, r.source, r.part) for r in groups} <= {("en", "s", "term"), ("", "s", "term")}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_and_empty_tables(spark, folders, name):
    odd, empty, n_docs, n_pages = folders
    got = registry.QUERIES[name](spark, odd)
    n = got.count()
    if name == "pipeline":
        assert 0 < n < n_docs
    else:
        assert name.startswith("op13") or n == (n_pages if name.startswith(("op8", "op12")) else n_docs)
    nothing = registry.QUERIES[name](spark, empty)
    assert nothing.columns == got.columns and nothing.count() == 0


def test_spark_hands_over_batches_of_bounded_size(spark):
    docs = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10000).alias("text"))
    common.map_batches(docs, lambda batches: batches, "text string")  # whatever maps batches bounds them
    handed = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(handed) > 2 and max(r.n for r in handed) < 2 * common.BATCH_BYTES
