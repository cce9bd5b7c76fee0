import random

import corpus_pipeline
from sievekit.llm import bpe, neardup, privacy, rules
from tokenizers import Tokenizer


def folder(spark, tmp_path):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice(["ba", "de", "li", "mo", "ru", "sa", "ti", "ne", "ko"]) for _ in range(draw.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(36)
    clean = [text(draw.randrange(30, 200)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[3]), (101, clean[4] + " tail"), (102, f"{text(40)} {item} {text(20)}"), (103, "%%% | " * 40), (104, "few words"), (105, None), (106, ""), (107, f"{text(30)} mail a.b@c.de now"), (19, clean[19]), (None, text(40))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs


def test_stages_equal_brute_force(spark, tmp_path):
    sf_dir, docs = folder(spark, tmp_path)
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "minhash_neardup", "decontamination", "privacy", "bpe"]
    first = stage["quality_rules"](spark, docs, sf_dir)
    assert first.columns == columns
    assert sorted(str(r.doc_id) for r in first.collect()) == sorted([*map(str, range(20)), "19", "100", "101", "102", "107", "None"])
    second = stage["minhash_neardup"](spark, first, sf_dir)
    assert second.columns == columns and sorted(str(r.doc_id) for r in second.collect()) == sorted([*map(str, range(20)), "102", "107", "None"])
    third = stage["decontamination"](spark, second, sf_dir)
    assert third.columns == columns and 102 not in {r.doc_id for r in third.collect()} and third.count() == 22
    fourth = stage["privacy"](spark, third, sf_dir)
    redacted = {r.doc_id: r for r in fourth.collect()}
    assert fourth.columns == columns and redacted[107].text.endswith("mail [EMAIL] now") and redacted[107].n_chars == len(redacted[107].text)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {i: r.n_tokens for i, r in last.items()} == {i: len(library.encode(r.text, add_special_tokens=False).ids) for i, r in redacted.items()}


def test_empty_tables_pass_through(spark, tmp_path):
    sf_dir, docs = folder(spark, tmp_path)
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == [], name


def test_extra_columns_with_clashing_names(spark, tmp_path):
    sf_dir, docs = folder(spark, tmp_path)
    wide = docs.selectExpr("*", "1 as n_words", "'x' as node", "2 as item_id", "'y' as spans")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide = stage(spark, wide, sf_dir)
        assert wide.columns == [*docs.columns, "n_words", "node", "item_id", "spans"], name
    assert {r.n_words for r in wide.collect()} == {1}


def test_modules_hold_their_queries():
    assert set(rules.QUERIES) == {"op7_quality_rules"} and set(neardup.QUERIES) == {"op3_minhash_neardup"} and set(privacy.QUERIES) == {"op6_private_spans"}


def test_rows_are_judged_not_ids(spark, tmp_path):
    """Repeated ids with other texts, and null ids with copies and leaks, against brute force by row."""
    draw = random.Random(16)
    word = lambda: "".join(draw.choice(["ba", "de", "li", "mo", "ru", "sa", "ti", "ne", "ko"]) for _ in range(draw.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, (a, b, c, d, e) = text(36), (text(60) for _ in range(5))
    leak = f"{text(30)} {item} {text(30)}"
    rows = [(5, a, "en"), (5, b, "de"), (1, c, "en"), (None, c, "en"), (None, d, "fr"), (None, d, "fr"), (None, leak, "en"), (5, leak + " end", "en"), (None, e, "es"), (7, e + " more", "es"), (8, "", "en"), (8, "", "en"), (8, None, "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted((str(r.doc_id), str(r.text), r.lang) for r in df.collect())
    second = stage["minhash_neardup"](spark, docs.repartition(3), str(tmp_path))
    # of each group the row with the smallest id, null last; rows without words are in no group
    kept = [(5, a, "en"), (5, b, "de"), (1, c, "en"), (None, d, "fr"), (5, leak + " end", "en"), (7, e + " more", "es"), (8, "", "en"), (8, "", "en"), (8, None, "en")]
    assert plain(second) == sorted((str(i), str(t), lang) for i, t, lang in kept)
    third = stage["decontamination"](spark, docs, str(tmp_path))
    assert plain(third) == sorted((str(i), str(t), lang) for i, t, lang in rows if item not in (t or ""))
