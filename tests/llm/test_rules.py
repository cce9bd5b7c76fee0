import re

from pyspark.sql import functions as F

from sievekit.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t", "one two", "a b c d e f g h " * 3, "x " * 30, "é#*$ ñ\n\né#*$ ñ\n", " ".join(map(str, range(40))),
    " ".join([*map(str, range(12)), *map(str, range(12)), "z"]), "l1\nl2\nl1\nl1\n \n \n", "a\x0bb\x0cc\rd\x1ce f",
]


def test_measures_equal_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in rules.ledger(rules.measure(rows)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = spark.createDataFrame([(1, good), (2, "short"), (3, "%%% " * 25), (4, good), (4, good)], "doc_id long, text string")
    kept = rules.judge(rules.ledger(rules.measure(rows)))
    assert sorted(r.doc_id for r in kept.where("kept").collect()) == [1, 4, 4]
    found = {r.rule: (r.n_failed, r.n_only_this) for r in rules.ablations(kept).collect()}
    assert found["too_short"] == (1, 1)
    assert found["symbol_heavy"][0] == 1 and found["shouting"] == (0, 0)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_words string")
    assert rules.judge(rules.ledger(rules.measure(empty))).collect() == []
    row = rules.measure(spark.createDataFrame([("a b", "old")], "text string, n_words string")).select("n_words", F.col("text")).first()
    assert row.n_words == 2
