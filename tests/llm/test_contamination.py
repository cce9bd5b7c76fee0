import os
import pickle
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievekit.llm import contamination as c


def made(n_docs=150, n_items=25, seed=8):
    draw = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "is"]
    syllables = ["ba", "de", "li", "mo", "ru", "sa", "ti", "ne", "ko", "fu"]
    word = lambda: draw.choice(common) if draw.random() < 0.35 else "".join(draw.choice(syllables) for _ in range(draw.randrange(2, 6)))
    text = lambda n: [word() for _ in range(n)]
    items = [text(draw.randrange(14, 70)) for _ in range(n_items)]
    docs, truth = [], {}
    for i in range(n_docs):
        words = text(draw.randrange(1, 400))
        if i % 3 == 0:
            k = draw.randrange(n_items)
            item = items[k][:]
            if i % 2:  # a paraphrase: every eighth word is another one
                item = [word() if j % 8 == 5 else w for j, w in enumerate(item)]
            at = draw.randrange(len(words) + 1)
            words[at:at] = item
            truth[i] = k
        docs.append((i, " ".join(words)))
    return docs, list(enumerate(map(" ".join, items))), truth


def test_finds_planted_items_and_leaves_clean_texts(spark):
    docs, items, truth = made()
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    found = c.leaked(c.matches(rows, spark.createDataFrame(items, "item_id long, text string"))).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    hit = sum((i, k) in got for i, k in truth.items())
    assert hit / len(truth) >= 0.9
    assert {i for i, _ in got} <= set(truth)
    for r in found:
        # the share is that of the brute-force common subsequence with the reported words
        words, item = c.words_of(docs[r.doc_id][1]), c.words_of(items[r.item_id][1])
        assert 0.6 <= r.share <= 1 and r.first_word < r.end_word <= len(words)
        assert brute(item, words[r.first_word : r.end_word]) >= r.share * min(len(item), c.WINDOW) - 1e-9


def test_recall_of_paraphrases_down_to_the_limit(spark):
    """Paraphrases of supplied items in supplied documents."""
    draw, folder = random.Random(4), f"{os.environ.get('TESTDATA', '/root/testdata')}/sf0.1"
    corpus = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").where("doc_id % 4 = 0").repartition(4)
    texts = [r.text for r in corpus.orderBy("doc_id").collect() if r.text and 20 <= len(r.text.split()) <= 600]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").collect()]
    words = [w for text in texts for w in text.split()]
    docs, planted = [], []
    for i, text in enumerate(draw.choices(texts, k=900)):
        k, item = draw.choice(items)
        item, host = item.split(), text.split()
        copy = item[:]
        for at in draw.sample(range(len(item)), int(len(item) * draw.choice([0.3, 0.38]))):
            copy[at] = draw.choice(words)
        at = draw.randrange(len(host) + 1)
        host[at:at] = copy
        docs.append((i, " ".join(host)))
        hashes = c.words_of(" ".join(item))
        if brute(hashes, c.words_of(" ".join(copy))) >= max(c.LEAST, c.COMMON * len(hashes)):
            planted.append((i, k, len(hashes)))
    # the space is that of the corpus, in which plants are rare
    search = c.Search(items, c.latent_space(corpus, c.document_frequencies(corpus)))
    got = {(i, k) for i, k, *_ in search(pa.array([text for _, text in docs]))}
    for lengths in (range(25), range(25, 41), range(41, 100)):
        hits = [(i, k) in got for i, k, n in planted if n in lengths]
        assert len(hits) > 50 and np.mean(hits) >= 0.95, (lengths, np.mean(hits))


def brute(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def test_common_length_equals_brute_force():
    draw = np.random.default_rng(1)
    for _ in range(50):
        a, b = draw.integers(0, 6, draw.integers(1, 30)), draw.integers(0, 6, draw.integers(1, 40))
        assert c.common_length(c.places_of(a), len(a), b.tolist()) == brute(a, b)


def test_answers(spark):
    stem = "which of the blue lanterns over the harbour was lit by the old keeper in winter"
    items = spark.createDataFrame([(1, f"{stem}? the seventh lantern")], "item_id long, text string")
    other = [(100 + i, t) for i, t in made(40, 5, 2)[0]]  # a corpus to fit the space to
    docs = spark.createDataFrame([*other, (1, f"{stem} said nobody at all here"), (2, f"{stem}? the seventh lantern"), (None, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r.answered for r in c.matches(docs, items).collect()}
    assert rows == {1: False, 2: True}
    # a question word for word is a leak without its answer; the answer check is for paraphrases
    assert sorted(r.doc_id for r in c.leaked(c.matches(docs, items)).collect()) == [1, 2]


def test_questions_with_long_answers():
    """A copied question is a leak however long its answer is; a paraphrase of it isn't without the answer."""
    draw = random.Random(7)
    text = lambda n: ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    space = c.Space(np.ones(c.BUCKETS), np.random.default_rng(0).standard_normal((c.BUCKETS, c.RANK)))
    for n, size in ((16, 14), (20, 3), (12, 1)):
        question, answer = text(n), text(size)
        item = " ".join(question) + "? " + " ".join(answer)
        paraphrase = [w if j % 4 else "other" for j, w in enumerate(question)]
        docs = [" ".join(text(30) + x + text(30)) for x in (question, paraphrase, paraphrase + answer, text(10))]
        found = {r[0]: r for r in c.Search([(1, item)], space)(pa.array(docs))}
        leaks = {i for i, r in found.items() if r[5] or r[4] >= c.COPY}
        assert leaks == {0, 2}, (n, size, found)


def test_query_equals_a_search_of_every_passage(spark):
    """Without cosines and bitmaps: the common subsequence of each item with every passage of each text."""
    folder = f"{os.environ.get('TESTDATA', '/root/testdata')}/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    space = c.Space(np.ones(c.BUCKETS), np.random.default_rng(0).standard_normal((c.BUCKETS, c.RANK)))
    groups = [g for across in (c.WINDOW // c.STRIDE, c.SHORT_WINDOW // c.STRIDE) if (g := c.Items(items, space, across)).ids]
    want = {}
    for i, text in texts.items():
        ids = c.words_of(text)
        found = set()
        for g in groups:
            for start in range(0, max(len(ids) - (g.across - 1) * c.STRIDE, 1), c.STRIDE):
                around = ids[max(0, start - c.WINDOW // 2) : start + g.across * c.STRIDE + c.WINDOW // 2]
                held = set(around.tolist())
                for k, words in enumerate(g.words):
                    if g.ids[k] not in found and sum(w in held for w in words.tolist()) >= c.COMMON * len(words):
                        assert not len(g.answers[k])
                        if len(ids) >= c.LEAST and brute(words, around) >= max(c.LEAST, c.COMMON * len(words)):
                            found.add(g.ids[k])
        want[i] = (bool(found), len(found), min(found, default=None))
    got = {r.doc_id: (r.contaminated, r.n_items, r.first_item) for r in c.op9_decontamination(spark, folder).collect()}
    assert set(got) == set(want) and sum(w[0] for w in want.values()) > 2
    wrong = {i for i in want if got[i] != want[i]}
    assert not {i for i in wrong if got[i][1] > want[i][1]} and len(wrong) <= 0.05 * sum(w[0] for w in want.values())


def test_rows_are_judged_by_their_own_texts(spark):
    docs, items, truth = made(60, 8, 5)
    leak = next(iter(truth))
    rows = spark.createDataFrame([*docs, docs[leak], docs[leak], (leak, "clean words"), (None, docs[leak][1]), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([*items, items[truth[leak]]], "item_id long, text string")
    got = [(r.n_items, r.first_item) for r in c.verdicts(rows, bench).where(F.col("doc_id") == leak).collect()]
    assert sorted(got, key=str) == [(0, None)] + [(1, truth[leak])] * 3
    assert sorted(r.n_items for r in c.verdicts(rows, bench).where("doc_id is null").collect()) == [0, 1]


def test_copies_and_answers_in_other_passages():
    draw = random.Random(6)
    text = lambda n: ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    question, answer, gap = text(40), text(3), text(90)
    item, space = " ".join(question) + "? " + " ".join(answer), c.Space(np.ones(c.BUCKETS), np.random.default_rng(0).standard_normal((c.BUCKETS, c.RANK)))
    # the question word for word without its answer, and again with the answer in a paraphrase
    paraphrase = [w if j % 4 else "other" for j, w in enumerate(question)]
    found = c.Search([(1, item)], space)(pa.array([" ".join(question + gap), " ".join(question + gap + paraphrase + answer)]))
    assert [(r[0], r[5]) for r in found] == [(0, False), (1, True)] and found[0][4] >= c.COPY > found[1][4]


def test_leaked_keeps_copies_without_answer(spark):
    rows = spark.createDataFrame([(1, 1.0, False), (2, 0.8, False), (3, 0.7, True)], "doc_id long, share double, answered boolean")
    assert [r.doc_id for r in c.leaked(rows).orderBy("doc_id").collect()] == [1, 3]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert c.matches(docs, none).collect() == []
    some = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], none.schema)
    assert c.matches(docs, some).collect() == [] and c.matches(docs.where("false"), some).collect() == []


def test_blocks_of_items(spark, monkeypatch):
    docs, items, truth = made(40, 12, 3)
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in c.matches(rows, bench).collect()}
    monkeypatch.setattr(c, "MOST_ITEMS", 4)
    assert {(r.doc_id, r.item_id) for r in c.matches(rows, bench).collect()} == whole


def test_latent_space_is_fitted_to_every_text(spark):
    texts = [f"w{i % 7} w{i % 11} w{i % 400}" for i in range(40000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    idf = c.document_frequencies(docs)
    space = c.latent_space(docs, idf)
    basis = space.rows / idf[:, None]
    x = c.Space(idf, basis).passages([c.words_of(t) for t in texts])[2]
    mean, scaling = c._shrunk(len(x), x.sum(axis=0), x.T @ x)
    assert np.allclose(space.mean, mean, atol=1e-5)
    # a sample of half of them has other moments
    assert not np.allclose(space.mean, c._shrunk(20000, x[::2].sum(axis=0), x[::2].T @ x[::2])[0], atol=1e-5)


def test_passes_share_bucket_numbers(spark):
    """Words are hashed once for document frequencies, space and moments, with the results of passes of their own."""
    docs = spark.createDataFrame([*made(60, 5, 9)[0], (100, None), (101, ""), (102, "one one two")], "doc_id long, text string")
    numbers = c.bucket_numbers(docs)
    idf = c.document_frequencies(docs, numbers=numbers)
    seen, n = np.zeros(c.BUCKETS), 0
    for r in docs.collect():
        ids = c.buckets(c.words_of(r.text)) if r.text else []
        for at in range(0, len(ids), c.WINDOW):
            n += 1
            seen[np.unique(ids[at : at + c.WINDOW])] += 1
    assert np.allclose(idf, np.log((n + 1) / (seen + 1)).clip(0.1))
    assert np.array_equal(idf, c.document_frequencies(docs))
    one, other = c.latent_space(docs, idf, numbers=numbers), c.latent_space(docs, idf)
    assert np.allclose(np.abs(one.rows.T @ other.rows), np.abs(other.rows.T @ other.rows), atol=1e-2)
    assert np.allclose(one.mean, other.mean, atol=1e-3)


def test_add_rows():
    draw = np.random.default_rng(3)
    for n, keys in ((0, 5), (1, 1), (5000, 3), (3000, 900)):
        at, rows, values = draw.integers(0, keys, n).astype(np.uint16), draw.integers(0, 50, n), draw.standard_normal((50, 4)).astype(np.float32)
        got, want = np.ones((keys, 4), np.float32), np.ones((keys, 4))
        c.add_rows(got, at, rows, values)
        np.add.at(want, at, values[rows].astype(float))
        assert np.allclose(got, want, atol=1e-3)


def test_memory_of_a_task_does_not_grow_with_the_items():
    """Cosines are looked at in blocks of CELLS, and a task gets the table of the space once."""
    draw = random.Random(5)
    text = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    space = c.Space(np.ones(c.BUCKETS), np.random.default_rng(0).standard_normal((c.BUCKETS, c.RANK)))
    assert len(pickle.dumps(space)) < 1.1 * space.padded.nbytes
    search, texts = c.Search([(i, text(30)) for i in range(3000)], space), pa.array([text(30_000)])
    tracemalloc.start()
    search(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6, peak
