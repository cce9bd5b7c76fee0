import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievekit.llm import common, labelled, quality, toxicity


def corpus(n=900, seed=1):
    """Texts of made-up words; toxic ones hold forms of two stems, junk ones hold signs."""
    draw = random.Random(seed)
    part = lambda: draw.choice(["ba", "de", "li", "mo", "ru", "sa", "ti", "ne"])
    word = lambda: "".join(part() for _ in range(draw.randrange(1, 5)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(draw.randrange(30, 120))]
        toxic, junk = draw.random() < 0.25, draw.random() < 0.3
        for at in range(0, len(words), 12):
            if toxic:
                words[at] = draw.choice(["scumx", "vequ"]) + draw.choice(["", "ta", "ri", "mo"])
            if junk:
                words[at : at + 6] = [w + "$$$ |" for w in words[at : at + 6]]
        rows.append((i, " ".join(words), int(not junk), int(toxic)))
    return rows


def write(spark, tmp_path, rows):
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], *r[2:]) for r in rows if r[2] is not None], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus()
    write(spark, tmp_path, [*rows, (5000, None, None, None), (5001, "", None, None)])
    truth = {r[0]: r[2:] for r in rows}
    for query, folds, rest, place in ((quality.op1_quality_classifier, 5, 0, 0), (toxicity.op5_toxicity, 3, 1, 1)):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == rest) for r in got)
        held = [r for r in got if r.held_out and r.doc_id in truth]
        pos, neg = ([r.score for r in held if truth[r.doc_id][place] == y] for y in (1, 0))
        assert np.mean([a > b for a in pos for b in neg]) > 0.95
        limit = 0.3 if place == 0 else 0.7
        assert all(r.predicted == int(r.score >= limit) for r in got)


def test_without_labels_or_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1, 1)], labels.schema)
    assert {r.score for r in quality.score(docs, quality.fit(docs, one)).collect()} == {1.0}
    empty = docs.where("false")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).collect() == []


def test_sample_is_bounded_and_repeatable(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    rows, weights = labelled.sample(labels, "toxic", F.lit(True), 200)
    first = {r.doc_id for r in rows.collect()}
    assert first == {r.doc_id for r in labelled.sample(labels, "toxic", F.lit(True), 200)[0].collect()}
    assert 300 < len(first) < 500 and weights == {0: 20.0, 1: 5.0}


def test_document_counts_equal_brute_force(spark):
    rows = corpus(60, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    counts = sorted(r.n for r in toxicity.document_counts(docs).where("not stem").collect())
    brute: dict = {}
    for _, text, *_ in rows:
        for w in set(text.replace("$", " ").replace("|", " ").split()):
            brute[w] = brute.get(w, 0) + 1
    assert counts == sorted(brute.values())


def test_hashed_words_equal_words():
    import re

    draw = random.Random(4)
    texts = ["".join(draw.choice("aAbZé ñ\n\t 🙂.x") for _ in range(draw.randrange(0, 60))) for _ in range(400)] + [None, "", " ", "a"]
    for table, pattern in ((common.SPACED, r"[^\x20\x09-\x0D]+"), (common.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        hashes, ends, stems = common.hashed_words(pa.array(texts), table, 4)
        at, known, known_stems = 0, {}, {}
        for text, end in zip(texts, ends):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
            words = re.findall(pattern, low)
            assert len(words) == end - at
            for i, w in enumerate(words):
                assert known.setdefault(w, hashes[at + i]) == hashes[at + i]
                assert known_stems.setdefault(w[:4], stems[at + i]) == stems[at + i]
            at = end
        assert len(set(known.values())) == len(known) and len(set(known_stems.values())) == len(known_stems)


def test_discounts_and_temperature():
    assert toxicity.discounted(np.array([0, 1, 1, 1, 2, 3, 9]))[0] == 0
    steps = toxicity.discounts({1: 100, 2: 40, 3: 20, 4: 10})
    assert 0 < steps[1] < 1 < steps[2] < steps[3] < 3
    draw = np.random.default_rng(0)
    logit = draw.normal(0, 2, 4000)
    y = (draw.random(4000) < labelled.sigmoid(logit / 2)).astype(float)
    assert abs(quality.temperature(logit, y, np.ones(4000)) - 2) < 0.3


def test_short_texts_of_toxic_words_alone(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, "scumxta vequri scumxmo"), (5001, "vequta debane scumxri"), (5002, "debane lisate mori")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("doc_id >= 5000").collect()}
    assert got[5000] >= toxicity.THRESHOLD and got[5001] >= toxicity.THRESHOLD > got[5002]


def test_bigrams_seen_once_have_mass(spark):
    texts = spark.createDataFrame([("one two three two three four", 1), ("five one two", 0)], "text string, y int")
    bigrams = toxicity.bigram_counts(texts)
    classes = [toxicity.Counts(bigrams, y) for y in (0, 1)]
    assert [len(c.n) for c in classes] == [3, 5]
    models = toxicity.Models(classes, (np.zeros(0, np.uint64), np.zeros(0)), 1.0)
    start, one, two, three, four = (np.uint64(1), *common.hashed_words(pa.array(["one two three four"]), common.ALNUM)[0])
    at = lambda h, w: np.searchsorted(models.keys, toxicity.pair_key(np.array([h]), np.array([w])))[0]
    steps = classes[1].steps
    assert np.isclose(models.pair_p[1][at(three, four)], (1 - steps[1]) / (2 + toxicity.CONTEXT))
    assert np.isclose(models.pair_p[1][at(two, three)], (2 - steps[2]) / (2 + toxicity.CONTEXT))
    back = models.back[1][np.searchsorted(models.words, three)]
    assert np.isclose(back, (2 * steps[1] + toxicity.CONTEXT) / (2 + toxicity.CONTEXT))


def test_word_vectors_and_pooling_equal_brute_force(spark):
    texts = ["one two THREE one two three, 42 one two THREE one", None, "", "A", "lone LONE lone LONE lone LONE"]
    table = quality.word_vectors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    places, signs = quality.index_vectors()
    again = []
    for text in texts:
        ids, tokens = [], quality.tokens_of(text)
        plain = [quality.xxhash.xxh64_intdigest(t) % quality.BUCKETS for t in tokens]
        for i, t in enumerate(tokens):
            ids.append(plain[i])
            if len(t) > 1 and t.isupper():
                ids.append(quality.CAPITALS)
            if any(plain[j - 2 : j + 1] == plain[i - 2 : i + 1] for j in range(2, i)) and i >= 2:
                ids.append(quality.AGAIN)
        again.append(ids)
    brute = np.zeros((quality.ROWS, quality.DIMENSIONS))
    for ids in again:
        for i, w in enumerate(ids):
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                if i != j:
                    np.add.at(brute[w], places[ids[j]], signs[ids[j]])
    assert np.allclose(table, brute / np.maximum(np.linalg.norm(brute, axis=1, keepdims=True), 1e-9), atol=1e-6)
    pooled = quality.Pooling(table)
    for text, ids in zip(texts, again):
        assert np.allclose(pooled(text), table[ids].mean(axis=0) if ids else 0, atol=1e-6)


def test_differences_equal_the_formulas(spark):
    import math
    import re
    from collections import Counter, defaultdict

    draw = random.Random(5)
    vocabulary = ["alpha", "alphas", "alphabet", "beta", "betas", "gamma", "gam", "delta", "eps"]
    train = [(" ".join(draw.choice(vocabulary[y * 3 :]) for _ in range(draw.randrange(2, 30))), y) for y in (0, 1) for _ in range(8)]
    corpus_texts = [t for t, _ in train] + ["zeta alpha", "alphanumeric zeta zeta"]
    tests = ["alpha beta gamma", "alphas alphas delta", "zeta alphazzz alpha", "gamma", *[t for t, _ in train[:3]]]

    def words(text):
        out = []
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()):
            if not out or out[-1] != w:
                out.append(w)
        return out

    stem = lambda w: w[: toxicity.STEM]
    df_word, df_stem = Counter(), Counter()
    for t in corpus_texts:
        found = set(re.findall(r"\w+", t))
        df_word.update(found), df_stem.update({stem(w) for w in found})
    pairs = [Counter(), Counter()]
    for t, y in train:
        w = words(t)
        pairs[y].update(zip(["<s>", *w[:-1]], w))
    known = {w for c in pairs for _, w in c}
    stems = {stem(w) for w in known}
    mass = sum(df_stem.values()) + toxicity.PRIOR * (len(known) + 1 + len(stems))
    in_stem = {s: df_stem[s] + toxicity.PRIOR * (1 + sum(stem(w) == s for w in known)) for s in stems}

    def model(counts):
        before, size = Counter(w for _, w in counts), defaultdict(int)
        for (h, _), n in counts.items():
            size[h] += n
        steps = toxicity.discounts(Counter(n for n in counts.values() if n < 5))
        total = sum(before.values())
        of_stem = Counter()
        for w, n in before.items():
            of_stem[stem(w)] += n
        cut = lambda table, keys: toxicity.discounts(Counter(table[k] for k in keys if table[k] < 5))
        stem_steps, word_steps = cut(of_stem, stems), cut(before, known | {"<s>"})
        off_stem = {s: stem_steps[min(of_stem[s], 3)] for s in stems}
        off_word = {w: word_steps[min(before[w], 3)] for w in known}
        stem_back, back = sum(off_stem.values()) / total, sum(off_word.values()) / total
        p_stem = {s: (of_stem[s] - off_stem[s]) / total + stem_back * in_stem[s] / mass for s in stems}

        def p(h, w):
            if w in known:
                within = (df_word[w] + toxicity.PRIOR) / max(in_stem[stem(w)], df_word[w] + toxicity.PRIOR)
                base = (before[w] - off_word[w]) / total + back * p_stem[stem(w)] * within
            else:
                base = back * p_stem[stem(w)] * 1e-4 if stem(w) in stems else back * stem_back * 1e-9
            mine = [n for (g, _), n in counts.items() if g == h]
            lam = (sum(steps[min(n, 3)] for n in mine) + toxicity.CONTEXT) / (size[h] + toxicity.CONTEXT) if mine else 1.0
            n = counts[h, w]
            return lam * base + ((n - steps[min(n, 3)]) / (size[h] + toxicity.CONTEXT) if n else 0.0)

        return p

    ordinary, toxic = map(model, pairs)
    rows = spark.createDataFrame(train, "text string, y int")
    bigrams = toxicity.bigram_counts(rows)
    classes = [toxicity.Counts(bigrams, y) for y in (0, 1)]
    counted = toxicity.document_counts(spark.createDataFrame([(t,) for t in corpus_texts], "text string")).toPandas()
    kept = counted.groupby("w").n.max()
    order = np.argsort(kept.index.to_numpy().view(np.uint64))
    shared = kept.index.to_numpy().view(np.uint64)[order], kept.to_numpy()[order]
    models = toxicity.Models(classes, shared, float(counted[counted.stem].n.sum()))
    ends, got, _ = toxicity.Scorer(models).differences(pa.array(tests))
    for low, high, t in zip(ends, ends[1:], tests):
        w = words(t)
        assert high - low == len(w)
        brute = [math.log(toxic(h, x) / ordinary(h, x)) for h, x in zip(["<s>", *w[:-1]], w)]
        assert np.allclose(got[low:high], brute, atol=1e-4), t


def test_toxicity_learns_from_every_training_row(spark):
    docs = spark.range(14000).select(F.col("id").alias("doc_id"), F.concat(F.lit("scum"), F.col("id").cast("string"), F.lit(" here")).alias("text"))
    labels = spark.range(14000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    models, _ = toxicity.fit(docs, labels)
    assert len(models.words) > 14000 * (1 - toxicity.CURVE_PART) * 0.95


def test_toxicity_models_keep_their_size_and_count_the_rest(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_BIGRAMS", 30)
    monkeypatch.setattr(toxicity, "MOST_WORDS", 30)
    texts = [(" ".join(["scum"] * (i % 3) + ["scuma", f"scumb{i}"] * (1 + i % 2)), i % 2) for i in range(200)]
    bigrams = toxicity.bigram_counts(spark.createDataFrame(texts, "text string, y int"))
    per_word = toxicity.words_before(bigrams)
    places = toxicity.held(bigrams, per_word)
    few, every = ([toxicity.Counts(bigrams, y, *rest) for y in (0, 1)] for rest in ((per_word, places), ()))
    assert max(len(c.n) for c in few) <= 30 < min(len(c.n) for c in every)
    for a, b in zip(few, every):
        assert a.total == b.total and (a.steps == b.steps).all() and (a.word_steps == b.word_steps).all()
        assert dict(zip(a.stem, a.stem_before)).items() <= dict(zip(b.stem, b.stem_before)).items()
        assert dict(zip(a.h, a.size)).items() <= dict(zip(b.h, b.size)).items()
    models = toxicity.Models(few, (np.zeros(0, np.uint64), np.zeros(0)), 1.0)
    assert all(((0 < b) & (b <= 1)).all() for b in models.back)


def test_bigrams_counted_in_turns_are_all_bigrams(spark):
    texts = spark.createDataFrame([(" ".join(f"w{i * k % 41}" for k in range(40)), i % 2) for i in range(60)], "text string, y int")
    rows = lambda df: sorted(tuple(r[c] for c in ("y", "h", "w", "n", "s")) for r in df.collect())
    turns = [rows(toxicity.bigram_counts(texts, turn)) for turn in range(toxicity.TURNS)]
    assert all(turns) and sorted(sum(turns, [])) == rows(toxicity.bigram_counts(texts))


def test_counts_of_known_words_leave_the_sum_of_the_others(spark):
    docs = spark.createDataFrame([(t,) for t in ("one two two", "two three four", "", None, "five")], "text string")
    every = toxicity.document_counts(docs).toPandas()
    two, four = common.hashed_words(pa.array(["two four"]), common.ALNUM)[0]
    few = toxicity.document_counts(docs, known=np.sort([two, four])).toPandas()
    assert dict(zip(few.w[~few.stem].astype("uint64"), few.n[~few.stem])) == {two: 2, four: 1, toxicity.OTHER: 3}
    assert list(few.w[few.stem]) == [toxicity.OTHER]
    assert few.groupby("stem").n.sum().to_dict() == every.groupby("stem").n.sum().to_dict()


def test_toxicity_holds_no_texts_beside_the_bigrams_and_shuffles_no_bigrams_again(spark, monkeypatch):
    left, plans, plain = [], [], toxicity.held

    def looks(bigrams, per_word):
        left.extend(path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in common._held)
        places = plain(bigrams, per_word)
        plans.append(toxicity.among(bigrams, places[1])._jdf.queryExecution().executedPlan().toString())
        return places

    before = len(common._held)
    monkeypatch.setattr(toxicity, "held", looks)
    rows = corpus(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int"))
    assert sorted(left[before:]) == ["bigrams"] * toxicity.TURNS + ["words-before"]
    assert "Exchange" not in plans[0] and len(common._held) == before
