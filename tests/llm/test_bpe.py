import hashlib
import random

import pytest
from tokenizers import Tokenizer

from sievekit.llm import bpe

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = [
    None, "", " ", "\n\n \t x", "The theble's ain't  two   blanks", "naïve façade Ünïcode", "数据 库 🙂🙂 é", "a<|endoftext|>b <|endoftext|>",
    "&&&" * 500, " " * 900, "abc" * 400, "x y z　", "12345 ½ ² Ⅷ 1,000.50", "\x00\x01\r\n", "don't WON'T 'S 'll", "ßẞ ſ ı İ",
]


def test_ids_equal_the_library(spark, library):
    draw = random.Random(5)
    letters = "aAbé ñ'\n\t-0123&|ſ中🙂́​ "
    texts = TEXTS + ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 400))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(rows, PATH), PATH).collect()}
    sums = {r.doc_id: r for r in bpe.digests(rows, PATH).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids, text
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded == back
        assert sums[i].n_tokens == len(ids)
        assert sums[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert sums[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_every_code_point_is_cut_as_the_library_cuts_it(library):
    """Beside a letter, a number, a sign and white space, and before a contraction."""
    encoder = bpe.Encoder(bpe.Vocabulary.load(PATH))
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p <= 0xDFFF]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{c}1{c}!{c} {c}{c}'t" for c in points[at : at + 4096])
        if encoder.encode(text) != library.encode(text, add_special_tokens=False).ids:
            bad = [hex(ord(c)) for c in points[at : at + 4096] if encoder.encode(t := f"a{c}1{c}!{c} {c}{c}'t") != library.encode(t, add_special_tokens=False).ids]
            raise AssertionError(bad[:5])


def test_heap_equals_scan(library):
    known = bpe.Vocabulary.load(PATH)
    draw = random.Random(1)
    for _ in range(200):
        word = bytes(draw.choice(b"abcth e&") for _ in range(draw.randrange(2, 150)))
        assert known._encode_long(word) == known.encode_word(word)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    assert bpe.digests(empty, PATH).collect() == []
    rows = spark.createDataFrame([(1, "x", "old"), (1, "x", "old")], "doc_id long, text string, n_tokens string")
    assert [r.n_tokens for r in bpe.digests(rows, PATH).collect()] == [1, 1]


def test_unknown_ids_and_nulls_decode_to_nothing(spark, library):
    ids = library.encode("some words", add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, [ids[0], None, 10**8, *ids[1:], -3]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(rows, PATH).collect()} == {1: "some words", 2: "", 3: ""}
