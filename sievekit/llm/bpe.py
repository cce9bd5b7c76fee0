"""Byte-level BPE encoding and decoding.

A text is cut into short words by the vocabulary's pre-tokenizing pattern. For
each word, two contiguous arrays hold its part boundaries and the merge rank of
every adjacent pair. The smallest rank is found by a scan, its boundary is
deleted and the two neighbouring ranks are looked up again, until no adjacent
pair merges. A vocabulary's added tokens are cut out of the text first and stand
for their own ids. The vocabulary is never trained here; its file's path is a
parameter.

Edge cases: a null or empty text has no ids and decodes to the empty text; texts
of any length are processed whole; repeated rows keep their own rows; an empty
table gives an empty result; other columns are carried along by encode() unless
their name is one of its outputs, which then replaces them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_task, map_batches, read, to_tasks

#: The pre-tokenizing pattern of byte-level vocabularies: contractions, letters, digits, other signs, white space.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Code points that are letters or numbers of newer versions of Unicode than the tokenizers library's, which takes
# them for signs.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Bytes that begin code points from there on, to pass over most texts quickly.
_FAR = re.compile(rb"[\xd5-\xf4]")
_NEWER = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")

#: Words remembered with their ids, in each task.
REMEMBERED = 200_000
NO_RANK = 1 << 30
#: Bytes of a word beyond which a heap finds the smallest rank.
LONG_WORD = 200


def byte_letters() -> dict[str, int]:
    """The printable letters by which vocabulary files write the 256 bytes: themselves where printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merge ranks and added tokens of a tokenizer file; its size is that of the file."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        model = spec["model"]
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(token): i for token, i in model["vocab"].items()}
        self.bytes_of = {i: token for token, i in self.ids.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # Two parts that make up a token are always the two that its merge names: up to
        # that merge, its bytes have gone through the same merges as the token alone.
        # So the rank of a pair is that of its bytes.
        self.ranks = {raw(a) + raw(b): rank for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-tokenized word."""
        if (whole := self.ids.get(word)) is not None and len(word) == 1:
            return [whole]
        if len(word) > LONG_WORD:
            return self._encode_long(word)
        rank_of, size = self.ranks.get, len(word)
        bounds = list(range(size + 1))
        rank = [rank_of(word[i : i + 2], NO_RANK) for i in range(size - 1)]
        while rank and (low := min(rank)) != NO_RANK:
            i = rank.index(low)  # the leftmost of equal ranks
            del bounds[i + 1], rank[i]
            if i < len(rank):
                rank[i] = rank_of(word[bounds[i] : bounds[i + 2]], NO_RANK)
            if i:
                rank[i - 1] = rank_of(word[bounds[i - 1] : bounds[i + 1]], NO_RANK)
        return [self.ids[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _encode_long(self, word: bytes) -> list[int]:
        """The same merges in the same order, by a heap instead of scans, whose time grows with the square of the length."""
        ranks, size = self.ranks, len(word)
        ends, before = list(range(1, size + 1)), list(range(-1, size - 1))  # of the part that starts at each place
        heap = []

        def offer(at: int) -> None:
            if (mid := ends[at]) < size and (rank := ranks.get(word[at : ends[mid]])) is not None:
                heapq.heappush(heap, (rank, at, mid, ends[mid]))

        for at in range(size):
            offer(at)
        while heap:
            _, at, mid, end = heapq.heappop(heap)
            if ends[at] != mid or ends[mid] != end:
                continue  # a part of this pair has merged otherwise
            ends[at], ends[mid] = end, 0
            if end < size:
                before[end] = at
                offer(at)
            if at:
                offer(before[at])
        ids, at = [], 0
        while at < size:
            ids.append(self.ids[word[at : ends[at]]])
            at = ends[at]
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that aren't UTF-8 become U+FFFD, nulls and ids outside the vocabulary stand for nothing."""
        known = self.bytes_of
        try:
            return b"".join(map(known.__getitem__, ids)).decode("utf-8", "replace")
        except KeyError:
            return b"".join(known[i] for i in ids if i in known).decode("utf-8", "replace")


class Encoder:
    """Encodes texts and remembers the ids of frequent words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.words = vocabulary, regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None
        self.known: dict[str, list[int]] = {}

    def _plain(self, text: str, ids: list[int]) -> None:
        known, vocabulary = self.known, self.vocabulary
        if not text.isascii() and _FAR.search(text.encode("utf-8", "surrogatepass")) and _NEWER.search(text):
            # cut as if there stood signs
            cuts = (m.span() for m in self.words.finditer(_NEWER.sub("!", text)))
            words = (text[a:b] for a, b in cuts)
        else:
            words = self.words.findall(text)
        for word in words:
            got = known.get(word)
            if got is None:
                got = vocabulary.encode_word(word.encode("utf-8", "surrogatepass"))
                if len(word) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = got
            ids += got

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        added = self.vocabulary.added
        if text and added and any(t in text for t in added):
            for piece in self.cut.split(text):
                if piece in added:
                    ids.append(added[piece])
                else:
                    self._plain(piece, ids)
        elif text:
            self._plain(text, ids)
        return ids


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the ids of each text as an array. The vocabulary goes to the executors as one broadcast variable, bounded by its file."""
    vocabulary = to_tasks(docs.sparkSession, Vocabulary.load(vocabulary_path))
    rest = [c for c in docs.columns if c != into]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = Encoder(in_task(vocabulary))
        for b in batches:
            yield {c: b[c] for c in rest} | {into: [encoder.encode(t) for t in b[text].to_pylist()]}

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*rest).dtypes)
    return map_batches(docs.select(*rest), run, f"{schema}, `{into}` array<int>")


def decode(rows: DataFrame, vocabulary_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text that each array of ids stands for; a null array decodes to the empty text, nulls and unknown ids in it are left out."""
    vocabulary = to_tasks(rows.sparkSession, Vocabulary.load(vocabulary_path))
    rest = [c for c in rows.columns if c != into]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known = in_task(vocabulary)
        for b in batches:
            yield {c: b[c] for c in rest} | {into: [known.decode(x or []) for x in b[ids].to_pylist()]}

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*rest).dtypes)
    return map_batches(rows.select(*rest), run, f"{schema}, `{into}` string")


def digests(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass over the rows and replaces the text by counts and digests of both results."""
    vocabulary = to_tasks(docs.sparkSession, Vocabulary.load(vocabulary_path))
    made = ("n_tokens", "ids_sha256", "decoded_sha256", "n_bytes")
    rest = [c for c in docs.columns if c not in (*made, text)]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known = in_task(vocabulary)
        encoder, written = Encoder(known), [str(i) for i in range(1 + max(known.bytes_of))]
        for b in batches:
            n, ids_hash, text_hash, size = [], [], [], []
            for t in b[text]:
                ids = encoder.encode(t.as_py())
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(written.__getitem__, ids)).encode()).hexdigest())
                decoded = known.decode(ids).encode("utf-8")
                text_hash.append(hashlib.sha256(decoded).hexdigest())
                size.append(len(decoded))
            yield {c: b[c] for c in rest} | {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_hash, "decoded_sha256": text_hash, "n_bytes": pa.array(size, pa.int64())}

    head = "".join(f"`{c}` {t}, " for c, t in docs.select(*rest).dtypes)
    return map_batches(docs.select(*rest, text), run, f"{head}n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint")


def default_vocabulary() -> str:
    """The byte-level vocabulary that the installed public tokenizer files hold."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return digests(docs, default_vocabulary())


QUERIES = {"op2_bpe": op2_bpe}
ORACLES: dict[str, str] = {}
