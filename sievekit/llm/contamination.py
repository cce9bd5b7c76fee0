"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of WINDOW words, one from every STRIDE words on. A
passage is a TF-IDF vector over hash buckets of words; the inverse document
frequencies count the whole corpus. The latent space comes from a randomised SVD
of the passages of all texts, whose words are kept as bucket numbers for both
passes over them and the document frequencies: each task adds up its part of A'(A R)
for its passages A and a fixed random matrix R, the parts are added by pieces, and
the orthonormal basis of the sum spans the leading right singular vectors. The next pass takes the mean and covariance of
the passages there, by which latent vectors are centred and scaled, so that the
few directions that all texts of one language share don't decide.

Every passage of every text, and the benchmark's items (cut the same way if they
are long), are compared by the cosine of their latent vectors, item block by item
block. What comes near is checked on its words, by the longest common
subsequence with the item and, for items that end in an answer, by whether the
passage also holds the answer, unless it is a near copy of the item or of its
question. Before that, hashed word bitmaps rule out pairs whose common
subsequence can't be long enough.

The space has BUCKETS * RANK numbers at any size of the corpus. The benchmark
goes to all tasks if it has at most MOST_ITEMS passages; a larger one is searched
in blocks of so many, each in a pass of its own.

Edge cases: a null or empty text or item matches nothing; a document of fewer
words than WINDOW is one passage; a very long one is searched whole. Each row is
judged by its own text, whether its id is null or repeated. Rows of the
benchmark that share an id are one item, and an item without an id isn't
searched. Of several passages that hold an item, an answered one counts, then the
one with the largest share, then the first. Shares and cosines at a limit pass
it. An empty table on either side gives no matches; no columns but doc_id,
item_id and the texts are read, and others are carried along by clean() only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, forget, in_task, map_batches, mixed, read, stored, to_tasks, word_slices

WINDOW, STRIDE = 40, 10
#: Items of at most SHORT words are compared with passages of SHORT_WINDOW words.
SHORT, SHORT_WINDOW = 24, 20
BUCKETS, RANK = 1 << 15, 48
BLOCKS = 64
#: Vectors that the covariance of the latent space is drawn towards equal variances by; few passages don't fix it.
SHRINKAGE = 2.0 * RANK
MOST_ITEMS = 1 << 15
#: Cosine in the latent space from which a passage is checked on its words: low, because the word bitmaps rule out most
#: pairs and paraphrases at the limit of COMMON keep little of an item's direction.
NEAR = 0.1
#: Share of an item's words that a passage must hold in order, and the least number of them.
COMMON, LEAST = 0.6, 8
#: Share of the words of an item, or of its question of LEAST words or more, from which a passage counts as a copy, whether it holds the answer or not.
COPY = 0.9
#: Words of texts that a task works on together, if no single text has more: their strides and vectors take some 500 bytes a word.
TOGETHER = 1 << 17
#: Rows of a key that add_rows() adds up before it sorts again.
ROUNDS = 16
#: Cosines that a task looks at together, whatever the number of items; what passes NEAR takes some 200 bytes each.
CELLS = 1 << 18
#: 64-bit parts of a passage's word bitmap.
PARTS = 8
#: Words up to which an answer must be there whole; of a longer one, a share of COMMON.
ANSWER = 8


def words_of(text: str | None) -> np.ndarray:
    return word_slices(pa.array([text], pa.string()), ALNUM)[0]


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


#: One bit of a bitmap for each value, and none for the last.
_ONE_BIT = np.zeros((64 * PARTS + 1, PARTS), np.uint64)
_ONE_BIT[np.arange(64 * PARTS), np.arange(64 * PARTS) >> 6] = np.uint64(1) << (np.arange(64 * PARTS) & 63).astype(np.uint64)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(20)) & np.uint64(64 * PARTS - 1)).astype(np.int64)


def set_bits(bitmaps: np.ndarray) -> np.ndarray:
    """How many bits each bitmap has, below 256: a product adds up the counts of its PARTS = 8 parts."""
    return (np.bitwise_count(bitmaps).view(np.uint64).ravel() * np.uint64(0x0101010101010101)) >> np.uint64(56)


class Space:
    """The latent space: idf-weighted rows of the basis, squared idf, and the centring and scaling of latent vectors."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, mean: np.ndarray | None = None, scaling: np.ndarray | None = None):
        # one more place, for the words that a text's last stride lacks
        self.padded = np.zeros((BUCKETS + 1, basis.shape[1] + 1), np.float32)
        self.padded[:-1, :-1], self.padded[:-1, -1] = basis * idf[:, None], idf**2
        self.mean = np.zeros(basis.shape[1]) if mean is None else mean
        self.scaling = np.eye(basis.shape[1]) if scaling is None else scaling

    # views, so that tasks get the table once
    @property
    def rows(self) -> np.ndarray:
        return self.padded[:-1, :-1]

    @property
    def squares(self) -> np.ndarray:
        return self.padded[:-1, -1]

    def passages(self, texts: list[np.ndarray], across: int = WINDOW // STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, vector) of each passage of `across` strides, of texts given as non-empty arrays of word hashes."""
        return Strides(self, texts).passages(across)

    def unit(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean.astype(np.float32)) @ self.scaling.astype(np.float32)
        return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


class Strides:
    """Sums over the strides of texts, taken once; a passage is the sum of its strides."""

    def __init__(self, space: Space, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts])
        self.strides = -(-lengths // STRIDE)
        self.offset = np.concatenate([[0], np.cumsum(self.strides)])
        hashes = np.concatenate(texts)
        # each text begins a new stride, and its last stride is filled up with places that hold nothing
        at = np.arange(len(hashes)) + np.repeat(self.offset[:-1] * STRIDE - (np.cumsum(lengths) - lengths), lengths)
        self.filled = lambda values, nothing: self._fill(values, at, nothing)
        self.hashes = hashes
        ids = self.filled(buckets(hashes), BUCKETS)
        # the last row holds nothing
        self.sums = np.zeros((self.offset[-1] + 1, space.padded.shape[1]), np.float32)
        for k in range(STRIDE):
            self.sums[:-1] += np.take(space.padded, ids[:, k], axis=0)

    def _fill(self, values: np.ndarray, at: np.ndarray, nothing: int) -> np.ndarray:
        out = np.full(self.offset[-1] * STRIDE, nothing, np.int64)
        out[at] = values
        return out.reshape(-1, STRIDE)

    def _first(self, across: int) -> tuple[np.ndarray, np.ndarray]:
        count = np.maximum(self.strides - across + 1, 1)
        text = np.repeat(np.arange(len(count)), count)
        return text, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)

    def passages(self, across: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, place = self._first(across)
        low, end, none = self.offset[text] + place, self.offset[text + 1], len(self.sums) - 1
        x = np.take(self.sums, low, axis=0)
        for step in range(1, across):
            x += np.take(self.sums, np.where(low + step < end, low + step, none), axis=0)
        return text, place * STRIDE, x[:, :-1] / np.sqrt(np.maximum(x[:, -1:], np.float32(1e-9)))

    def words(self) -> np.ndarray:
        """Bitmaps of the words of each stride; the last row holds nothing."""
        bits = self.filled(bits_of(self.hashes), 64 * PARTS)
        out = np.zeros((len(self.sums), PARTS), np.uint64)
        for k in range(STRIDE):
            out[:-1] |= np.take(_ONE_BIT, bits[:, k], axis=0)
        return out

    def bitmaps(self, words: np.ndarray, across: int, margin: int) -> np.ndarray:
        """Bitmaps of the words of each passage and of margin strides on either side of it."""
        text, place = self._first(across)
        first, low, end, none = self.offset[text] + place, self.offset[text], self.offset[text + 1], len(words) - 1
        out = np.take(words, first, axis=0)
        for step in range(-margin, across + margin):
            at = first + step
            out |= np.take(words, np.where((at >= low) & (at < end), at, none), axis=0)
        return out


def bucket_numbers(docs: DataFrame, text: str = "text") -> DataFrame:
    """The words of each text that has any as bucket numbers of two bytes, stored, so that words are hashed once for all passes."""

    def number(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"ids": [buckets(words).astype("<u2").tobytes() for words in word_slices(b[text], ALNUM) if len(words)]}

    return stored(map_batches(docs.select(text), number, "ids binary"), "bucket-numbers")


def _numbers_of(batches: Iterator[dict]) -> Iterator[list[np.ndarray]]:
    """The bucket numbers of texts, in lists of bounded size."""
    for b in batches:
        yield from _parts([np.frombuffer(x.as_buffer(), "<u2") for x in b["ids"]], len)


def _laid_out(texts: list[np.ndarray]) -> np.ndarray:
    """Bucket numbers of passages that follow one another, one column each; BUCKETS stands for words that a text's last passage lacks."""
    lengths = np.array([len(t) for t in texts])
    places = -(-lengths // WINDOW) * WINDOW
    at = np.arange(lengths.sum()) + np.repeat(np.cumsum(places) - places - (np.cumsum(lengths) - lengths), lengths)
    out = np.full(places.sum(), BUCKETS, np.uint16)
    out[at] = np.concatenate(texts)
    return np.ascontiguousarray(out.reshape(-1, WINDOW).T)


def document_frequencies(docs: DataFrame, text: str = "text", numbers: DataFrame | None = None) -> np.ndarray:
    """Inverse document frequencies of the buckets over all passages, from per-task counts of fixed size.

    numbers: bucket_numbers() of docs, where they are there already.
    """

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        seen, n = np.zeros(BUCKETS + 1, np.int64), 0
        for texts in _numbers_of(batches):
            words = _laid_out(texts)
            n += words.shape[1]
            for k, ids in enumerate(words):
                seen += np.bincount(ids[~(words[:k] == ids).any(axis=0)], minlength=BUCKETS + 1)
        if n:
            yield {"block": np.arange(-1, BLOCKS), "counts": [np.array([n]).tobytes(), *(x.tobytes() for x in seen[:-1].reshape(BLOCKS, -1))]}

    def total(batches: Iterator[dict]) -> Iterator[dict]:
        yield from _summed(batches, "counts", np.int64)

    held = bucket_numbers(docs, text) if numbers is None else numbers
    parts = map_batches(held, count, "block int, counts binary").repartition(BLOCKS, "block")
    seen, n = np.zeros((BLOCKS, BUCKETS // BLOCKS)), 0
    for row in map_batches(parts, total, "block int, counts binary").collect():  # BLOCKS + 1 rows of fixed size
        if row.block < 0:
            n = int(np.frombuffer(row.counts, np.int64)[0])
        else:
            seen[row.block] = np.frombuffer(row.counts, np.int64)
    if numbers is None:
        forget(held)
    return np.log((n + 1) / (seen.ravel() + 1)).clip(0.1) if n else np.ones(BUCKETS)


def _summed(batches: Iterator[dict], column: str, kind) -> Iterator[dict]:
    """Adds up the arrays of each block; a task holds its blocks' sums only."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, x in zip(b["block"].to_pylist(), b[column]):
            part = np.frombuffer(x.as_buffer(), kind)
            sums[block] = sums[block] + part if block in sums else part
    yield {"block": list(sums), column: [x.tobytes() for x in sums.values()]}


def _parts(rows: list, size) -> Iterator[list]:
    """The rows in order, in lists of at most TOGETHER words; a row may be larger."""
    part, held = [], 0
    for row in rows:
        if part and held + size(row) > TOGETHER:
            yield part
            part, held = [], 0
        part.append(row)
        held += size(row)
    if part:
        yield part


def add_rows(out: np.ndarray, keys: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values[rows[i]] to out[keys[i]] for every i, up to ROUNDS rows of each key at a time."""
    while len(keys):
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        run = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(run, len(keys)))
        first = np.flatnonzero((np.arange(len(keys)) - np.repeat(run, size)) % ROUNDS == 0)
        piece = np.diff(np.append(first, len(keys)))
        order = np.argsort(-piece, kind="stable")
        first, piece = first[order], piece[order]
        sums = np.take(values, rows[first], axis=0)
        for k in range(1, int(piece[0])):
            n = np.searchsorted(-piece, -k)  # the pieces of more than k rows
            sums[:n] += np.take(values, rows[first[:n] + k], axis=0)
        whole = np.repeat(size <= ROUNDS, size)[first]
        out[keys[first[whole]]] += sums[whole]
        rows = np.flatnonzero(~whole)
        keys, values = keys[first[rows]], sums


def latent_space(docs: DataFrame, idf: np.ndarray, text: str = "text", numbers: DataFrame | None = None) -> Space:
    """The space fitted to the passages of all texts; numbers: bucket_numbers() of docs, where they are there already."""
    spark = docs.sparkSession
    stored_numbers = bucket_numbers(docs, text) if numbers is None else numbers

    held = to_tasks(spark, Space(idf, np.random.default_rng(23).standard_normal((BUCKETS, RANK))))

    def sketch(batches: Iterator[dict]) -> Iterator[dict]:
        space, out, any_ = in_task(held), np.zeros((BUCKETS, RANK), np.float32), False
        for texts in _numbers_of(batches):
            any_ = True
            words = _laid_out(texts)
            y = np.zeros((words.shape[1], RANK + 1), np.float32)
            for ids in words:
                y += np.take(space.padded, ids, axis=0)
            y = y[:, :-1] / np.maximum(y[:, -1:], 1e-9)
            at = np.flatnonzero(words.ravel() != BUCKETS)
            add_rows(out, words.ravel()[at], at % words.shape[1], y)
        out *= np.sqrt(space.squares)[:, None]
        if any_:
            yield {"block": list(range(BLOCKS)), "rows": [x.tobytes() for x in out.reshape(BLOCKS, -1)]}

    def total(batches: Iterator[dict]) -> Iterator[dict]:
        yield from _summed(batches, "rows", np.float32)

    parts = map_batches(stored_numbers, sketch, "block int, rows binary").repartition(BLOCKS, "block")
    whole = np.zeros((BLOCKS, BUCKETS * RANK // BLOCKS), np.float32)
    for row in map_batches(parts, total, "block int, rows binary").collect():  # BLOCKS rows of fixed size
        whole[row.block] = np.frombuffer(row.rows, np.float32)
    basis = np.linalg.qr(whole.reshape(BUCKETS, RANK).astype(float))[0]
    plain = to_tasks(spark, Space(idf, basis))

    def moments(batches: Iterator[dict]) -> Iterator[dict]:
        space, n, sums, squares = in_task(plain), 0, np.zeros(RANK), np.zeros((RANK, RANK))
        for texts in _numbers_of(batches):
            x = space.passages([t.astype(np.uint64) for t in texts])[2]
            n, sums, squares = n + len(x), sums + x.sum(axis=0), squares + x.T @ x
        if n:
            yield {"block": [0], "rows": [np.concatenate([[n], sums, squares.ravel()]).tobytes()]}

    def added(batches: Iterator[dict]) -> Iterator[dict]:
        yield from _summed(batches, "rows", float)

    got = map_batches(map_batches(stored_numbers, moments, "block int, rows binary").repartition(1), added, "block int, rows binary").collect()  # one row of fixed size
    if numbers is None:
        forget(stored_numbers)
    if not got:
        return Space(idf, basis)
    n, sums, squares = np.split(np.frombuffer(got[0].rows, float), [1, 1 + RANK])
    return Space(idf, basis, *_shrunk(n[0], sums, squares.reshape(RANK, RANK)))


def _shrunk(n: float, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, scaling) that make the covariance of n vectors the unit, drawn towards no mean and equal variances as if by SHRINKAGE more vectors."""
    mean = sums / n
    covariance = squares / n - np.outer(mean, mean)
    part = n / (n + SHRINKAGE)
    even = np.eye(len(mean)) * np.trace(covariance) / len(mean)
    size, directions = np.linalg.eigh(part * covariance + (1 - part) * even)
    return part * mean, directions / np.sqrt(np.maximum(size, 1e-6 * max(size.max(), 1e-12)))


def answer_of(text: str) -> np.ndarray:
    """The words after an item's last question mark, where they are fewer than those before it; more of them are prose."""
    head, mark, tail = text.rpartition("?")
    question, words = words_of(head), words_of(tail if mark else None)
    return words if len(words) < len(question) else words[:0]


def places_of(words: np.ndarray) -> dict[int, int]:
    """For each word the bits of the places where it stands."""
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_length(places: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence of n words, given by places_of(), and others: one row of the table as the bits of a number."""
    whole = (1 << n) - 1
    row = whole
    for w in other:
        if bits := places.get(w):
            met = row & bits
            row = ((row + met) | (row - met)) & whole
    return n - row.bit_count()


def runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    last = len(words) - n + 1
    h = words[: max(last, 0)]
    for k in range(1, n):
        h = mixed(h) ^ words[k : last + k]
    return h


class Items:
    """A block of benchmark passages, short ones apart: words, answers, ids, latent vectors and bitmaps."""

    def __init__(self, rows: list[tuple], space: Space, across: int):
        self.across, self.ids, self.words, self.answers, self.asked = across, [], [], [], []
        for item, text in sorted(rows):
            ids, answer = words_of(text), answer_of(text)
            last = max(len(ids) - WINDOW, 0)
            for at in [] if len(ids) < LEAST or (len(ids) <= SHORT) != (across * STRIDE < WINDOW) else sorted({*range(0, last, WINDOW // 2), last}):
                self.ids.append(item)
                self.words.append(ids[at : at + WINDOW])
                self.answers.append(answer)
                # the words of the passage that belong to the question
                asked = min(len(self.words[-1]), len(ids) - len(answer) - at)
                self.asked.append(asked if len(answer) and asked >= LEAST else 0)
        self._places: dict[int, tuple] = {}
        if self.words:
            # an item's words are one passage, whatever their number
            self.vectors = space.unit(space.passages(self.words, WINDOW // STRIDE)[2])
            self.bits = np.array([np.bitwise_or.reduce(_ONE_BIT[bits_of(w)], axis=0) for w in self.words])
            # a word of the item that the passage lacks shortens the common subsequence by one at least
            enough = [min(COMMON * len(w), COPY * n) if n else COMMON * len(w) for w, n in zip(self.words, self.asked)]
            self.missing = np.array([len(w) - max(LEAST, e) for w, e in zip(self.words, enough)])

    def places(self, k: int) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
        """Places of the words of a passage, of its answer and of its question, made when they are first asked for."""
        if k not in self._places:
            self._places[k] = places_of(self.words[k]), places_of(self.answers[k]), places_of(self.words[k][: self.asked[k]])
        return self._places[k]

    def share(self, k: int, words: list[int]) -> float:
        """The share of the passage's words that others hold in order, or that of its question's if it is copied; 0 below COMMON."""
        mine, _, question = self.places(k)
        n, asked = len(self.words[k]), self.asked[k]
        length = common_length(mine, n, words)
        share = length / n if length >= max(LEAST, COMMON * n) else 0.0
        if asked and share < COPY and (copied := common_length(question, asked, words)) >= max(LEAST, COPY * asked):
            share = copied / asked
        return share


class Search:
    """Matches of texts with a block of items."""

    def __init__(self, rows: list[tuple], space: Space):
        self.space = space
        self.groups = [g for across in (WINDOW // STRIDE, SHORT_WINDOW // STRIDE) if (g := Items(rows, space, across)).ids]
        short: dict[int, dict[int, list]] = {}
        for item, text in sorted(rows):
            if 0 < len(words := words_of(text)) < LEAST:
                short.setdefault(len(words), {}).setdefault(int(runs_of(words, len(words))[0]), []).append(item)
        #: By number of words: sorted hashes of short items, and the items of each.
        self.short = {n: (np.array(sorted(found), np.uint64), [found[h] for h in sorted(found)]) for n, found in short.items()}

    def __call__(self, texts: pa.Array) -> list[tuple]:
        """(place in texts, item, first word, end word, share, answered) of the best passage for each item that a text holds: one with the answer, if any."""
        every = word_slices(texts, ALNUM)
        best: dict[tuple, tuple] = {}
        for n, (known, items) in self.short.items():
            for i, words in enumerate(every):
                runs = runs_of(words, n)
                at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
                for start in np.flatnonzero(known[at] == runs)[::-1]:  # the first place comes last
                    best |= {(i, item): (True, 1.0, -int(start), int(start) + n) for item in items[at[start]]}
        held = [(i, words) for i, words in enumerate(every) if len(words) >= LEAST]
        if self.groups:
            for part in _parts(held, lambda row: len(row[1])):
                self._near(part, best)
        return [(i, item, -low, high, share, answered) for (i, item), (answered, share, low, high) in sorted(best.items())]

    def _near(self, held: list[tuple[int, np.ndarray]], best: dict[tuple, tuple]) -> None:
        strides = Strides(self.space, [ids for _, ids in held])
        words, margin = strides.words(), WINDOW // 2 // STRIDE
        for items in self.groups:
            text, place, x = strides.passages(items.across)
            x, absent = self.space.unit(x), ~strides.bitmaps(words, items.across, margin)
            block = max(1, CELLS // len(items.vectors))
            for at in range(0, len(x), block):
                # places in the product by row: far cheaper to find than pairs of places
                rows, ks = np.divmod(np.flatnonzero((x[at : at + block] @ items.vectors.T >= NEAR).ravel()), len(items.vectors))
                lacks = set_bits(np.take(items.bits, ks, axis=0) & np.take(absent, at + rows, axis=0))
                open_ = np.flatnonzero(lacks <= items.missing[ks])
                for row, k in zip(rows[open_], ks[open_]):
                    i, ids = held[text[at + row]]
                    start = int(place[at + row])
                    # the item may begin before or end behind the passage
                    low, high = max(0, start - margin * STRIDE), min(len(ids), start + (items.across + margin) * STRIDE)
                    share = items.share(k, ids[low:high].tolist())
                    if share:
                        size = len(items.answers[k])
                        behind = ids[low : high + size].tolist()
                        answered = not size or common_length(items.places(k)[1], size, behind) >= (size if size <= ANSWER else COMMON * size)
                        key, found = (i, items.ids[k]), (answered, share, -low, high)
                        if key not in best or found > best[key]:
                            best[key] = found


def _searches(docs: DataFrame, benchmark: DataFrame) -> list:
    """What Search() needs in each task, for one block of items after the other; none without items."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    sizes = items.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    if not sizes[0]:
        return []
    blocks = max(1, -(-max(sizes[0], (sizes[1] or 0) // (5 * STRIDE)) // MOST_ITEMS))
    numbers = bucket_numbers(docs)
    space = latent_space(docs, document_frequencies(docs, numbers=numbers), numbers=numbers)
    forget(numbers)
    # about MOST_ITEMS passages by hash, so each block has a bounded size
    parts = (items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect() for block in range(blocks))
    return [to_tasks(docs.sparkSession, ([tuple(r) for r in rows], space)) for rows in parts]


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, end_word, share, answered): documents that hold a benchmark item or a paraphrase of it."""
    docs = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, first_word bigint, end_word bigint, share double, answered boolean"
    found = docs.sparkSession.createDataFrame([], kinds)
    for held in _searches(docs, benchmark):

        def run(batches: Iterator[dict], held=held) -> Iterator[dict]:
            search = Search(*in_task(held))
            for b in batches:
                if out := search(b["text"]):
                    at, *columns = map(list, zip(*out))
                    yield {"doc_id": b["doc_id"].take(pa.array(at, pa.int64()))} | dict(zip(("item_id", "first_word", "end_word", "share", "answered"), columns))

        found = found.union(map_batches(docs, run, kinds))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; each row is judged by its own text, in one pass."""
    for held in _searches(docs.select("doc_id", F.col(text).cast("string").alias("text")), benchmark):

        def run(batches: Iterator[dict], held=held) -> Iterator[dict]:
            search = Search(*in_task(held))
            for b in batches:
                leaks = {i for i, _, _, _, share, answered in search(b[text]) if answered or share >= COPY}
                keep = pa.array([i not in leaks for i in range(len(b[text]))], pa.bool_())
                yield {c: x.filter(keep) for c, x in b.items()}

        docs = map_batches(docs, run, docs.schema)
    return docs


def leaked(found: DataFrame) -> DataFrame:
    """The matches that count as leaks: copies, and those whose passage also holds the answer, where the item has one."""
    return found.where(F.col("answered") | (F.col("share") >= COPY))


VERDICT = ("contaminated", "n_items", "share", "first_item")


def verdicts(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, *VERDICT) for each row: whether it holds an item, how many, the largest share of one, and the smallest id of one."""
    item = benchmark.schema["item_id"].dataType
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    searches = _searches(rows, benchmark)
    rows = rows.withColumns({"n_items": F.lit(0).cast("long"), "share": F.lit(None).cast("double"), "first_item": F.lit(None).cast(item)})
    for held in searches:

        def run(batches: Iterator[dict], held=held) -> Iterator[dict]:
            search = Search(*in_task(held))
            for b in batches:
                n, share, first = (b[c].to_pylist() for c in ("n_items", "share", "first_item"))
                for i, item, _, _, found, answered in search(b["text"]):
                    if answered or found >= COPY:
                        n[i] += 1
                        share[i] = found if share[i] is None else max(share[i], found)
                        first[i] = item if first[i] is None else min(first[i], item)
                yield {"doc_id": b["doc_id"], "text": b["text"], "n_items": n, "share": share, "first_item": first}

        rows = map_batches(rows, run, rows.schema)
    return rows.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "share", "first_item")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontamination": op9_decontamination}
#: Latent retrieval has no SQL form; a test compares the query with a search of every passage.
ORACLES: dict[str, str] = {}
