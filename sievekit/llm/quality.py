"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network.

A token is a run of letters, of digits or of other signs. Two marks count as
tokens too: one behind each word in capitals, and one behind each token that
closes a run of three that the text had before. Each of BUCKETS hash buckets of
tokens has a fixed sparse index vector, and its word vector is the sum of the
index vectors of the tokens within REACH places of it, over the whole corpus. A
document is the mean of its tokens' normalised word vectors and nothing else. A
network with one hidden layer, fitted in numpy to at most
about ROWS_A_CLASS labelled rows of each class, gives a logit, and a temperature
fitted to rows that the network hasn't seen turns it into a probability.

The table of word vectors has BUCKETS * DIMENSIONS numbers at any size of the
corpus, so it can go to every task.

Edge cases: a null text counts as empty; an empty text has the zero vector and
gets the network's score for it; without labelled rows of both classes every
score is the share of label 1, or 0.5 without any; repeated rows get equal
scores; an empty table gives an empty result; no column but doc_id and the text
is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_task, map_batches, read, to_tasks
from .labelled import fold, sample, sigmoid

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 14, 48, 4, 2
BLOCKS = 64
ROWS_A_CLASS = 4000
HIDDEN, EPOCHS, RATE = 32, 60, 3e-3
#: Shares of the sampled rows for stopping the fit and for the temperature.
STOP_PART, CURVE_PART = 0.15, 0.15
THRESHOLD = 0.3
#: The marks' places behind the buckets.
CAPITALS, AGAIN = BUCKETS, BUCKETS + 1
ROWS = BUCKETS + 2

_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of the index vector of each bucket and mark."""
    draw = np.random.default_rng(7)
    places = np.argsort(draw.random((ROWS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), draw.choice([-1.0, 1.0], (ROWS, NONZERO))


class Tokens(dict):
    """Buckets of tokens, less BUCKETS for those in capitals, remembered for up to `most` of them."""

    most = 300_000

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token) % BUCKETS - BUCKETS * (len(token) > 1 and token.isupper())
        return value

    def of(self, text: str | None) -> np.ndarray:
        """The rows of a text's tokens and marks in the table of word vectors."""
        tokens = tokens_of(text)
        n = len(tokens)
        out = np.full((n, 3), -1, np.int64)
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, n)
        out[ids < 0, 1] = CAPITALS
        out[:, 0] = ids % BUCKETS
        if n > 3:
            triples = (out[:-2, 0] * BUCKETS + out[1:-1, 0]) * BUCKETS + out[2:, 0]
            order = np.argsort(triples, kind="stable")
            out[order[1:][triples[order[1:]] == triples[order[:-1]]] + 2, 2] = AGAIN
        out = out.ravel()
        return out[out >= 0]


def tokens_of(text: str | None) -> list[bytes]:
    return _TOKEN.findall(text.encode("utf-8", "surrogatepass")) if text else []


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of word vectors over all texts.

    Each task adds up a table of its own; the tables are added in BLOCKS pieces,
    each by a task that holds one piece.
    """

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        known, (places, signs) = Tokens(), index_vectors()
        # one more row stands between texts, so that these aren't neighbours
        places, signs = np.vstack([places, places[:1]]), np.vstack([signs, 0 * signs[:1]])
        between = np.full(REACH, ROWS)
        table, held, size = np.zeros((ROWS + 1) * DIMENSIONS), [], 0

        def add() -> None:
            ids = np.concatenate(held)
            for step in range(1, REACH + 1):
                for word, other in ((ids[step:], ids[:-step]), (ids[:-step], ids[step:])):
                    for k in range(NONZERO):
                        table[:] += np.bincount(word * DIMENSIONS + places[other, k], signs[other, k], len(table))

        for b in batches:
            for t in b[text]:
                if len(ids := known.of(t.as_py())):
                    held += [ids, between]
                    size += len(ids)
            if size > 2_000_000:
                add()
                held, size = [], 0
        if held:
            add()
        if table.any():
            parts = np.array_split(table[: ROWS * DIMENSIONS].astype(np.float32), BLOCKS)
            yield {"block": list(range(BLOCKS)), "vectors": [p.tobytes() for p in parts]}

    def total(batches: Iterator[dict]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, vectors in zip(b["block"].to_pylist(), b["vectors"]):
                part = np.frombuffer(vectors.as_buffer(), np.float32).astype(float)
                sums[block] = sums[block] + part if block in sums else part
        yield {"block": list(sums), "vectors": [x.astype(np.float32).tobytes() for x in sums.values()]}

    parts = map_batches(docs.select(text), count, "block int, vectors binary").repartition(BLOCKS, "block")
    got = {r.block: np.frombuffer(r.vectors, np.float32) for r in map_batches(parts, total, "block int, vectors binary").collect()}  # BLOCKS rows of fixed size
    table = np.concatenate([got[k] for k in range(BLOCKS)]) if got else np.zeros(ROWS * DIMENSIONS, np.float32)
    table = table.reshape(ROWS, DIMENSIONS)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


class Pooling:
    """Documents as mean word vectors."""

    def __init__(self, table: np.ndarray):
        self.table, self.known = table, Tokens()

    def __call__(self, text: str | None) -> np.ndarray:
        ids = self.known.of(text)
        if not len(ids):
            return np.zeros(DIMENSIONS, np.float32)
        if len(ids) > BUCKETS // 4:
            return np.bincount(ids, minlength=ROWS).astype(np.float32) @ self.table / len(ids)
        return self.table[ids].mean(axis=0)


class Network:
    """Logit of label 1: one hidden layer of rectified units over standardised inputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, stop: np.ndarray):
        draw = np.random.default_rng(11)
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        x = (x - self.mean) / self.scale
        shapes = ((x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), ())
        self.w = [draw.normal(0, (2 / max(s[0], 1)) ** 0.5, s) if len(s) == 2 else (draw.normal(0, 0.2, s) if i == 2 else np.zeros(s)) for i, s in enumerate(shapes)]
        first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        fit = np.flatnonzero(~stop)
        best, kept, step = np.inf, [w.copy() for w in self.w], 0
        for _ in range(EPOCHS):
            for at in np.array_split(draw.permutation(fit), max(1, len(fit) // 64)):
                step += 1
                hidden = np.maximum(x[at] @ self.w[0] + self.w[1], 0)
                error = weight[at] * (sigmoid(hidden @ self.w[2] + self.w[3]) - y[at]) / weight[at].sum()
                back = np.outer(error, self.w[2]) * (hidden > 0)
                for i, g in enumerate((x[at].T @ back + 1e-4 * self.w[0], back.sum(axis=0), hidden.T @ error, error.sum())):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g**2
                    self.w[i] = self.w[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            held = stop if stop.any() else ~stop
            loss = cross_entropy(self._logit(x[held]), y[held], weight[held])
            if loss < best:
                best, kept = loss, [w.copy() for w in self.w]
        self.w = kept

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._logit((x - self.mean) / self.scale)


def cross_entropy(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / weight.sum())


def temperature(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits with the least loss."""
    if len(set(y.tolist())) < 2:
        return 1.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 200))
    return float(grid[np.argmin([cross_entropy(logit / t, y, weight) for t in grid])])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", training=None, text: str = "text"):
    """(word vectors, network, temperature), or the constant score without labelled rows of both classes."""
    rows, stand_for = sample(labels, label, training if training is not None else F.lit(True), ROWS_A_CLASS)
    if set(stand_for) != {0, 1}:
        return float(next(iter(stand_for), 0.5))
    table = word_vectors(docs, text)
    # bounded by the sample, so it can go to every task
    mine = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(rows), "doc_id")
    held = to_tasks(docs.sparkSession, table)

    def pool(batches: Iterator[dict]) -> Iterator[dict]:
        pooled = Pooling(in_task(held))
        for b in batches:
            yield {"y": b["y"], "part": b["part"], "x": [pooled(t.as_py()).tobytes() for t in b["text"]]}

    got = map_batches(mine.select("y", "part", "text"), pool, "y int, part double, x binary").toArrow()
    y, part = got.column("y").to_numpy().astype(float), got.column("part").to_numpy()
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(y), -1).astype(float)
    order = np.lexsort((*x.T[:2], part))  # tasks end in any order
    x, y, part = x[order], y[order], part[order]
    weight = np.where(y == 1, stand_for[1], stand_for[0])
    curve = part < CURVE_PART
    network = Network(x[~curve], y[~curve], weight[~curve], part[~curve] < CURVE_PART + STOP_PART)
    return table, network, temperature(network(x[curve]), y[curve], weight[curve])


def score(docs: DataFrame, fitted, text: str = "text") -> DataFrame:
    """(doc_id, score) of each text."""
    if isinstance(fitted, float):
        return docs.select("doc_id", F.lit(fitted).alias("score"))
    held = to_tasks(docs.sparkSession, fitted)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        table, network, heat = in_task(held)
        pooled = Pooling(table)
        for b in batches:
            x = np.array([pooled(t.as_py()) for t in b[text]], float).reshape(-1, DIMENSIONS)
            yield {"doc_id": b["doc_id"], "score": pa.array(sigmoid(network(x) / heat))}

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", text), run, f"doc_id {kind}, score double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    held_out = fold(F.col("doc_id"), 5) == 0
    fitted = fit(docs, read(spark, sf_dir, "labels"), "quality", ~held_out)
    return score(docs, fitted).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLES: dict[str, str] = {}
