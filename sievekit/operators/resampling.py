"""Bootstrap by hashed draws: the same at every run, on every engine.

replicates(): a row's number in a replicate is Poisson(1), read off the digits of a hash of the
replicate and the row's key, so every row draws for itself: there are no ranks, no
joins and no repeated rows, and cells are summed inside each task before the
shuffle. Rows of one key (a cluster) are drawn together. Class sizes vary between
replicates as they do for independent rows; rates inside a class don't depend on
that, and a replicate without rows of a class has no rate for it.

multinomial_cells(): draws that keep the size of each class, by binomial splits over
its cells. auroc_replicates(): AUROC of every replicate in one pass over the scores.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.sources.shared import stored

# Functions go to the executors by value, so that these don't need the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Draws that one hash of 64 hex digits makes.
DRAWS = 4


def poisson_limits() -> list[str]:
    """16 hex digits for each k: hashes from these on mean more than k rows; beyond the last, the chance is below 1e-9."""
    total, term, limits = 0.0, math.exp(-1), []
    for k in range(12):
        total += term
        limits.append(f"{min(int(total * 2**64), 2**64 - 1):016x}")
        term /= k + 1
    return limits


def replicates(df: DataFrame, key: Column, cells: list[str], reps: int) -> DataFrame:
    """(rep, *cells, n): how many rows of each cell the replicates draw, from 1 on."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-reps // DRAWS) - 1)))
    hashed = df.select(*cells, key.cast("string").alias("__key")).withColumn("__block", blocks).withColumn("__h", F.sha2(F.concat_ws(":", F.col("__block").cast("string"), "__key"), 256))
    digits = lambda i: F.substring("__h", 16 * i + 1, 16)
    weight = lambda i: sum(((digits(i) >= limit).cast("int") for limit in poisson_limits()), F.lit(0))
    sums = hashed.groupBy("__block", *cells).agg(*[F.sum(weight(i)).alias(f"__w{i}") for i in range(DRAWS)])
    each = F.explode(F.array(*[F.struct((F.col("__block") * DRAWS + i).alias("rep"), F.col(f"__w{i}").alias("n")) for i in range(DRAWS)])).alias("__e")
    return sums.select(*cells, each).select("__e.rep", *cells, "__e.n").where((F.col("rep") < reps) & (F.col("n") > 0))


def ranked(df: DataFrame, stratum: str, order: str) -> DataFrame:
    """Adds __i, from 0 inside each stratum, and its size __n; ranks are taken in 4096 ranges of a hash of the order key."""
    rows = df.withColumn("__h", F.sha2(F.col(order).cast("string"), 256)).withColumn("__b", F.substring("__h", 1, 3))
    sizes = rows.groupBy(F.col(stratum).alias("__s"), F.col("__b").alias("__sb")).agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy("__s")
    before = F.coalesce(F.sum("__c").over(whole.orderBy("__sb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__s", "__sb", before.alias("__before"), F.sum("__c").over(whole).alias("__n"))
    rank = F.row_number().over(Window.partitionBy(stratum, "__b").orderBy("__h", order)) - 1
    ranked = rows.withColumn("__r", rank).join(sizes, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__sb")))
    return ranked.withColumn("__i", (F.col("__before") + F.col("__r")).cast("long")).drop("__h", "__b", "__r", "__s", "__sb", "__before")


def stratified_bootstrap(df: DataFrame, stratum: str, order: str, reps: int) -> DataFrame:
    """Adds `rep`, from 0: each replicate draws exactly as many rows from each stratum as it has, with replacement.

    The result has reps times the rows of df; where sums over cells suffice,
    replicates() needs neither ranks nor joins.
    """
    places = ranked(df, stratum, order)
    slots = places.select(stratum, F.col("__i").alias("__slot"), "__n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    digits = F.substring(F.sha2(F.concat_ws(":", F.col("rep").cast("string"), F.col(stratum).cast("string"), F.col("__slot").cast("string")), 256), 1, 15)
    draws = slots.select(stratum, "rep", (F.conv(digits, 16, 10).cast("bigint") % F.col("__n")).alias("__i"))
    return draws.join(places.drop("__n"), [stratum, "__i"]).drop("__i")


def cluster_bootstrap(df: DataFrame, stratum: str, group: str, reps: int) -> DataFrame:
    """Adds `rep`: each replicate draws groups of each stratum with replacement, and all members follow."""
    groups = df.select(stratum, group).distinct()
    return stratified_bootstrap(groups, stratum, group, reps).join(df, [stratum, group])


def share(hit: Column, n: str = "n") -> Column:
    """The weighted share of rows for which hit holds."""
    return F.sum(F.when(hit, F.col(n)).otherwise(0)) / F.sum(n)


def interval(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, 2.5 % and 97.5 % points (linear) and number of valid replicates."""
    return df.groupBy(*(by or [])).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.percentile(value, F.lit(0.025)).alias("low"),
        F.percentile(value, F.lit(0.975)).alias("high"),
        F.count(value).alias("n_reps"),
    )


def binomial_quantile(n: int, p: float, u: np.ndarray) -> np.ndarray:
    """For each u in [0, 1), the smallest k whose binomial distribution function exceeds u.

    Probabilities are summed over some 25 standard deviations around the mean
    only; what lies outside is below the precision of u.
    """
    if n == 0 or p <= 0 or p >= 1:
        return np.full(len(u), n if p >= 1 else 0, np.int64)
    spread = 13 * math.sqrt(n * p * (1 - p)) + 40
    low, high = max(0, int(n * p - spread)), min(n, int(n * p + spread))
    k = np.arange(low, high + 1)
    start = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) + low * math.log(p) + (n - low) * math.log1p(-p)
    steps = np.log((n - k[:-1]) / (k[:-1] + 1)) + math.log(p) - math.log1p(-p)
    total = np.cumsum(np.exp(start + np.concatenate([[0.0], np.cumsum(steps)])))
    return np.minimum(low + np.searchsorted(total, u, side="right"), high)


def multinomial_cells(df: DataFrame, stratum: str, cells: list[str], reps: int, size: str | None = None) -> DataFrame:
    """(rep, stratum, *cells, n): each replicate draws exactly as many units from each stratum as it has, with replacement.

    A cell is what units of a stratum have in common, such as whether they were
    hit; units are rows, or as many as the column `size` says. How many draws
    fall into a cell depends on sizes alone, so nothing is drawn for each unit:
    the cells of a stratum are the leaves of a binary tree, and each node splits
    its draws between its halves by one binomial variable, read off a hash. The
    work is that of replicates times cells, whatever the number of units. Cells
    of a stratum are placed in one task, so they must be few next to the rows;
    cells of continuous scores have their own way, auroc_replicates().
    """
    one = F.col(size) if size else F.lit(1)
    leaves = df.groupBy(stratum, *cells).agg(F.sum(one).cast("long").alias("__size"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(*cells)) - 1
    leaves = stored(leaves.withColumn("__place", place.cast("long")), "bootstrap-cells")
    levels = max(int(leaves.agg(F.max("__place")).first()[0] or 0), 0).bit_length()
    draws = leaves.groupBy(stratum).agg(F.sum("__size").alias("n")).withColumn("__node", F.lit(0).cast("long")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    for level in range(levels):
        # each node with the size of its left half
        below = leaves.withColumn("__below", F.shiftrightunsigned("__place", levels - level - 1))
        nodes = below.groupBy(F.col(stratum).alias("__s"), F.shiftrightunsigned("__below", 1).alias("__n")).agg(F.sum("__size").alias("__all"), F.sum(F.when(F.col("__below") % 2 == 0, F.col("__size")).otherwise(0)).alias("__left"))
        here = draws.join(nodes, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__node") == F.col("__n")))
        name = F.concat_ws(":", F.col("rep").cast("string"), F.coalesce(F.col(stratum).cast("string"), F.lit("")), F.lit(str(levels - level)), F.col("__node").cast("string"))
        u = F.conv(F.substring(F.sha2(name, 256), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
        split = here.withColumn("__k", F.pandas_udf(_binomials, "long")(F.col("n"), F.col("__left") / F.col("__all"), u))
        halves = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("__k").alias("n")), F.struct(F.lit(1).alias("side"), (F.col("n") - F.col("__k")).alias("n"))))
        draws = split.select(stratum, "rep", "__node", halves.alias("__h")).select(stratum, "rep", (F.col("__node") * 2 + F.col("__h.side")).alias("__node"), F.col("__h.n").alias("n")).where("n > 0")
    leaf = leaves.select(F.col(stratum).alias("__s"), F.col("__place").alias("__n"), *cells)
    return draws.join(leaf, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__node") == F.col("__n"))).select("rep", stratum, *cells, "n")


def _binomials(n: pd.Series, p: pd.Series, u: pd.Series) -> pd.Series:
    rows = pd.DataFrame({"n": n.to_numpy(), "p": p.to_numpy(), "u": u.to_numpy()})
    out = np.zeros(len(rows), np.int64)
    for (size, chance), at in rows.groupby(["n", "p"]).indices.items():  # each node's distribution once
        out[at] = binomial_quantile(int(size), float(chance), rows["u"].to_numpy()[at])
    return pd.Series(out)


#: Rows of a range of scores in the mean, replicates that are carried together, and replicates of a row of the merge.
RANGE_ROWS, TOGETHER, CHUNK = 1 << 14, 200, 50


def poisson_weights(keys: list[str], first: int, reps: int) -> np.ndarray:
    """Rows of the keys, columns of the replicates first .. first + reps - 1: the weights that replicates() draws. `first` and `reps` are multiples of DRAWS."""
    limits = np.array([int(x, 16) for x in poisson_limits()], np.uint64)
    blocks = range(first // DRAWS, (first + reps) // DRAWS)
    digests = b"".join(hashlib.sha256(f"{b}:{k}".encode()).digest() for k in keys for b in blocks)
    drawn = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(len(keys), reps)
    return np.searchsorted(limits, drawn, side="right")


class _Pass:
    """Sums over scores in descending order, for all replicates at once: positives, negatives, and pairs of a positive above a negative, ties half."""

    def __init__(self, reps: int):
        self.reps = reps
        self.start()

    def start(self) -> None:
        self.score, self.top = None, None
        self.p, self.n, self.area = np.zeros(self.reps), np.zeros(self.reps), np.zeros(self.reps)
        self.tie_p, self.tie_n = np.zeros(self.reps), np.zeros(self.reps)

    def close(self) -> None:
        self.area += self.tie_n * (self.p + self.tie_p / 2)
        self.p += self.tie_p
        self.n += self.tie_n
        self.tie_p, self.tie_n, self.score = np.zeros(self.reps), np.zeros(self.reps), None

    def add(self, scores: np.ndarray, positive: np.ndarray, weights: list[np.ndarray]) -> None:
        """Rows in descending order of scores; weights: blocks of columns."""
        begins = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
        if self.score is not None and scores[0] != self.score:
            self.close()
        if self.top is None:
            self.top = scores[0]
        at = 0
        for block in weights:
            to = slice(at, at + block.shape[1])
            p = np.add.reduceat(block * positive[:, None], begins).astype(float)
            n = np.add.reduceat(block * ~positive[:, None], begins).astype(float)
            p[0] += self.tie_p[to]
            n[0] += self.tie_n[to]
            above = self.p[to] + np.cumsum(p, axis=0) - p
            self.area[to] += (n[:-1] * (above[:-1] + p[:-1] / 2)).sum(axis=0)
            self.p[to] += p[:-1].sum(axis=0)
            self.n[to] += n[:-1].sum(axis=0)
            self.tie_p[to], self.tie_n[to] = p[-1], n[-1]
            at = to.stop
        self.score = scores[-1]

    def rows(self) -> pd.DataFrame:
        self.close()
        cut = range(0, self.reps, CHUNK)
        return pd.DataFrame({"chunk": [c // CHUNK for c in cut], "top": self.top, **{k: [v[c : c + CHUNK] for c in cut] for k, v in (("p", self.p), ("n", self.n), ("area", self.area))}})


def auroc_replicates(df: DataFrame, key: str, truth: str, score: str, reps: int) -> DataFrame:
    """(rep, auroc): AUROC under the weights of replicates(), for scores of any kind; a replicate with one class has none.

    Rows are dealt to ranges of scores. A task goes once through a range in
    descending order and carries a vector of running sums, one entry for each
    replicate; the ranges' vectors are then merged in order. So there is no row
    for each score and replicate, and nothing but vectors leaves a task. A score
    that very many rows share is a range of its own, summed in several tasks.
    """
    whole = -(-reps // CHUNK) * CHUNK
    whole += -whole % DRAWS
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(truth) == 1, F.lit(False)).alias("positive"), F.col(score).cast("double").alias("score"))
    rows = stored(rows, "scores")
    n = rows.count()
    # at most n / RANGE_ROWS scores
    hot = sorted(r.score for r in rows.groupBy("score").count().where(F.col("count") > RANGE_ROWS).select("score").collect())
    bounds = np.array(hot)
    blocks = [(a, min(TOGETHER, whole - a)) for a in range(0, whole, TOGETHER)]
    schema = "chunk int, top double, p array<double>, n array<double>, area array<double>"

    def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, place = _Pass(whole), None
        for batch in batches:
            scores, positive, keys = batch["score"].to_numpy(), batch["positive"].to_numpy(bool), batch["key"].tolist()
            places = np.searchsorted(bounds, scores)  # rows between two hot scores
            for a, b in _stretches(places):
                if place is not None and places[a] != place:
                    yield now.rows()
                    now.start()
                place = places[a]
                for c in range(a, b, 1000):
                    d = min(b, c + 1000)
                    now.add(scores[c:d], positive[c:d], [poisson_weights(keys[c:d], first, size) for first, size in blocks])
        if place is not None:
            yield now.rows()

    def tied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[float, _Pass] = {}
        for batch in batches:
            for at, part in batch.groupby("score"):
                now = sums.setdefault(at, _Pass(whole))
                for c in range(0, len(part), 1000):
                    cut = part.iloc[c : c + 1000]
                    now.add(cut["score"].to_numpy(), cut["positive"].to_numpy(bool), [poisson_weights(cut["key"].tolist(), first, size) for first, size in blocks])
        for now in sums.values():
            yield now.rows()

    is_hot = F.col("score").isin(hot) if hot else F.lit(False)
    plain = rows.where(~is_hot).repartitionByRange(max(1, -(-n // RANGE_ROWS)), F.desc("score")).sortWithinPartitions(F.desc("score")).mapInPandas(ranged, schema)
    vectors = plain.withColumn("hot", F.lit(False))
    if hot:
        vectors = vectors.unionByName(rows.where(is_hot).mapInPandas(tied, schema).withColumn("hot", F.lit(True)))

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("top", ascending=False, kind="stable")
        p, n, area = (np.vstack(parts[c].tolist()) for c in ("p", "n", "area"))
        same = np.flatnonzero(np.r_[True, np.diff(parts["top"].to_numpy()) != 0])
        ties = parts["hot"].to_numpy()[same]
        p, n, area = (np.add.reduceat(x, same) for x in (p, n, area))
        area[ties] = p[ties] * n[ties] / 2
        total = (area + n * (np.cumsum(p, axis=0) - p)).sum(axis=0)
        pairs = p.sum(axis=0) * n.sum(axis=0)
        first = int(parts["chunk"].iloc[0]) * CHUNK
        out = pd.DataFrame({"rep": np.arange(first, first + len(pairs)), "auroc": np.divide(total, pairs, out=np.full(len(pairs), np.nan), where=pairs > 0)})
        return out[(out["rep"] < reps) & out["auroc"].notna()]

    return vectors.groupBy("chunk").applyInPandas(merged, "rep int, auroc double")


def _stretches(places: np.ndarray) -> list[tuple[int, int]]:
    begins = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]).tolist() if len(places) else []
    return list(zip(begins, [*begins[1:], len(places)]))
