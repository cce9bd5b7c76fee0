"""Pairs of signatures within a Hamming distance, through an index whose hot buckets are refined.

The bits of a signature are cut into distance + 1 blocks. Two signatures within
the distance agree on one whole block at least, so rows that share a block's
value meet in a bucket and no pair is lost. How long a key must be depends on
the table: a bucket with many rows on both sides is refined, which cuts the bits
that its key doesn't hold into distance + 1 blocks once more, one of which a
near pair of that bucket must share too. Small buckets stay whole. So a bucket's
join costs at most CAP rows for each of its members, whatever the table's size,
until keys hold DEPTH blocks, and rows are copied again only where it pays.

Only buckets with a probing row and another row are joined at all. A pair is
kept where its first common way through the blocks leads, so nothing has to be
made distinct. Steps are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.sources.shared import stored

#: Rows of the smaller side up to which a bucket is joined, and blocks that a key holds at most.
CAP, DEPTH = 256, 3


@dataclass(frozen=True)
class Ways:
    """For each depth, the bits of the last block of every way through the blocks, and those of its whole key."""

    blocks: tuple[tuple[int, ...], ...]
    keys: tuple[tuple[int, ...], ...]


@lru_cache(maxsize=8)
def ways(bits: int, distance: int, depth: int = DEPTH) -> Ways:
    """Way w at one depth leads to the ways w * (distance + 1) and following at the next."""
    parts = distance + 1
    level = [(list(range(bits)), 0)]
    blocks, keys = [], []
    for _ in range(depth):
        if len(level[0][0]) < 2 * parts:
            break
        after, cut = [], []
        for free, taken in level:
            for k in range(parts):
                own = free[len(free) * k // parts : len(free) * (k + 1) // parts]
                mask = sum(1 << b for b in own)
                cut.append(mask)
                after.append(([b for b in free if not mask >> b & 1], taken | mask))
        blocks.append(tuple(cut))
        keys.append(tuple(taken for _, taken in after))
        level = after
    return Ways(tuple(blocks), tuple(keys))


def _tables(masks: tuple[int, ...], words: list[str], width: int) -> list[Column]:
    """The masks' bits of each word, as array literals."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    of = lambda m, i: signed(m >> width * i & (1 << width) - 1)
    return [F.split(F.lit(",".join(str(of(m, i)) for m in masks)), ",").cast("array<long>") for i in range(len(words))]


def _key(words: list[str], tables: list[Column], way: Column) -> Column:
    return F.xxhash64(way, *[F.col(w).bitwiseAND(F.get(t, way)) for w, t in zip(words, tables)])


def _agree(words: list[str], tables: list[Column], way: Column) -> Column:
    differing = [F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}")).bitwiseAND(F.get(t, way)) for w, t in zip(words, tables)]
    both = differing[0]
    for d in differing[1:]:
        both = both.bitwiseOR(d)
    return both == 0


def _agreeing(words: list[str], tables: list[Column]) -> Callable[[Column], Column]:
    return lambda way: _agree(words, tables, way)


def _hamming(words: list[str]) -> Column:
    return sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words), F.lit(0))


def _first_way(words: list[str], width: int, how: Ways, depth: int, parts: int) -> Column:
    """Whether a pair's first common way through the blocks is this one: at no depth it agrees on an earlier block."""
    first = F.lit(True)
    for level in range(depth + 1):
        way = F.floor(F.col("way") / F.lit(parts ** (depth - level))).cast("int")
        begin = way - way % parts
        before = F.when(way > begin, F.sequence(begin, way - 1)).otherwise(F.array().cast("array<int>"))
        tables = _tables(how.blocks[level], words, width)
        first = first & _agree(words, tables, way) & ~F.exists(before, _agreeing(words, tables))
    return first


def joined(rows: DataFrame, words: list[str], bits: int, distance: int, probes: Column | None = None, width: int = 64) -> list[tuple[DataFrame, int]]:
    """For each depth, the pairs of rows that meet in a bucket (a: a probing row, b, way), and the depth."""
    how, parts = ways(bits, distance), distance + 1
    columns = rows.columns
    probing = F.lit(True) if probes is None else F.coalesce(probes, F.lit(False))
    base = rows.select(F.struct(*columns).alias("row"), probing.alias("probing"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("way"))
    members, found = base, []
    for depth in range(len(how.keys)):
        # copies are worked out from the stored rows twice, which costs less than to write them
        keyed = members.withColumn("key", _key([f"row.{w}" for w in words], _tables(how.keys[depth], words, width), F.col("way")))
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("probing").alias("n_probing")).where("n > 1 and n_probing > 0")
        last = depth + 1 == len(how.keys)
        hot = F.lit(False) if last else F.least("n", "n_probing") > CAP
        placed = stored(keyed.join(sizes.select("key", hot.alias("hot")), "key"), f"buckets-{depth}")
        cold = placed.where("not hot")
        left = cold.where("probing").select("key", "way", F.col("row").alias("a"))
        found.append((left.join(cold.select("key", F.col("row").alias("b"), F.col("probing").alias("b_probing")), "key").drop("key"), depth))
        if last or placed.where("hot").isEmpty():
            break
        deeper = F.explode(F.sequence(F.col("way") * parts, F.col("way") * parts + parts - 1))
        members = placed.where("hot").select("row", "probing", deeper.alias("way"))
    return found


def within(rows: DataFrame, keys: list[str], words: list[str], bits: int, distance: int, probes: Column | None = None, wanted: Column | None = None, width: int = 64) -> DataFrame:
    """(a, b, distance): all pairs of a probing row a and another row b within the distance, as structs of the rows' columns.

    words: bigint columns that hold the signature's bits, `width` in each, from
    the lowest on. Keys together must be unique. Two probing rows make one pair,
    in the order of their keys; without `probes` all rows probe. wanted: a
    condition over a and b. A null word keeps a row out of all pairs.
    """
    # stored first, so that the filter isn't pushed into whatever computes the signatures
    rows = stored(rows, "signatures").where(" and ".join(f"`{w}` is not null" for w in words))
    parts, how, out = distance + 1, ways(bits, distance), None
    ordered = F.struct(*[f"a.{k}" for k in keys]) < F.struct(*[f"b.{k}" for k in keys])
    for pairs, depth in joined(rows, words, bits, distance, probes, width):
        near = pairs.where(~F.col("b_probing") | ordered).withColumn("distance", _hamming(words)).where(F.col("distance") <= distance)
        near = near if wanted is None else near.where(wanted)
        near = near.where(_first_way(words, width, how, depth, parts)).select("a", "b", F.col("distance").cast("int"))
        out = near if out is None else out.unionByName(near)
    return out


def cross_split(rows: DataFrame, key: str, words: list[str], bits: int, distance: int = 6, split: str = "split", evaluation: tuple[str, ...] = ("val", "test", "unseen"), width: int = 64) -> DataFrame:
    """Near copies that lie in different splits, one of them an evaluation split.

    Rows of one signature in one split are a class, named by its smallest key, so
    that copies aren't expanded into all pairs. One row for each pair of classes:
    a (of an evaluation split) and b, their splits and sizes, the distance, and
    n_pairs, the pairs of rows that it stands for.
    """
    classes = rows.groupBy(*words, split).agg(F.min(key).alias("key"), F.count(F.lit(1)).alias("n"))
    found = within(classes, ["key", split], words, bits, distance, F.col(split).isin(*evaluation), F.col(f"a.{split}") != F.col(f"b.{split}"), width)
    sides = [F.col(f"{s}.{c}").alias(n) for s in "ab" for c, n in (("key", s), (split, f"split_{s}"), ("n", f"n_{s}"))]
    return found.select(*sides, "distance", (F.col("a.n") * F.col("b.n")).alias("n_pairs"))
