"""Connected components of an edge table, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, forget, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(dealt_anew(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(dealt_anew(least, "u"), "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and no edge leads to a node that has one."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("down")), F.struct(F.col("v").alias("node"), F.lit(None).cast("bigint").alias("down"))))
    each = edges.select(ends.alias("e")).groupBy("e.node").agg(F.min("e.down").alias("least"), F.max("e.down").alias("most"), F.max(F.col("e.down").isNull()).alias("below"))
    return each.where("least <> most or (least is not null and below)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge that isn't its component's smallest node.

    edges: bigint columns u and v; self-loops, repeats and either direction are
    allowed. Every round is written to the shared folder, so that a lost
    executor costs one round at most. A star's edges go through grouped minima,
    which combine before the shuffle, and through joins that shuffle both sides,
    so that adaptive execution can split a hot centre. Rounds grow with the
    logarithm of the largest component. No edges give no rows. The result reads
    a stored table, which its `stored_at` names for forget().
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not _settled(now):
        after = stored(_small_star(_large_star(now)), "edges")
        forget(now)
        now = after
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found.stored_at = now.stored_at
    return found
