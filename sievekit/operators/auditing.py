"""Duplicate, leakage and coupling audits, checked unions and lineage joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.sources.shared import stored

from . import nearness


def keep_first(df: DataFrame, content: Column, order: str) -> DataFrame:
    """(content, first, n): the first row of each content by an explicit order, and how many rows have it."""
    return df.groupBy(content.alias("content")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))


def spanning(df: DataFrame, content: Column, split: str = "split") -> DataFrame:
    """Contents that occur in several splits."""
    return df.groupBy(content.alias("content")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def banded_pairs(df: DataFrame, key: str, signature: str, bits: int, distance: int) -> DataFrame:
    """(a, b, distance) of all classes of equal signatures within a Hamming distance, a < b being their smallest keys.

    Rows of equal signature are one class, so blank or copied content adds no pairs.
    """
    classes = df.groupBy(F.col(signature).alias("sig")).agg(F.min(key).alias("key"))
    return nearness.within(classes, ["key"], ["sig"], bits, distance).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), "distance")


def nearest_pairs(pairs: DataFrame, most: int = 200) -> DataFrame:
    """The closest pairs in order, `most` of them, each with the number of all pairs; the pairs are made once."""
    pairs = stored(pairs, "pairs")
    n = pairs.agg(F.count(F.lit(1)).alias("n_pairs"))  # one row
    return pairs.orderBy("distance", "a", "b").limit(most).crossJoin(F.broadcast(n))


def coupling(df: DataFrame, group: str, role: str, real: str, fake: str, split: str = "split") -> DataFrame:
    """(group, n, coupling, bridge): how the real and fake members of a group lie across the splits.

    train_fit_leak: a real member in train and a fake one outside it, or the
    other way round; straddling: both kinds and several splits, without such a
    leak; same_side: both kinds in one split; single: one kind only. bridge:
    both kinds occur, in different sets of splits.
    """
    is_real, in_train = F.col(role) == real, F.col(split) == "train"
    is_fake = F.col(role) == fake
    any_ = lambda c: F.bool_or(c)
    rows = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        any_(is_real).alias("r"),
        any_(is_fake).alias("f"),
        F.count_distinct(split).alias("k"),
        any_(is_real & in_train).alias("rt"),
        any_(is_real & ~in_train).alias("ro"),
        any_(is_fake & in_train).alias("ft"),
        any_(is_fake & ~in_train).alias("fo"),
        # at most as many entries as splits
        F.sort_array(F.collect_set(F.when(is_real, F.col(split)))).alias("rs"),
        F.sort_array(F.collect_set(F.when(is_fake, F.col(split)))).alias("fs"),
    )
    leak = (F.col("rt") & F.col("fo")) | (F.col("ft") & F.col("ro"))
    kind = F.when(~(F.col("r") & F.col("f")), "single").when(leak, "train_fit_leak").when(F.col("k") > 1, "straddling").otherwise("same_side")
    return rows.select(group, "n", kind.alias("coupling"), (F.col("r") & F.col("f") & (F.col("rs") != F.col("fs"))).alias("bridge"))


def reconcile(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(issue, key): keys that are missing, extra, or repeated among the found."""
    e, f = expected.select(key).distinct(), found.select(key)
    missing = e.join(f, key, "left_anti").select(F.lit("missing").alias("issue"), key)
    extra = f.distinct().join(e, key, "left_anti").select(F.lit("extra").alias("issue"), key)
    repeated = f.groupBy(key).count().where("count > 1").select(F.lit("repeated").alias("issue"), key)
    return missing.unionByName(extra).unionByName(repeated)


def union_checked(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """UNION ALL of two prediction tables in the first one's columns; extra columns of the second, or repeated keys, raise."""
    if extra := [c for c in second.columns if c not in first.columns]:
        raise ValueError(f"columns of the second table only: {extra}")
    both = first.unionByName(second, allowMissingColumns=True)
    if both.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("a key is in both tables")
    return both


def resolve_groups(df: DataFrame, sidecar: DataFrame, key: str, source: str, group: str) -> DataFrame:
    """Adds `group`: the sidecar's group of the row's source (or of the row itself without one); on a miss, the row's own key."""
    look = sidecar.select(F.col(key).alias("__k"), F.col(group).alias("__g"))
    rows = df.join(look, F.coalesce(F.col(source), F.col(key)) == F.col("__k"), "left")
    return rows.withColumn(group, F.coalesce("__g", key)).drop("__k", "__g")


def latest_sidecar(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """Union of sidecars: blank fields are skipped, and of several values for a key the last table's counts."""
    rows = None
    for i, part in enumerate(parts):
        one = part.where(f"trim(`{key}`) <> '' and trim(`{value}`) <> ''").select(key, value, F.lit(i).alias("__at"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(F.max_by(value, "__at").alias(value))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def near_misses(left: DataFrame, right: DataFrame, path: str) -> DataFrame:
    """Unmatched paths of the left table whose base name exists on the right: a sign of another prefix."""
    names = right.select(base_name(F.col(path)).alias("name")).where("name <> ''").distinct()
    rest = left.join(right.select(path), path, "left_anti").withColumn("name", base_name(F.col(path)))
    return rest.join(names, "name", "left_semi")


def append_missing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows whose key the log doesn't hold yet."""
    return new.join(existing.select(key), key, "left_anti")
