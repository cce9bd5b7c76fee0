"""Content-stable, group-aware split assignment and sampling by hash rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions.hashing import hash_hex, threshold_hex


def assign_splits(df: DataFrame, key: str, stratum: str, group: str | None = None, test: float = 0.2, val: float = 0.1, seed: Column | int = 42) -> DataFrame:
    """Adds `split`: test, val or train.

    A row whose group differs from its key goes where its group's hash sends
    it, so a group is never divided; this needs no shuffle. The other rows are
    ranked by hash inside their stratum: the first rint(n * test) are test, the
    next rint(n * val) val. Adding rows to one stratum doesn't move another's.
    """
    own = F.lit(True) if group is None else ~F.coalesce(F.col(group) != F.col(key).cast("string"), F.lit(False))
    strata = [F.col(stratum)] + ([] if isinstance(seed, int) else [seed])
    df = df.withColumns({"__own": own, "__hash": hash_hex(seed, F.col(key)), "__stratum": F.xxhash64(*strata)})
    df = df.withColumn("__bucket", F.substring("__hash", 1, 3))
    # a stratum may hold most rows: they are ranked inside 4096 ranges of hashes, and a small table has the ranges' first ranks
    place = ["__stratum", "__own", "__bucket"]
    sizes = df.groupBy(*place).agg(F.count(F.lit(1)).alias("__size"))
    whole = Window.partitionBy("__stratum", "__own")
    before = F.coalesce(F.sum("__size").over(whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*place, before.alias("__before"), F.sum("__size").over(whole).alias("__n"))
    df = df.join(sizes, place)
    n = F.col("__n")
    rank = F.col("__before") + F.row_number().over(Window.partitionBy(*place).orderBy("__hash", key))
    made = [*place, "__hash", "__before", "__n"]
    n_test, n_val = F.rint(n * F.lit(test)), F.rint(n * F.lit(val))
    by_rank = F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "val").otherwise("train")
    if group is None:
        return df.withColumn("split", by_rank).drop(*made)
    digits = hash_hex(seed, F.concat(F.lit("GROUP:"), F.col(group)))
    by_group = F.when(digits < threshold_hex(test), "test").when(digits < threshold_hex(test + val), "val").otherwise("train")
    return df.withColumn("split", F.when(F.col("__own"), by_rank).otherwise(by_group)).drop(*made)


def reconstruct(df: DataFrame, key: str, stratum: str, in_set: Column, group: str | None = None, **how) -> DataFrame:
    """The split that a training run made of its classes, for an audit of the whole table: rows outside the set are `unseen`.

    They don't take part in ranking, so the other rows fall as they did in the run.
    """
    inside = F.coalesce(in_set, F.lit(False))
    return assign_splits(df.where(inside), key, stratum, group, **how).unionByName(df.where(~inside).withColumn("split", F.lit("unseen")))


def straddling_groups(df: DataFrame, key: str, group: str, split: str = "split") -> DataFrame:
    """Explicit groups (group <> key) with more than one row: size, number of splits, and whether they straddle."""
    explicit = df.where(F.col(group).isNotNull() & (F.col(group) != F.col(key).cast("string")))
    return (
        explicit.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(split).alias("n_splits"))
        .where("n_rows > 1")
        .withColumn("straddles", F.col("n_splits") > 1)
    )


def assert_no_straddle(df: DataFrame, key: str, group: str, split: str = "split") -> int:
    """Number of explicit groups; raises if one is divided between splits."""
    explicit = df.where(F.col(group).isNotNull() & (F.col(group) != F.col(key).cast("string")))
    counted = explicit.groupBy(group).agg(F.count_distinct(split).alias("n_splits"))
    row = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("n_splits") > 1).cast("int")), F.lit(0)).alias("bad")).first()
    if row.bad:
        raise ValueError(f"{row.bad} of {row.n} groups straddle splits")
    return row.n


def sample_per_class(df: DataFrame, key: str, stratum: str | None, cap: int, seed: int = 42) -> DataFrame:
    """Up to `cap` rows of each class by hash rank; 0 takes all."""
    if cap == 0:
        return df
    window = Window.partitionBy(*([stratum] if stratum else [])).orderBy(hash_hex(seed, F.col(key)), F.col(key))
    if stratum is None:
        return df.orderBy(hash_hex(seed, F.col(key)), key).limit(cap)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= cap)


def sample_round_robin(df: DataFrame, key: str, source: str, sources: list[str], cap: int, seed: int = 42) -> DataFrame:
    """Rows taken in turn from each source, by hash rank and then by the sources' order, up to `cap` in all."""
    order = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col(source))
    window = Window.partitionBy(source).orderBy(hash_hex(seed, F.col(key)), F.col(key))
    ranked = df.where(F.col(source).isin(sources)).withColumn("rank", F.row_number().over(window)).withColumn("source_position", order)
    return ranked.where(F.col("rank") <= cap).orderBy("rank", "source_position").limit(cap)


#: Folds that leave_one_out() makes at most: each copies the table once.
MOST_FOLDS = 1000


def leave_one_out(df: DataFrame, label: str, key: str, group: str | None, val: float = 0.1, seed: int = 42) -> DataFrame:
    """One fold for each class: `fold`, and `role` test, val, train or dropped.

    The held-out class is the test set; rows that share an explicit group with
    it are dropped. The number of folds is the number of classes, so each row
    is copied that often; a label with more than MOST_FOLDS classes raises.
    """
    classes = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().limit(MOST_FOLDS + 1).collect()]
    if len(classes) > MOST_FOLDS:
        raise ValueError(f"{label} has more than {MOST_FOLDS} classes")
    kind = df.schema[label].dataType
    rows = df.withColumn("fold", F.explode(F.array(*[F.lit(c).cast(kind) for c in sorted(classes)]) if classes else F.array().cast(f"array<{kind.simpleString()}>")))
    if group is not None:
        explicit = F.col(group).isNotNull() & (F.col(group) != F.col(key).cast("string"))
        held = df.where(explicit).select(F.col(group).alias("__g"), F.col(label).alias("__f")).distinct()
        rows = rows.join(held, (rows[group] == held["__g"]) & (rows["fold"] == held["__f"]) & explicit, "left")
        shared = F.col("__g").isNotNull()
    else:
        shared = F.lit(False)
    inner = hash_hex(seed, F.concat_ws(":", F.lit("val"), F.col("fold").cast("string"), F.col(key).cast("string"))) < threshold_hex(val)
    role = F.when(F.col(label) == F.col("fold"), "test").when(shared, "dropped").when(inner, "val").otherwise("train")
    return rows.withColumn("role", role).drop("__g", "__f")


def hold_out(df: DataFrame, label: str, held: list, key: str, group: str, real: str | None = None, real_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds `role`: held-out classes and a hash-drawn share of the real class are test; rows sharing an explicit group with a test row are dropped."""
    reserved = F.lit(False) if real is None else (F.col(label) == real) & (hash_hex(seed, F.col(key)) < threshold_hex(real_share))
    df = df.withColumn("__test", F.col(label).isin(held) | reserved)
    explicit = F.col(group).isNotNull() & (F.col(group) != F.col(key).cast("string"))
    groups = df.where(F.col("__test") & explicit).select(F.col(group).alias("__g")).distinct()
    rows = df.join(groups, explicit & (df[group] == groups["__g"]), "left")
    role = F.when(F.col("__test"), "test").when(F.col("__g").isNotNull(), "dropped").otherwise("train")
    return rows.withColumn("role", role).drop("__test", "__g")


def multi_seed(df: DataFrame, seeds: list[int], **how) -> DataFrame:
    """The splits of every seed, in one plan: a row for each row and seed."""
    many = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return assign_splits(many, seed=F.col("seed"), **how)


def populations(df: DataFrame, label: str, mapping: dict[str, list[str]]) -> DataFrame:
    """Adds a boolean column for each named population of classes; raises if a class is in two of them or has no rows."""
    seen: dict[str, str] = {}
    for name, classes in mapping.items():
        for c in classes:
            if c in seen:
                raise ValueError(f"class {c} is both in {seen[c]} and in {name}")
            seen[c] = name
    present = {r[0] for r in df.select(F.col(label).cast("string")).where(F.col(label).isin(list(seen))).distinct().collect()}
    if missing := sorted(set(map(str, seen)) - present):
        raise ValueError(f"classes without rows: {missing}")
    return df.withColumns({f"is_{name}": F.coalesce(F.col(label).isin(classes), F.lit(False)) for name, classes in mapping.items()})

