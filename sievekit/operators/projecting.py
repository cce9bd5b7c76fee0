"""Projections, filters and lookups of evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.sources.shared import stored


def has_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.coalesce(F.startswith(F.col(column), F.lit(prefix)), F.lit(False)))


def mentions(df: DataFrame, part: str, columns: tuple[str, ...] = ("source_dataset", "generator")) -> DataFrame:
    """Rows whose first present column of the given ones contains a text, in any case; null doesn't."""
    column = next((c for c in columns if c in df.columns), None)
    if column is None:
        raise ValueError(f"none of {columns} is a column")
    return df.where(F.coalesce(F.contains(F.lower(F.col(column)), F.lit(part.lower())), F.lit(False)))


def one_real_class(label: Column, reals: list[str], name: str = "real") -> Column:
    return F.when(label.isin(reals), name).otherwise(label)


def named(column: Column, names: dict[str, str]) -> Column:
    """Display names; others pass through."""
    if not names:
        return column
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), column), column)


def encoded(df: DataFrame, label: str, classes: list[str], into: str = "y") -> DataFrame:
    """Adds the place of each label in the given order; an unknown label raises."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    rows = df.withColumn(into, place.cast("int"))
    if bad := [r[0] for r in rows.where(F.col(into).isNull() | (F.col(into) < 0)).select(label).distinct().limit(5).collect()]:
        raise KeyError(f"unknown labels {bad}")
    return rows


def first_maximum(values: Column) -> Column:
    """Place, from 0, of the first largest entry."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def fake_score(probabilities: Column, classes: list[str], reals: list[str]) -> Column:
    """Sum of the probabilities of the classes that aren't real."""
    kept = [F.get(probabilities, F.lit(i)) for i, c in enumerate(classes) if c not in reals]
    return sum(kept[1:], kept[0]) if kept else F.lit(0.0)


def metadata_features(df: DataFrame) -> DataFrame:
    """aspect, log_area, is_png, is_jpeg; unreadable images (-1) are left out, a height of 0 has no aspect."""
    end = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    area = F.greatest(F.col("width").cast("double") * F.col("height"), F.lit(1.0))
    return df.where("width <> -1 and height <> -1").withColumns({"aspect": F.col("width") / F.nullif("height", F.lit(0)), "log_area": F.ln(area), "is_png": (end == "png").cast("int"), "is_jpeg": end.isin("jpg", "jpeg").cast("int")})


def occurrences(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """How often a source was used before (turn) and which of its n uses this is (use).

    Rows are dealt to ranges of source and order, so the uses of a frequent source
    are ranked in several tasks; a small table has each source's rows in earlier ranges.
    """
    dealt = stored(df.repartitionByRange(F.col(source), F.col(order)).withColumn("__range", F.spark_partition_id()), "occurrences")
    sizes = dealt.groupBy(F.col(source).alias("__s"), F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__s", "__r", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(source, "__range").orderBy(order)) - 1
    ranked = dealt.withColumn("__i", inside).join(sizes, F.col(source).eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    at = F.col("__before") + F.col("__i")
    return ranked.withColumns({"turn": F.floor(at / n).cast("int"), "use": F.pmod(at, F.lit(n)).cast("int")}).drop("__range", "__i", "__s", "__r", "__before")


def captions_of(df: DataFrame, captions: DataFrame, key: str = "full_path", source: str = "source_path", caption: str = "blip_caption") -> DataFrame:
    """Adds the caption of the row's source, or of the row itself; '' on a miss. A caption column that is there is replaced."""
    path = F.coalesce(F.col(source), F.col(key)) if source in df.columns else F.col(key)
    look = captions.groupBy(F.col(key).alias("__k")).agg(F.max(caption).alias("__c"))
    return df.drop(caption).join(look, path == F.col("__k"), "left").withColumn(caption, F.coalesce("__c", F.lit(""))).drop("__k", "__c")


def resolved_truth(predictions: DataFrame, truth: DataFrame, key: str, label: str) -> DataFrame:
    """The truth table's label for each prediction; a label column of the predictions gives way."""
    return predictions.drop(label).join(truth.select(key, label), key)


def external_predictions(df: DataFrame, other: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """Adds another model's column by key, null where missing, and the number of rows that have it; without overlap the column is left out."""
    rows = df.join(other.select(key, column), key, "left")
    n = rows.where(F.col(column).isNotNull()).count()
    return (rows, n) if n else (df, 0)


def assert_same_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """Raises unless both tables hold the same keys."""
    left, right = a.select(*keys, F.lit(1).alias("__a")), b.select(*keys, F.lit(1).alias("__b"))
    if n := left.join(right, keys, "full").where("__a is null or __b is null").count():
        raise ValueError(f"{n} rows are on one side only")


def in_set(df: DataFrame, label: str, trained: list[str] | None, configured: list[str]) -> DataFrame:
    """Adds in_set by the first of: the row's own flag, the classes that the model was trained on, the configured classes."""
    by_class = F.col(label).isin(trained if trained is not None else configured)
    if "in_set" not in df.columns:
        return df.withColumn("in_set", by_class)
    text = F.lower(F.trim(F.col("in_set").cast("string")))
    own = F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False)
    return df.withColumn("in_set", F.coalesce(own, by_class))


def restrict_to(df: DataFrame, index: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that a shared test index holds, and the rest; no match raises."""
    test = df.join(index.select(key).distinct(), key, "left_semi")
    if not test.limit(1).count():
        raise ValueError("no row is in the test index")
    return test, df.join(index.select(key), key, "left_anti")


def unreadable(manifest: DataFrame, kept: DataFrame, key: str, label: str) -> DataFrame:
    """(label, n) of the manifest rows that feature extraction left out."""
    return manifest.join(kept.select(key), key, "left_anti").groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def smallest_class(df: DataFrame, label: str, least: int = 2) -> bool:
    """Whether every class has enough rows to be split."""
    row = df.groupBy(label).count().agg(F.min("count")).first()
    return row[0] is not None and row[0] >= least


def evaluation_mode(df: DataFrame) -> str:
    """detection, frequency or attribution, by the columns present."""
    for mode, needed in (("attribution", {"true_generator", "pred_generator"}), ("frequency", {"y_true", "score"}), ("detection", {"label", "defake_predict"})):
        if needed <= set(df.columns):
            return mode
    raise ValueError(f"no evaluation fits the columns {df.columns}")


def best_of(df: DataFrame, score: str, order: str) -> DataFrame:
    """The row with the largest score; the first of equal ones."""
    return df.orderBy(F.desc(score), order).limit(1)


def datasheet_markdown(rows: DataFrame, title: str) -> str:
    """A small result as a Markdown table."""
    head = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect())]) + "\n"
