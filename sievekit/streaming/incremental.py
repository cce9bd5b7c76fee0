"""Incremental use: group splits and append-and-resume logs, which need no view of the whole table, and occurrence
numbers and first copies, which keep a state for each key."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.functions.hashing import hash_hex, threshold_hex
from sievekit.operators.auditing import append_missing

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def group_splits(stream: DataFrame, group: str, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """The split of rows with an explicit group, by the same hash as in batch; it works on streams, as no row needs another.

    Rows that are their own group are ranked inside their stratum, which needs
    the whole table: those stay a batch operation.
    """
    digits = hash_hex(seed, F.concat(F.lit("GROUP:"), F.col(group)))
    return stream.withColumn("split", F.when(digits < threshold_hex(test), "test").when(digits < threshold_hex(test + val), "val").otherwise("train"))


def append_new(path: str, key: str):
    """A foreachBatch function that appends the rows whose key the log at path doesn't hold; a repeated batch adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            fresh = append_missing(spark.read.schema(batch.schema).parquet(path), fresh, key)
        fresh.write.mode("append").parquet(path)

    return run


def numbered_uses(stream: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """occurrences() on a stream: each row's turn and use of its source, which go on where the batch before, or the run before, ended.

    The state of a source is one number. Rows of a batch are numbered by their
    order; where sources arrive in that order, the result is that of the batch
    operation, however the rows are cut into batches. Rows without a source
    share one.
    """
    schema = stream.drop("turn", "use").schema.add("turn", "integer").add("use", "integer")

    def number(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # a source's rows of one batch, in which their order isn't kept
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        before = state.get[0] if state.exists else 0
        at = before + pd.RangeIndex(len(rows)).to_numpy()
        state.update((before + len(rows),))
        rows["turn"], rows["use"] = (at // n).astype("int32"), (at % n).astype("int32")
        yield rows[schema.names]

    return stream.drop("turn", "use").groupBy(source).applyInPandasWithState(number, schema, "seen bigint", "append", "NoTimeout")


def first_copies(stream: DataFrame, content: list[str]) -> DataFrame:
    """The first row of each content that arrives; later copies are dropped, in the same batch, a later one or a later run."""
    return stream.dropDuplicates(content)
