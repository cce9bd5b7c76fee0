"""Intermediate tables in the folder that the driver and all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that new_path() gave out and drop() hasn't deleted, with their sessions.
_held: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; where none is set, a local master gets a temporary one, as in tests, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="sievekit-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one; what is left of it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _held:
        atexit.register(_drop_all)
    _held[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them again, so that a lost executor never costs what made them."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes the files of stored() tables that nothing reads any more; other tables stay."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path in _held:
            _delete(_held.pop(path), path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _drop_all() -> None:
    while _held:
        path, spark = _held.popitem()
        if spark.sparkContext._jsc is not None:  # else the session has ended, and its files can't be reached
            _delete(spark, path)
