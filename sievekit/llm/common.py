"""What the operators of this subpackage share: intermediate tables, batch mapping, word hashing."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

import sievekit

# Functions go to the executors by value, so that these don't need the package on their path.
cloudpickle.register_pickle_by_value(sievekit)

#: Rows and bytes of what a function gets at once: whole documents, so less than a batch that Spark hands over.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Where it is unset, a local master gets a temporary one, as in tests; on a
    cluster, whose executors wouldn't see each other's files there, that is an
    error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="sievekit-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders that new_path() gave out and forget() hasn't deleted, with their sessions.
_held: dict[str, SparkSession] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one; what is left of it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _held:
        atexit.register(_forget_all)
    _held[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them again, which cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored() tables that nothing reads any more; other tables stay."""
    for df in tables:
        if spark := _held.pop(getattr(df, "stored_at", None), None):
            _delete(spark, df.stored_at)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _forget_all() -> None:
    while _held:
        path, spark = _held.popitem()
        if spark.sparkContext._jsc is not None:  # else the session has ended, and its files can't be reached
            _delete(spark, path)


def placed(df: DataFrame, name: str) -> DataFrame:
    """Adds a struct that identifies each row: its file (hashed) and its place there; tables that aren't read from files are stored first."""
    if df._jdf.queryExecution().analyzed().children().isEmpty():
        try:
            return _with_place(df, name)
        except AnalysisException:
            pass
    return _with_place(stored(df, "placed"), name)


def _with_place(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """The same rows with a copy of a bigint key of which Spark doesn't know how it is dealt.

    A join by the key then shuffles this side too, and adaptive execution can
    split a hot key; it doesn't where a side comes from an aggregate as it is.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps now and not at its next turn.

    The cleaner acts on what the driver's garbage collection finds unreachable,
    which a driver with little to do may put off while the disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def to_tasks(spark: SparkSession, value):
    """A broadcast of a value of bounded size, by value as well; in_task() opens it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def in_task(held):
    return cloudpickle.loads(held.value)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most BATCH_ROWS rows and BATCH_BYTES bytes; a row may be larger."""
    n = batch.num_rows
    if n <= BATCH_ROWS and (n < 2 or batch.nbytes <= BATCH_BYTES):
        yield batch
    else:
        for part in (batch.slice(0, n // 2), batch.slice(n // 2)):
            yield from pieces(part)


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand over Arrow batches of at most BATCH_BYTES, where the session does not set a limit (64 MB by default).

    pieces() cuts them to that size anyway, but until then every task holds the
    whole batch twice, outside the heap of its executor and in Python.
    """
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def map_batches(df: DataFrame, function: Callable[[Iterator[dict]], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """Runs function over batches as {column: array} in each task; it yields dicts that hold the schema's columns."""
    kind: StructType = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in function({c: b.column(i) for i, c in enumerate(b.schema.names)} for whole in batches for b in pieces(whole)):
            yield pa.RecordBatch.from_arrays(
                [x.cast(f.type) if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, kind)


#: Byte tables for hashed_words(): what isn't part of a word becomes a space, A-Z become a-z.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SPACED = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in _LOWER)
ALNUM = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in _LOWER)

_MIX1, _MIX2, _SIZE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Sets the hashes of stems apart from those of words.
_STEM = np.uint64(0xC2B2AE3D27D4EB4F)
#: What is kept of the eight bytes from a place on, by how many of them belong to the word.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes up to which words are hashed eight bytes at a time, all words at once.
_SHORT = 64
#: Bytes of text that are hashed at a time, if no single text is longer.
_CHUNK = 4 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _runs(chunk: bytes, starts: np.ndarray, ends: np.ndarray, salt: np.uint64) -> np.ndarray:
    """64-bit hashes of the runs of bytes from starts to ends.

    Each eight bytes go through a mixing that is one to one, so no two runs of
    the same size of at most eight bytes share a hash. Runs of more than _SHORT
    bytes are hashed one by one.
    """
    eight = np.ndarray(len(chunk) + 1, np.dtype("<u8"), chunk + bytes(8), strides=(1,))
    size = ends - starts
    h = mixed(size.astype(np.uint64) * _SIZE ^ salt)
    h = mixed(h ^ (eight[starts] & _KEPT[np.minimum(size, 8)]))
    at = np.flatnonzero((size > 8) & (size <= _SHORT))
    done = 8
    while len(at):
        h[at] = mixed(h[at] ^ (eight[starts[at] + done] & _KEPT[np.minimum(size[at] - done, 8)]))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > _SHORT):
        h[i] = xxhash.xxh64_intdigest(chunk[starts[i] : ends[i]], int(salt))
    return h


def hashed_words(texts: pa.Array, table: bytes, stem: int = 0) -> tuple[np.ndarray, ...]:
    """(hashes, ends): 64-bit hashes of all words of the texts, and where each text's words end; null texts have none.

    With stem, the third array hashes the first `stem` characters of each word
    in another way.
    """
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    parts, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _CHUNK, side="right")) - 1)
        chunk = bytes(data[bounds[at] : bounds[to]]).translate(table) if bounds[to] > bounds[at] else b""
        parts.append(_hashed(chunk, bounds[at : to + 1] - bounds[at], stem))
        at = to
    if not parts:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * bool(stem))
    counts = np.concatenate([p[1] for p in parts])
    stems = [np.concatenate([p[2] for p in parts])] if stem else []
    return (np.concatenate([p[0] for p in parts]), np.cumsum(counts), *stems)


def _hashed(chunk: bytes, bounds: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(hashes, words of each text, stems) of texts that follow one another."""
    x = np.frombuffer(chunk, np.uint8)
    if not len(x):
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64), np.zeros(0, np.uint64)
    inside = x != 0x20
    edge = np.empty(len(x) + 1, bool)
    edge[0], edge[1:-1], edge[-1] = True, ~inside[:-1], True
    edge[bounds] = True  # a text's first byte begins a word, wherever the text before it ends
    starts = np.flatnonzero(inside & edge[:-1])
    edge[1:-1] = ~inside[1:]
    edge[bounds] = True
    ends = np.flatnonzero(inside & edge[1:]) + 1
    hashes = _runs(chunk, starts, ends, np.uint64(0))
    counts = np.diff(np.searchsorted(starts, bounds))
    if not stem:
        return hashes, counts, None
    letters = np.flatnonzero((x & 0xC0) != 0x80)
    after = np.searchsorted(letters, starts) + stem
    cut = np.where(after < len(letters), letters[np.minimum(after, len(letters) - 1)], len(x))
    return hashes, counts, _runs(chunk, starts, np.minimum(cut, ends), _STEM)


def word_slices(texts: pa.Array, table: bytes) -> list[np.ndarray]:
    """The word hashes of each text."""
    hashes, ends = hashed_words(texts, table)
    return np.split(hashes, ends[:-1]) if len(ends) else []
