"""Sizes of image files from their headers.

Spark lists the files without reading them, and tasks read of each file only as
far as its header reaches, so that the bytes read don't depend on the size of the
images. PNG, GIF and BMP have their size in the first 32 bytes; a JPEG file is a
chain of segments, of which those before the frame header are skipped by their
lengths. Files are opened through Arrow, which knows local paths, HDFS and
object stores by the paths' schemes.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that are read at a time, and segments of a JPEG file that are followed at most; a longer chain counts as junk.
STEP, MOST_SEGMENTS = 4096, 1000

# Frame markers of JPEG, which hold the size.
FRAMES = frozenset([*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)])
ALONE = frozenset([0x01, *range(0xD0, 0xD8)])

UNKNOWN = (-1, -1)


class Bytes:
    """A file's bytes by place, read in steps and only where they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self._read, self._at, self._held = read, 0, b""

    def __call__(self, at: int, size: int) -> bytes:
        if not self._at <= at or at + size > self._at + len(self._held):
            self._at, self._held = at, self._read(at, max(size, STEP if at == 0 else 64))
        return self._held[at - self._at : at - self._at + size]


def image_size(read: Callable[[int, int], bytes]) -> tuple[int, int]:
    """(width, height) of an image, given what reads n bytes from a place on; -1 and -1 of what isn't one, or is cut off."""
    part = Bytes(read)
    head = part(0, 32)
    number = lambda at, n, order="big": int.from_bytes(head[at : at + n], order)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24:
        return number(16, 4), number(20, 4)
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return number(6, 2, "little"), number(8, 2, "little")
    if head[:2] == b"BM" and len(head) >= 26 and number(14, 4, "little") >= 40:
        return number(18, 4, "little"), abs(int.from_bytes(head[22:26], "little", signed=True))
    if head[:2] == b"\xff\xd8":
        return _jpeg(part)
    return UNKNOWN


def _jpeg(part: Bytes) -> tuple[int, int]:
    at = 2
    for _ in range(MOST_SEGMENTS):
        segment = part(at, 9)
        if len(segment) < 2 or segment[0] != 0xFF:
            return UNKNOWN
        marker = segment[1]
        if marker == 0xFF:  # a byte to fill up
            at += 1
        elif marker in ALONE:
            at += 2
        elif marker in FRAMES:
            return (int.from_bytes(segment[7:9], "big"), int.from_bytes(segment[5:7], "big")) if len(segment) == 9 else UNKNOWN
        elif marker in (0xD9, 0xDA) or len(segment) < 4:
            return UNKNOWN  # the picture began without a frame
        else:
            at += 2 + max(2, int.from_bytes(segment[2:4], "big"))
    return UNKNOWN


def _opened(path: str) -> Callable[[int, int], bytes]:
    system, place = fs.FileSystem.from_uri(path)
    file = system.open_input_file(place)

    def read(at: int, size: int) -> bytes:
        return file.read_at(max(0, min(size, file.size() - at)), at) if at < file.size() else b""

    return read


def scan_headers(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg,gif,bmp}", exclude: str | None = None, recursive: bool = True) -> DataFrame:
    """(full_path, filename, length, width, height, n_read) of image files: -1 and -1 where no header can be read, and the bytes read of each.

    Files under an excluded name pattern are left out and not opened; Spark
    doesn't list files without a byte. A folder without images gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder).select("path", "length")
    files = files.withColumn("filename", F.substring_index("path", "/", -1))
    files = files if exclude is None else files.where(~F.col("filename").rlike(exclude))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column(0).to_pylist():
                n = 0

                def counted(at: int, size: int) -> bytes:
                    nonlocal n
                    got = read(at, size)
                    n += len(got)
                    return got

                try:
                    read = _opened(path)
                    found.append((*image_size(counted), n))
                except OSError:
                    found.append((*UNKNOWN, n))
            made = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], ["full_path", "length", "filename", "width", "height", "n_read"])

    return files.mapInArrow(run, "full_path string, length bigint, filename string, width int, height int, n_read bigint")
