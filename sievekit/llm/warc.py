"""WARC archives: writing captures, reading records back, and assembling transactions.

Each capture is written as a request record, a response record (or a revisit of
an equal payload's response) and a metadata record; request and metadata name
their response in WARC-Concurrent-To. Spark's text writer puts out the archives:
a record is one value, and the line separator is the empty line pair that ends a
WARC record, so archives go through Spark's commit protocol to any file system,
and a lost executor's task is simply written again. Each archive is one gzip
stream.

Records are read from whole archives, which the writer keeps to about
ARCHIVE_BYTES each before compression; a payload is cut out by its
Content-Length, so whatever it holds can't end a record. Assembly joins the
three kinds of record by identifier and gives one nested row per capture.

Edge cases: a null payload counts as empty; equal payloads (empty ones too)
share one response, that with the largest id; rows that repeat an id are separate
captures with record ids of their own; a null id sorts before all others and is
written as an empty id; captures without a request or metadata record keep null
there; an empty table gives archives without records and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, new_path, read, stored

VERSION = "WARC/1.1"
ARCHIVE_BYTES = 8_000_000
#: Payloads of at least so many bytes can be revisits.
LEAST_REVISIT = 0
#: Parts into which the rows of one digest are dealt before they are joined.
SALTS = 16

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Base32 of the SHA-1 of a binary column: 20 bits at a time from the hex digits."""
    digits = F.sha1(payload)
    letters = []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(digits, at + 1, 5), 16, 10).cast("int")
        letters += [F.lit(_BASE32).substr(F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_roles(rows: DataFrame) -> DataFrame:
    """(row, size, digest, first) for rows with a unique row id: first is the (page_id, row) that a revisit refers to.

    The largest page of each digest is found by an aggregate that combines
    before the shuffle, and is copied to SALTS rows, so that a payload that a
    third of all pages share is joined in as many parts.
    """
    small = rows.select("row", "page_id", F.length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("digest"))
    small = stored(small, "digests")
    largest = small.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("first"))
    # only digests that several rows share need the join's second side
    largest = largest.join(small.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "digest", "left_semi")
    copies = largest.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = small.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(copies, ["digest", "salt"], "left")
    return both.select("row", "size", "digest", F.when(F.col("first.row") != F.col("row"), F.col("first")).alias("first"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record as one string: version line, headers with values, empty line, block; null headers are left out."""
    lines = [F.lit(VERSION)] + [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", *lines, size), F.lit(_END), block)


def write(pages: DataFrame, path: str, row: Column | None = None, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes page_id, url and html as archives under path.

    row: a text that identifies each row and is the same at every reading; where
    the source has none, numbers are given out and kept in a table.
    """
    spark = pages.sparkSession
    source = [F.col("page_id"), F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", " ").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")]
    if row is None:
        rows = stored(pages.select(F.monotonically_increasing_id().cast("string").alias("row"), *source), "captures")
    else:
        rows = pages.select(row.alias("row"), *source)
    roles = stored(with_roles(rows), "roles")
    mean = roles.agg(F.avg("size")).first()[0] or 0
    each = max(1, math.ceil(ARCHIVE_BYTES / (mean + 1500))) * 3
    all_ = rows.join(roles, "row")
    name = lambda kind, row: F.concat(F.lit(f"<urn:sievekit:{kind}:"), row.cast("string"), F.lit(">"))
    mine, revisit = name("response", F.col("row")), F.col("first").isNotNull()
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    payload = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", mine),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Refers-To", F.when(revisit, name("response", F.col("first.row")))),
            ("X-Refers-To-Page-Id", F.when(revisit, F.coalesce(F.col("first.page_id").cast("string"), F.lit("")))),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("X-Page-Id", page),
            ("X-Payload-Length", F.col("size")),
            ("Content-Type", F.lit("text/html; charset=utf-8")),
        ],
        payload,
    )
    ask = F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(" HTTP/1.1"))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", name("request", F.col("row"))), ("WARC-Concurrent-To", mine), *common, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(ask, F.lit(_END)))
    fields = F.concat(F.lit("page-id: "), page, F.lit("\r\nrole: "), F.when(revisit, "revisit").otherwise("response"))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", name("metadata", F.col("row"))), ("WARC-Concurrent-To", mine), *common, ("Content-Type", F.lit("application/warc-fields"))], fields)
    all_.select(F.explode(F.array(request, response, metadata)).alias("value")).write.options(lineSep=_END, compression="gzip", maxRecordsPerFile=each).text(path)


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(archive, offset, headers, size, digest, block) of every record; block is null without payloads, digest and size are the block's own."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    # an archive is some megabytes: a few of them make a batch
    files = archives.select("path", "content")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"]):
                data = gzip.decompress(content.as_buffer())
                out: dict[str, list] = {c: [] for c in ("archive", "offset", "headers", "size", "digest", "block")}
                at, held = 0, 0
                while at < len(data):
                    head = data.index(b"\r\n\r\n", at)
                    lines = data[at:head].decode("utf-8").split("\r\n")
                    if not lines[0].startswith("WARC/"):
                        raise ValueError(f"no record at byte {at} of {path}")
                    headers = dict(line.split(": ", 1) for line in lines[1:])
                    size = int(headers["Content-Length"])
                    block = data[head + 4 : head + 4 + size]
                    values = (path, at, list(headers.items()), size, base64.b32encode(hashlib.sha1(block).digest()).decode(), block if payloads else None)
                    for column, value in zip(out.values(), values):
                        column.append(value)
                    at, held = head + 8 + size, held + size
                    if held > 4_000_000 or len(out["offset"]) >= 5_000:
                        yield _batch(out)
                        out, held = {c: [] for c in out}, 0
                if out["offset"]:
                    yield _batch(out)

    return map_batches(files, run, "archive string, offset bigint, headers map<string,string>, size bigint, digest string, block binary")


def _batch(out: dict[str, list]) -> dict:
    return out | {"headers": pa.array(out["headers"], pa.map_(pa.string(), pa.string()))}


def assemble(rows: DataFrame) -> DataFrame:
    """One row per capture: id, url, response, request and metadata records as structs, joined by concurrent-to identifiers."""
    kind = F.col("headers")["WARC-Type"]
    record = F.struct("archive", "offset", "headers", "size", "digest", "block")
    main = rows.where(kind.isin("response", "revisit")).select(F.col("headers")["WARC-Record-ID"].alias("id"), record.alias("response"))
    beside = rows.where(kind.isin("request", "metadata")).select(F.col("headers")["WARC-Concurrent-To"].alias("id"), kind.alias("kind"), record.alias("record"))
    # a capture has one of each; of several, the first in the archives counts
    both = beside.groupBy("id").agg(
        *[F.min_by(F.when(F.col("kind") == k, F.col("record")), F.when(F.col("kind") == k, F.struct("record.archive", "record.offset"))).alias(k) for k in ("request", "metadata")]
    )
    return main.join(both, "id", "left").select("id", F.col("response.headers")["WARC-Target-URI"].alias("url"), "response", "request", "metadata")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    pages = read(spark, sf_dir, "pages")
    place = F.concat_ws("-", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
    write(pages, path, place)
    captures = assemble(records(spark, path, payloads=False))
    header = lambda name: F.col("response.headers")[name]
    revisit = header("WARC-Type") == "revisit"
    kind = dict(pages.dtypes)["page_id"]
    number = lambda c: F.when(c != "", c).cast(kind)
    return captures.select(
        number(header("X-Page-Id")).alias("page_id"),
        # of a response, what its own block says; of a revisit, what its headers say
        F.when(revisit, header("X-Payload-Length").cast("long")).otherwise(F.col("response.size")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(header("WARC-Payload-Digest"), ":", -1)).otherwise(F.col("response.digest")).alias("payload_digest"),
        header("WARC-Type").alias("record_type"),
        number(header("X-Refers-To-Page-Id")).alias("refers_to"),
        (F.col("request").isNotNull() & F.col("metadata").isNotNull()).alias("complete"),
    )


def _oracle() -> str:
    letter = lambda at, s: f"substr('{_BASE32}', ((cast('0x' || substr(h, {at + 1}, 5) as integer) >> {s}) & 31) + 1, 1)"
    digest = " || ".join(letter(at, s) for at in range(0, 40, 5) for s in (15, 10, 5, 0))
    return f"""
with p as (select page_id, coalesce(html, '') t from pages),
h as (select page_id, cast(octet_length(encode(t)) as bigint) n, sha1(t) h from p),
d as (select page_id, n, {digest} digest, max(page_id) over (partition by h) first from h)
select page_id, n as payload_bytes, digest as payload_digest,
  case when first = page_id then 'response' else 'revisit' end record_type,
  case when first = page_id then null else first end refers_to, true as complete
from d
"""


QUERIES = {"op8_warc": op8_warc}
ORACLES = {"op8_warc": _oracle()}
