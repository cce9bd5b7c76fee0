import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from sievekit.llm import warc

PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>"), (5, "http://a/5", "<p>one</p>"), (3, None, None), (4, "http://a/\r\nx", ""),
    (6, "http://é/6", "é🙂\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nfake"), (7, "u", "x" * 70_000), (7, "u", "x" * 70_000), (9, "u", "<p>one</p>"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_equals_brute_force(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op8_warc(spark, str(tmp_path)).collect()
    assert len(got) == len(PAGES) and all(r.complete for r in got)
    last = {}
    for page, _, html in PAGES:
        last[html or ""] = max(page, last.get(html or "", page))
    html_of = {p: h or "" for p, _, h in PAGES}
    seen = set()
    for r in sorted(got, key=lambda r: r.record_type):
        html = html_of[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), digest(html))
        if r.record_type == "response":
            assert r.page_id == last[html] and r.refers_to is None and html not in seen
            seen.add(html)
        else:
            assert r.refers_to == last[html]


def test_archives_and_transactions(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.write(pages, path)
    data = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "warc").glob("part-*")))
    assert data.count(b"\r\nWARC-Record-ID: ") == 3 * len(PAGES)
    rows = warc.records(spark, path)
    assert rows.count() == 3 * len(PAGES)
    whole = warc.assemble(rows).where(F.col("response.headers")["X-Page-Id"] == "6").first()
    assert bytes(whole.response.block).decode() == PAGES[5][2]
    assert whole.request.headers["WARC-Concurrent-To"] == whole.metadata.headers["WARC-Concurrent-To"] == whole.id
    alone = warc.assemble(rows.where(F.col("headers")["WARC-Type"] != "request")).collect()
    assert len(alone) == len(PAGES) and all(r.request is None and r.metadata is not None for r in alone)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op8_warc(spark, str(tmp_path)).collect() == []


def test_base32(spark):
    texts = ["", "a", "longer text é"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(warc.base32_sha1(F.encode("t", "UTF-8"))).collect()
    assert [r[0] for r in got] == [digest(t) for t in texts]
