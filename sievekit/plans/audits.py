"""Queries: duplicates, leakage, reconciliation, datasheets, lineage and JSON fields."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.operators import auditing, nearness, splitting
from sievekit.plans.splits import _split
from sievekit.sources.shared import stored
from sievekit.sources.tables import spread, table

SIGNATURE_BYTES, WIDE_BYTES = 7, 14
#: Runs of words whose digests are held at once.
RUNS = 16384
#: Languages of the population that a split is reconstructed for; all others are unseen.
IN_SET = ["de", "en", "fr"]


def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = auditing.keep_first(table(spark, d, "documents"), F.sha2("text", 256), "doc_id")
    return rows.select(F.col("first").alias("doc_id"), F.col("n").alias("n_copies"))


def _least_bytes(digest: Callable, n: int, text: str) -> np.ndarray:
    """Byte k ends the least run of 4 bytes, from 2k on, of the digests of a text's runs of three words; a shorter text is one run."""
    words = text.encode().split(b" ")
    runs = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for some in batched(runs, RUNS):
        digests = np.frombuffer(b"".join([digest(run).digest() for run in some]), ">u4").reshape(len(some), -1)
        # runs of 4 bytes that begin at a number of the digest, and those halfway between two
        whole = digests.astype(np.uint32)
        halves = whole[:, :-1] << 16 | whole[:, 1:] >> 16
        for k, numbers in ((0, whole), (1, halves)):
            own = least[k::2]
            np.minimum(own, numbers[:, : len(own)].min(axis=0), out=own)
    return least & 0xFF


def _signed(docs: DataFrame, digest: Callable, words: dict[str, range]) -> DataFrame:
    """Replaces text by bigint words of some of its least bytes, the first in the lowest bits; they are null where the text is."""
    n = max(r.stop for r in words.values())
    kind = T.StructType([f for f in docs.schema if f.name != "text"] + [T.StructField(w, T.LongType()) for w in words])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            least = np.array([_least_bytes(digest, n, t or "") for t in texts.to_pylist()], np.int64).reshape(-1, n)
            missing = texts.is_null().to_numpy(zero_copy_only=False)
            made = [(least[:, r.start : r.stop] << (8 * np.arange(len(r)))).sum(axis=1) for r in words.values()]
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *[pa.array(m, mask=missing) for m in made]], [*rest, *words])

    return spread(docs).mapInArrow(run, kind)


def signatures(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and a 56-bit signature over the text's runs of three words, by bytes of the minima of their md5."""
    return _signed(table(spark, d, "documents").select("doc_id", "text"), hashlib.md5, {"sig": range(SIGNATURE_BYTES)})


def wide_signatures(docs: DataFrame) -> DataFrame:
    """Replaces text by two words of 56 bits, by bytes of the minima of the runs' sha256."""
    return _signed(docs, hashlib.sha256, {"low": range(7), "high": range(7, WIDE_BYTES)})


def audited_split(docs: DataFrame) -> DataFrame:
    """Documents under the split of a run over the languages IN_SET, which ignored copies; other languages are unseen."""
    return splitting.reconstruct(docs, "doc_id", "lang", F.col("lang").isin(IN_SET))


def split_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    return audited_split(table(spark, d, "documents").select("doc_id", "lang")).groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))


def near_dup_cross_split(spark: SparkSession, d: str) -> DataFrame:
    """Near copies in different splits, one of them val, test or unseen: a row for each pair of classes of equal signature and split."""
    # signed first, so that texts are read once and never shuffled; the split ranks rows without text too
    rows = stored(wide_signatures(table(spark, d, "documents").select("doc_id", "lang", "text")), "wide-signatures")
    return nearness.cross_split(audited_split(rows), "doc_id", ["low", "high"], 8 * WIDE_BYTES, width=56)


def near_dup_cross_report(spark: SparkSession, d: str) -> DataFrame:
    """The 200 closest of these pairs, each with the number of all pairs of classes and of rows."""
    pairs = stored(near_dup_cross_split(spark, d), "cross-pairs")
    n = pairs.agg(F.count(F.lit(1)).alias("n_class_pairs"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_all"))  # one row
    return pairs.orderBy("distance", "a", "b", "split_a", "split_b").limit(200).crossJoin(F.broadcast(n))


def near_dup_banded(spark: SparkSession, d: str) -> DataFrame:
    return auditing.banded_pairs(signatures(spark, d), "doc_id", "sig", 8 * SIGNATURE_BYTES, 6)


def near_dup_report(spark: SparkSession, d: str) -> DataFrame:
    """The 200 closest pairs and the number of all pairs."""
    return auditing.nearest_pairs(near_dup_banded(spark, d))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


def contamination_semi(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a line that is also a line of the benchmark."""
    held = table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").distinct()
    return _lines(spark, d).join(held, "line", "left_semi").select("doc_id").distinct()


def contamination_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(contamination_semi(spark, d), "doc_id", "left_anti")


def reconcile_missing_extra(spark: SparkSession, d: str) -> DataFrame:
    rows = auditing.reconcile(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")
    return rows.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def datasheet(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    main = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min_by("lang", "doc_id").alias("first_lang"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))
    counts = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_lang"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_lang"), "lang"))
    top = counts.withColumn("place", place).where("place <= 3").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("place", "lang", "n_lang"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["lang"], F.lit(":"), x["n_lang"].cast("string"))), ",")
    return main.join(top.select("source", text.alias("top_langs")), "source")


def metadata_features(spark: SparkSession, d: str) -> DataFrame:
    """Format features of pages: lengths as width and height."""
    pages = table(spark, d, "pages").select("page_id", "url", F.length("url").alias("w"), F.length("html").alias("h"))
    return pages.select(
        "page_id",
        F.round(F.col("w") / F.nullif("h", F.lit(0)), 9).alias("aspect"),
        F.round(F.ln(F.greatest(F.col("w").cast("double") * F.col("h"), F.lit(1.0))), 9).alias("log_area"),
        F.startswith("url", F.lit("https:")).cast("int").alias("is_https"),
        F.lower(F.regexp_extract("url", r"\.([A-Za-z]+)/", 1)).alias("domain_end"),
    )


def lineage_group_join(spark: SparkSession, d: str) -> DataFrame:
    """Turns resolve their group through the first turn of their conversation; the sidecar holds conversations of users only."""
    rows = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("path"), F.when(F.col("turn") > 0, F.concat(F.col("conv_id"), F.lit(":0"))).alias("source_path"))
    sidecar = table(spark, d, "conversations").where("turn = 0 and role = 'user'").select(F.concat(F.col("conv_id"), F.lit(":0")).alias("path"), F.concat(F.lit("conv"), F.col("conv_id")).alias("grp"))
    return auditing.resolve_groups(rows, sidecar.distinct(), "path", "source_path", "grp").select("path", "source_path", "grp")


def basename_near_miss(spark: SparkSession, d: str) -> DataFrame:
    """http pages without an equal https url whose last path element some https page has."""
    pages = table(spark, d, "pages").select(F.substring_index("url", "?", 1).alias("path"))
    http, https = pages.where("path like 'http:%'").distinct(), pages.where("path like 'https:%'").distinct()
    return auditing.near_misses(http, https, "path").select("path", "name")


def union_checked(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("key"), F.length("text").cast("long").alias("size"), F.lit("documents").alias("origin"))
    second = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("key"), F.length("text").cast("long").alias("size"), F.lit("benchmark").alias("origin"))
    return auditing.union_checked(first, second, "key").groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def id_scoped_join(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the role of the next one; turn numbers repeat between conversations, so both ids are the key."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    following = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"))
    return rows.join(following, ["conv_id", "turn"], "left")


def json_props(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.k")).alias("n_k"), F.min(F.get_json_object("props", "$.k")).alias("min_k"), F.max(F.get_json_object("props", "$.k")).alias("max_k"))


QUERIES = {
    f.__name__: f
    for f in (
        dedup_keep_first,
        near_dup_banded,
        near_dup_report,
        split_reconstruction,
        near_dup_cross_split,
        near_dup_cross_report,
        contamination_semi,
        contamination_anti,
        reconcile_missing_extra,
        datasheet,
        metadata_features,
        lineage_group_join,
        basename_near_miss,
        union_checked,
        id_scoped_join,
        json_props,
    )
}

_LINES = "with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents), b as (select distinct line from (select unnest(string_split(text, chr(10))) line from benchmark) where line <> '')"
_BYTES = ", ".join(f"min(substr(h, {4 * k + 1}, 8)) m{k}" for k in range(SIGNATURE_BYTES))
_SIG = " | ".join(f"(cast('0x' || substr(m{k}, 7, 2) as bigint) << {8 * k})" for k in range(SIGNATURE_BYTES))
_NEAR = f"""
with s as (select doc_id, string_split(text, ' ') ws from documents), i as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) i from s),
w as (select doc_id, md5(array_to_string(list_slice(ws, i, i + 2), ' ')) h from i), m as (select doc_id, {_BYTES} from w group by doc_id),
c as (select {_SIG} sig, min(doc_id) doc_id from m group by 1),
np as (select a.doc_id a, b.doc_id b, cast(bit_count(xor(a.sig, b.sig)) as integer) distance from c a join c b on a.doc_id < b.doc_id where bit_count(xor(a.sig, b.sig)) <= 6)"""

_LOW, _HIGH = (" | ".join(f"(cast('0x' || substr(m{k}, 7, 2) as bigint) << {8 * (k - begin)})" for k in range(begin, begin + 7)) for begin in (0, 7))
_AUDITED = f"""
in_set as (select doc_id, lang, '' grp from documents where lang in ('de', 'en', 'fr')), {_split("in_set", "doc_id", "lang", False)},
sp as (select doc_id, lang, split from s union all select doc_id, lang, 'unseen' from documents where lang is null or lang not in ('de', 'en', 'fr'))"""
_CROSS = f"""
with {_AUDITED}, t as (select doc_id, string_split(text, ' ') ws from documents where text is not null), i as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) i from t),
w as (select doc_id, sha256(array_to_string(list_slice(ws, i, i + 2), ' ')) h from i), m as (select doc_id, {", ".join(f"min(substr(h, {4 * k + 1}, 8)) m{k}" for k in range(WIDE_BYTES))} from w group by doc_id),
g as (select doc_id, {_LOW} low, {_HIGH} high from m),
c as (select low, high, split, split in ('val', 'test', 'unseen') probing, min(doc_id) k, count(*) n from g join sp using (doc_id) group by low, high, split),
x as (select a.k a, a.split split_a, a.n n_a, b.k b, b.split split_b, b.n n_b, cast(bit_count(xor(a.low, b.low)) + bit_count(xor(a.high, b.high)) as integer) distance, a.n * b.n n_pairs
  from c a join c b on a.split <> b.split where a.probing and (not b.probing or a.k < b.k or (a.k = b.k and a.split < b.split))
  and bit_count(xor(a.low, b.low)) + bit_count(xor(a.high, b.high)) <= 6)"""

ORACLES = {
    "split_reconstruction": f"with {_AUDITED} select split, lang, count(*) n from sp group by split, lang",
    "near_dup_cross_split": f"{_CROSS} select * from x",
    "near_dup_cross_report": f"{_CROSS} select *, (select count(*) from x) n_class_pairs, (select cast(coalesce(sum(n_pairs), 0) as bigint) from x) n_all from x order by distance, a, b, split_a, split_b limit 200",
    "dedup_keep_first": "select min(doc_id) doc_id, count(*) n_copies from documents group by sha256(text)",
    "near_dup_banded": f"{_NEAR} select * from np",
    "near_dup_report": f"{_NEAR} select a, b, distance, (select count(*) from np) n_pairs from np order by distance, a, b limit 200",
    "contamination_semi": f"{_LINES} select distinct doc_id from l join b on l.line = b.line",
    "contamination_anti": f"{_LINES} select doc_id from documents where doc_id not in (select doc_id from l join b on l.line = b.line)",
    "reconcile_missing_extra": """
select issue, count(*) n, min(doc_id) first_id from (
  select 'missing' issue, doc_id from (select doc_id from documents except select doc_id from labels)
  union all select 'extra', doc_id from (select doc_id from labels except select doc_id from documents)
  union all select 'repeated', doc_id from (select doc_id from labels group by doc_id having count(*) > 1)) group by issue""",
    "datasheet": """
with c as (select source, lang, count(*) n_lang, row_number() over (partition by source order by count(*) desc, lang) place from documents group by source, lang),
t as (select source, string_agg(lang || ':' || n_lang, ',' order by place) top_langs from c where place <= 3 group by source)
select d.source, count(*) n, arg_min(lang, doc_id) first_lang, min(n_chars) min_chars, max(n_chars) max_chars, any_value(top_langs) top_langs from documents d join t on t.source = d.source group by d.source""",
    "metadata_features": r"""
select page_id, round(length(url)::double / nullif(length(html), 0), 9) aspect, round(ln(greatest(length(url)::double * length(html), 1.0::double)), 9) log_area,
  cast(starts_with(url, 'https:') as integer) is_https, lower(regexp_extract(url, '\.([A-Za-z]+)/', 1)) domain_end from pages""",
    "lineage_group_join": """
with r as (select conv_id || ':' || turn as path, case when turn > 0 then conv_id || ':0' end source_path from conversations),
s as (select distinct conv_id || ':0' as path, 'conv' || conv_id as grp from conversations where turn = 0 and role = 'user')
select r.path, source_path, coalesce(s.grp, r.path) grp from r left join s on s.path = coalesce(source_path, r.path)""",
    "basename_near_miss": """
with p as (select distinct split_part(url, '?', 1) path from pages), n as (select path, string_split(path, '/')[-1] name from p)
select path, name from n where path like 'http:%' and name <> '' and name in (select name from n where path like 'https:%')""",
    "union_checked": "select 'documents' origin, count(*) n, cast(sum(length(text)) as bigint) size from documents union all select 'benchmark', count(*), cast(sum(length(text)) as bigint) from benchmark",
    "id_scoped_join": "select a.conv_id, a.turn, a.role, b.role as next_role from conversations a left join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1",
    "json_props": "select event_type, count(*) n, count(json_extract_string(props, '$.k')) n_k, min(json_extract_string(props, '$.k')) min_k, max(json_extract_string(props, '$.k')) max_k from events group by event_type",
}
