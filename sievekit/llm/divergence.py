"""How the sources of a language differ in their words, exactly and in whole numbers.

Terms are words of letters, with A-Z in lower case. Each language keeps the V
terms that at least LEAST of its documents have. A group is one source of one
language; with N, the count of all kept terms there, each kept term has the
smoothed share p = 1 + floor(10**9 * (count + 2) / (N + 2 V)), so a term that
the group lacks has one share, p0, that only depends on N. Two groups differ in a
term by f(p, q) = floor((p - q)**2 / (p + q)).

The sum of f over all V terms for a pair of groups g and h never walks the
terms that a group lacks. It is priced by inclusion and exclusion over the supports:

    sum over terms of g of f(p, h's p0)        by a histogram of g's counts
  + sum over terms of h of f(g's p0, p)        by a histogram of h's counts
  + (V - terms of g - terms of h) f(p0, p0)    a constant
  + sum over common terms of f(p, p') - f(p, p0') - f(p0, p') + f(p0, p0')

where the last line joins the postings of both. Postings are joined in blocks: a
task gets a bucket of terms for two blocks of BLOCK sources and adds the
corrections up for each pair of sources, so it holds BLOCK**2 sums at most and
gives one row for each pair, however many terms they share or sources a
term has.

Edge cases: null text, language and source count as ''. A group without terms
counts with N = 0, one whose language keeps no term has the value 0 for all
pairs. Repeated rows are documents of their own. Ties rank by the item in the
order of its UTF-8. A language of one source has no pairs. An empty table gives
no rows, and other columns of the documents aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, read, stored

#: Documents of a language that a kept term is in at least, what counts are raised by, and the whole of the shares.
LEAST, RAISED, WHOLE = 10, 2, 10**9
#: Ranks of the terms of a group.
TOP = 10
#: Sources of a block, and postings of a bucket of terms in the mean.
BLOCK, BUCKET = 256, 1 << 16
#: Terms of groups that a task holds, but for those of one batch, before it hands their counts on.
HELD = 1 << 19

WORDS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; the term '' stands for the group itself."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        # for each group, the occurrences and the documents of its terms
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[dict]:
            for (lang, source), (counts, found) in held.items():
                size = len(counts)
                yield {"lang": pa.repeat(pa.scalar(lang), size), "source": pa.repeat(pa.scalar(source), size), "term": list(counts), "n": list(counts.values()), "docs": [found[t] for t in counts]}
            held.clear()

        for b in batches:
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].to_pylist()):
                counts, found = held.setdefault((lang, source), (Counter({"": 0}), Counter()))
                words = WORDS.findall(text.encode().translate(LOWER).decode())
                counts.update(words)
                found.update(set(words))
                found[""] += 1
            if sum(len(counts) for counts, _ in held.values()) >= HELD:
                yield from flushed()
        yield from flushed()

    whole = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = map_batches(whole, run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count in a group; decimals keep the product exact for any count."""
    raised = (count + RAISED).cast("decimal(20,0)") * F.lit(WHOLE)
    whole = (total + RAISED * terms).cast("decimal(20,0)")
    return F.when(whole > 0, 1 + F.call_function("div", raised, whole)).cast("long")


def difference(p: Column, q: Column) -> Column:
    """f(p, q); squares of differences of shares stay below 2**63."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Audit:
    """The tables of an audit: languages, groups with their constants, and the postings of kept terms."""

    def __init__(self, docs: DataFrame):
        counts = stored(term_counts(docs), "terms")
        self.counts = counts
        kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST).drop("docs")
        self.kept = stored(kept, "kept-terms")
        languages = self.kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("all_n"))
        postings = counts.where("term <> ''").select("lang", "source", "term", "n").join(self.kept, ["lang", "term"])
        totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("present"))
        groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(languages, "lang", "left").na.fill(0, ["total", "present", "v", "all_n"])
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one row for each source of a language
        zero = F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("v")), F.lit(0).cast("long"))
        self.groups = stored(groups.select("*", place.cast("long").alias("place"), zero.alias("zero")), "groups")
        of = self.groups.select("lang", "source", "place", "zero", "total", "v", "all_n")
        p = share(F.col("n"), F.col("total"), F.col("v"))
        q = share(F.col("all"), F.col("all_n"), F.col("v"))
        self.postings = stored(postings.join(of, ["lang", "source"]).select("lang", "source", "place", "term", "zero", p.alias("p"), q.alias("q")), "postings")

    def pairs(self) -> DataFrame:
        """(lang, source, other, value) of all ordered pairs of sources of a language."""
        groups = self.groups
        # one row for each pair that the result has
        mine = groups.select("lang", F.col("place").alias("g"), "source", F.col("zero").alias("zero_g"), F.col("present").alias("n_g"), "v")
        its = groups.select("lang", F.col("place").alias("h"), F.col("source").alias("other"), F.col("zero").alias("zero_h"), F.col("present").alias("n_h"))
        constant = F.when(F.col("v") > 0, (F.col("v") - F.col("n_g") - F.col("n_h")) * difference(F.col("zero_g"), F.col("zero_h"))).otherwise(0)
        pairs = mine.join(its, "lang").where("g <> h").select("lang", "source", "other", F.col("g").cast("long"), F.col("h").cast("long"), constant.cast("long").alias("value"))
        parts = self._priced().unionByName(self._corrections())
        both = parts.unionByName(parts.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
        sums = both.groupBy("lang", "g", "h").agg(F.sum("value").alias("part"))
        return pairs.join(sums, ["lang", "g", "h"], "left").select("lang", "source", "other", (F.col("value") + F.coalesce("part", F.lit(0))).alias("value"))

    def _priced(self) -> DataFrame:
        """(lang, g, h, value): what g's terms cost against a source h that lacks them, from the histogram of g's shares."""
        histogram = self.postings.groupBy("lang", F.col("place").alias("g"), "p").agg(F.count(F.lit(1)).alias("n"))
        zeros = self.groups.where("v > 0").select("lang", F.col("place").alias("h"), F.col("zero").alias("zero_h"))
        cost = F.col("n") * difference(F.col("p"), F.col("zero_h"))
        return histogram.join(zeros, "lang").where("g <> h").groupBy("lang", "g", "h").agg(F.sum(cost).alias("value"))

    def _corrections(self) -> DataFrame:
        """(lang, g, h, value) with g < h: what common terms cost beyond the prices of their two sides, in parts."""
        spark = self.postings.sparkSession
        n = self.postings.count()
        buckets = max(64, -(-n // BUCKET))
        blocks = self.groups.groupBy("lang").agg(F.floor(F.max("place") / BLOCK).alias("last"))
        block = F.floor(F.col("place") / BLOCK)
        rows = self.postings.join(blocks, "lang").withColumn("mine", block).withColumn("its", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        keyed = rows.select(
            "lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), F.least("mine", "its").alias("low"), F.greatest("mine", "its").alias("high"), F.xxhash64("term").alias("hash"), "term", "place", "p", "zero"
        )

        def corrected(rows: pd.DataFrame) -> pd.DataFrame:
            low, high = int(rows["low"].iloc[0]) * BLOCK, int(rows["high"].iloc[0]) * BLOCK
            codes = pd.factorize(rows["term"])[0]
            order = np.argsort(codes, kind="stable")
            place, p, zero = (rows[c].to_numpy(np.int64)[order] for c in ("place", "p", "zero"))
            ends = np.cumsum(np.bincount(codes))
            sums = np.zeros((BLOCK, BLOCK), np.int64)
            met = np.zeros((BLOCK, BLOCK), bool)
            for a, b in zip([0, *ends[:-1]], ends):
                at, ps, zs = place[a:b], p[a:b], zero[a:b]
                left, right = np.flatnonzero((at >= low) & (at < low + BLOCK)), np.flatnonzero((at >= high) & (at < high + BLOCK))
                if not len(left) or not len(right) or b - a < 2:
                    continue
                x, x0, y, y0 = ps[left][:, None], zs[left][:, None], ps[right][None, :], zs[right][None, :]
                cell = np.ix_(at[left] - low, at[right] - high)
                sums[cell] += _difference(x, y) - _difference(x, y0) - _difference(x0, y) + _difference(x0, y0)
                met[cell] = True
            g, h = np.nonzero(met)
            out = pd.DataFrame({"lang": rows["lang"].iloc[0], "g": g + low, "h": h + high, "value": sums[g, h]})
            return out[out["g"] < out["h"]]

        return keyed.drop("hash").groupBy("lang", "bucket", "low", "high").applyInPandas(corrected, "lang string, g long, h long, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, term, value, rank): the terms that a group has more of than its language, those that differ most first."""
        more = self.postings.where("p > q").select("lang", "source", "term", difference(F.col("p"), F.col("q")).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
        return more.withColumn("rank", rank).where(F.col("rank") <= top)


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of a group's language, and the terms that set the group apart."""
    tables = Audit(docs)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other"))  # one row for each other source
    pairs = tables.pairs().withColumn("rank", place).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank")
    terms = tables.terms(top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
with d as (select row_number() over () i, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t from documents),
w as (select i, lang, source, unnest(list_transform(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) term from d),
c as (select lang, source, term, count(*)::bigint n, count(distinct i)::bigint docs from w group by all),
k as (select lang, term, sum(n)::bigint n from c group by all having sum(docs) >= 10),
v as (select lang, count(*)::bigint v, sum(n)::bigint total from k group by lang),
g as (select distinct lang, source from d),
f as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, k.n all_n from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
gt as (select lang, source, sum(n)::bigint total from f group by all),
p as (select f.*, 1 + (1000000000::hugeint * (f.n + 2)) // (gt.total + 2 * v.v) p, 1 + (1000000000::hugeint * (f.all_n + 2)) // (v.total + 2 * v.v) q
  from f join gt on gt.lang = f.lang and gt.source = f.source join v on v.lang = f.lang),
pv as (select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as val from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pr as (select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(val, 0) as bigint) as val from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
tm as (select lang, source, 'term' part, term item, cast(((p - q) * (p - q)) // (p + q) as bigint) as val from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by val desc, item) rk from (select * from pr union all select * from tm))
select lang, source, part, item, val as value, cast(rk as integer) as rank from r where part = 'pair' or rk <= 10
"""

QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {"op13_source_divergence": OP13_SQL}
