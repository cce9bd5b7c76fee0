"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is parsed into a Boolean query over trigrams that
every match must contain, in lower case: an OR of ANDs. postings() lists, for
each trigram that some rule asks for, the documents that hold it. candidates()
intersects these lists rule by rule, and only a rule's candidates are searched
with its expression. A rule without mandatory trigrams is searched in every
text.

Edge cases: a null text counts as empty (no spans); repeated rows get equal
results; texts that share an id share candidates, which only makes more texts be
searched; null ids are one id; an empty table gives an empty result; no column
but doc_id and the text is read.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of one of its groups (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Base kinds first, in the order that breaks ties between spans.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("hosting", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

#: Strings that are still multiplied out while a query is derived.
MOST_STRINGS = 64

Query = frozenset  # of frozensets of trigrams: an OR of ANDs; ANY matches every text
ANY: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    return frozenset(x | y for x in a for y in b)


def _of_strings(strings: set[str]) -> Query:
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _strings(items) -> set[str] | None:
    """All strings that the parsed items match, or None if there are too many."""
    found = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            more = {chr(arg)}
        elif op is sre.IN:
            more = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    more.add(chr(value))
                elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
                    more |= {chr(c) for c in range(value[0], value[1] + 1)}
                else:
                    return None
        elif op is sre.SUBPATTERN:
            more = _strings(arg[3])
        elif op is sre.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif op is sre.MAX_REPEAT and arg[1] <= 2:
            one = _strings(arg[2])
            more = None if one is None else {"" if n == 0 else x * n for n in range(arg[0], arg[1] + 1) for x in one}
        else:
            return None
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def _query(items) -> Query:
    """The trigrams that every match of the parsed items holds."""
    query, open_ = ANY, {""}
    for item in items:
        op, arg = item
        strings = _strings([item])
        if strings is not None and len(open_) * len(strings) <= MOST_STRINGS:
            open_ = {a + b for a in open_ for b in strings}
            continue
        query, open_ = _both(query, _of_strings(open_)), {""}
        if op is sre.SUBPATTERN:
            query = _both(query, _query(arg[3]))
        elif op is sre.BRANCH:
            query = _both(query, frozenset().union(*(_query(x) for x in arg[1])))
        elif op is sre.MAX_REPEAT and arg[0] >= 1:
            query = _both(query, _query(arg[2]))
    query = _both(query, _of_strings(open_))
    return ANY if frozenset() in query else query


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression; its letters are lower-cased, as the indexed texts are."""
    lowered = frozenset(frozenset(t.lower() for t in part) for part in _query(parser.parse(pattern)))
    return frozenset(part for part in lowered if not any(other < part for other in lowered))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(trigram, doc_id) for the trigrams that the rules ask for."""
    wanted = sorted({t for r in rules for part in trigram_query(r.pattern) for t in part})
    low = docs.select("doc_id", F.lower(F.col(text)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): a bit for each rule whose query the document's trigrams satisfy."""
    parts = [(1 << r, p, t, 1 << i, (1 << len(part)) - 1) for r, rule in enumerate(rules) for p, part in enumerate(trigram_query(rule.pattern)) for i, t in enumerate(sorted(part))]
    queries = index.sparkSession.createDataFrame(parts, "rule long, part int, trigram string, bit long, whole long")
    met = index.join(F.broadcast(queries), "trigram").groupBy("doc_id", "rule", "part").agg(F.bit_or("bit").alias("bits"), F.max("whole").alias("whole"))
    return met.where("bits = whole").groupBy("doc_id").agg(F.bit_or("rule").alias("rules"))


def _spans(rows: DataFrame, rules: tuple[Rule, ...], searched: list[Column]) -> DataFrame:
    """Adds __s0, __s1 ...: each rule's valid spans as (start, place of the rule, kind, end), in code points.

    The gaps between matches come from splitting at the same expression. Running
    totals of lengths are taken in blocks of 64, so that many matches in one
    text don't take quadratic time.
    """
    ordinals = range(len(rules))
    kept = [c for c in rows.columns if not c.startswith("__")]
    rows = rows.select(
        *kept,
        *[F.when(s, F.regexp_extract_all("__t", F.lit(r.pattern), F.lit(0))).alias(f"__m{i}") for i, (r, s) in enumerate(zip(rules, searched))],
        *[F.when(s, F.split("__t", r.pattern, -1)).alias(f"__g{i}") for i, (r, s) in enumerate(zip(rules, searched))],
        *[F.when(s, F.regexp_extract_all("__t", F.lit(r.pattern), F.lit(r.group))).alias(f"__v{i}") for i, (r, s) in enumerate(zip(rules, searched)) if r.group],
    )
    rows = rows.withColumns({f"__n{i}": F.zip_with(f"__g{i}", f"__m{i}", lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))) for i in ordinals})
    plus = lambda a, b: a + b

    def block_totals(i: int) -> Column:
        def total(k: Column) -> Column:
            return F.aggregate(F.slice(f"__n{i}", k * 64 + 1, 64), F.lit(0), plus)

        totals = F.transform(F.sequence(F.lit(0), F.floor(F.size(f"__n{i}") / 64).cast("int")), total)
        return F.aggregate(totals, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    rows = rows.withColumns({f"__b{i}": F.when(F.col(f"__n{i}").isNotNull(), block_totals(i)) for i in ordinals})

    def spans(i: int, rule: Rule) -> Column:
        def span(match: Column, at: Column) -> Column:
            block = F.floor(at / 64).cast("int")
            before = F.get(F.col(f"__b{i}"), block) + F.aggregate(F.slice(f"__n{i}", block * 64 + 1, at - block * 64), F.lit(0), plus)
            start = before + F.length(F.get(F.col(f"__g{i}"), at))
            value = F.get(F.col(f"__v{i}"), at) if rule.group else match
            made = F.struct(start.alias("start"), F.lit(i).alias("place"), F.lit(rule.kind).alias("kind"), (start + F.length(match)).alias("end"))
            return F.when(F.length(value) >= rule.least, made)

        none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
        return F.coalesce(F.array_compact(F.transform(f"__m{i}", span)), none)

    return rows.select(*kept, *[spans(i, r).alias(f"__s{i}") for i, r in enumerate(rules)])


def joined(spans: Column) -> Column:
    """kind:start:end of each span by start, then by the order of the rules, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(doc_id, found): the spans of every text as an array of (start, place, kind, end), by start."""
    docs = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    sure = [trigram_query(r.pattern) == ANY for r in rules]
    index = postings(docs.withColumnRenamed("__t", "text"), rules)
    masks = candidates(index, rules).select(F.col("doc_id").alias("__id"), F.col("rules").alias("__r"))
    rows = docs.join(masks, docs["doc_id"].eqNullSafe(masks["__id"]), "left")
    searched = [F.col("__t").rlike(r.pattern) if s else F.coalesce(F.col("__r"), F.lit(0)).bitwiseAND(1 << i) != 0 for i, (r, s) in enumerate(zip(rules, sure))]
    rows = _spans(rows, rules, searched)
    return rows.select("doc_id", F.sort_array(F.concat(*[f"__s{i}" for i in range(len(rules))])).alias("found"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def _oracle() -> str:
    quoted = lambda s: s.replace("'", "''")
    parts = []
    for i, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(
            f"select doc_id, {i} place, '{r.kind}' kind, unnest(range(1, len(m) + 1)) i, m, v, g from (select doc_id, regexp_extract_all(t, '{p}') m, "
            f"regexp_extract_all(t, '{p}', {r.group}) v, string_split_regex(t, '{p}') g from d where regexp_matches(t, '{p}'))"
        )
    least = " ".join(f"when {i} then {r.least}" for i, r in enumerate(RULES))
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"cast(coalesce(sum((kind = '{r.kind}')::int), 0) as bigint) n_{r.kind}" for r in RULES if r.base)
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
a as ({" union all ".join(parts)}),
p as (
  select doc_id, place, kind, length(m[i]) n, length(v[i]) vn,
    sum(length(g[i]) + length(m[i])) over (partition by doc_id, place order by i rows unbounded preceding) as stop
  from a
),
s as (
  select doc_id, place, kind, cast(stop - n as bigint) start, kind || ':' || cast(stop - n as bigint) || ':' || cast(stop as bigint) item
  from p where vn >= case place {least} end
),
f as (
  select doc_id, {counts},
    sha256(coalesce(string_agg(item, ',' order by start, place) filter (where kind in ({base})), '')) base_sha256,
    coalesce(string_agg(item, ',' order by start, place), '') spans
  from s group by doc_id
)
select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) n_{r.kind}" for r in RULES if r.base)},
  coalesce(base_sha256, sha256('')) base_sha256, coalesce(spans, '') spans
from d left join f on f.doc_id = d.doc_id
"""


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES = {"op10_secret_scan": _oracle()}
