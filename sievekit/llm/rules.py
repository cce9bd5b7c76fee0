"""Quality rules as a bitmask ledger, in DataFrame functions only.

measure() computes each measurement of a text once, ledger() turns every rule
into one bit of `failed_bits`, and a policy is a versioned mask over those
bits. A new policy or an ablation works on the stored ledger and never reads a
text again.

Edge cases: a null text counts as empty (no words, so it fails too_short);
repeated rows each keep their own row; an empty table gives an empty ledger;
other columns of the input are carried along unless their name is one of the
ledger's, in which case the ledger's column replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")

#: (name, failing condition over the measurements), in bit order. New rules go to the end, so that stored bits keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines"),
    ("shouting", "10 * n_upper > 5 * word_chars"),
    ("short_words", "2 * n_words > word_chars"),
    ("long_words", "word_chars > 40 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_short", "repeated_windows"),
    "v1": tuple(name for name, _ in RULES),
}


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the MEASURES of each whole text, without a shuffle.

    Windows of eight words are compared by 64-bit hashes within one text. Only
    texts with a repeated window go on to the sort that finds which words such
    windows cover.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = docs.drop(*MEASURES, "__t", "__w", "__h", "__l").withColumn("__t", whole)
    words = words.withColumn("__w", F.filter(F.split("__t", SPACE), lambda w: w != "")).withColumn(
        "__l", F.filter(F.split("__t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    )
    counted = words.select(
        *[c for c in words.columns if c not in ("__t", "__w", "__l")],
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("__t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    starts = F.when(F.size("__h") >= WINDOW, F.sequence(F.lit(0), F.size("__h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = counted.withColumn("__v", F.transform(starts, lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(WINDOW)]))).drop("__h")
    # (hash, start) sorted by hash: a window is repeated if a neighbour has its hash
    ordered = windows.withColumn(
        "__s",
        F.when(
            F.size(F.array_distinct("__v")) < F.size("__v"),
            F.sort_array(F.transform("__v", lambda v, i: F.struct(v.alias("v"), i.alias("i")))),
        ),
    ).drop("__v")
    hits = ordered.withColumn(
        "__p",
        F.sort_array(
            F.transform(
                F.filter(
                    F.transform(
                        "__s",
                        lambda s, i: F.when(
                            (F.get(F.col("__s"), i - 1)["v"] == s["v"]) | (F.get(F.col("__s"), i + 1)["v"] == s["v"]), s["i"]
                        ),
                    ),
                    lambda p: p.isNotNull(),
                ),
                lambda p: p,
            )
        ),
    ).drop("__s")
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n"), p.alias("at")),
        lambda a: a["n"],
    )
    return hits.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__p")


def ledger(measured: DataFrame) -> DataFrame:
    """Evaluates every rule once: bit i of failed_bits is set where rule i fails."""
    bits: Column = F.lit(0)
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), BIT[name]).otherwise(0))
    return measured.withColumn("failed_bits", bits.cast("int"))


def judge(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Applies a policy to a ledger."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(mask(policy)) == 0)


def keep(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns only.

    The counts are observed as query metrics. That also keeps the filter above
    the measurements: below them, it would hold a copy of their expressions for
    each time that a rule uses them.
    """
    judged = judge(ledger(measure(docs.withColumns({f"__c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}), text)), policy)
    judged = judged.observe("quality_rules", F.count(F.lit(1)).alias("n_documents"), F.count_if("kept").alias("n_kept"))
    return judged.where("kept").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects.

    The ledger is first summed by bit pattern (at most 2**rules rows, combined
    before the shuffle); every figure then comes from bit operations on these
    patterns.
    """
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(mask(policy)).alias("bits")).count()
    rules = rows.sparkSession.createDataFrame([(n, BIT[n]) for n in POLICIES[policy]], "rule string, bit int")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return (
        patterns.join(F.broadcast(rules), hit, "right")
        .groupBy("rule")
        .agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count"))), F.lit(0)).alias("n_only_this"),
        )
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = judge(ledger(measure(docs)))
    return rows.select(
        "doc_id",
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        (F.col("failed_bits").bitwiseAND(mask("base")) != 0).alias("base_failed"),
        "kept",
        "failed_bits",
    )


_RULE_BITS = " + ".join(f"(case when {fails} then {BIT[name]} else 0 end)" for name, fails in RULES)

OP7_SQL = rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (
  select doc_id, t,
    regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls
  from d
),
win as (
  select doc_id, i, list_slice(ws, i, i + 7) g
  from (select doc_id, ws, unnest(range(1, len(ws) - 6)) i from w where len(ws) >= 8)
),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) c from win) where c > 1),
cov as (
  select doc_id, sum(least(8, coalesce(nxt - i, 8))) n_rep
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) nxt from rep) group by doc_id
),
m as (
  select w.doc_id,
    cast(len(ws) as bigint) n_words,
    cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
    cast(len(ls) as bigint) n_lines,
    cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines,
    cast(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as bigint) n_upper,
    cast(coalesce(n_rep, 0) as bigint) n_repeat_words
  from w left join cov using (doc_id)
),
b as (select *, cast({_RULE_BITS} as integer) failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & {mask("base")}) <> 0 as base_failed,
  (failed_bits & {mask("v1")}) = 0 as kept,
  failed_bits
from b
"""

QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": OP7_SQL}
