"""Queries: split assignment, sampling, folds and their audits.

Stand-ins: a document is a manifest row, its language the stratum, and texts
that occur several times form groups; a conversation is a source group whose
turns have two roles; an embedding is a sample of a class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.operators import auditing, splitting
from sievekit.sources.tables import table

SOURCES = ["src1", "src2", "src3"]


def grouped_documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, source, sha, grp: copies of a text share a group, other documents are their own."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("sha"))
    copied = docs.groupBy("sha").count().where("count > 1").select("sha", F.substring("sha", 1, 16).alias("g"))
    return docs.join(copied, "sha", "left").withColumn("grp", F.coalesce("g", F.col("doc_id").cast("string"))).drop("g")


def split_documents(spark: SparkSession, d: str) -> DataFrame:
    return splitting.assign_splits(grouped_documents(spark, d), "doc_id", "lang", "grp")


def turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.concat(F.lit("c"), F.col("conv_id")).alias("grp"), "conv_id", "turn", "role")
    return rows


def split_group_aware(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(spark, d).select("doc_id", "lang", "grp", "split")


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = split_documents(spark, d)
    sets = rows.groupingSets([["split", "lang"], ["split", "source"]], "split", "lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return sets.select("split", "lang", "source", "n")


def split_straddle_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = splitting.assign_splits(turns(spark, d), "key", "role")
    return splitting.straddling_groups(rows, "key", "grp")


def split_multi_seed(spark: SparkSession, d: str) -> DataFrame:
    rows = splitting.multi_seed(grouped_documents(spark, d), [41, 42, 43], key="doc_id", stratum="lang", group="grp")
    return rows.groupBy("seed", "split").agg(F.count(F.lit(1)).alias("n"))


def sample_hash_cap(spark: SparkSession, d: str) -> DataFrame:
    return splitting.sample_per_class(table(spark, d, "documents"), "doc_id", "source", 5).select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


def sample_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return splitting.sample_round_robin(table(spark, d, "documents"), "doc_id", "source", SOURCES, 20).select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    group = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("g"), F.col("vec_id") % 21)).otherwise(F.col("vec_id").cast("string"))
    return table(spark, d, "embeddings").select("vec_id", "label", group.alias("grp"))


def fold_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    rows = splitting.leave_one_out(_vectors(spark, d), "label", "vec_id", "grp")
    return rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


def holdout_group_exclusion(spark: SparkSession, d: str) -> DataFrame:
    rows = splitting.hold_out(_vectors(spark, d), "label", [8, 9], "vec_id", "grp", real=0)
    return rows.select("vec_id", "label", "grp", F.col("role").alias("assigned"))


def exact_dup_cross_split(spark: SparkSession, d: str) -> DataFrame:
    """Copies that fall into several splits when the split ignores groups."""
    rows = splitting.assign_splits(grouped_documents(spark, d), "doc_id", "lang")
    return auditing.spanning(rows, F.col("sha"))


def coupling_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = splitting.assign_splits(turns(spark, d), "key", "role")
    return auditing.coupling(rows, "conv_id", "role", "user", "assistant")


def population_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = splitting.populations(_vectors(spark, d), "label", {"train": [0, 1, 2, 3, 4, 5], "out_of_set": [8, 9]})
    return rows.groupBy("is_train", "is_out_of_set").agg(F.count(F.lit(1)).alias("n"))


def _hex(seed: str, key: str) -> str:
    return f"substr(sha256({seed} || ':' || {key}), 1, 16)"


_DOCS = """
h as (select doc_id, lang, source, sha256(text) sha from documents),
cp as (select sha from h group by sha having count(*) > 1),
docs as (select h.*, case when cp.sha is not null then substr(h.sha, 1, 16) else cast(doc_id as varchar) end grp from h left join cp on cp.sha = h.sha)
"""
_TURNS = "turns as (select conv_id || ':' || turn as key, 'c' || conv_id as grp, conv_id, turn, role from conversations)"
_VECTORS = "v as (select vec_id, label, case when vec_id % 3 = 0 then 'g' || (vec_id % 21) else cast(vec_id as varchar) end grp from embeddings)"


def _split(rows: str, key: str, stratum: str, grouped: bool, seed: str = "'42'", extra: str = "") -> str:
    """CTEs that end in s(.., split)."""
    own = f"(grp = cast({key} as varchar))" if grouped else "true"
    test, val = (f"{int(x * 2**64):016x}" for x in (0.2, 0.2 + 0.1))
    return f"""
hk as (select *, {_hex(seed, f"cast({key} as varchar)")} k, {own} own, {_hex(seed, "'GROUP:' || grp")} gk from {rows}),
rk as (select *, row_number() over (partition by {stratum}{extra}, own order by k, {key}) r, count(*) over (partition by {stratum}{extra}, own) n from hk),
s as (select *, case when own then (case when r <= round_even(n * 0.2::double, 0) then 'test' when r <= round_even(n * 0.2::double, 0) + round_even(n * 0.1::double, 0) then 'val' else 'train' end)
  else (case when gk < '{test}' then 'test' when gk < '{val}' then 'val' else 'train' end) end split from rk)
"""


def _below(seed: str, key: str, share: float) -> str:
    return f"{_hex(seed, key)} < '{int(share * 2**64):016x}'"


_DOC_SPLIT = f"with {_DOCS}, {_split('docs', 'doc_id', 'lang', True)}"
_TURN_SPLIT = f"with {_TURNS}, {_split('turns', 'key', 'role', False)}"

QUERIES = {
    "split_group_aware": split_group_aware,
    "split_counts": split_counts,
    "split_straddle_audit": split_straddle_audit,
    "split_multi_seed": split_multi_seed,
    "sample_hash_cap": sample_hash_cap,
    "sample_round_robin": sample_round_robin,
    "fold_leave_one_out": fold_leave_one_out,
    "holdout_group_exclusion": holdout_group_exclusion,
    "exact_dup_cross_split": exact_dup_cross_split,
    "coupling_classes": coupling_classes,
    "population_flags": population_flags,
}

ORACLES = {
    "split_group_aware": f"{_DOC_SPLIT} select doc_id, lang, grp, split from s",
    "split_counts": f"{_DOC_SPLIT} select split, lang, source, count(*) n from s group by grouping sets ((split, lang), (split, source))",
    "split_straddle_audit": f"{_TURN_SPLIT} select grp, count(*) n_rows, count(distinct split) n_splits, count(distinct split) > 1 straddles from s group by grp having count(*) > 1",
    "split_multi_seed": f"with {_DOCS}, many as (select docs.*, seed from docs, (values (41), (42), (43)) t(seed)), {_split('many', 'doc_id', 'lang', True, 'cast(seed as varchar)', ', seed')} select seed, split, count(*) n from s group by seed, split",
    "sample_hash_cap": f"select doc_id, source, rank from (select doc_id, source, row_number() over (partition by source order by {_hex(chr(39) + '42' + chr(39), 'cast(doc_id as varchar)')}, doc_id) rank from documents) where rank <= 5",
    "sample_round_robin": f"select doc_id, source, rank from (select doc_id, source, row_number() over (partition by source order by {_hex(chr(39) + '42' + chr(39), 'cast(doc_id as varchar)')}, doc_id) rank from documents where source in ('src1', 'src2', 'src3')) order by rank, source limit 20",
    "fold_leave_one_out": f"""
with {_VECTORS}, f as (select distinct label fold from v), x as (select v.*, fold, grp <> cast(vec_id as varchar) explicit from v, f),
g as (select distinct grp, label from x where explicit),
r as (select fold, case when x.label = fold then 'test' when explicit and g.grp is not null then 'dropped'
  when {_below("'42'", "'val:' || fold || ':' || vec_id", 0.1)} then 'val' else 'train' end role from x left join g on g.grp = x.grp and g.label = fold)
select fold, role, count(*) n from r group by fold, role""",
    "holdout_group_exclusion": f"""
with {_VECTORS}, t as (select *, label in (8, 9) or (label = 0 and {_below("'42'", "cast(vec_id as varchar)", 0.3)}) test, grp <> cast(vec_id as varchar) explicit from v),
g as (select distinct grp from t where test and explicit)
select vec_id, label, t.grp, case when test then 'test' when explicit and g.grp is not null then 'dropped' else 'train' end assigned from t left join g on g.grp = t.grp""",
    "exact_dup_cross_split": f"with {_DOCS}, {_split('docs', 'doc_id', 'lang', False)} select sha as content, count(*) n, count(distinct split) n_splits from s group by sha having count(distinct split) > 1",
    "coupling_classes": f"""{_TURN_SPLIT}, g as (select conv_id, count(*) n, bool_or(role = 'user') r, bool_or(role = 'assistant') f, count(distinct split) k,
  bool_or(role = 'user' and split = 'train') rt, bool_or(role = 'user' and split <> 'train') ro, bool_or(role = 'assistant' and split = 'train') ft, bool_or(role = 'assistant' and split <> 'train') fo,
  string_agg(distinct split, ',' order by split) filter (where role = 'user') rs, string_agg(distinct split, ',' order by split) filter (where role = 'assistant') fs from s group by conv_id)
select conv_id, n, r and f and coalesce(rs <> fs, false) bridge, case when not (r and f) then 'single' when (rt and fo) or (ft and ro) then 'train_fit_leak' when k > 1 then 'straddling' else 'same_side' end coupling from g""",
    "population_flags": "select label in (0, 1, 2, 3, 4, 5) is_train, label in (8, 9) is_out_of_set, count(*) n from embeddings group by 1, 2",
}
