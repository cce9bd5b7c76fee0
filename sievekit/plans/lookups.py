"""Queries: filters, projections, lookups and selections of evaluation tables, and the writers and readers of their files.

Stand-ins: a page is a manifest row (its url the path), a conversation's turn 0
the source of its later turns, a document's language its class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievekit.functions.hashing import hash_fraction
from sievekit.operators import auditing, learning, projecting, splitting
from sievekit.plans import scoring
from sievekit.sources import readers
from sievekit.sources.shared import new_path
from sievekit.sources.tables import table

LANGUAGES = ["de", "en", "es", "fr"]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


def prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return projecting.has_prefix(table(spark, d, "pages"), "url", "https://").select("page_id", "url")


def contains_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose source holds "RC1" in any case."""
    return projecting.mentions(_documents(spark, d), "RC1", ("source_dataset", "source")).select("doc_id", "source")


def mask_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Set membership combined with other masks; unknown lengths count as short."""
    some, long_ = F.col("lang").isin("de", "fr"), F.coalesce(F.col("n_chars") > 1000, F.lit(False))
    return _documents(spark, d).where((some & ~long_) | (~some & long_ & (F.col("source") != "src3"))).select("doc_id", "lang")


def label_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Real sources as one class, display names of languages, and the place of the language among the classes."""
    names = {"de": "German", "en": "English"}
    rows = projecting.encoded(_documents(spark, d).where(F.col("lang").isin(LANGUAGES)), "lang", LANGUAGES)
    return rows.select("doc_id", projecting.one_real_class(F.col("source"), ["src0", "src1", "src2"]).alias("source_class"), projecting.named(F.col("lang"), names).alias("display"), F.col("y"))


def first_maximum(spark: SparkSession, d: str) -> DataFrame:
    """Place and value of the largest entry of each vector."""
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", projecting.first_maximum(F.col("embedding")).alias("place"), F.round(F.array_max("embedding").cast("double"), 6).alias("most"))


def manifest_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns renamed, dropped, given defaults, coalesced and added; rows without a name are left out."""
    rows = table(spark, d, "pages").withColumnRenamed("url", "full_path").withColumn("size", F.length("html")).drop("html")
    rows = rows.withColumn("generator", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("g"), F.col("page_id") % 7)))
    rows = rows.withColumns({"category": F.coalesce("generator", F.lit("real")), "dataset": F.lit("pages"), "size": F.coalesce("size", F.lit(-1))})
    return rows.dropna(subset=["full_path"]).select("page_id", "full_path", "category", "dataset", "size")


def caption_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The caption of each turn's source, the first turn of its conversation, where a user opened it; '' elsewhere."""
    rows = table(spark, d, "conversations")
    path = F.concat_ws(":", "conv_id", "turn")
    mine = rows.select(path.alias("full_path"), F.when(F.col("turn") > 0, F.concat(F.col("conv_id"), F.lit(":0"))).alias("source_path"))
    captions = rows.where("turn = 0 and role = 'user'").select(path.alias("full_path"), F.substring("text", 1, 20).alias("blip_caption"))
    return projecting.captions_of(mine, captions).select("full_path", "source_path", "blip_caption")


def truth_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with the truth table's label in place of their own."""
    mine = _documents(spark, d).select("doc_id", "lang", F.lit(-1).alias("quality"))
    return projecting.resolved_truth(mine, table(spark, d, "labels"), "doc_id", "quality").select("doc_id", "lang", "quality")


def external_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Another model's column, null where it has no row."""
    other = table(spark, d, "labels").select("doc_id", F.round(hash_fraction(21, F.col("doc_id")), 6).alias("other_score"))
    return projecting.external_predictions(_documents(spark, d), other, "doc_id", "other_score")[0].select("doc_id", "other_score")


def in_set_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The row's own flag first, then the classes that the model was trained on."""
    own = F.when(F.col("doc_id") % 5 == 0, "yes").when(F.col("doc_id") % 5 == 1, " FALSE")
    rows = _documents(spark, d).withColumn("in_set", own)
    return projecting.in_set(rows, "lang", ["de", "en"], ["fr"]).select("doc_id", "lang", "in_set")


def occurrence_index(spark: SparkSession, d: str) -> DataFrame:
    """How often an event's user came before, in uses of four."""
    return projecting.occurrences(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 4)


def unreadable_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each language that have no label."""
    return projecting.unreadable(_documents(spark, d), table(spark, d, "labels"), "doc_id", "lang")


def sidecar_union(spark: SparkSession, d: str) -> DataFrame:
    """Groups of two sidecars: blank ones are skipped, and the later table counts."""
    rows = _documents(spark, d)
    first = rows.select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("grp"))
    second = rows.where("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("new-"), "lang")).otherwise(F.lit(" ")).alias("grp"))
    return auditing.latest_sidecar([first, second], "path", "grp")


def generation_groups(spark: SparkSession, d: str) -> DataFrame:
    """The identity of each source and output of a generation log."""
    rows = table(spark, d, "conversations").where("turn > 0").select(F.concat(F.col("conv_id"), F.lit(":0")).alias("source_image"), F.concat_ws(":", "conv_id", "turn").alias("output_path"), F.concat(F.lit("c"), F.col("conv_id")).alias("source_identity"))
    return readers.generation_groups(rows)


def lineage_rebase(spark: SparkSession, d: str) -> DataFrame:
    """Paths moved from one root to another, and the folder that each stands in."""
    rows = table(spark, d, "pages").select("page_id", F.substring_index("url", "?", 1).alias("path"))
    moved = rows.withColumn("rebased", F.regexp_replace("path", "^https?://[^/]+/", "/data/"))
    return moved.select("page_id", "rebased", readers.folder_label(F.col("rebased")).alias("folder"))


def class_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the languages and the sources have the rows that a split needs, and the evaluation that fits the table."""
    rows = _documents(spark, d)
    scored = rows.select(F.lit(1).alias("y_true"), F.lit(0.5).alias("score"))
    found = [("lang", projecting.smallest_class(rows, "lang", 60), projecting.evaluation_mode(scored)), ("source", projecting.smallest_class(rows, "source", 2), projecting.evaluation_mode(scored))]
    return spark.createDataFrame(found, "label string, enough boolean, mode string")


def best_of_languages(spark: SparkSession, d: str) -> DataFrame:
    """The longest document; of equally long ones the first."""
    return projecting.best_of(_documents(spark, d), "n_chars", "doc_id").select("doc_id", "n_chars")


def sorted_head(spark: SparkSession, d: str) -> DataFrame:
    """The first documents in the order of source and id, and their languages' numbers in falling order."""
    head = _documents(spark, d).orderBy("source", "doc_id").limit(25)
    counts = head.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "lang")).cast("long"))  # at most as many rows as languages


def capped_examples(spark: SparkSession, d: str) -> DataFrame:
    """At most three example ids for each source and language."""
    place = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    return _documents(spark, d).withColumn("place", place.cast("long")).where("place <= 3").select("source", "lang", "doc_id", "place")


def append_resume(spark: SparkSession, d: str) -> DataFrame:
    """What a resumed run adds to a log that holds the labelled documents, together with that log."""
    log = table(spark, d, "labels").select("doc_id")
    added = auditing.append_missing(log, _documents(spark, d), "doc_id")
    return added.select("doc_id", F.lit("added").alias("state")).union(log.select("doc_id", F.lit("there").alias("state")))


def realign(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows that could be read, in agreement with their features' keys; another set of keys raises."""
    features = table(spark, d, "labels").select("doc_id", "quality")
    kept = _documents(spark, d).join(features.select("doc_id"), "doc_id", "left_semi")
    projecting.assert_same_rows(kept, features, ["doc_id"])
    return kept.join(features, "doc_id").select("doc_id", "lang", "quality")


def frame_unions(spark: SparkSession, d: str) -> DataFrame:
    """Split frames as one table; classes that two populations share; all classes once, in order."""
    rows = splitting.assign_splits(_documents(spark, d), "doc_id", "lang")
    parts = [rows.where(F.col("split") == s).select("doc_id", "source", "split") for s in ("train", "val", "test")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    shared = whole.where("split = 'val'").select("source").intersect(whole.where("split = 'test'").select("source"))
    sizes = whole.groupBy(F.col("split").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.union(shared.agg(F.lit("shared").alias("name"), F.count(F.lit(1)).alias("n"))).union(whole.select("source").distinct().agg(F.lit("sources").alias("name"), F.count(F.lit(1)).alias("n")))


def file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Languages' detection counts through the CSV writer and both readers, in the folder that all executors share."""
    path = new_path(spark, "round-trip")
    counts = _documents(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("most"))
    readers.write_csv(counts, path)
    text = readers.read_strings(spark, path)
    return text.select("lang", F.col("n").cast("long").alias("n"), F.col("most").cast("long").alias("most"))


def model_reload(spark: SparkSession, d: str) -> DataFrame:
    """A linear SVM that is saved and loaded again scores as before: how many test rows differ."""
    rows = learning.as_vectors(splitting.assign_splits(table(spark, d, "embeddings"), "vec_id", "label").withColumn("y_true", (F.col("label") >= 5).cast("int")), "embedding")
    model = learning.fit_linear_svm(rows.where("split = 'train'"), "y_true")
    path = new_path(spark, "model")
    model.write().save(path)
    test = rows.where("split = 'test'")
    before = learning.margins(model, test).select("vec_id", F.col("score").alias("before"))
    after = learning.margins(learning.PipelineModel.load(path), test).select("vec_id", "score")
    return before.join(after, "vec_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("before") - F.col("score")) > 1e-12).alias("n_differ"))


def table_signature(spark: SparkSession, d: str) -> DataFrame:
    """Order-free digests of two tables, the key of what is cached for them."""
    docs = readers.table_digest(_documents(spark, d)).select(F.lit("documents").alias("name"), "*")
    return docs.unionByName(readers.table_digest(table(spark, d, "labels").select("doc_id", "quality", "toxic")).select(F.lit("labels").alias("name"), "*"))


def metrics_files(spark: SparkSession, d: str) -> DataFrame:
    """The figures of one metrics file for each language, written by Spark and read back as documents of any kind."""
    rows = scoring.detection_metrics(spark, d).select("lang", F.to_json(F.struct(F.struct("n", "accuracy", "balanced_accuracy", "macro_f1").alias("overall"))).alias("value"))
    path = new_path(spark, "metrics")
    # a file for each language
    rows.repartition("lang").write.option("maxRecordsPerFile", 1).partitionBy("lang").option("compression", "none").text(path)
    renamed = readers.metrics_report(spark, path, "*.txt")
    return renamed.select(F.regexp_extract("file", "lang=([^/]*)/", 1).alias("lang"), "kind", "path", F.col("value"))


QUERIES = {
    f.__name__: f
    for f in (
        prefix_filter,
        contains_filter,
        mask_algebra,
        label_mapping,
        first_maximum,
        manifest_columns,
        caption_lookup,
        truth_resolution,
        external_predictions,
        in_set_precedence,
        occurrence_index,
        unreadable_counts,
        sidecar_union,
        generation_groups,
        lineage_rebase,
        class_gate,
        best_of_languages,
        sorted_head,
        capped_examples,
        append_resume,
        realign,
        frame_unions,
        file_round_trip,
        model_reload,
        table_signature,
        metrics_files,
    )
}

_HASH = "(cast('0x' || substr(sha256('{seed}:' || cast({key} as varchar)), 1, 16) as ubigint)::double / 18446744073709551616.0::double)"
_SPLIT = """
k as (select doc_id, source, lang, substr(sha256('42:' || doc_id), 1, 16) k from documents),
r as (select *, row_number() over (partition by lang order by k, doc_id) r, count(*) over (partition by lang) n from k),
w as (select doc_id, source, case when r <= round_even(n * 0.2::double, 0) then 'test' when r <= round_even(n * 0.2::double, 0) + round_even(n * 0.1::double, 0) then 'val' else 'train' end split from r)"""


def _digest_sql(name: str, rows: str, columns: list[str]) -> str:
    text = " || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in columns)
    number = lambda at: f"(coalesce(sum(cast('0x' || substr(h, {at}, 16) as ubigint)::hugeint), 0) % 18446744073709551616::hugeint)::varchar"
    return f"select '{name}' as name, count(*) n, {number(1)} high, {number(17)} low from (select sha256({text}) h from {rows})"


ORACLES = {
    "table_signature": f"{_digest_sql('documents', 'documents', ['doc_id', 'lang', 'source', 'n_chars'])} union all {_digest_sql('labels', 'labels', ['doc_id', 'quality', 'toxic'])}",
    "metrics_files": f"""with m as ({scoring.ORACLES["detection_metrics"]}), u as (select lang, 'overall.accuracy' path, accuracy as value from m union all select lang, 'overall.balanced_accuracy', balanced_accuracy from m union all select lang, 'overall.macro_f1', macro_f1 from m)
select lang, 'detection' kind, path, value from u""",
    "prefix_filter": "select page_id, url from pages where starts_with(url, 'https://')",
    "contains_filter": "select doc_id, source from documents where contains(lower(source), 'rc1')",
    "mask_algebra": "select doc_id, lang from documents where (lang in ('de', 'fr') and not coalesce(n_chars > 1000, false)) or (lang not in ('de', 'fr') and coalesce(n_chars > 1000, false) and source <> 'src3')",
    "label_mapping": "select doc_id, case when source in ('src0', 'src1', 'src2') then 'real' else source end source_class, case lang when 'de' then 'German' when 'en' then 'English' else lang end display, (list_position(['de', 'en', 'es', 'fr'], lang) - 1)::integer y from documents where lang in ('de', 'en', 'es', 'fr')",
    "first_maximum": "select vec_id, (list_position(embedding, list_max(embedding)) - 1)::integer place, round(list_max(embedding)::double, 6) most from embeddings",
    "manifest_columns": "select page_id, url full_path, case when page_id % 3 = 0 then 'g' || (page_id % 7) else 'real' end category, 'pages' dataset, coalesce(length(html), -1)::integer size from pages where url is not null",
    "caption_lookup": """
with r as (select conv_id || ':' || turn full_path, case when turn > 0 then conv_id || ':0' end source_path from conversations),
c as (select conv_id || ':' || turn path, max(substr(text, 1, 20)) caption from conversations where turn = 0 and role = 'user' group by 1)
select full_path, source_path, coalesce(caption, '') blip_caption from r left join c on c.path = coalesce(source_path, full_path)""",
    "truth_resolution": "select d.doc_id, lang, quality from documents d join labels l on l.doc_id = d.doc_id",
    "external_predictions": f"select d.doc_id, case when l.doc_id is not null then round({_HASH.format(seed=21, key='l.doc_id')}, 6) end other_score from documents d left join labels l on l.doc_id = d.doc_id",
    "in_set_precedence": "select doc_id, lang, case doc_id % 5 when 0 then true when 1 then false else lang in ('de', 'en') end in_set from documents",
    "occurrence_index": "select event_id, user_id, (n // 4)::integer turn, (n % 4)::integer as use from (select event_id, user_id, row_number() over (partition by user_id order by event_id) - 1 n from events)",
    "unreadable_counts": "select lang, count(*) n from documents where doc_id not in (select doc_id from labels) group by lang",
    "sidecar_union": "select cast(doc_id as varchar) path, case when doc_id % 8 = 0 then 'new-' || lang else source end grp from documents",
    "generation_groups": "select distinct unnest([conv_id || ':0', conv_id || ':' || turn]) full_path, 'c' || conv_id source_image_id from conversations where turn > 0",
    "lineage_rebase": "select page_id, rebased, string_split(rebased, '/')[-2] folder from (select page_id, regexp_replace(split_part(url, '?', 1), '^https?://[^/]+/', '/data/') rebased from pages)",
    "class_gate": "select 'lang' as label, min(n) >= 60 enough, 'frequency' as mode from (select count(*) n from documents group by lang) union all select 'source', min(n) >= 2, 'frequency' from (select count(*) n from documents group by source)",
    "best_of_languages": "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 1",
    "sorted_head": "select lang, n, row_number() over (order by n desc, lang) place from (select lang, count(*) n from (select lang from documents order by source, doc_id limit 25) group by lang)",
    "capped_examples": "select source, lang, doc_id, place from (select *, row_number() over (partition by source, lang order by doc_id) place from documents) where place <= 3",
    "append_resume": "select doc_id, 'added' state from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'there' from labels",
    "realign": "select d.doc_id, lang, quality from documents d join labels l on l.doc_id = d.doc_id",
    "frame_unions": f"with {_SPLIT} select split as name, count(*) n from w group by split union all select 'shared', count(*) from (select source from w where split = 'val' intersect select source from w where split = 'test') union all select 'sources', count(distinct source) from w",
    "file_round_trip": "select lang, count(*) n, max(n_chars) most from documents group by lang",
    "model_reload": """
with k as (select vec_id, label, substr(sha256('42:' || vec_id), 1, 16) k from embeddings), r as (select *, row_number() over (partition by label order by k, vec_id) r, count(*) over (partition by label) n from k)
select count(*) n, 0::bigint n_differ from r where r <= round_even(n * 0.2::double, 0)""",
}
