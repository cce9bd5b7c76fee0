"""Readers and writers of the tables that evaluation stages exchange, with declared schemas."""

from __future__ import annotations

import functools
import hashlib
import json
import operator
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

MANIFEST = "filename string, full_path string, label string, generator string, category string, source_dataset string, width int, height int"
DETECTOR = f"{MANIFEST}, defake_predict int, prob_real double, prob_fake double, blip_caption string"
FREQUENCY = "full_path string, generator string, y_true int, score double, pred int"
ATTRIBUTION = "full_path string, true_generator string, pred_generator string, confidence double, entropy double, group_id string, in_set string"
SIDECAR = "full_path string, source_image_id string"
ANNOTATIONS = "images array<struct<id:bigint,file_name:string>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<int>>>"


def read_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header, by declared types; the header is matched by name, and missing required columns raise."""
    header = spark.read.text(path).limit(1).first()
    names = [] if header is None else [c.strip().strip('"') for c in header[0].split(",")]
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"{path}: missing columns {missing}")
    kinds = dict(f.split(" ", 1) for f in (x.strip() for x in re.split(r",\s*(?![^<]*>)", schema)))
    rows = spark.read.option("header", True).schema(", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in names)).csv(path)
    return rows


def read_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Every column as text."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return read_strings(spark, path, sep="\t")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV export with a header; single collects a small result in one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def read_boolean(column: Column) -> Column:
    """true/1/yes and false/0/no in any case; anything else is null."""
    text = F.lower(F.trim(column.cast("string")))
    return F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False)


def scan_images(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg}", exclude: str | None = None, recursive: bool = True) -> DataFrame:
    """Image files with their sizes; -1 marks those that can't be read. Files under an excluded name pattern are left out."""
    rows = spark.read.format("image").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).option("dropInvalid", False).load(folder)
    rows = rows.select(F.col("image.origin").alias("full_path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    rows = rows.withColumn("filename", F.substring_index("full_path", "/", -1))
    return rows if exclude is None else rows.where(~F.col("filename").rlike(exclude))


def folder_label(path: Column) -> Column:
    """The folder that a file stands in."""
    return F.element_at(F.split(path, "/"), -2)


def read_annotations(spark: SparkSession, path: str, real: int = 0) -> DataFrame:
    """(split, annotation_id, image_id, file_name, label, bbox) from polygon files; ids are unique inside one split only."""
    files = spark.read.schema(ANNOTATIONS).option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("file"))
    files = files.withColumn("split", F.regexp_extract("file", r"^([A-Za-z]+)", 1))
    images = files.select("split", F.explode("images").alias("i")).select("split", F.col("i.id").alias("image_id"), F.col("i.file_name").alias("file_name"))
    marks = files.select("split", F.explode("annotations").alias("a")).select("split", F.col("a.id").alias("annotation_id"), F.col("a.image_id").alias("image_id"), F.when(F.col("a.category_id") == real, "real").otherwise("fake").alias("label"), F.col("a.bbox").alias("bbox"))
    return marks.join(images, ["split", "image_id"], "left")


def clamp_box(bbox: Column, width: Column, height: Column, margin: float = 0.0) -> Column:
    """(left, top, right, bottom) of an [x, y, w, h] box with a margin, inside the image."""
    x, y, w, h = (F.get(bbox, F.lit(i)).cast("double") for i in range(4))
    edge = lambda v, most: F.greatest(F.lit(0), F.least(F.rint(v).cast("int"), most))
    return F.struct(edge(x - w * margin, width).alias("left"), edge(y - h * margin, height).alias("top"), edge(x + w * (1 + margin), width).alias("right"), edge(y + h * (1 + margin), height).alias("bottom"))


def generation_groups(metadata: DataFrame) -> DataFrame:
    """(full_path, source_image_id): two rows for each record, source and output; conflicting identities raise."""
    rows = metadata.select(F.explode(F.array("source_image", "output_path")).alias("full_path"), F.col("source_identity").alias("source_image_id")).distinct()
    grouped = rows.groupBy("full_path").agg(F.min("source_image_id").alias("source_image_id"), F.count(F.lit(1)).alias("n"))
    if n := grouped.where("n > 1").count():
        raise ValueError(f"{n} paths have several identities")
    return grouped.drop("n").orderBy("full_path")


def signature(parts: dict[str, bytes], parameters: dict) -> str:
    """sha256 over named contents and parameters: the key of a feature cache."""
    h = hashlib.sha256()
    for name in sorted(parts):
        h.update(f"{name}:{hashlib.sha256(parts[name]).hexdigest()};".encode())
    h.update(json.dumps(parameters, sort_keys=True).encode())
    return h.hexdigest()


def table_digest(df: DataFrame) -> DataFrame:
    """(n, high, low): the number of rows and two 64-bit sums of row digests, which don't depend on the order of rows or files.

    A row's digest is the sha256 of its values, each as text with its length, or
    a mark for null; nested values count as JSON. Tasks add digests up, so a
    table of any size gives one row. Repeated rows count as often as they occur.
    """
    text = lambda f: F.to_json(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.base64(f.name) if isinstance(f.dataType, BinaryType) else F.col(f"`{f.name}`").cast("string")
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in map(text, df.schema.fields)]
    digest = F.sha2(F.concat(*parts) if parts else F.lit(""), 256)
    number = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")
    whole = lambda at: F.coalesce(F.sum(number(at)), F.lit(0)).cast("decimal(38,0)") % F.lit(str(1 << 64)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), whole(1).cast("decimal(20,0)").cast("string").alias("high"), whole(17).cast("decimal(20,0)").cast("string").alias("low"))


def table_signature(df: DataFrame, parameters: dict) -> str:
    """The key of a feature cache: sha256 over the columns, the table's digest and the parameters. It changes with any cell, and not with the order of files."""
    row = table_digest(df).first()
    return signature({"columns": json.dumps(df.dtypes).encode(), "rows": f"{row.n}:{row.high}:{row.low}".encode()}, parameters)


def cached_features(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """Features under folder/key; made and written if that folder holds none."""
    path = f"{folder}/{key}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def metrics_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(file, document) of every metrics JSON under a folder; files that don't parse are left out."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.expr("try_parse_json(value)").alias("json"), F.col("value").alias("document")).where("json is not null").drop("json")


#: The kinds of metrics files, by file name and by a key that only they have.
METRICS_FILES = {
    "detection_metrics.json": "detection",
    "metrics.json": "svm",
    "attribution_metrics.json": "attribution",
    "finetune_metrics.json": "attribution",
    "logo_summary.json": "leave_one_out",
    "out_of_set_summary.json": "out_of_set",
    "cascade_metrics.json": "cascade",
}
#: For each kind, the paths of its figures, in which * stands for any key.
METRICS_PATHS = {
    "detection": ["overall.accuracy", "overall.balanced_accuracy", "overall.macro_f1", "overall.auroc"],
    "svm": ["test.balanced_accuracy", "test.macro_f1", "test.auroc"],
    "attribution": [f"{part}.{m}" for part in ("in_set", "out_of_set", "all_fakes", "test") for m in ("top1_accuracy", "macro_f1", "balanced_accuracy")],
    "leave_one_out": ["*.n_held_out", "*.mean_confidence", "*.mean_entropy", "*.forced_label_distribution.*"],
    "out_of_set": [f"*.{part}.{m}" for part in ("in_set", "out_of_set") for m in ("mean_confidence", "n")],
    "cascade": ["known_fake.n", "known_fake.n_detected", "known_fake.conditional_attribution.top1_accuracy", "known_fake.end_to_end_attribution.top1_accuracy"],
}


def metrics_report(spark: SparkSession, folder: str, names: str = "*.json") -> DataFrame:
    """(file, kind, path, value): the figures of every metrics JSON under a folder, a row each, whatever their kind.

    A file's kind is that of its name, or else what its keys show; other
    documents have no rows. Files that don't parse have one row of the kind
    `unparsable`, without a path.
    """
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.expr("try_parse_json(value)").alias("v"))
    bad = rows.where("v is null").select("file", F.lit("unparsable").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("double").alias("value"))
    good = rows.where("v is not null").select("file", "v", _metrics_kind(F.substring_index("file", "/", -1)).alias("kind")).where("kind is not null")
    # figures lie at most three keys deep
    at = good.select("file", "kind", F.array().cast("array<string>").alias("path"), "v")
    found = None
    for _ in range(3):
        inner = spark.tvf.variant_explode(F.col("v").outer())
        at = at.where("schema_of_variant(v) like 'OBJECT%'").lateralJoin(inner).select("file", "kind", F.concat("path", F.array("key")).alias("path"), F.col("value").alias("v"))
        leaves = at.select("file", "kind", "path", F.expr("try_variant_get(v, '$', 'double')").alias("value")).where("value is not null")
        found = leaves if found is None else found.unionByName(leaves)
    wanted = F.lit(False)
    for kind, paths in METRICS_PATHS.items():
        for keys in (p.split(".") for p in paths):
            same = [F.get("path", F.lit(i)) == k for i, k in enumerate(keys) if k != "*"]
            wanted = wanted | functools.reduce(operator.and_, same, (F.col("kind") == kind) & (F.size("path") == len(keys)))
    return found.where(wanted).withColumn("path", F.array_join("path", ".")).unionByName(bad)


def _metrics_kind(name: Column) -> Column:
    kind = F.when(F.lit(False), "")
    for file, k in METRICS_FILES.items():
        kind = kind.when(name == file, k)
    has = lambda path: F.expr(f"is_variant_null(try_variant_get(v, '{path}', 'variant')) = false")
    shown = F.when(has("$.overall"), "detection").when(has("$.known_fake"), "cascade")
    for part in ("in_set", "out_of_set", "all_fakes", "test"):
        shown = shown.when(has(f"$.{part}.top1_accuracy"), "attribution")
    return F.coalesce(kind, shown.when(has("$.test"), "svm"))


def metrics_json(row: DataFrame) -> str:
    """One row of metrics as JSON."""
    return row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]


def read_config(path: str, env: dict[str, str] | None = None):
    """A JSON or YAML file of nested values with its ${NAME}s replaced; a YAML file needs the yaml package."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        return resolve_config(json.loads(text), env)
    import yaml

    return resolve_config(yaml.safe_load(text), env)


def resolve_config(values, env: dict[str, str] | None = None):
    """Replaces ${NAME} in strings of nested values; the environment wins, and a missing name is a KeyError."""
    env = dict(os.environ) if env is None else env
    if isinstance(values, dict):
        return {k: resolve_config(v, env) for k, v in values.items()}
    if isinstance(values, list):
        return [resolve_config(v, env) for v in values]
    return re.sub(r"\$\{(\w+)\}", lambda m: env[m[1]], values) if isinstance(values, str) else values
