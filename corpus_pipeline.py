"""The training-data pipeline: five stages over `documents`, each one operator of sievekit.llm.

Every stage works on all that the stage before it kept. Stages 1 to 4 return the
columns of documents; the last one returns what encoding and decoding give. All
of them judge rows, not ids: rows that share an id or have none stay or go by
their own texts. A near-duplicate group keeps a row without an id only where the
whole group has no id, and of rows that repeat id and text it keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import bpe, contamination, neardup, privacy, rules
from sievekit.llm.common import forget, read, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps."""
    return rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest id, a null id counting as the largest."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return contamination.clean(docs, read(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text."""
    fitted = privacy.fit(docs)
    rows = privacy.redact(docs, fitted)
    return rows.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else rows


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with token counts and digests of the ids and of the decoded text."""
    columns = [c for c in ("doc_id", "lang", "source", "text") if c in docs.columns]
    return bpe.digests(docs.select(*columns), bpe.default_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_neardup", near_duplicates),
    ("decontamination", decontamination),
    ("privacy", redaction),
    ("bpe", encoding),
]

#: Latent retrieval and boosted trees have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
