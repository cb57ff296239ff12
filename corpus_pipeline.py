"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import anchors, packing, pii, quality, simhash
from spindrift.session import shared_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the forest finds anomalous go; see ``quality.judge`` for edge rows."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays; see ``simhash.keep_one`` for edge rows."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 20 words that start earlier are cut out of the texts; texts without any stay as they are, nulls too.

    All rows stay, also those whose text becomes empty. n_chars is that of the new text.
    """
    names = docs.columns
    # Plain names, so that no column clashes with what the operator adds.
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    body = f"_c{names.index('text')}"
    cut = anchors.remove_repeats(plain, f"_c{names.index('doc_id')}", body)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(body))
    return _counted(cut.withColumn(body, text).select(*plain.columns).toDF(*names))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; all rows stay. n_chars is that of the new text."""
    return _counted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as pieces of sequences of 1,024 ids."""
    return packing.pack(docs, BPE)


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars counted anew where it was known."""
    if "n_chars" not in docs.columns:
        return docs
    n = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), n))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packed),
]

#: SQL has no XXH64 with a seed, no byte-level tokenizer and no forest, so the pipeline is tested in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
