"""From documents to packed training sequences, in five stages.

Each stage is written as Parquet and read again by the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from codemap_spark.llm import common, exact_dedup, near_dedup, packing, quality, secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at least 0.7 stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    return quality.score(docs, model, keep=COLUMNS).where(F.col("__predicted") == 1).select(*COLUMNS)


def _one_of_each(docs: DataFrame, key, chosen: DataFrame) -> DataFrame:
    """The documents whose id (null counts as a value) and ``key`` are among
    ``chosen``'s doc_id and __key; of rows equal in both, one."""
    rows = docs.withColumn("__key", key)
    chosen = common.materialise(chosen.distinct(), "chosen")
    kept = rows.join(chosen.withColumnsRenamed({"doc_id": "__id", "__key": "__chosen"}), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__chosen")), "left_semi")
    if not rows.groupBy("doc_id", "__key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__key"])
    return kept.select(*COLUMNS)


def keep_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; null ids are smallest."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = exact_dedup.exact_duplicates(docs).where("kept").select("doc_id", F.col("text_sha256").alias("__key"))
    return _one_of_each(docs, F.sha2(lower, 256), found)


def keep_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    found = near_dedup.near_duplicate_groups(docs, similarity=near_dedup.EDITED).where("kept").select("doc_id", F.col("text_md5").alias("__key"))
    return _one_of_each(docs, F.md5(F.coalesce("text", F.lit("")).cast("binary")), found)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span is replaced by a mark; all documents stay."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_exact),
    ("near dedup", keep_near),
    ("secret scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Weighted sampling, the line field and the tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
