"""Token counts through a digest cache.

A text's normal form (white space as the tokenizer's own normaliser leaves it)
has a digest; with the digest of the vocabulary file it is the key of a cache
table in a shared folder.  Known keys are joined, each distinct unknown text is
encoded once and its count appended to the cache.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from .common import LOCAL_FILES, join_counted, materialise, prepare, slices
from .vocabulary import encoder, version

CACHE_SCHEMA = "digest binary, version string, n_tokens bigint"


def _normal_form(text, path: str):
    """White-space runs shrink only for tokenizers that shrink them themselves."""
    with open(path, encoding="utf-8") as f:
        normalizer = json.dumps(json.load(f).get("normalizer"))
    if '"\\\\s+"' not in normalizer:
        return text
    return F.when(text.rlike(r"[\t\n\x0B\f\r]|  "), F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")).otherwise(text)


def read_cache(spark, cache_path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(f"{cache_path.rstrip('/')}/*")
    except AnalysisException:
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit: one row per input row.

    Null text counts as empty (0 bytes, 0 tokens), repeated rows repeat, an
    empty table gives an empty one.  Other columns aren't read.  Each append is
    a folder of its own, committed by Spark's writer, so a lost executor or a
    failed run leaves no half-written counts; should two runs append a digest
    twice, the reader takes one of the equal counts.  Very common texts are
    joined by sending their counts to every task.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = version(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(_normal_form(text, tokenizer_path).cast("binary"), 256))
    known = read_cache(spark, cache_path).where(F.col("version") == own).select("digest")
    unknown = docs.select(digest.alias("digest"), text.alias("text"))
    if not known.isEmpty():
        unknown = unknown.join(known.distinct(), "digest", "left_anti")
    misses = unknown.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches):
        tokens = encoder(tokenizer_path)
        for batch in slices(batches, "text"):
            n = tokens.count_batch(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([own] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "version", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.options(**LOCAL_FILES).parquet(f"{cache_path.rstrip('/')}/append-{uuid.uuid4().hex}")
    keyed = materialise(docs.select(F.col(id_col), F.octet_length(text).cast("bigint").alias("n_bytes"), digest.alias("digest")), "token-keys")
    cached = read_cache(spark, cache_path).where(F.col("version") == own).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = materialise(keyed.groupBy("digest").agg(F.count("*").alias("rows")).join(cached, "digest"), "token-counts", small=True)
    found = join_counted(keyed, counts, "digest", "rows", keyed.count())
    return found.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
