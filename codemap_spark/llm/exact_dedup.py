"""Exact deduplication with an extendible-hash index on shared files.

Texts are normalised by lower-casing A-Z.  The first 64 bits of the SHA-256 of
the normal form are the index key.  A directory over the leading bits of the
key doubles until no bucket is overfull (or only one key is left in it); each
owner task inserts the texts of a contiguous key range, chains texts whose keys
collide and compares their bytes.  Copies are combined before the shuffle, so
a text with a third of all rows reaches its owner once per map task.  The
buckets (``entries``) and the ``directory`` are Parquet tables in the shared
folder.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOCAL_FILES, join_counted, materialise, prepare, shared_path, slices

#: Bucket capacity in bytes, and the most slots of a directory.  Beyond
#: BUCKET_BYTES * MAX_SLOTS / 4 bytes of text the capacity grows instead, so
#: the directory stays small enough to be sent to every task.
BUCKET_BYTES = 4 << 20
MAX_SLOTS = 1 << 20
#: Bytes of text that one owner task inserts, some buckets after another.
OWNER_BYTES = 32 << 20


class Directory:
    """Extendible-hash directory over a histogram of key prefixes.

    ``slots[prefix]`` is the bucket of a key whose leading ``depth`` bits are
    ``prefix``; buckets are numbered in key order.
    """

    def __init__(self, histogram: np.ndarray, capacity: int) -> None:
        most = int(math.log2(len(histogram)))
        totals = [histogram.astype(np.int64)]
        while len(totals[-1]) > 1:
            totals.append(totals[-1].reshape(-1, 2).sum(1))
        totals.reverse()  # totals[d][prefix of d bits]
        self.depth, local = 0, np.zeros(1, np.int64)
        while self.depth < most:
            width = local == self.depth
            over = width & (totals[self.depth] > capacity)
            if not over.any():
                break
            # the directory doubles; only buckets at full depth that are over capacity split
            local = np.repeat(local, 2)
            self.depth += 1
            local[np.repeat(over, 2)] = self.depth
        self.local = local
        prefix = np.arange(len(local)) >> (self.depth - local)
        new = np.ones(len(local), bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (local[1:] != local[:-1])
        self.slots = np.cumsum(new) - 1
        self.buckets = int(self.slots[-1]) + 1

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        """Buckets of unsigned 64-bit keys."""
        return self.slots[(keys >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(keys), np.int64)


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame, str]:
    """(keys of all rows, index entries, path of the index).

    Keys: id, digest, n_bytes.  Entries: one per distinct normalised text, with
    bucket, chain position, key, digest, keep_id, group_size and the text.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            texts = [x.lower() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), pa.array(list(map(len, texts)), pa.int64())],
                names=["id", "digest", "n_bytes"],
            )

    keys = materialise(source.mapInArrow(digest, f"id {id_type}, digest binary, n_bytes bigint"), "dedup-keys")
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    capacity = max(bucket_bytes, 4 * total // MAX_SLOTS)
    bits = min(int(math.log2(MAX_SLOTS)), max(4, math.ceil(math.log2(max(1, total / capacity))) + 3))
    # at most 2**bits counters, whatever the input
    prefix = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint"), 32 - bits)
    histogram = np.zeros(1 << bits, np.int64)
    for p, n in keys.groupBy(prefix.alias("p")).agg(F.sum(F.col("n_bytes") + 64).alias("n")).collect():
        histogram[p] = n
    directory = Directory(histogram, capacity)
    per_owner = max(1, OWNER_BYTES // capacity)
    owners = -(-directory.buckets // per_owner)

    def combine(batches):
        """Copies within the task become one row; flushed when it holds much."""
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            digests = list(held)
            k = _keys(digests)
            b = directory.bucket(k)
            for i in range(0, len(digests), 256):
                part = [held[d] for d in digests[i : i + 256]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b[i : i + 256] // per_owner, pa.int32()), pa.array(b[i : i + 256], pa.int64()), pa.array(k[i : i + 256].view(np.int64), pa.int64()),
                        pa.array(digests[i : i + 256], pa.binary()), pa.array([x[0] for x in part], pa.binary()), pa.array([x[1] for x in part], id_arrow), pa.array([x[2] for x in part], pa.int64()),
                    ],
                    names=["owner", "bucket", "key", "digest", "text", "keep_id", "group_size"],
                )

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field("id").type
            for i, raw in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = raw.lower()
                d = hashlib.sha256(text).digest()
                entry = held.get(d)
                if entry is None:
                    held[d] = [text, i, 1]
                    size += len(text) + 200
                else:
                    if entry[0] != text:
                        raise ValueError("two texts share a SHA-256 digest")
                    entry[1] = max(entry[1], i, key=lambda x: (x is not None, x or 0))
                    entry[2] += 1
            if size > 32 << 20:
                yield from flush()
                held, size = {}, 0
        if held:
            yield from flush()

    def insert(batches):
        """One owner: rows come by key, so only the chain of one key is held."""
        key, chain = None, []

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        names = ["bucket", "chain", "key", "digest", "keep_id", "group_size", "text"]
        types, done = None, []
        held = 0
        for batch in slices(batches, "text"):
            types = types or [pa.int64(), pa.int32(), pa.int64(), pa.binary(), batch.schema.field("keep_id").type, pa.int64(), pa.binary()]
            columns = [batch.column(c).to_pylist() for c in ("bucket", "key", "digest", "text", "keep_id", "group_size")]
            for bucket, k, d, text, keep, n in zip(*columns, strict=True):
                if k != key:
                    done += chain
                    key, chain = k, []
                    if held > 4 << 20:
                        yield emit(done)
                        done, held = [], 0
                for entry in chain:
                    if entry[6] == text:
                        entry[4] = max(entry[4], keep, key=lambda x: (x is not None, x or 0))
                        entry[5] += n
                        break
                else:
                    if any(entry[3] == d for entry in chain):
                        raise ValueError("two texts share a SHA-256 digest")
                    chain.append([bucket, len(chain), k, d, keep, n, text])
                    held += len(text) + 200
        done += chain
        if done:
            yield emit(done)

    combined = source.mapInArrow(combine, f"owner int, bucket bigint, key bigint, digest binary, text binary, keep_id {id_type}, group_size bigint")
    owned = combined.repartitionById(owners, F.col("owner")).drop("owner").sortWithinPartitions("key")
    path = shared_path(spark, "dedup-index")
    schema = f"bucket bigint, chain int, key bigint, digest binary, keep_id {id_type}, group_size bigint, text binary"
    owned.mapInArrow(insert, schema).write.option("compression", "zstd").options(**LOCAL_FILES).parquet(f"{path}/entries")
    spark.createDataFrame(
        [(int(i), int(b), int(directory.depth), int(x)) for i, (b, x) in enumerate(zip(directory.slots, directory.local, strict=True))], "slot bigint, bucket bigint, depth int, local_depth int"
    ).coalesce(1).write.parquet(f"{path}/directory")
    return keys, spark.read.schema(schema).parquet(f"{path}/entries"), path


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256: one row per input row.

    Null text counts as empty; equal texts keep the row with the largest id
    (rows that repeat an id all count, and all of the kept id are kept; null
    ids are the smallest); an empty table gives an empty one; other columns
    aren't read.  Texts with over a HOT_KEYS-th of all rows are joined by
    sending them to every task, so none gets all of their rows.
    """
    keys, entries, _ = build_index(docs, id_col, text_col, bucket_bytes)
    groups = entries.select("digest", "keep_id", "group_size")
    return join_counted(keys, groups, "digest", "group_size", keys.count()).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
