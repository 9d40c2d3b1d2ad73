"""What the operators share: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of one Arrow batch sent to Python; keeps a batch of long texts small.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, as texts can be very long.  The
    setting stays, as results are computed after the operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder replaces it only where the setting is absent (tests on
    one machine).
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="codemap-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def codes_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of every value in order of first appearance, distinct values), by
    Arrow's hash table: pandas would cost each worker some 50 MB."""
    found = pa.array(values).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_numpy(zero_copy_only=False)


#: At most so many keys can hold more than this share of the rows.
HOT_KEYS = 1024


def join_counted(big: DataFrame, small: DataFrame, key: str, count: str, rows: int) -> DataFrame:
    """``big`` joined with ``small``, which has every key (a number, binary
    or a hex string) once and in ``count`` how many of the ``rows`` rows of ``big`` hold it (or
    more than that).

    Keys above rows / HOT_KEYS, of which there are at most HOT_KEYS times the
    overcount, are named in the plan and sent to every task, so no task gets
    all the rows of a hot key; the others are joined by shuffle.  Null keys
    don't join.  ``big`` is read twice if there are hot keys.
    """
    hot = small.where(F.col(count) > rows // HOT_KEYS)
    keys = [r[0] for r in hot.select(key).collect()]
    if not keys:
        return big.join(small, key)
    listed = ",".join(f"'{k}'" if isinstance(k, str) else f"{k}L" if isinstance(k, int) else f"X'{bytes(k).hex()}'" for k in keys)
    is_hot = F.expr(f"`{key}` IN ({listed})")
    return big.where(is_hot).join(F.broadcast(hot), key).unionByName(big.where(~is_hot).join(small.where(F.col(count) <= rows // HOT_KEYS), key))


#: On a local file system (one machine, or a mounted shared folder) every file
#: with a side file of checksums starts four processes that set rights; without
#: it, two.  Other file systems don't read these settings.
LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialise(df: DataFrame, name: str, *partition_by: str, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors and is computed once.  A ``small`` table, a few
    numbers a row and cheap to finish, is written by a 64th of the shuffle
    partitions, as each file costs calls to the file system.  The folder's
    owner removes what is left in it when the results have been written."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    if small:
        df = df.coalesce(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 64))
    writer = df.write.mode("errorifexists").option("compression", "zstd").options(**LOCAL_FILES)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialise`` that nothing reads any more."""
    for table in tables:
        session = table.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table._shared_path)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps now: it
    follows the driver's garbage collector, which may take half an hour.  Twice,
    as the last job is held until the first collection has been seen."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def id_crc32(col: str):
    """CRC-32 of the id's decimal text, as the held-out rule wants it."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def held_out(col: str):
    return F.coalesce(id_crc32(col) % 4 == 2, F.lit(False))


def splitmix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def binary_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    raw = array.buffers()
    width = np.int64 if large else np.int32
    if len(array) == 0 or raw[1] is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(raw[1], width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str, max_bytes: int = (1 << 21) - 1):
    """The rows of Arrow batches again, in batches whose ``column`` has at most
    ``max_bytes`` bytes (a longer value stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = binary_buffer(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + max_bytes, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def by_bytes(rows: list, size, most: int = 1 << 20):
    """Lists of rows, in order, of at most ``most`` bytes by ``size`` (a longer
    row stands alone)."""
    part, held = [], 0
    for row in rows:
        n = size(row)
        if part and held + n > most:
            yield part
            part, held = [], 0
        part.append(row)
        held += n
    if part:
        yield part


def trim() -> None:
    """Give memory that this process has freed back to the system: a worker
    waits for its next task with what it once needed, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to give back this way
