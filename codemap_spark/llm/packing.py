"""Sequence packing along a space-filling curve.

A document's hashed token vector is projected to three dimensions; the cells
of the projection are numbered along a Hilbert curve.  Documents are ranged by
that number, and the tokens of neighbours along the curve fill sequences one
after another.  What is left at the end of a range is cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, slices, splitmix
from .vocabulary import encoder

DIMENSIONS, BITS, BUCKETS = 3, 12, 1024
#: Rows that the range bounds are fitted on, tokens of a range, and the most ranges.
SAMPLE_ROWS = 8_192
RANGE_TOKENS, MAX_RANGES = 8_000_000, 1 << 20


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (rows, dimensions),
    by Skilling's transposition (2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection() -> np.ndarray:
    """Gaussian rows of the hash buckets."""
    return np.random.default_rng(5).standard_normal((BUCKETS, DIMENSIONS))


def coordinates(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Projected unit vectors of hashed square-root term counts; zeros if empty."""
    n = len(offsets) - 1
    bucket = (splitmix(np.arange(1 << 17, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)[np.minimum(ids, (1 << 17) - 1)]
    out, table = np.zeros((n, DIMENSIONS)), _projection()
    step = 256
    for i in range(0, n, step):
        m = min(step, n - i)
        rows = np.repeat(np.arange(m), np.diff(offsets[i : i + m + 1]))
        counts = np.sqrt(np.bincount(rows * BUCKETS + bucket[offsets[i] : offsets[i + m]], minlength=m * BUCKETS).reshape(m, BUCKETS))
        norm = np.linalg.norm(counts, axis=1, keepdims=True)
        out[i : i + m] = (counts / np.maximum(norm, 1e-12)) @ table
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty (the end id alone); rows that repeat an id are
    packed each; an empty table gives an empty one; other columns aren't read.
    Range bounds come from about SAMPLE_ROWS documents, chosen by a hash of id
    and length, and lie between their keys where more ranges are wanted; every
    document is packed.  Equal keys are dealt by a hash of the id, so copies
    spread over ranges.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batch):
        ids, offsets = encoder(tokenizer_path).ids_batch(batch.column("text"))
        return ids, offsets, coordinates(ids, offsets)

    def sketch(batches):
        for batch in slices(batches, "text"):
            _, offsets, at = encode(batch)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets) + 1, pa.int64()), *(pa.array(at[:, i]) for i in range(DIMENSIONS))], names=["id", "n", "x", "y", "z"])

    rows = source.count()
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    fitted = source if share == 1.0 else source.where(F.pmod(F.xxhash64(F.lit(11), "id", F.char_length("text")), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = fitted.mapInArrow(sketch, "id bigint, n bigint, x double, y double, z double").toPandas()
    at = sample[["x", "y", "z"]].to_numpy()
    # cell bounds are the sample's quantiles, so that cells hold alike many documents
    edges = [np.unique(np.quantile(at[:, i], np.linspace(0, 1, 1 << 8)[1:-1])) if len(at) else np.zeros(0) for i in range(DIMENSIONS)]

    def curve(at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Hilbert position, then 24 bits of the id's hash: no ties to speak of."""
        cells = np.stack([np.searchsorted(edges[i], at[:, i], "right") << (BITS - 8) for i in range(DIMENSIONS)], 1)
        return (hilbert_key(cells) << 24) | (splitmix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(40)).astype(np.int64)

    sample_ids = sample["id"].fillna(0).to_numpy(np.int64)
    keys, weight = curve(at, sample_ids), sample["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    ranges = min(MAX_RANGES, max(1, round(weight.sum() / share / RANGE_TOKENS))) if len(keys) else 1
    passed = np.cumsum(weight[order])
    # between two keys of the sample the bounds are as far apart as the tokens wanted
    bounds = np.unique(np.interp(passed[-1] * np.arange(1, ranges) / ranges, passed, keys[order].astype(float)).astype(np.int64)) if ranges > 1 else np.zeros(0, np.int64)

    def tokens(batches):
        for batch in slices(batches, "text"):
            ids, offsets, at = encode(batch)
            small = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else None
            raw, width = (small.tobytes(), 2) if small is not None else (ids.astype("<u4").tobytes(), 4)
            own = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)
            key = curve(at, own)
            blobs = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((offsets * width).astype(np.int32).tobytes()), pa.py_buffer(raw)])
            part = np.searchsorted(bounds, key, "right")
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(key, pa.int64()), batch.column("id"), pa.array(np.full(len(own), width), pa.int32()), blobs], names=["part", "key", "id", "width", "ids"]
            )

    def fill(batches):
        """One range: sequences are filled in key order, one of them open."""
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        out: list[tuple] = []
        open_pieces: list[tuple] = []  # id, start, ids, doc_tokens
        room, sequence = max_tokens, 0

        def place(pieces):
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def record():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

        def tail():
            """Powers of two, largest first, over what the open sequence holds."""
            left, pieces = max_tokens - room, list(open_pieces)
            while left:
                size = 1 << (left.bit_length() - 1)
                take, need = [], size
                while need:
                    doc, start, ids, total = pieces.pop(0)
                    take.append((doc, start, ids[:need], total))
                    if len(ids) > need:
                        pieces.insert(0, (doc, start + need, ids[need:], total))
                    need -= min(need, len(ids))
                place(take)
                left -= size

        part = None
        for batch in slices(batches, "ids"):
            for p, doc, width, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "width", "ids")), strict=True):
                if p != part:
                    tail()
                    part, open_pieces, room, sequence = p, [], max_tokens, p << 32
                ids = np.append(np.frombuffer(blob, f"<u{width}").astype(np.uint32), np.uint32(end_id))
                start, total = 0, len(ids)
                while start < total:
                    piece = ids[start : start + room]
                    open_pieces.append((doc, start, piece, total))
                    start += len(piece)
                    room -= len(piece)
                    if not room:
                        place(open_pieces)
                        open_pieces, room = [], max_tokens
            if len(out) > 20_000:
                yield record()
                out = []
        tail()
        if out:
            yield record()

    ranged = source.mapInArrow(tokens, "part int, key bigint, id bigint, width int, ids binary").repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "key", "id")
    return ranged.mapInArrow(fill, "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint").withColumnRenamed("id", id_col)
