"""How text filters overlap: what each removes, in every order of applying them.

Arrow buffers are scanned whole: a table of byte classes and prefix sums give
words, capitals and symbols of every text, sorted word hashes (equal neighbours
compared byte by byte) its distinct words.  A text's failures are bits of one
mask; documents are counted by mask, and all orders are worked out from those
few counts.
"""

from __future__ import annotations

import hashlib
import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import binary_buffer, join_counted, materialise, prepare, slices
from .textarrays import join_ranges, substring_hashes, words_of

#: The filters' thresholds.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
FILTERS = "ABCDE"

_CAPITAL, _SYMBOL, _CONTINUED = 1, 2, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = _CAPITAL
_CLASS[list(SYMBOLS)] = _SYMBOL
_CLASS[0x80:0xC0] = _CONTINUED


def _per_document(on: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of every document are ``on``, by differences of one prefix sum."""
    total = np.zeros(len(on) + 1, np.int64)
    np.cumsum(on, out=total[1:])
    return np.diff(total[offsets])


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    """Distinct words of each of ``n`` documents (at most 2^20), given the words' bounds in ``data``.

    A document's words are sorted by 44 bits of their hash.  Neighbours with
    equal bits must have equal bytes; where they don't, that document's words
    are counted by a set of their bytes.
    """
    words = np.bincount(document, minlength=n)
    key = (document.astype(np.uint64) << np.uint64(44)) | (substring_hashes(data, start, end) >> np.uint64(20))
    order = np.argsort(key)
    key = key[order]
    again = np.flatnonzero(key[1:] == key[:-1])
    a, b = order[again], order[again + 1]
    length = end - start
    same = length[a] == length[b]
    i, j = a[same], b[same]
    unequal = data[join_ranges(start[i], length[i])] != data[join_ranges(start[j], length[j])]
    ends = np.cumsum(length[i])
    differs = np.diff(np.concatenate([[0], np.cumsum(unequal)])[np.concatenate([[0], ends])])
    out = words - np.bincount(document[a], minlength=n)
    for d in set(document[a[~same]].tolist()) | set(document[i[differs > 0]].tolist()):
        own = np.flatnonzero(document == d)
        out[d] = len({data[x:y].tobytes() for x, y in zip(start[own], end[own], strict=True)})
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, digest, n_words, n_distinct, n_capitals, n_symbols, n_points,
    mask (bits 0 to 3: fails A to D): one row per input row.

    Null texts count as empty, null parts as ''.  Whole texts are scanned; a
    task holds 2 MB of text at a time, or one longer text with some 50 bytes
    for each of its bytes.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    counts = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")

    def scan(batches):
        for batch in slices(batches, "text"):
            data, offsets = binary_buffer(batch.column("text"))
            n, kind = batch.num_rows, _CLASS[data]
            start, end, document = words_of(data, offsets)
            words = np.bincount(document, minlength=n)
            distinct = distinct_words(data, start, end, document, n)
            capitals, symbols = _per_document(kind == _CAPITAL, offsets), _per_document(kind == _SYMBOL, offsets)
            points = _per_document(kind != _CONTINUED, offsets)
            fails = (words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * capitals > CAPITAL_PERCENT * points, symbols > 0)
            mask = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
            digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array(digests, pa.binary()), *map(pa.array, (words, distinct, capitals, symbols, points)), pa.array(mask, pa.int32())],
                names=["id", "part", "digest", *counts, "mask"],
            )

    return source.mapInArrow(scan, f"id {id_type}, part string, digest binary, {', '.join(f'{c} bigint' for c in counts)}, mask int")


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask (bits 0 to 4: fails A to E), good, toxic, n: how many
    documents of each part fail exactly those filters.

    E fails where the same text stands under a smaller id; rows that share the
    smallest id pass, and a row with a null id neither fails E nor makes others
    fail.  A document is good (toxic) if any label row of its id says so; null
    ids have no labels.

    Rows are combined by id and text before anything is joined; the first row
    of a text is found by (text, id), so the copies of a common text go to many
    tasks, and ids that very many rows share are sent to all tasks.
    """
    measured = materialise(measure(docs, id_col, text_col, part_col).select("id", "part", "digest", "mask"), "filter-masks")
    firsts = measured.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    rows = measured.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n")).join(firsts, ["id", "digest"], "left")
    later = F.col("id").isNotNull() & F.col("is_first").isNull()
    rows = materialise(rows.select("id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"), "n"), "filter-rows")
    named = labels.where(f"`{id_col}` IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col(id_col).alias("id"))
    marks = named.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marks = rows.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("held")).join(marks, "id", "left")
    marked = join_counted(rows, materialise(marks, "filter-labels"), "id", "held", rows.count())
    no = F.lit(False)
    every = marked.select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n")
    every = every.unionByName(rows.where("id IS NULL").select("part", "mask", no.alias("good"), no.alias("toxic"), "n"))
    return every.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley: a row for every part, order and step.

    See ``measure`` and ``interactions`` for nulls and repeats; an empty table
    gives an empty one.  A document that fails k filters is removed by each of
    them in 120 / k of the 120 orders, which gives ``shapley``.
    """
    orders = math.factorial(len(FILTERS))
    cells = interactions(docs, labels, id_col, text_col, part_col)
    each = cells.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])))
    each = each.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def bits(below):
        """Bits of the order's filters at the steps that ``below`` takes."""
        steps = F.sequence(F.lit(1), F.lit(len(FILTERS)))

        def bit(i):
            return F.call_function("shiftleft", F.lit(1), F.ascii(F.col("filter_order").substr(i, F.lit(1))) - ord("A"))

        return F.aggregate(steps, F.lit(0), lambda acc, i: acc + F.when(below(i), bit(i)).otherwise(0))

    each = each.withColumn("own", bits(lambda i: i == F.col("step"))).withColumn("before", bits(lambda i: i < F.col("step")))
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition, n=F.col("n")):
        return F.sum(F.when(condition, n).otherwise(0)).cast("bigint")

    return each.groupBy("part", "filter_order", "step").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(~gone & fails & F.col("good")).alias("good_lost"),
        total(~gone & fails & F.col("toxic")).alias("toxic_lost"),
        total(fails, F.col("n") * F.expr(f"{orders} div bit_count(mask)")).alias("shapley"),
    )
