"""Phrase collocations mined from vertical positional inverted lists.

A block is some megabytes of text.  Within it every word has the sorted list of
its positions; a piece's words have consecutive positions, and between pieces
one position stays free, so a phrase can't run over a border.  A list of k-word
phrases is extended by merging it with the list of the k-word phrases that
start one position later: the result is the (k+1)-word phrase's list, and the
lists' lengths are exact frequencies.  Only lists of phrases that are frequent
in the whole corpus are extended.

Blocks are independent, so work is spread by block; frequencies are summed by
phrase, where a phrase has one row per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from .common import binary_buffer, codes_of, discard, join_counted, materialise, prepare, release, slices, trim
from .textarrays import distinct, join_ranges

#: Bytes that end a piece, bytes that end a word, and the scale of scores.
PIECE_ENDS, BLANKS, SCALE = b".,;:!?\n\x0b\x0c\r", b" \t", 1_000_000
#: Bytes of text after which a task closes its blocks.
BLOCK_BYTES = 24 << 20
#: Shares of the final ranking that are cut to the limit before a language's rows meet.
SHARES = 64

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(BLANKS)] = 1
_CLASS[list(PIECE_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words_with_positions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, position) of the words of texts; positions are consecutive
    within a piece and leave at least one free between pieces and texts."""
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    on = np.zeros(len(data) + 2, bool)
    on[1:-1] = kind == 0
    start = np.flatnonzero(on[1:-1] & (~on[:-2] | edge[:-1]))
    end = np.flatnonzero(on[1:-1] & (~on[2:] | edge[1:])) + 1
    ends = np.cumsum((kind == 2) | edge[:-1])
    breaks = ends[start]
    gap = np.zeros(len(start), np.int64)
    gap[1:] = breaks[1:] != breaks[:-1]
    return start, end, np.arange(len(start)) + np.cumsum(gap)


def _lists(owner: np.ndarray, position: np.ndarray, n: int) -> pa.Array:
    """The list of little-endian 32-bit positions of every owner below ``n``;
    positions ascend."""
    order = np.argsort(owner, kind="stable")
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(4 * np.bincount(owner, minlength=n), out=offsets[1:])
    raw = position[order].astype("<i4").tobytes()
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


class _Block:
    """The words of one part's texts as they come in: slices are encoded by
    their own distinct words, which are made one list at the end."""

    def __init__(self) -> None:
        self.codes, self.positions, self.words, self.known, self.following = [], [], [], 0, 0

    def add(self, texts: pa.Array) -> None:
        data, offsets = binary_buffer(texts)
        data = _LOWER[data]
        start, end, position = words_with_positions(data, offsets)
        if not len(start):
            return
        codes, first = distinct(data, start, end)
        self.codes.append((codes + self.known).astype(np.int32))
        self.positions.append((position + self.following).astype(np.int32))
        self.words.append(_substrings(data, start[first], end[first]))
        self.known += len(first)
        self.following += int(position[-1]) + 2

    def rows(self, number: int, prefix: bytes, most: int = 1 << 15):
        """block, word, positions, some thousand at a time."""
        if not self.codes:
            return
        words = pa.chunked_array(self.words).combine_chunks().dictionary_encode()
        owner = words.indices.to_numpy()[np.concatenate(self.codes)]
        words = pa.compute.binary_join_element_wise(pa.scalar(prefix, pa.binary()), words.dictionary, pa.scalar(b"", pa.binary()))
        lists = _lists(owner, np.concatenate(self.positions), len(words))
        for a in range(0, len(words), most):
            part = words.slice(a, most)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number)), part, lists.slice(a, most)], names=["block", "word", "positions"])


def _substrings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    raw = data[join_ranges(start, end - start)]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def postings(docs: DataFrame, text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """block, word (part, line feed, word), positions: each block's lists.

    Null texts are empty, a null part is 'und'.  A block holds texts of one part."""
    prepare(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("und")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def invert(batches):
        from pyspark import TaskContext

        number, held, blocks = TaskContext.get().partitionId() << 32, 0, {}

        def flush():
            nonlocal number
            for part in sorted(blocks):
                yield from blocks[part].rows(number, part.encode() + b"\n")
                number += 1
            blocks.clear()
            trim()

        for batch in slices(batches, "text"):
            parts = batch.column("part").dictionary_encode()
            for k, part in enumerate(parts.dictionary.to_pylist()):
                texts = batch.column("text").filter(pa.compute.equal(parts.indices, k))
                blocks.setdefault(part, _Block()).add(texts)
            held += batch.column("text").nbytes
            if held >= BLOCK_BYTES:
                yield from flush()
                held = 0
        yield from flush()

    return source.mapInArrow(invert, "block bigint, word binary, positions binary")


_EXTENDED = "block bigint, a bigint, b bigint, positions binary"


def _extend(group: pa.Table) -> pa.Table:
    """A block's lists (id, positions) merged with themselves one position on:
    a row per pair of ids that are ever neighbours, with the first one's places."""
    group = group.combine_chunks()
    ids = group.column("id").chunk(0).to_numpy()
    raw, offsets = binary_buffer(group.column("positions").chunk(0))
    position = np.frombuffer(raw.tobytes(), "<i4")
    at = np.full(int(position.max()) + 2, -1, np.int32)
    at[position] = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(offsets) // 4)
    here = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
    codes, pairs = codes_of(at[here].astype(np.int64) * len(ids) + at[here + 1])
    lists = _lists(codes, here, len(pairs))
    columns = [np.full(len(pairs), group.column("block")[0].as_py(), np.int64), ids[pairs // len(ids)], ids[pairs % len(ids)]]
    out = pa.Table.from_arrays([*map(pa.array, columns), lists], names=["block", "a", "b", "positions"])
    return pa.Table.from_batches(out.to_batches(max_chunksize=1 << 15), out.schema)


def _longer(lists: DataFrame, min_count: int, name: str) -> DataFrame:
    """The next level of lists: block, id, a, b, f, positions, for phrases that
    start with ``a`` and end with ``b`` and occur ``min_count`` times.

    A phrase has one row per block, so its rows are a small share of all.
    Ids are unique, as all rows of a phrase are in one task, and fixed by the
    written table."""
    found = lists.select("block", "id", "positions").groupBy("block").applyInArrow(_extend, _EXTENDED)
    # sorted by a hash first, which nearly always tells two phrases apart at the first look
    same = Window.partitionBy(F.xxhash64("a", "b"), "a", "b")
    dealt = found.repartition("a", "b")
    counted = dealt.withColumn("f", F.sum(F.expr("octet_length(positions) div 4")).over(same)).where(F.col("f") >= min_count)
    return materialise(counted.withColumn("id", F.min(F.monotonically_increasing_id()).over(same)).select("block", "id", "a", "b", "f", "positions"), name)


def _attach(rows: DataFrame, key: str, other: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` with ``columns`` (new name: name) of ``other``'s row of that id;
    ids that very many rows name are sent to all tasks."""
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"))
    named = counts.join(other.select(F.col("id").alias(key), *[F.col(old).alias(new) for new, old in columns.items()]), key)
    return join_counted(rows, materialise(named, "phrase-names"), key, "__n", rows.count()).drop("__n")


def phrases(docs: DataFrame, min_words: int = 2, max_words: int = 3, min_count: int = 10, text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(candidates, words per part).

    Candidates: part, phrase, size, f, prefixes and suffixes (f of the first
    and last 1, 2, .. words), longer (largest f of a candidate one word longer
    that holds it, else null).  Words per part: part, n.
    """
    spark = docs.sparkSession
    inverted = materialise(postings(docs, text_col, part_col), "phrase-postings")
    counts = materialise(inverted.groupBy("word").agg(F.sum(F.expr("octet_length(positions) div 4")).alias("f")), "phrase-words")
    last = F.substring_index(F.col("word").cast("string"), "\n", -1)  # a word holds no line feed
    part = F.col("word").cast("string").substr(F.lit(1), F.char_length(F.col("word").cast("string")) - F.char_length(last) - 1)
    named = counts.select("word", "f", last.alias("last"), part.alias("part"))
    totals = named.groupBy("part").agg(F.sum("f").alias("n"))
    frequent = materialise(named.where(F.col("f") >= min_count).withColumn("id", F.monotonically_increasing_id()), "phrase-level-1")
    all_words = counts.agg(F.sum("f")).first()[0] or 0
    release(spark)
    lists = materialise(join_counted(inverted, frequent.select("word", "id", "f"), "word", "f", all_words).select("block", "id", "positions"), "phrase-lists-1")
    discard(inverted)
    release(spark)
    level = frequent.select("id", "part", F.col("last").alias("phrase"), "last", "f", F.array("f").alias("prefixes"), F.array("f").alias("suffixes"))
    levels = []
    for k in range(2, max_words + 1):
        shorter, lists = lists, _longer(lists, min_count, f"phrase-lists-{k}")
        discard(shorter)
        release(spark)
        found = lists.groupBy("id", "a", "b").agg(F.max("f").alias("f"))
        found = materialise(found, f"phrase-found-{k}")
        found = materialise(_attach(found, "a", level, {"part": "part", "start": "phrase", "pre": "prefixes"}), f"phrase-started-{k}")
        found = _attach(found, "b", level, {"last": "last", "suf": "suffixes"})
        own = F.array("f")
        upper = found.select("id", "a", "b", "part", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "f", F.concat("pre", own).alias("prefixes"), F.concat("suf", own).alias("suffixes"))
        upper = materialise(upper, f"phrase-level-{k}")
        levels.append((k - 1, level, upper))
        level = upper
    levels.append((max_words, level, None))
    out = None
    for size, here, upper in levels:
        if size < min_words:
            continue
        rows = here.select("id", "part", "phrase", F.lit(size).alias("size"), "f", "prefixes", "suffixes")
        if upper is None:
            rows = rows.withColumn("longer", F.lit(None).cast("bigint"))
        else:
            inside = upper.select(F.col("a").alias("id"), "f").unionAll(upper.select(F.col("b").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("longer"))
            rows = rows.join(inside, "id", "left")
        rows = rows.drop("id")
        out = rows if out is None else out.unionByName(rows)
    return out, totals


def collocations(docs: DataFrame, min_words: int = 2, max_words: int = 3, min_count: int = 10, inside_percent: int = 50, top: int = 2000, text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, rank, phrase, a, l, r, n, score: the ``top`` phrases of each part by
    score, a (both descending) and phrase.

    Phrases count within pieces, A-Z lowered, overlaps included; every row
    counts, repeated ones too.  Null texts are empty, a null part is 'und'; an
    empty table gives an empty one.  The score of a phrase is that of its
    lowest cut, floor(10^6 * a * a / (l * r)) in decimals of 38 digits, so counts
    may reach 10^15.  A phrase is dropped where a longer candidate that holds it
    has at least ``inside_percent`` of its count.
    """
    found, totals = phrases(docs, min_words, max_words, min_count, text_col, part_col)
    wide = "decimal(38,0)"
    cut = F.expr(
        f"""array_min(transform(sequence(1, size - 1), k -> struct(
            ({SCALE} * cast(f AS {wide}) * f) div (cast(prefixes[k - 1] AS {wide}) * suffixes[size - k - 1]) AS score,
            k AS k, prefixes[k - 1] AS l, suffixes[size - k - 1] AS r)))"""
    )
    kept = found.where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("f"))).withColumn("cut", cut)
    rows = kept.select("part", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = materialise(rows, "phrase-scores")
    # scores reach 10^6: a histogram of a thousand steps tells from which step on the first rows come
    step = F.expr(f"score div {SCALE // 1000}").alias("step")
    steps = rows.groupBy("part", step).agg(F.count("*").alias("held"))
    above = F.sum("held").over(Window.partitionBy("part").orderBy(F.desc("step"))) - F.col("held")
    wanted = steps.withColumn("above", above).where(F.col("above") < top).select("part", "step")
    near = rows.withColumn("step", step).join(wanted, ["part", "step"])
    # many rows of one step: each share of a part keeps its first rows, so a part's whole list never meets in one task
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    first = near.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("part", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "part").select(F.col("part").alias(part_col), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
