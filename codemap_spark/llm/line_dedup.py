"""Line dedup: lines that many documents hold lose all their occurrences, in
DataFrame operations only.

Every line's key is hashed.  (hash, document, position) is range-partitioned
and sorted, so each task streams the occurrences of its range in order and
marks the first one of every line and document; ranges end anywhere, also
inside a common line, so none is overfull.  Counts of first occurrences give
each line's documents.  The result is a compressed bitmap per document, not
text: words of 64 lines, of which only those with a dropped line are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import join_counted, materialise

#: What is stripped from a line's ends, and which letters are lowered.
STRIPPED = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row with its text (null: empty) and the digest that names its
    document: of id and text, so it is the same whenever it is computed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.col(id_col).cast("string")
    name = F.concat(F.coalesce(F.concat(F.char_length(named).cast("string"), F.lit(":"), named), F.lit("-")), text)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(name.cast("binary"))).alias("document"))


def occurrences(rows: DataFrame) -> DataFrame:
    """hash, document, position of every line whose key isn't empty."""
    lowered = rows.select("document", F.posexplode(_lines(F.translate("text", CAPITALS, SMALL))).alias("position", "line"))
    key = F.btrim("line", F.lit(STRIPPED))
    return lowered.select("document", "position", key.alias("key")).where("key <> ''").select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash"), "document", "position")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = 10) -> DataFrame:
    """document, n_dropped, keep: one row per document that loses lines.

    ``keep`` is array<struct<word, bits>> in order of word: bit i of word w is 1
    if line 64 * w + i stays (bits past the last line are 1); words that aren't
    listed keep all their lines.  ``document`` is the digest of id and text:
    rows equal in both are one document, rows with a null id are told apart by
    their texts.
    """
    rows = _document(docs, id_col, text_col)
    found = materialise(occurrences(rows), "line-occurrences")
    if not rows.groupBy("document").count().where("count > 1").isEmpty():
        found = found.dropDuplicates()  # combines before its shuffle
    total = found.count()
    ranges = found.repartitionByRange("hash", "document").sortWithinPartitions("hash", "document", "position")
    here = Window.partitionBy("hash", "document").orderBy("position")
    first = ranges.withColumn("is_first", (F.row_number().over(here) == 1).cast("bigint"))
    lines = first.groupBy("hash").agg(F.sum("is_first").alias("documents"), F.count("*").alias("lines"))
    common = materialise(lines.where(F.col("documents") >= min_documents).select("hash", "lines"), "line-common")
    dropped = join_counted(found, common, "hash", "lines", total).select("document", F.expr("position div 64").cast("int").alias("word"), F.expr("shiftleft(1L, position % 64)").alias("bit"))
    words = dropped.groupBy("document", "word").agg(F.bit_or("bit").alias("bits"))
    packed = words.select("document", F.struct("word", F.bitwise_not("bits").alias("bits")).alias("w"), F.bit_count("bits").alias("n"))
    return packed.groupBy("document").agg(F.sum("n").cast("bigint").alias("n_dropped"), F.array_sort(F.collect_list("w")).alias("keep"))


def _dense(keep: Column) -> Column:
    """All words up to the last one listed: gaps are filled with ones."""

    def filled(w: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.element_at(keep, F.greatest(i, F.lit(1)))["word"])
        return F.concat(F.array_repeat(F.lit(-1).cast("bigint"), w["word"] - before - 1), F.array(w["bits"]))

    return F.flatten(F.transform(keep, filled))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = 10) -> DataFrame:
    """id, n_lines, n_dropped, keep, kept_text: one row per input row.

    A null or empty text is one empty line; empty keys are never dropped.  The
    key of a line is what is left when white space is stripped from its ends and
    A-Z are lowered.  Repeated rows repeat and count once, see ``keep_bitmaps``;
    an empty table gives an empty one.
    """
    bitmaps = materialise(keep_bitmaps(docs, id_col, text_col, min_documents), "line-bitmaps")
    words = bitmaps.select(F.col("document").alias("__document"), "n_dropped", "keep", _dense(F.col("keep")).alias("words"))
    rows = _document(docs, id_col, text_col)
    joined = rows.join(words, F.col("document") == F.col("__document"), "left")
    lines = _lines(F.col("text"))

    def stays(_, i: Column) -> Column:
        word = F.call_function("shiftright", i, F.lit(6))
        return F.coalesce(F.get("words", word).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i % 64)) != 0, F.lit(True))

    kept = F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return joined.select(F.col("id").alias(id_col), F.size(lines).cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "keep", kept.alias("kept_text"))
