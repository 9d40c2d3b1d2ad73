"""Term statistics kept up by deltas (AGG1 within RF1 and RF2).

The statistics are counts, so a change is the terms of what came minus the
terms of what went: only the texts of changed rows are cut into terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

COUNTS = ("document_count", "total_count")


def source_documents(files: DataFrame, symbols: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """source, text: what AGG1 counts terms in: path, file name, language and
    role of every file, every symbol's name, every commit's message."""
    texts = (("path", F.col("path")), ("filename", T.file_name(F.col("path"))), ("language", F.col("language")), ("role", F.col("role")))
    of_file = F.explode(F.array(*[F.struct(F.lit(k).alias("source"), v.alias("text")) for k, v in texts]))
    rows = files.select(of_file.alias("x")).select("x.*")
    rows = rows.unionByName(symbols.select(F.lit("symbol").alias("source"), F.col("name").alias("text")))
    return rows if commits is None else rows.unionByName(commits.select(F.lit("commit").alias("source"), F.col("message").alias("text")))


def sizes(docs: DataFrame) -> DataFrame:
    """source, n: documents per source and in ``all``; at most seven rows."""
    either = F.explode(F.array(F.col("source"), F.lit("all"))).alias("source")
    return docs.groupBy("source").agg(F.count("*").alias("n")).select(either, "n").groupBy("source").agg(F.sum("n").alias("n"))


def counts(docs: DataFrame) -> DataFrame:
    """term, source, document_count, total_count, for every source and ``all``.

    A source's counts are combined before their shuffle, and ``all`` adds up
    the sources' counts, as it holds every document of each."""
    # paths are nearly all distinct; names, messages and labels repeat, and are cut into terms once each
    alone = F.col("source").isin("path", "filename")
    repeated = docs.where(~alone).groupBy("source", "text").agg(F.count("*").alias("times"))
    texts = docs.where(alone).withColumn("times", F.lit(1).cast("bigint")).unionByName(repeated)
    terms = texts.select("source", "times", F.sort_array(T.useful_terms(F.col("text"))).alias("terms"))
    before = F.concat(F.array(F.lit("")), F.slice("terms", 1, F.greatest(F.size("terms") - 1, F.lit(0))))
    each = F.explode(F.arrays_zip(F.col("terms").alias("term"), before.alias("before"))).alias("x")
    paired = terms.select("source", "times", each).where("x.term is not null")
    first = F.when(F.col("x.before") != F.col("x.term"), F.col("times")).otherwise(0)
    counted = paired.groupBy(F.col("x.term").alias("term"), "source").agg(F.sum(first).alias("document_count"), F.sum("times").alias("total_count"))
    either = F.explode(F.array(F.col("source"), F.lit("all"))).alias("source")
    return _added(counted.select("term", either, *COUNTS))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "source").agg(*[F.sum(c).alias(c) for c in COUNTS])


def delta(gone: DataFrame, come: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, sizes) to be added for documents (source, text) that went and
    came; terms whose counts don't change are left out."""
    lost = counts(gone).select("term", "source", *[(-F.col(c)).alias(c) for c in COUNTS])
    changed = _added(counts(come).unionByName(lost)).where(" OR ".join(f"{c} <> 0" for c in COUNTS))
    fewer = sizes(gone).select("source", (-F.col("n")).alias("n"))
    return changed, sizes(come).unionByName(fewer).groupBy("source").agg(F.sum("n").alias("n")).where("n <> 0")


def applied(stored: DataFrame, change: DataFrame) -> DataFrame:
    """Stored counts with a change; what no document holds any more goes."""
    return _added(stored.select("term", "source", *COUNTS).unionByName(change)).where("total_count <> 0")


def applied_sizes(stored: DataFrame, change: DataFrame) -> DataFrame:
    return stored.select("source", "n").unionByName(change).groupBy("source").agg(F.sum("n").alias("n")).where("n <> 0")


def weighed(counted: DataFrame, sized: DataFrame) -> DataFrame:
    """AGG1: term, source, document_count, total_count, weight."""
    known = counted.join(F.broadcast(sized), "source")  # seven rows
    raw = 0.45 + F.log((F.col("n") + 1) / (F.col("document_count") + 1))
    weight = F.round(F.least(F.lit(2.8), F.greatest(F.lit(0.25), raw)), 6)
    return known.select("term", "source", *COUNTS, weight.alias("weight"))
