"""Changes of stored tables and exports (SNK1 to SNK13, XP1, JN16).

A change is a plan from the stored table and the incoming rows to the new
table; ``TableStore`` writes it as a version of its own, so readers of the
older version and lost executors do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..sources.shared import stage


class TableStore:
    """Tables under a folder that all executors share, one folder a version.

    The newest version with a success mark is the table; ``keep`` older ones stay."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 1) -> None:
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _versions(self, name: str) -> list[int]:
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = folder.getFileSystem(hadoop)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(folder, f"{n}/_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise ValueError(f"no table {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/v{versions[-1]}")

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """SNK3: the rows of ``df``, which may read the older version, become the table."""
        versions = self._versions(name)
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{versions[-1] + 1 if versions else 1}")
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for old in versions[: max(0, len(versions) - self.keep)]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v{old}")
            path.getFileSystem(hadoop).delete(path, True)
        return self.read(name)


def numbered(rows: DataFrame, key: str, first: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids upwards from the one value of ``first``, in the order of the first
    three digits of the key's MD5, then of the key.

    4,096 groups are numbered apart and moved by the groups before them, so no
    task orders all rows.  Keys are distinct."""
    grouped = rows.withColumn("__group", F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 3))
    sizes = grouped.groupBy("__group").agg(F.count("*").alias("__n"))  # at most 4,096 rows
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = sizes.select("__group", before.alias("__before")).crossJoin(F.broadcast(first.toDF("__first")))
    place = F.row_number().over(Window.partitionBy("__group").orderBy(key)) - 1
    return grouped.withColumn("__place", place).join(F.broadcast(start), "__group").withColumn(id_col, (F.col("__first") + F.col("__before") + F.col("__place")).cast("bigint")).drop("__group", "__place", "__before", "__first")


def _next_id(stored: DataFrame, id_col: str = "id") -> DataFrame:
    return stored.agg((F.coalesce(F.max(id_col), F.lit(0)) + 1).alias("first"))


def upsert_files(stored: DataFrame, incoming: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """SNK1: incoming rows replace stored ones of their path, whose id stays;
    new paths get the next ids, or ids from ``first`` (one value) on.  A path
    that comes in more than once counts with its largest row."""
    values = [c for c in stored.columns if c not in ("id", "path")]
    latest = incoming.groupBy("path").agg(F.max(F.struct(*values)).alias("new"))
    both = stored.select("id", "path", F.struct(*values).alias("old")).join(latest, "path", "full_outer")
    merged = both.select("id", "path", F.when(F.col("new").isNull(), F.col("old")).otherwise(F.col("new")).alias("row"))
    known = merged.where("id is not null")
    fresh = numbered(merged.where("id is null").drop("id"), "path", _next_id(stored) if first is None else first)
    return known.unionByName(fresh).select("id", "path", *[F.col(f"row.{c}").alias(c) for c in values])


def replace_children(stored: DataFrame, incoming: DataFrame, touched: DataFrame, key: str = "file_id") -> DataFrame:
    """SNK2: rows of the touched files go, incoming rows come; a touched file
    without incoming rows has none afterwards."""
    return stored.join(touched.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(incoming.select(*stored.columns))


def defines_edges(symbols: DataFrame) -> DataFrame:
    """SNK2: one ``defines`` relation per symbol, from its file."""
    metadata = F.to_json(F.struct("kind", "line", "name"))
    return symbols.select(
        F.lit("file").alias("source_type"), F.col("file_id").alias("source_id"), F.lit("defines").alias("relation"), F.lit("symbol").alias("target_type"),
        F.col("id").cast("string").alias("target_id"), F.lit(1.0).alias("confidence"), metadata.alias("metadata"),
    )


def delete_files(files: DataFrame, symbols: DataFrame, relations: DataFrame, tags: DataFrame, paths: DataFrame) -> dict[str, DataFrame]:
    """SNK4: the four tables without the files of ``paths`` and all that hangs
    on them.  Symbols' edges go by the symbol's id, file edges by the raw target."""
    gone = files.join(paths.select("path").distinct(), "path", "left_semi").select("id", "path")
    ids = gone.select(F.col("id").alias("file_id"))
    gone_symbols = symbols.join(ids, "file_id", "left_semi").select(F.lit("symbol").alias("target_type"), F.col("id").cast("string").alias("target_id"))
    targets = gone_symbols.unionByName(gone.select(F.lit("file").alias("target_type"), F.col("path").alias("target_id")))
    sources = gone.select(F.lit("file").alias("source_type"), F.col("id").alias("source_id"))
    left = relations.join(sources, ["source_type", "source_id"], "left_anti").join(targets, ["target_type", "target_id"], "left_anti").select(*relations.columns)
    return {
        "files": files.join(gone.select("path"), "path", "left_anti").select(*files.columns),
        "symbols": symbols.join(ids, "file_id", "left_anti").select(*symbols.columns),
        "relations": left,
        "file_tags": tags.join(ids, "file_id", "left_anti").select(*tags.columns),
    }


def upsert_meta(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """SNK5: key, value; incoming values win."""
    return stored.join(incoming, "key", "left_anti").select("key", "value").unionByName(incoming.groupBy("key").agg(F.max("value").alias("value")))


def append(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """SNK7: incoming rows, distinct in ``key``, with the next ids, after the stored ones."""
    return stored.unionByName(numbered(incoming, key, _next_id(stored)).select(*stored.columns))


def begin_run(runs: DataFrame, command: str, at: str) -> DataFrame:
    """SNK6: the log (id, command, started_at, finished_at, status) with a running entry."""
    new = _next_id(runs).select(
        F.col("first").cast("bigint").alias("id"), F.lit(command).alias("command"), F.lit(at).alias("started_at"), F.lit(None).cast("string").alias("finished_at"), F.lit("running").alias("status")
    )
    return runs.unionByName(new)


def finish_run(runs: DataFrame, run_id: int, at: str, status: str = "ok") -> DataFrame:
    """SNK6: the log with that entry closed."""
    mine = F.col("id") == run_id
    return runs.withColumn("finished_at", F.when(mine, F.lit(at)).otherwise(F.col("finished_at"))).withColumn("status", F.when(mine, F.lit(status)).otherwise(F.col("status")))


def update_notes(notes: DataFrame, changes: DataFrame, files: DataFrame, now: str) -> DataFrame:
    """SNK8: notes with the topics and texts of ``changes`` (id, topic, note;
    null keeps).  Changed notes get the present hash of their file, new tokens
    and ``now`` as their date; a changed text that is blank is refused."""
    new = changes.select("id", F.trim("topic").alias("new_topic"), F.trim("note").alias("new_note"), F.lit(True).alias("changed"))
    hashes = files.select("path", F.col("sha256").alias("present"))
    refused = F.when(F.col("new_note") == "", F.raise_error(F.lit("note is required")).cast("string")).otherwise(F.coalesce("new_note", "note"))
    joined = notes.join(new, "id", "left").join(hashes, "path", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    changed = F.col("changed")
    out = joined.withColumn("topic", F.coalesce("new_topic", "topic")).withColumn("note", refused)
    tokens = T.query_tokens(F.concat_ws(" ", "scope", "path", "topic", "note", F.array_join("tags", " ")))
    values = {
        "file_sha256": F.when(changed, F.when(F.col("scope") == "file", F.col("present"))).otherwise(F.col("file_sha256")),
        "note_tokens": F.when(changed, tokens).otherwise(F.col("note_tokens")),
        "created_at": F.when(changed, F.lit(now)).otherwise(F.col("created_at")),
    }
    return out.withColumns(values).select(*notes.columns)


def delete_notes(notes: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """SNK10: (the notes that stay, the deleted ones); unknown ids delete nothing."""
    mine = F.coalesce(F.col("id").isin(ids), F.lit(False))
    return notes.where(~mine), notes.where(mine)


def clear_feedback(feedback: DataFrame, query: str | None = None, path: str | None = None, everything: bool = False) -> DataFrame:
    """SNK11: the feedback that stays; without a choice it is refused."""
    if not (query or path or everything):
        raise ValueError("choose feedback by query or path, or ask for everything")
    gone: Column = F.lit(True)
    if query:
        gone = gone & (F.col("query") == query)
    if path:
        gone = gone & (F.col("path") == F.regexp_replace(F.lit(path), r"^(\./)+", ""))
    return feedback.where(~F.coalesce(gone, F.lit(False)))


def export_relations(relations: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """JN16: relations with the path of their source and what they point at;
    a symbol id that is no number or unknown gives nulls.

    Only symbols that a relation names go on.  Relations without a symbol id are
    dealt out by their own id, as keys that are null would all meet in one task."""
    is_symbol = F.col("target_type") == "symbol"
    source = files.select(F.lit("file").alias("source_type"), F.col("id").alias("source_id"), F.col("path").alias("source_path"))
    wanted = F.when(is_symbol, F.expr("try_cast(target_id AS bigint)"))
    asked = stage(relations.select(wanted.alias("id")).where("id IS NOT NULL").distinct(), "wanted-symbols")
    named = symbols.join(asked, "id", "left_semi").select(F.col("id").cast("string").alias("key"), F.col("name").alias("target_symbol"), F.col("kind").alias("target_kind"), F.col("line").alias("target_line"))
    keyed = relations.withColumn("key", F.coalesce(wanted.cast("string"), F.concat(F.lit("r"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    out = keyed.join(source, ["source_type", "source_id"], "left").join(named, "key", "left")
    target_path = F.when(F.col("target_type") == "file", F.col("target_id"))
    return out.select("id", "source_path", "relation", "target_type", "target_id", target_path.alias("target_path"), "target_symbol", "target_kind", "target_line", "confidence", "metadata")


def export_commits(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """XP1: commits with the sorted list of their files, empty without any."""
    listed = commit_files.groupBy(F.col("commit_id").alias("id")).agg(F.array_sort(F.collect_set("path")).alias("files"))
    return commits.join(listed, "id", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def export_graph(files: DataFrame, symbols: DataFrame, relations: DataFrame, commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """SNK12: section, value (JSON): every row of the graph as a line of its
    own, for ``write.partitionBy('section').text``."""

    def lines(section, df):
        return df.select(F.lit(section).alias("section"), F.to_json(F.struct(*df.columns)).alias("value"))

    placed = symbols.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id", "left")
    return (
        lines("files", files).unionByName(lines("symbols", placed)).unionByName(lines("relations", export_relations(relations, files, symbols)))
        .unionByName(lines("commits", export_commits(commits, commit_files)))
    )


def export_feedback(feedback: DataFrame, path: str) -> None:
    """SNK13: one JSON object a row."""
    feedback.write.mode("overwrite").json(path)


def import_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback rows from JSON: an object or an array of them, or one object
    that holds the list under ``feedback``; rows without path or rating fall away."""
    item = "query string, path string, rating string, reason string, source string"
    raw = spark.read.option("multiLine", True).schema(f"feedback array<struct<{', '.join(c.replace(' ', ':', 1) for c in item.split(', '))}>>, {item}").json(path)
    nested = raw.where("feedback is not null").select(F.explode("feedback").alias("x")).select("x.*")
    return nested.unionByName(raw.where("feedback is null").drop("feedback")).where("path is not null and rating is not null")
