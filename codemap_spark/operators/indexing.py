"""The index of a project: built whole, or refreshed by what changed (RF1, RF2).

Only changed files are read and extracted, and only their terms are counted.
``build`` and ``refresh`` are plans from an index to the next one;
``IndexStore`` keeps an index in hash buckets and rewrites those that a change
touches, all tables in one version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import stage
from . import relations as edges, stats, store, term_index
from .bucket_store import BucketStore, Change

#: Tables of an index by name, with their columns.
SCHEMAS = {
    "files": "id long, path string, language string, role string, size long, extension string, modified string, sha256 string",
    "symbols": "id long, file_id long, name string, kind string, line int, signature string",
    "relations": "id long, source_type string, source_id long, relation string, target_type string, target_id string, confidence double, metadata string",
    "file_tags": "file_id long, tag string, source string, weight double",
    "commits": "hash string, message string",
    "terms": "term string, source string, document_count long, total_count long",
    "term_sizes": "source string, n long",
    "runs": "id long, command string, started_at string, finished_at string, status string",
    "meta": "key string, value string",
}
#: The column by whose hash a table is kept in buckets.
KEYS = {"files": "path", "symbols": "file_id", "relations": "source_id", "file_tags": "file_id", "commits": "hash", "terms": "term", "term_sizes": "source", "runs": "id", "meta": "key"}
#: Raised when the tables' form changes.
VERSION = "3"

Index = dict[str, DataFrame]
#: Makes path, what, kind, target_type, name, line, confidence, signature of files (path, language, content).
Extract = Callable[[DataFrame], DataFrame]


def empty(spark: SparkSession) -> Index:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def _next_id(table: DataFrame) -> DataFrame:
    return table.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("first"))


def indexed(known: DataFrame, scanned: DataFrame, extract: Extract, first: dict[str, DataFrame]) -> Index:
    """files, symbols, relations and file_tags of the scanned files (the columns
    of ``repository.scan``).

    ``known`` are the stored files of the same paths, which keep their ids; new
    ids go up from the one value of ``first`` for files, symbols and relations."""
    columns = [c for c in known.columns if c != "id"]
    files = store.upsert_files(known, scanned.select(*columns), first["files"])
    found = extract(scanned).join(files.select(F.col("id").alias("file_id"), "path"), "path")
    place = F.concat_ws("/", F.lpad(F.col("file_id").cast("string"), 20, "0"), F.lpad(F.col("line").cast("string"), 9, "0"), "kind", "name")
    named = found.where("what = 'symbol'").withColumn("place", place).dropDuplicates(["place"])
    symbols = store.numbered(named, "place", first["symbols"]).select("id", "file_id", "name", "kind", "line", "signature")

    def edge(df, relation, target_type, target, confidence, metadata):
        return df.select(
            F.lit("file").alias("source_type"), F.col("file_id").alias("source_id"), relation.alias("relation"), target_type.alias("target_type"),
            target.alias("target_id"), confidence.alias("confidence"), metadata.alias("metadata"),
        )

    labels = files.withColumnRenamed("id", "file_id")
    said = found.where("what = 'relation'")
    new = edge(said, F.col("kind"), F.col("target_type"), F.col("name"), F.col("confidence"), F.to_json(F.struct("line")))
    for relation, column in (("belongs_to_language", "language"), ("has_role", "role")):
        new = new.unionByName(edge(labels, F.lit(relation), F.lit(column), F.col(column), F.lit(1.0), F.lit("{}")))
    new = new.unionByName(store.defines_edges(symbols).select(*new.columns)).dropDuplicates()
    new = new.withColumn("place", F.concat_ws("/", F.lpad(F.col("source_id").cast("string"), 20, "0"), "relation", "target_type", "target_id", "metadata"))
    relations = store.numbered(new, "place", first["relations"])
    tagged = stats.file_tags(files, symbols, edge(said, F.col("kind"), F.col("target_type"), F.col("name"), F.col("confidence"), F.lit("{}")))
    return {
        "files": files.select("id", *columns),
        "symbols": symbols,
        "relations": relations.select("id", *[c for c in new.columns if c != "place"]),
        "file_tags": tagged.select("file_id", "tag", "source", "weight"),
    }


def _without_ids(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of other files; ``ids`` is (id)."""
    return table.join(ids.select(F.col("id").alias(key)), key, "left_anti").select(*table.columns)


def _others(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations that don't start at the files of ``ids`` (id)."""
    mine = ids.select(F.lit("file").alias("source_type"), F.col("id").alias("source_id"))
    return relations.join(mine, ["source_type", "source_id"], "left_anti").select(*relations.columns)


def without(index: Index, paths: DataFrame) -> Index:
    """The index without files and all that hangs on them; its term statistics
    stay as they are."""
    return index | store.delete_files(index["files"], index["symbols"], index["relations"], index["file_tags"], paths)


def _logged(index: Index, command: str, at: tuple[str, str] | None) -> Index:
    """SNK6: the index with a finished run in its log, if its times are given,
    and the version stamp."""
    spark = index["files"].sparkSession
    stamp = [("index_version", VERSION)] + ([(f"last_{command}", at[1])] if at else [])
    out = index | {"meta": store.upsert_meta(index["meta"], spark.createDataFrame(stamp, SCHEMAS["meta"]))}
    if at:
        new = _next_id(index["runs"]).select(
            F.col("first").cast("long").alias("id"), F.lit(command).alias("command"), F.lit(at[0]).alias("started_at"), F.lit(at[1]).alias("finished_at"), F.lit("ok").alias("status")
        )
        out["runs"] = index["runs"].unionByName(new)
    return out


def put(index: Index, scanned: DataFrame, extract: Extract, removed: DataFrame | None = None, commits: DataFrame | None = None) -> Index:
    """The index with the scanned files put in, new or in place of their former
    rows, without the files of ``removed`` (path), and with ``commits`` (hash,
    message) if given in place of its own.  Term statistics follow by the
    difference: see ``term_index``."""
    left = index if removed is None else without(index, removed)
    known = left["files"].join(scanned.select("path").distinct(), "path", "left_semi").select(*left["files"].columns)
    new = indexed(known, scanned, extract, {name: _next_id(left[name]) for name in ("files", "symbols", "relations")})
    ids = new["files"].select("id")
    touched = known.select("id") if removed is None else index["files"].join(scanned.select("path").unionByName(removed.select("path")).distinct(), "path", "left_semi").select("id")
    old_commits = None if commits is None else index["commits"].join(commits, ["hash", "message"], "left_anti")
    new_commits = None if commits is None else commits.join(index["commits"], ["hash", "message"], "left_anti")
    gone = term_index.source_documents(index["files"].join(touched, "id", "left_semi"), index["symbols"].join(touched.withColumnRenamed("id", "file_id"), "file_id", "left_semi"), old_commits)
    change, size_change = term_index.delta(gone, term_index.source_documents(new["files"], new["symbols"], new_commits))
    return left | {
        "files": _without_ids(left["files"], "id", ids).unionByName(new["files"].select(*left["files"].columns)),
        "symbols": _without_ids(left["symbols"], "file_id", ids).unionByName(new["symbols"]),
        "relations": _others(left["relations"], ids).unionByName(new["relations"]),
        "file_tags": _without_ids(left["file_tags"], "file_id", ids).unionByName(new["file_tags"]),
        "commits": index["commits"] if commits is None else commits.select("hash", "message"),
        "terms": term_index.applied(index["terms"], change),
        "term_sizes": term_index.applied_sizes(index["term_sizes"], size_change),
    }


def build(index: Index, scanned: DataFrame, extract: Extract, commits: DataFrame | None = None, at: tuple[str, str] | None = None) -> Index:
    """RF2: every scanned file indexed anew, vanished ones gone; ``at`` is when
    the run began and ended, for the log."""
    gone = index["files"].select("path").join(scanned.select("path"), "path", "left_anti")
    return _logged(put(index, scanned, extract, gone, commits), "map", at)


def _version(index: Index) -> str | None:
    found = index["meta"].where("key = 'index_version'").first()
    return found.value if found else None


def refresh(index: Index, scanned: DataFrame, extract: Extract, commits: DataFrame | None = None, at: tuple[str, str] | None = None) -> tuple[Index, DataFrame]:
    """RF1: (index, changes): only files whose hash is new or other are read
    and indexed, vanished ones go.  ``changes`` has path and change: added,
    updated, unchanged or removed.

    An index without files, or of another version, must be built whole."""
    if index["files"].isEmpty():
        raise ValueError("no files are indexed yet: build the index first")
    if _version(index) != VERSION:
        raise ValueError("the index was made by other rules: build it anew")
    changes = edges.refresh_diff(index["files"].select("path", "sha256"), scanned.select("path", "sha256"))
    changed = scanned.join(changes.where("change IN ('added', 'updated')").select("path"), "path", "left_semi")
    return _logged(put(index, changed, extract, changes.where("change = 'removed'").select("path"), commits), "refresh", at), changes


def outdated(index: Index, scanned: DataFrame, last_map: str) -> DataFrame:
    """DR1: path, issue: indexed but gone, there but not indexed, or modified
    over a second after the last map."""
    known = edges.index_health(index["files"].select("path"), scanned.select("path"))
    later = F.to_timestamp("modified") > F.to_timestamp(F.lit(last_map)) + F.expr("INTERVAL 1 SECOND")
    return known.unionByName(scanned.where(later).select("path", F.lit("modified_after_map").alias("issue")))


class IndexStore(BucketStore):
    """An index in buckets: files by path, what hangs on them by file id, terms
    by term.  A change reads and writes the buckets of its own keys."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256, keep: int = 1) -> None:
        super().__init__(spark, root, SCHEMAS, KEYS, buckets, keep)

    def index(self, version: int | None = None) -> Index:
        return {name: self.read(name, version) for name in SCHEMAS}

    def term_stats(self, version: int | None = None) -> DataFrame:
        """AGG1 as of a version."""
        return term_index.weighed(self.read("terms", version), self.read("term_sizes", version))

    def change(self, scanned: DataFrame, extract: Extract, removed: DataFrame | None = None, command: str = "refresh", at: tuple[str, str] | None = None, batch: tuple[str, int] | None = None) -> int:
        """Scanned files whose hash is new or other are put in, those of
        ``removed`` (path) go; the number of the newest version.

        ``at`` is when the run began and ended, for the log (SNK6); of a path
        that is scanned more than once the last modified row counts, and a path
        that is scanned isn't removed.  A batch that has been applied, and a
        change without effect, leave the version as it is."""
        spark = self.spark
        if batch and self.applied(batch[0]) >= batch[1]:
            return self.manifest()["version"]
        columns = [c for c in scanned.columns if c != "path"]
        latest = scanned.groupBy("path").agg(F.max(F.struct("modified", "sha256", *[c for c in columns if c not in ("modified", "sha256")])).alias("x"))
        wanted = stage(latest.select("path", *[F.col(f"x.{c}").alias(c) for c in columns]), "index-scanned")
        gone = spark.createDataFrame([], "path string") if removed is None else removed.select("path").distinct().join(wanted.select("path"), "path", "left_anti")
        gone = stage(gone, "index-removed")
        stored = self.read("files", touching=wanted.select("path").unionByName(gone))
        changed = wanted.join(stored.select("path", "sha256"), ["path", "sha256"], "left_anti").select(*wanted.columns)
        old = stage(stored.join(changed.select("path").unionByName(gone), "path", "left_semi").select(*stored.columns), "index-old-files")
        meta = self.manifest()["meta"]
        first = {name: spark.range(1).select(F.lit(meta.get(f"next_{name}", 1)).cast("long").alias("first")) for name in ("files", "symbols", "relations")}
        known = old.join(gone, "path", "left_anti").select(*old.columns)
        new = {name: stage(rows, f"index-new-{name}") for name, rows in indexed(known, changed, extract, first).items()}
        if new["files"].isEmpty() and old.isEmpty():
            return self.manifest()["version"]
        ids = stage(old.select("id").unionByName(new["files"].select("id")).distinct(), "index-touched")
        file_ids = ids.withColumnRenamed("id", "file_id")
        old_symbols = self.read("symbols", touching=file_ids).join(file_ids, "file_id", "left_semi")
        # relations from elsewhere that point at what goes, found by their targets alone
        lost_files = old.join(gone, "path", "left_semi").select("id", "path")
        lost_symbols = old_symbols.join(lost_files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
        targets = lost_files.select(F.lit("file").alias("target_type"), F.col("path").alias("target_id"))
        targets = targets.unionByName(lost_symbols.select(F.lit("symbol").alias("target_type"), F.col("id").cast("string").alias("target_id")))
        targets = stage(targets, "index-lost-targets")
        pointing = spark.createDataFrame([], "source_id long")
        if not targets.isEmpty():
            pointing = self.read("relations").select("source_id", "target_type", "target_id").join(targets, ["target_type", "target_id"], "left_semi").select("source_id")
        come = term_index.source_documents(new["files"], new["symbols"])
        terms, term_sizes = term_index.delta(term_index.source_documents(old, old_symbols), come)
        terms, term_sizes = stage(terms, "index-term-change"), stage(term_sizes, "index-size-change")
        stamp = spark.createDataFrame([("index_version", VERSION)] + ([(f"last_{command}", at[1])] if at else []), SCHEMAS["meta"])

        def replaced(key: str, rows: DataFrame):
            return lambda stored: _without_ids(stored, key, ids).unionByName(rows.select(*stored.columns))

        changes = [
            Change("files", old.select("path").unionByName(new["files"].select("path")), replaced("id", new["files"])),
            Change("symbols", file_ids, replaced("file_id", new["symbols"])),
            Change("file_tags", file_ids, replaced("file_id", new["file_tags"])),
            Change(
                "relations", file_ids.select(F.col("file_id").alias("source_id")).unionByName(pointing),
                lambda stored: _others(stored, ids).join(targets, ["target_type", "target_id"], "left_anti").select(*stored.columns).unionByName(new["relations"].select(*stored.columns)),
            ),
            Change("terms", terms.select("term"), lambda stored: term_index.applied(stored, terms)),
            Change("term_sizes", term_sizes.select("source"), lambda stored: term_index.applied_sizes(stored, term_sizes)),
            Change("meta", stamp.select("key"), lambda stored: store.upsert_meta(stored, stamp)),
        ]
        following = {}
        for name in ("files", "symbols", "relations"):
            most = new[name].agg(F.max("id")).first()[0]
            following[f"next_{name}"] = max(meta.get(f"next_{name}", 1), (most or 0) + 1)
        if at:
            run = spark.createDataFrame([(meta.get("next_runs", 1), command, *at, "ok")], SCHEMAS["runs"])
            changes.append(Change("runs", run.select("id"), lambda stored: stored.unionByName(run)))
            following["next_runs"] = meta.get("next_runs", 1) + 1
        return self.commit(changes, following, batch)
