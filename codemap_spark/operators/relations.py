"""Keyword search, callers, co-change and path resolution (FLT1, JN2 to JN11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T


def keyword_search(files: DataFrame, symbols: DataFrame, commits: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """FLT1: kind, label, score; best first, ties by label and kind."""
    term = text.strip().lower()
    path, role = F.lower("path"), F.lower("role")
    file_score = F.when(path == term, 100).otherwise(0) + F.when(path.contains(term), 40).otherwise(0) + F.when(role == term, 35).when(role.contains(term), 20).otherwise(0)
    name = F.lower("name")
    found = (
        files.select(F.lit("file").alias("kind"), F.col("path").alias("label"), file_score.alias("score"))
        .unionByName(symbols.select(F.lit("symbol").alias("kind"), F.col("name").alias("label"), F.when(name == term, 90).when(name.contains(term), 50).otherwise(0).alias("score")).distinct())
        .unionByName(commits.select(F.lit("commit").alias("kind"), F.col("message").alias("label"), F.when(F.lower("message").contains(term), 30).otherwise(0).alias("score")).distinct())
    )
    return found.where("score > 0").orderBy(F.desc("score"), "label", "kind").limit(limit)


def commits_with_files(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """JN2: every commit with its count of files, those without any too."""
    counted = commit_files.groupBy(F.col("commit_id").alias("id")).agg(F.count("*").alias("n_files"))
    return commits.join(counted, "id", "left").select("id", "date", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def recent_commits(commits: DataFrame, commit_files: DataFrame, path: str, limit: int = 10) -> DataFrame:
    """JN3: newest commits of a path by date string, then id."""
    touching = commit_files.where(F.col("path") == path).select(F.col("commit_id").alias("id"))
    return commits.join(touching, "id", "left_semi").orderBy(F.desc("date"), F.desc("id")).limit(limit)


def cochanged(commits: DataFrame, commit_files: DataFrame, path: str, newest: int = 10, limit: int = 20) -> DataFrame:
    """JN4: path, commits: what the newest commits of ``path`` touched too."""
    recent = F.broadcast(recent_commits(commits, commit_files, path, newest).select(F.col("id").alias("commit_id")))  # at most ``newest`` rows
    return commit_files.join(recent, "commit_id", "left_semi").where(F.col("path") != path).groupBy("path").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "path").limit(limit)


def callers(calls: DataFrame, files: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """JN5: path, call_count, first line of the callers of a name."""
    line = F.get_json_object("metadata", "$.k").cast("int")
    counted = calls.where(F.col("target_id") == name).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("call_count"), F.min(line).alias("first_line"))
    return counted.join(files.select("id", "path"), "id").select("path", "call_count", "first_line").orderBy(F.desc("call_count"), "path").limit(limit)


def definitions(symbols: DataFrame, files: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """JN6: path, kind, line of the definitions of a name."""
    return symbols.where(F.col("name") == name).join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "kind", "line").orderBy("path", "line", "kind").limit(limit)


def callers_of_file_symbols(symbols: DataFrame, calls: DataFrame, files: DataFrame, file_id: int, per_symbol: int = 20, limit: int = 20) -> DataFrame:
    """JN8: name, path, call_count from other files; a name that the file
    defines twice counts twice."""
    own = symbols.where(F.col("file_id") == file_id).select("id", "name")
    counted = calls.where(F.col("source_id") != file_id).join(own, F.col("target_id") == F.col("name")).groupBy(F.col("id").alias("symbol_id"), "name", F.col("source_id").alias("id")).agg(F.count("*").alias("call_count"))
    named = counted.join(files.select("id", "path"), "id")
    rank = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("call_count"), "path"))
    return named.withColumn("rank", rank).where(F.col("rank") <= per_symbol).select("symbol_id", "name", "path", "call_count").orderBy(F.desc("call_count"), "path", "symbol_id").limit(limit)


def distinct_relations(relations: DataFrame) -> DataFrame:
    """JN9: source_id, relation, target_type, target_id, best confidence and
    the metadata of that row (ties by the metadata) of every file's relations
    other than its definitions and calls."""
    best = F.max(F.struct("confidence", "metadata"))
    own = relations.where((F.col("source_type") == "file") & ~F.col("relation").isin("defines", "calls"))
    return own.groupBy("source_id", "relation", "target_type", "target_id").agg(best.alias("b")).select("source_id", "relation", "target_type", "target_id", F.col("b.confidence").alias("confidence"), F.col("b.metadata").alias("metadata"))


def suffix_index(paths: DataFrame) -> DataFrame:
    """JN11: suffix, the smallest path that ends with it."""
    return paths.select("path", F.explode(T.path_suffixes(F.col("path"))).alias("suffix")).groupBy("suffix").agg(F.min("path").alias("path"))


def resolve(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """JN10: target, path: the target's own suffix first, then its file name."""
    index = suffix_index(paths)
    whole = index.select(F.col("suffix").alias("normal"), F.col("path").alias("by_path"))
    name = index.select(F.col("suffix").alias("name"), F.col("path").alias("by_name"))
    wanted = targets.select("target", T.normal_path(F.col("target")).alias("normal")).distinct().withColumn("name", T.file_name(F.col("normal")))
    return wanted.join(whole, "normal", "left").join(name, "name", "left").select("target", F.coalesce("by_path", "by_name").alias("path"))


def refresh_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """RF1: path, change: added, updated, unchanged or removed by content hash."""
    both = before.select("path", F.col("sha256").alias("old")).join(now.select("path", F.col("sha256").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return both.select("path", change.alias("change"))


def index_health(indexed: DataFrame, real: DataFrame) -> DataFrame:
    """DR1: path, issue: indexed but gone, or there but not indexed."""
    gone = indexed.join(real, "path", "left_anti").select("path", F.lit("missing_on_disk").alias("issue"))
    return gone.unionByName(real.join(indexed, "path", "left_anti").select("path", F.lit("not_indexed").alias("issue")))


def resolved_calls(relations: DataFrame, symbols: DataFrame, files: DataFrame, file_id: int, limit: int = 10) -> DataFrame:
    """JN7: name, confidence, path, kind, line: the names that a file calls
    with up to ``limit`` definitions each by path and line, null without any.
    A PHP caller sees definitions in PHP files only."""
    called = relations.where((F.col("source_type") == "file") & (F.col("source_id") == file_id) & (F.col("relation") == "calls") & (F.col("target_type") == "symbol_name"))
    names = called.groupBy(F.col("target_id").alias("name")).agg(F.max("confidence").alias("confidence"))
    caller = F.broadcast(files.where(F.col("id") == file_id).select(F.col("language").alias("caller_language")))  # one row
    known = symbols.where(F.col("kind").isin("function", "method")).join(files.select(F.col("id").alias("file_id"), "path", "language"), "file_id")
    visible = known.join(caller, (F.col("caller_language") != "php") | (F.col("language") == "php"), "left_semi")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("path", "line", "kind", "id"))
    first = visible.join(names.select("name"), "name", "left_semi").withColumn("rank", rank).where(F.col("rank") <= limit)
    return names.join(first.select("name", "path", "kind", "line"), "name", "left")


def targets_among(relations: DataFrame, candidates: DataFrame) -> DataFrame:
    """target_id, linked: the candidate that a relation's target names, by its
    own path or the end of one, or by its file name."""
    normal = F.regexp_replace("target_id", r"^[./]+", "")
    suffixes = F.explode(T.path_suffixes(F.regexp_replace("path", r"^[./]+", "")))
    index = candidates.select("path", suffixes.alias("suffix")).groupBy("suffix").agg(F.min("path").alias("path"))
    whole = index.select(F.col("suffix").alias("normal"), F.col("path").alias("by_path"))
    name = index.select(F.col("suffix").alias("name"), F.col("path").alias("by_name"))
    targets = relations.select("target_id", normal.alias("normal")).distinct().withColumn("name", T.file_name(F.col("normal")))
    return targets.join(whole, "normal", "left").join(name, "name", "left").select("target_id", F.coalesce("by_path", "by_name").alias("linked")).where("linked is not null")


def _boosted() -> tuple:
    """(path that an edge boosts, path at its other end)."""
    inside = F.col("inside")
    return F.when(inside, F.when(F.col("linked") != F.col("source"), F.col("linked"))).otherwise(F.col("source")), F.when(inside, F.col("source")).otherwise(F.col("linked"))


def related_scores(relations: DataFrame, files: DataFrame, candidates: DataFrame, step: float = 0.5, most: float = 1.5, targets: DataFrame | None = None) -> DataFrame:
    """CX5: path, score: ``step`` per edge between a candidate and another file.

    An edge from a candidate boosts the path that it resolves to among the
    candidates, one from any other file that leads to a candidate boosts its
    source.  Equal edges are counted before they are dealt out.  ``targets``
    are ``targets_among`` the candidates where the caller has them."""
    targets = targets_among(relations, candidates) if targets is None else targets
    edges = relations.groupBy(F.col("source_id").alias("id"), "target_id").agg(F.count("*").alias("n")).join(files.select("id", F.col("path").alias("source")), "id")
    inside = candidates.select(F.col("path").alias("source"), F.lit(True).alias("inside")).distinct()
    found = edges.join(targets, "target_id").join(inside, "source", "left")
    return found.select(_boosted()[0].alias("path"), "n").where("path is not null").groupBy("path").agg(F.least(step * F.sum("n"), F.lit(most)).alias("score"))


def linked_edges(relations: DataFrame, files: DataFrame, candidates: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """CX5's edges one by one: path (boosted), other, source_id, relation,
    target_type, target_id, id."""
    targets = targets_among(relations, candidates) if targets is None else targets
    inside = candidates.select(F.col("path").alias("source"), F.lit(True).alias("inside")).distinct()
    edges = relations.select("id", "source_id", "relation", "target_type", "target_id").join(files.select(F.col("id").alias("source_id"), F.col("path").alias("source")), "source_id")
    path, other = _boosted()
    found = edges.join(targets, "target_id").join(inside, "source", "left")
    return found.select(path.alias("path"), other.alias("other"), "source_id", "relation", "target_type", "target_id", "id").where("path is not null")
