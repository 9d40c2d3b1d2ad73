"""Edges between files, and traces along them (JN10, TR1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..sources.shared import stage
from . import ranking

INCLUDES = ("include", "include_once", "require", "require_once")
SCRIPT_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx")


def _folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def _under(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def _included(source: Column, target: Column) -> Column:
    """Where an include may lead: from the root, from the file's folder, or to
    a file of that name in it."""
    name = F.regexp_replace(target, "^/+", "")
    folder = _folder(source)
    found = F.array(name, _under(folder, name), _under(folder, T.file_name(name)))
    return F.transform(found, T.normal_path)


def _imported(source: Column, target: Column) -> Column:
    """Where a module may be: a relative one beside the file as a script or an
    index of a folder, any as a Python module or package, also under src."""
    up = F.char_length(F.regexp_extract(target, r"^((?:\.\./)*)", 1)) / 3
    rest = F.regexp_replace(F.regexp_replace(target, r"^(?:\.\./)+", ""), r"^\./", "")
    parts = F.split(source, "/")
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1 - up.cast("int"), F.lit(0))), "/")
    base = _under(folder, rest)
    near = F.array(*[F.concat(base, F.lit(x)) for x in SCRIPT_SUFFIXES], *[F.concat(base, F.lit(f"/index{x}")) for x in SCRIPT_SUFFIXES])
    dotted = F.replace(target, F.lit("."), F.lit("/"))
    python = F.array(*[F.concat(F.lit(a), dotted, F.lit(b)) for a in ("", "src/") for b in (".py", "/__init__.py")])
    return F.when(target.startswith("."), F.concat(near, python)).otherwise(python)


def _rendered(target: Column) -> Column:
    """Where a template may be, besides any folder of templates."""
    plain = F.array(target, F.concat(F.lit("templates/"), target))
    app = F.substring_index(target, "/", 1)
    rest = F.expr("substring(target_id, length(substring_index(target_id, '/', 1)) + 2)")
    return F.when(target.contains("/"), F.concat(plain, F.array(F.concat(app, F.lit("/templates/"), app, F.lit("/"), rest)))).otherwise(plain)


def resolved_edges(relations: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """JN10: id (the relation's), source, target (file ids), relation, target_id, confidence.

    Includes, imports and templates lead to the first of their candidate paths
    that is a file, templates else to the first path that ends with them under
    a folder of templates; names that are called or handle a route lead to
    every file that defines them, whatever the case.  Edges to the file itself
    are left out.  Candidates are joined by equality, path ends too."""
    target = F.col("target_id")
    named = relations.where("source_type = 'file'").join(files.select(F.col("id").alias("source_id"), F.col("path").alias("source_path")), "source_id")
    keyed = named.select("id", "source_id", "source_path", "relation", "target_type", "target_id", "confidence")
    candidates = (
        F.when((F.col("target_type") == "file") & F.col("relation").isin(*INCLUDES), _included(F.col("source_path"), target))
        .when((F.col("target_type") == "module") & (F.col("relation") == "imports"), _imported(F.col("source_path"), target))
        .when((F.col("target_type") == "template") & (F.col("relation") == "renders_template"), _rendered(target))
    )
    wanted = keyed.where("relation <> 'calls' AND relation <> 'route_to_handler'").select("source_path", "relation", "target_type", "target_id").distinct()
    tried = wanted.withColumn("candidates", candidates).where("candidates is not null").select("source_path", "relation", "target_type", "target_id", F.posexplode("candidates").alias("priority", "path"))
    known = files.select(F.col("id").alias("target"), "path")
    # templates that no candidate has: path ends under a folder of templates, by the smallest path
    ends = files.where("path LIKE '%/templates/%'").select("id", "path", F.explode(T.path_suffixes(F.col("path"))).alias("end"))
    ends = ends.where("end LIKE 'templates/%' AND length(end) < length(path)").select(F.expr("substring(end, 11)").alias("name"), F.struct("path", "id").alias("at")).groupBy("name").agg(F.min("at").alias("at"))
    by_end = wanted.where("relation = 'renders_template' AND target_type = 'template'").withColumn("name", F.regexp_replace("target_id", "^/+", "")).join(ends, "name")
    rows = tried.join(known, "path").select("source_path", "relation", "target_type", "target_id", "priority", "target")
    rows = rows.unionByName(by_end.select("source_path", "relation", "target_type", "target_id", F.lit(99).alias("priority"), F.col("at.id").alias("target")))
    first = rows.groupBy("source_path", "relation", "target_type", "target_id").agg(F.min(F.struct("priority", "target")).alias("best"))
    by_path = keyed.join(first, ["source_path", "relation", "target_type", "target_id"]).select("id", "source_id", F.col("best.target").alias("target"), "relation", "target_id", "confidence")
    defined = symbols.select(F.lower("name").alias("lower"), F.col("file_id").alias("target")).distinct()
    called = keyed.where("target_type = 'symbol_name' AND relation IN ('calls', 'route_to_handler')").withColumn("lower", F.lower("target_id"))
    by_name = called.join(defined, "lower").select("id", "source_id", "target", "relation", "target_id", "confidence")
    return by_path.unionByName(by_name).where("source_id <> target").withColumnRenamed("source_id", "source")


#: The texts of a trace's reasons.
AT_DISTANCE, IN_PATH, IN_CONTENT, IN_NAME = "reachable from start at distance ", 'path contains "', 'content contains "', 'filename contains "'
MARKUP, MATCHED, ROUTE_START, USUAL_START = "emits HTML/render markup", "query matched path tokens: ", "route file selected as likely runtime start", " selected as likely entrypoint/start file"
REACHED, IS_START, FOLLOWED = " is reachable through ", " is a start file; ", "followed "
MOST_REASONS, MOST_MATCHES = 8, 4


def strongest(edges: DataFrame, fan_out: int = 25) -> DataFrame:
    """TR2: source, target, place, relation, target_id, confidence: of each
    file's ``fan_out`` best edges (includes weigh 4, imports 2, others 1, and
    their confidence; ties by the relation's id, then target) the best to every
    target.  Spark keeps the best few of every task before it shuffles, so a
    file with very many edges is no burden."""
    base = F.when(F.col("relation").isin(*INCLUDES), 4.0).when(F.col("relation") == "imports", 2.0).otherwise(1.0)
    sure = F.coalesce("confidence", F.lit(0.0))
    order = Window.partitionBy("source").orderBy(F.desc(base + sure), "id", "target")
    few = edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= fan_out)
    best = few.groupBy("source", "target").agg(F.min(F.struct("place", "relation", F.coalesce("target_id", F.lit("")).alias("target_id"), F.round(sure, 3).alias("confidence"))).alias("edge"))
    return best.select("source", "target", "edge.*")


def _newest(labels: DataFrame, hop: int, top: int) -> DataFrame:
    return labels.where(F.shiftright("code", top) == hop)


def path_labels(strong: DataFrame, starts: DataFrame, max_depth: int = 4, fan_out: int = 25) -> DataFrame:
    """TR1: start, target, hops, order, ids: for every start (node) and file the
    first of the shortest paths along the ``strongest`` edges, in the order in
    which a breadth-first search finds them.

    A score falls with the distance, so no other path of the pair can come
    before it.  A path is a number: its hops, then the places of its edges.
    Each round joins the newest labels with the edges once and keeps the least
    number per start and file; the rows of a start stay together, side by side,
    so that little is shuffled.  ``order`` holds the places, ``ids`` the files
    on the way, found again at the end: the number without its last place is
    that of another label of the start (at most fan_out ** max_depth of them)."""
    bits = fan_out.bit_length()
    top = bits * max_depth
    if top > 60:
        raise ValueError("paths of so many places have no number")
    node = F.col("node").cast("bigint")
    known = starts.select(node.alias("start"), node.alias("target"), F.lit(0).cast("bigint").alias("code")).distinct()
    edges = strong.select("source", F.col("target").alias("next"), "place")
    for hop in range(1, max_depth + 1):
        known = stage(known, f"trace-{hop - 1}")
        front = _newest(known, hop - 1, top)
        if front.isEmpty():
            break
        places = F.col("code").bitwiseAND(F.lit((1 << top) - 1))
        code = F.lit(hop << top) + F.shiftleft(places, bits) + F.col("place")
        longer = front.join(edges, F.col("target") == F.col("source")).select("start", F.col("next").alias("target"), code.alias("code"))
        known = known.unionByName(longer).repartition("start").groupBy("start", "target").agg(F.min("code").alias("code"))

    def walk(table: pa.Table) -> pa.Table:
        code, target = table.column("code").to_numpy(), table.column("target").to_numpy()
        by_code = np.argsort(code)
        code, target = code[by_code], target[by_code]
        hops = code >> top
        least, most = (1 << bits) - 1, (1 << top) - 1
        steps = [np.zeros((0, 2), np.int64)]
        for n in range(int(hops[-1]) + 1):
            of = code[hops == n] & most
            prefixes = [((k << top) | (of >> bits * (n - k)), of >> bits * (n - k)) for k in range(1, n + 1)]
            ids = [target[np.searchsorted(code, whole)] for whole, _ in prefixes]
            steps.append(np.stack([np.array(ids).T.ravel(), np.array([p & least for _, p in prefixes]).T.ravel()], axis=1) if n else np.zeros((0, 2), np.int64))
        ids, order = np.concatenate(steps).astype(np.int64).T
        at = pa.array(np.append(0, np.cumsum(hops)), pa.int32())
        listed = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (order.astype(np.int32), ids)]
        return pa.table([table.column("start"), pa.array(target), pa.array(hops.astype(np.int32)), *listed], names=["start", "target", "hops", "order", "ids"])

    return known.groupBy("start").applyInArrow(walk, "start bigint, target bigint, hops int, order array<int>, ids array<bigint>")


def with_edges(paths: DataFrame, strong: DataFrame) -> DataFrame:
    """``paths`` (start, target, order, ids and others) with ``edges`` (source,
    target, relation, target_id, confidence) in place of ids."""
    before = F.transform("ids", lambda x, i: F.when(i == 0, F.col("start")).otherwise(F.get("ids", i - 1)))
    steps = paths.select("start", "target", F.posexplode(F.arrays_zip(before.alias("source"), "order")).alias("at", "step"))
    keyed = steps.select(F.col("start").alias("s"), F.col("target").alias("t"), "at", "step.source", F.col("step.order").alias("place"))
    edge = F.struct("source", "target", "relation", "target_id", "confidence")
    named = keyed.join(strong, ["source", "place"]).select("s", "t", F.struct("at", edge.alias("edge")).alias("x"))
    listed = named.groupBy("s", "t").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["edge"]).alias("edges"))  # as many as a path has
    none = F.array().cast("array<struct<source:bigint,target:bigint,relation:string,target_id:string,confidence:double>>")
    joined = paths.join(listed, (F.col("start") == F.col("s")) & (F.col("target") == F.col("t")), "left")
    return joined.withColumn("edges", F.coalesce("edges", none)).drop("s", "t", "ids")


def best_paths(edges: DataFrame, starts: DataFrame, max_depth: int = 4, fan_out: int = 25) -> DataFrame:
    """TR1: start, target, hops, order, edges of ``path_labels``."""
    strong = stage(strongest(edges, fan_out), "trace-edges")
    return with_edges(stage(path_labels(strong, starts, max_depth, fan_out), "trace-paths"), strong)


def first_paths(strong: DataFrame, starts: DataFrame, max_depth: int = 4) -> DataFrame:
    """TR1: target, start, hops, ids: every file in reach once, by the first of
    its shortest paths from any start; ties by start, then as a search from it
    finds them.

    A file before the last one of such a path has the path's beginning as its
    own first path, so one label a file is enough, and work grows with the
    edges, not with the pairs of starts and files."""
    node = F.col("node").cast("bigint")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    known = front = stage(starts.select(node.alias("target"), node.alias("start"), F.lit(0).alias("hops"), none("int").alias("order"), none("bigint").alias("ids")).distinct(), "first-0")
    for hop in range(1, max_depth + 1):
        longer = front.alias("f").join(strong.alias("s"), F.col("f.target") == F.col("s.source")).select(
            F.col("s.target").alias("target"), F.struct("f.start", F.concat("f.order", F.array("s.place")).alias("order"), F.concat("f.ids", F.array("s.target")).alias("ids")).alias("x")
        )
        first = longer.join(known.select("target"), "target", "left_anti").groupBy("target").agg(F.min("x").alias("x"))
        front = stage(first.select("target", "x.start", F.lit(hop).alias("hops"), "x.order", "x.ids"), f"first-{hop}")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known.select("target", "start", "hops", "ids")


def _reasons(tokens: list[str]) -> Column:
    """Why a file (path, content, distance) has its score, in order, the first few."""
    lower, text = F.lower("path"), F.lower(F.coalesce("content", F.lit("")))
    said = [F.concat(F.lit(AT_DISTANCE), F.col("distance").cast("string"))]
    for t in sorted(set(tokens)):
        said.append(F.when(lower.contains(t), F.lit(f'{IN_PATH}{t}"')))
        said.append(F.when(text.contains(t), F.lit(f'{IN_CONTENT}{t}"')).when(T.file_name(lower).contains(t), F.lit(f'{IN_NAME}{t}"')))
    said.append(F.when(ranking.emits_markup(text), F.lit(MARKUP)))
    return F.slice(F.array_compact(F.array(*said)), 1, MOST_REASONS)


def _start_reason(path: Column, role: Column, tokens: list[str]) -> Column:
    found = F.array_compact(F.array(*[F.when(F.lower(path).contains(t), F.lit(t)) for t in sorted(set(tokens))]))
    matched = F.concat(F.lit(MATCHED), F.array_join(F.slice(found, 1, MOST_MATCHES), ", "))
    return F.when(F.size(found) > 0, matched).when(role == "route", ROUTE_START).otherwise(F.concat(T.file_name(path), F.lit(USUAL_START)))


def trace(edges: DataFrame, files: DataFrame, starts: DataFrame, tokens: list[str], max_depth: int = 4, limit: int = 10) -> DataFrame:
    """TR1: rank, target, score, distance, trail, edges, start_reason,
    why_this_path, reasons: files that the starts (id, place) lead to, best
    first.

    A file that several paths lead to stands at the place of the best of them,
    with the best path that has edges if there is one.  Paths are at most
    min(max_depth, 6) long, starts at most eight.  Only the ``limit`` best
    files (30 at most) meet in one task."""
    few = F.broadcast(starts.orderBy("place").limit(8).select(F.col("id").cast("bigint").alias("start"), F.col("place").alias("start_place")))  # eight rows
    strong = stage(strongest(edges), "trace-edges")
    labels = path_labels(strong, few.select(F.col("start").alias("node")), max(1, min(max_depth, 6))).join(few, "start")
    own = F.struct("hops", "start_place", "order", "start", "ids")
    best = labels.groupBy("target").agg(F.min(own).alias("first"), F.min(F.when(F.col("hops") > 0, own)).alias("shown"))
    best = best.select(F.col("target").alias("id"), "first", F.coalesce("shown", "first").alias("shown"))
    on = best.join(files.select("id", "path", "role", "content"), "id")
    first = ranking.trace_scores(on.withColumn("distance", F.col("first.hops")), tokens, keep=("id", "role", "content", "first", "shown")).withColumnRenamed("score", "first_score").where("first_score > 0")
    scored = ranking.trace_scores(first.withColumn("distance", F.col("shown.hops")), tokens, keep=("id", "first", "shown", "first_score", "distance", "role", "content"))
    # a path with edges counts only if its own score is above 0
    bare = F.col("score") <= 0
    order = [F.desc("first_score"), F.col("first.start_place"), F.col("first.hops"), F.col("first.order")]
    rows = scored.orderBy(*order).limit(max(1, min(limit, 30)))
    rows = rows.select(
        "id",
        F.struct((-F.col("first_score")).alias("s"), F.col("first.start_place").alias("p"), F.col("first.hops").alias("h"), F.col("first.order").alias("o")).alias("at"), "path", "content",
        F.when(bare, F.col("first_score")).otherwise(F.col("score")).alias("score"), F.when(bare, F.col("first")).otherwise(F.col("shown")).alias("x"),
    ).select("at", "path", "content", "score", F.col("id").alias("target"), "x.start", F.col("x.hops").alias("distance"), "x.order", "x.ids")
    rows = stage(rows.select("*", _reasons(tokens).alias("reasons")).drop("content"), "trace-rows")  # 30 rows at most
    return _explained(with_edges(rows, strong).withColumnRenamed("edges", "taken").drop("target", "order"), files, tokens)


def _explained(rows: DataFrame, files: DataFrame, tokens: list[str]) -> DataFrame:
    """The few rows of a trace with paths in place of ids."""
    named = rows.select("path", F.explode(F.concat(F.array("start"), F.col("taken.target"))).alias("id")).select("id").distinct()
    names = F.broadcast(files.join(F.broadcast(named), "id", "left_semi").select("id", F.col("path").alias("name"), F.col("role").alias("its_role")))  # at most seven a row
    steps = rows.select("path", F.posexplode(F.concat(F.array(F.struct(F.col("start").alias("target"), F.lit("").alias("relation"), F.lit("").alias("target_id"), F.lit(0.0).alias("confidence"))), F.transform("taken", lambda e: F.struct(e["target"].alias("target"), e["relation"].alias("relation"), e["target_id"].alias("target_id"), e["confidence"].alias("confidence"))))).alias("at_step", "e"))
    steps = steps.join(names, F.col("e.target") == F.col("id"))
    listed = steps.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at_step", "name", "its_role", "e"))).alias("steps"))
    step = F.col("steps")
    pairs = F.transform(
        F.slice(step, 2, F.greatest(F.size(step) - 1, F.lit(0))),
        lambda x, i: F.struct(
            F.get(step, i)["name"].alias("from"), x["name"].alias("to"), x["e"]["relation"].alias("relation"), x["e"]["confidence"].alias("confidence"),
            F.concat(F.lit(FOLLOWED), x["e"]["relation"], F.lit(" relation to "), F.when(x["e"]["target_id"] != "", x["e"]["target_id"]).otherwise(x["name"])).alias("reason"),
        ),
    )
    full = rows.join(F.broadcast(listed), "path").withColumn("edges", pairs)
    chain = F.array_join(F.transform("edges", lambda e: e["relation"]), " -> ")
    why = F.when(F.size("edges") > 0, F.concat("path", F.lit(REACHED), chain, F.lit("; "), F.get("reasons", F.lit(0)))).otherwise(F.concat("path", F.lit(IS_START), F.get("reasons", F.lit(0))))
    start = F.get(step, F.lit(0))
    return full.select(
        F.row_number().over(Window.orderBy("at")).alias("rank"), F.col("path").alias("target"), F.round("score", 3).alias("score"), "distance",
        F.array_join(F.transform(step, lambda x: x["name"]), " > ").alias("trail"), "edges", _start_reason(start["name"], start["its_role"], tokens).alias("start_reason"),
        why.alias("why_this_path"), "reasons",
    )
