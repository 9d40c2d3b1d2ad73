"""Context ranking (CX1 to CX11), overview scoring (OV1) and tracing (TR1)."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as L, text as T
from ..sources.shared import stage
from .relations import related_scores

#: Weights of a query's tokens by source; "all" stands for sources not named.
Weights = dict[str, dict[str, float]]


def flat(tokens: list[str]) -> Weights:
    """Every token weighs 1 everywhere."""
    return {t: {"all": 1.0} for t in tokens}


def weight(weights: Weights, token: str, source: str) -> float:
    """AGG3: the weight of a token in a source, or in all, or 1."""
    own = weights[token]
    return own.get(source, own.get("all", 1.0))


def name_stem(path: Column) -> Column:
    """File name without its suffix, lower-cased, letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(T.file_name(path), r"(?<=.)\.[^.]*$", "")), "[^a-z0-9]", "")


def soft_path_matches(files: DataFrame, tokens: list[str]) -> DataFrame:
    """CX1: id, token, in_path, in_name: the best soft match of each long token
    with a term of the path and of the file name, from 0.78 on.

    The matcher sees every distinct term of the corpus that can match once: a
    cheap bound drops the others before the shuffle, so that their number
    doesn't weigh on the few tasks behind it."""
    long = [t for t in tokens if len(t) >= 6]
    terms = files.select("id", F.explode(T.path_tokens(F.col("path"))).alias("candidate"), T.path_tokens(T.file_name(F.col("path"))).alias("name"))
    terms = terms.select("id", "candidate", F.array_contains("name", F.col("candidate")).alias("named"))
    able = F.array(*[F.when(_may_match(t, F.col("candidate")), F.lit(t)) for t in long])
    pairs = terms.select("candidate", F.explode(able.cast("array<string>")).alias("token")).where("token is not null").distinct()
    found = soft_matches(pairs).where("score >= 0.78")
    best = terms.join(found, "candidate").groupBy("id", "token")
    return best.agg(F.max("score").alias("in_path"), F.max(F.when(F.col("named"), F.col("score"))).alias("in_name"))


def path_scores(files: DataFrame, weights: Weights, soft: bool = False) -> DataFrame:
    """CX1: id, path, score of files that a token hits.

    ``weights`` holds a query's tokens, a handful, which become expressions;
    with ``soft`` terms that are nearly a token count too."""
    name = T.file_name(F.col("path"))
    prepared = files.select("id", "path", F.lower("role").alias("role"), F.lower("language").alias("language"), T.path_tokens(F.col("path")).alias("in_path"), T.path_tokens(name).alias("in_name"), name_stem(F.col("path")).alias("stem"))
    score = F.lit(0.0)
    for t in weights:
        w_path, w_name = weight(weights, t, "path"), weight(weights, t, "filename")
        w_role = max(weight(weights, t, "role"), weight(weights, t, "language"))
        score = score + F.when(F.array_contains("in_path", t), 7.0 * w_path).otherwise(0.0)
        in_name = F.when(F.array_contains("in_name", t), 5.0 * w_name)
        score = score + (in_name.when(F.contains("stem", F.lit(t)), 4.0 * w_name) if len(t) >= 5 else in_name).otherwise(0.0)
        score = score + F.when(F.contains("role", F.lit(t)) | F.contains("language", F.lit(t)), 1.5 * w_role).otherwise(0.0)
    scored = prepared.withColumn("score", score)
    if soft and any(len(t) >= 6 for t in weights):
        points = F.lit(0.0)
        for t in weights:
            on = F.col("token") == t
            points = points + F.when(on & ~F.array_contains("paths", t), F.coalesce("in_path", F.lit(0.0)) * 2.5 * weight(weights, t, "path")).otherwise(0.0)
            points = points + F.when(on & ~F.array_contains("names", t), F.coalesce("in_name", F.lit(0.0)) * 2.0 * weight(weights, t, "filename")).otherwise(0.0)
        exact = prepared.select("id", F.col("in_path").alias("paths"), F.col("in_name").alias("names"))
        more = soft_path_matches(files, list(weights)).join(exact, "id").groupBy("id").agg(F.sum(points).alias("more"))
        scored = scored.join(more, "id", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return scored.where("score > 0").select("id", "path", "score")


def documentation_share(role: Column, kind: Column, tokens: list[str]) -> Column:
    """CX2: what a symbol of documentation counts, unless it is asked for."""
    if set(tokens) & set(L.DOCS_INTENT):
        return F.lit(1.0)
    return F.when(role == "documentation", F.when(kind.isin("heading", "command_example"), 0.25).otherwise(0.5)).otherwise(1.0)


def _any(text: Column, tokens) -> Column:
    """Whether any token is inside of a text."""
    return reduce(or_, [text.contains(t) for t in tokens], F.lit(False))


def _by_token(rows: DataFrame, text: Column, tokens) -> DataFrame:
    """The rows whose text holds a token, with it as ``token``, once for each."""
    each = F.explode(F.array(*[F.when(text.contains(t), F.lit(t)) for t in tokens]).cast("array<string>"))
    return rows.where(_any(text, tokens)).withColumn("token", each).where("token is not null")


def matched_symbols(symbols: DataFrame, files: DataFrame, tokens: list[str]) -> DataFrame:
    """CX2: file_id, path, token, id, share: the first symbol (by id) of a file
    that holds a token.

    A file's symbols of one kind are combined by a hash before the few kinds
    are compared, so that not all of them are sorted."""
    hits = _by_token(symbols, F.lower("name"), tokens)
    least = F.when(F.bool_or(F.col("id").isNull()), F.lit(None)).otherwise(F.min("id"))  # as in a struct, null is the least
    first = hits.groupBy("file_id", "token", "kind").agg(least.alias("id")).groupBy("file_id", "token").agg(F.min(F.struct("id", "kind")).alias("s"))
    named = first.join(files.select(F.col("id").alias("file_id"), "path", "role"), "file_id")
    return named.select("file_id", "path", "token", F.col("s.id").alias("id"), documentation_share(F.col("role"), F.col("s.kind"), tokens).alias("share"))


def _worth(weights: Weights, source: str) -> Column:
    """The weight in a source of the column ``token``."""
    out = F.lit(1.0)
    for t in weights:
        out = F.when(F.col("token") == t, weight(weights, t, source)).otherwise(out)
    return out


def symbol_scores(symbols: DataFrame, files: DataFrame, weights: Weights) -> DataFrame:
    """CX2: path, score: 3.5 times the weight and the symbol's share, once per
    file and token that a symbol name contains."""
    found = matched_symbols(symbols, files, list(weights))
    return found.groupBy("path").agg(F.sum(3.5 * _worth(weights, "symbol") * F.col("share")).alias("score"))


def matched_commits(commits: DataFrame, tokens) -> DataFrame:
    """CX3: the commits whose message holds a token."""
    return commits.where(_any(F.lower("message"), tokens))


def commit_scores(commits: DataFrame, commit_files: DataFrame, weights: Weights) -> DataFrame:
    """CX3: path, score: 1.2 times the weight per matching token and 0.8 per
    matching commit."""
    message = F.lower("message")
    points = sum((F.when(message.contains(t), 1.2 * weight(weights, t, "commit")).otherwise(0.0) for t in weights), F.lit(0.0))
    per_commit = matched_commits(commits, weights).select(F.col("id").alias("commit_id"), (points + 0.8).alias("score"))
    return commit_files.join(per_commit, "commit_id").groupBy("path").agg(F.sum("score").alias("score"))


def matched_calls(relations: DataFrame, files: DataFrame, tokens: list[str]) -> DataFrame:
    """CX4: path, token, target: the first called name of a file that holds a token."""
    names = relations.where((F.col("relation") == "calls") & (F.col("target_type") == "symbol_name"))
    called = _by_token(names, F.lower("target_id"), tokens).select(F.col("source_id").alias("id"), "target_id", "token").distinct()
    return called.groupBy("id", "token").agg(F.min("target_id").alias("target")).join(files.select("id", "path"), "id").select("path", "token", "target")


def call_scores(relations: DataFrame, files: DataFrame, weights: Weights) -> DataFrame:
    """CX4: path, score: 2.2 times the weight, once per file and token that a
    called name contains."""
    return matched_calls(relations, files, list(weights)).groupBy("path").agg(F.sum(2.2 * _worth(weights, "symbol")).alias("score"))


def pack_commits(commits: DataFrame, commit_files: DataFrame, candidates: DataFrame, tokens: list[str], limit: int = 5, most_files: int = 10) -> DataFrame:
    """CX11: id, date, message, files, total_files, files_truncated of the
    newest commits that a token is in and that touch a candidate or nothing."""
    message = F.lower("message")
    matched = commits.where(F.greatest(*[message.contains(t) for t in tokens]) if len(tokens) > 1 else message.contains(tokens[0]))
    touched = commit_files.join(matched.select(F.col("id").alias("commit_id")), "commit_id", "left_semi").distinct()
    on = candidates.select("path", F.lit(1).alias("on")).distinct()
    per_commit = touched.join(on, "path", "left").groupBy(F.col("commit_id").alias("id")).agg(F.count("*").alias("total_files"), F.count("on").alias("on"))
    kept = matched.join(per_commit, "id", "left").where("on is null or on > 0").orderBy(F.desc("date"), F.desc("id")).limit(limit)
    top = kept.select("id", "date", "message", F.coalesce("total_files", F.lit(0)).alias("total_files"))
    rank = F.row_number().over(Window.partitionBy("commit_id").orderBy("path"))
    few = touched.join(F.broadcast(top.select(F.col("id").alias("commit_id"))), "commit_id", "left_semi").withColumn("rank", rank).where(F.col("rank") <= most_files)  # ``limit`` rows
    listed = few.groupBy(F.col("commit_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("files"))
    return top.join(listed, "id", "left").select("id", "date", "message", F.coalesce("files", F.lit("")).alias("files"), "total_files", (F.col("total_files") > most_files).alias("files_truncated"))


def adjusted_by(scored: DataFrame, wants: Callable[[str], Column]) -> DataFrame:
    """CX6, CX7: multiplications by role and suffix, in order; ``wants`` says
    whether tests, ui, db, docs or examples are asked for."""
    role, ext = F.col("role"), T.extension(F.col("path"))
    docs = (role == "documentation") | ext.isin(".md", ".rst", ".txt")
    example = F.arrays_overlap(F.split(F.lower("path"), "/"), T.strings(L.EXAMPLE_PARTS))
    code = (role == "source") & ext.isin(".php", ".py", ".js", ".ts", ".go", ".rs")
    rules = (
        (~wants("tests") & (role == "test"), 0.45, 0.0),
        (~wants("ui") & ((role == "asset") | ext.isin(".css", ".scss", ".less")), 0.7, 0.0),
        (~wants("db") & ((role == "migration") | (ext == ".sql")), 0.75, 0.0),
        (wants("docs") & docs, 1.35, 1.0),
        (~wants("docs") & docs, 0.4, 0.0),
        (~wants("examples") & example, 0.5, 0.0),
        (code, 1.05, 0.1),
    )
    s = F.col("score")
    for condition, times, plus in rules:
        s = F.when(condition, s * times + plus).otherwise(s)
    return scored.withColumn("score", s)


def adjusted(scored: DataFrame, tokens: list[str]) -> DataFrame:
    """CX6, CX7 for one query."""
    words = {"tests": L.TEST_AWARE, "ui": L.UI_INTENT, "db": L.DB_INTENT, "docs": L.DOCS_INTENT, "examples": L.EXAMPLE_INTENT}
    return adjusted_by(scored, lambda k: F.lit(bool(set(tokens) & set(words[k]))))


def with_feedback(known: DataFrame) -> DataFrame:
    """CX8: adds raw: the score with the boost (or null) of feedback, lowered by
    its penalty."""
    boosted = F.col("score") + F.coalesce("boost", F.lit(0.0))
    final = F.when((F.coalesce("penalty", F.lit(0.0)) < 0) & (boosted > 0), F.greatest(F.lit(0.0), boosted + F.col("penalty")) * 0.35).otherwise(boosted)
    return known.withColumn("raw", F.round(final, 6))


def pack_scores(files: DataFrame, symbols: DataFrame, commits: DataFrame, commit_files: DataFrame, weights: Weights, relations: DataFrame | None = None, soft: bool = True) -> DataFrame:
    """CX1 to CX3, and CX4 if relations are given: path, score of every file
    that a token hits.  Of ``commit_files`` those of matched commits do."""
    rows = path_scores(files, weights, soft).select("path", "score").unionByName(symbol_scores(symbols, files, weights)).unionByName(commit_scores(commits, commit_files, weights))
    if relations is not None:
        rows = rows.unionByName(call_scores(relations, files, weights))
    return rows.groupBy("path").agg(F.sum("score").alias("score"))


def context_pack(
    files: DataFrame, symbols: DataFrame, commits: DataFrame, commit_files: DataFrame, signals: DataFrame, weights: Weights, limit: int = 10, relations: DataFrame | None = None, soft: bool = True, scores: DataFrame | None = None, targets: DataFrame | None = None
) -> DataFrame:
    """CX1 to CX9 as one plan (CX4 and CX5 if relations are given): path,
    language, role, raw score, score over the top score; best first, ties by
    path.  Only files of the index are listed.  ``scores`` and ``targets`` are
    the staged ``pack_scores`` and the ``targets_among`` their files, where the
    caller has them."""
    tokens = list(weights)
    total = pack_scores(files, symbols, commits, commit_files, weights, relations, soft) if scores is None else scores
    if relations is not None:
        total = stage(total, "pack-scores") if scores is None else total  # read three times below
        related = related_scores(relations, files, total.where("score > 0").select("path"), targets=targets)
        total = total.unionByName(related).groupBy("path").agg(F.sum("score").alias("score"))
    known = with_feedback(adjusted(files.select("path", "language", "role").join(total, "path"), tokens).join(signals, "path", "left"))
    top = known.select("path", "language", "role", "raw").where("raw > 0").orderBy(F.desc("raw"), "path").limit(limit)
    return top.withColumn("score", T.round_even(F.col("raw") / F.max("raw").over(Window.partitionBy()), 2))  # over at most ``limit`` rows


def related_symbols(symbols: DataFrame, files: DataFrame, tokens: list[str], candidates: DataFrame, limit: int = 10) -> DataFrame:
    """CX10: name, kind, path, line, score: 1 if the file is a candidate and 3
    if any token is in the name; best first, then by path, line, name and id.
    ``candidates`` (path) are the few of a pack."""
    any_token = F.exists(T.strings(tokens), lambda t: F.contains(F.lower("name"), t))
    on = F.broadcast(candidates.select("path", F.lit(1).alias("on")).distinct())  # as many rows as a pack lists
    named = symbols.join(files.select(F.col("id").alias("file_id"), "path").join(on, "path", "left"), "file_id")
    score = F.coalesce("on", F.lit(0)) + F.when(any_token, 3).otherwise(0)
    found = named.select("name", "kind", "path", F.coalesce("line", F.lit(0)).alias("line"), score.alias("score"), "id").where("score > 0")
    return found.orderBy(F.desc("score"), "path", "line", "name", "id").limit(limit).drop("id")


def _exact_matches(a: Column, b: Column) -> tuple[Column, Column]:
    """FN11: whether one is a long prefix of the other, and whether one is
    inside the other."""
    la, lb = F.char_length(a), F.char_length(b)
    short, long_ = F.least(la, lb), F.greatest(la, lb)
    prefix = (F.startswith(a, b) | F.startswith(b, a)) & (short >= 6) & (2 * short >= long_)
    return prefix, (F.contains(a, b) | F.contains(b, a)) & (short >= 6) & (short / long_ >= 0.65)


def _may_match(token: str, b: Column) -> Column:
    """False only where FN11 gives 0: no more letters can be shared than those
    of ``b`` that the token has at all."""
    la, lb = F.lit(len(token)), F.char_length(b)
    common = F.least(la, lb - F.char_length(F.translate(b, token, "")))
    prefix, inside = _exact_matches(F.lit(token), b)
    return prefix | inside | (2 * common / (la + lb) >= 0.82)


def soft_matches(pairs: DataFrame) -> DataFrame:
    """FN11 over distinct (token, candidate) pairs: a long common prefix gives
    0.9, else one inside the other 0.84, else the sequence similarity from 0.82
    on; 0 below the thresholds and for noise.

    Twice the letters that both have, and twice the shorter length, over the
    sum of the lengths bound the similarity, so few pairs reach Python."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    ratio = ratio.asNondeterministic()  # else Spark moves the filter on it below the distinct, to every occurrence
    a, b = F.col("token"), F.col("candidate")
    la, lb = F.char_length(a), F.char_length(b)
    prefix, inside = _exact_matches(a, b)
    fine = (la >= 6) & (lb >= 5) & ~T.is_noise(a) & ~T.is_noise(b)
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.least(la - F.char_length(F.replace(a, c)), lb - F.char_length(F.replace(b, c))))
    near = (2 * shared / (la + lb) >= 0.82) & ~prefix & ~inside
    known = pairs.distinct().where(fine).select("token", "candidate", F.when(prefix, 0.9).when(inside, 0.84).alias("exact"), near.alias("near"))
    by_ratio = known.where("near").withColumn("ratio", ratio(a, b)).select("token", "candidate", F.when(F.col("ratio") >= 0.82, F.col("ratio")).otherwise(0.0).alias("score"))
    return known.where("not near").select("token", "candidate", F.coalesce("exact", F.lit(0.0)).alias("score")).unionByName(by_ratio)


def semantic_depth(path: Column) -> Column:
    """FN19: depth without a leading folder that only holds the sources."""
    return T.depth(path) - F.when(F.split(path, "/")[0].isin("src", "lib", "app"), 1).otherwise(0)


def framework_points(path: Column) -> Column:
    """FN20: 12 or 8 for the package file of commands, servers or routing."""
    parts = F.split(F.lower(path), "/")
    package = (T.file_name(path) == "__init__.py") & (semantic_depth(path) <= 4)
    return F.when(package & F.arrays_overlap(parts, T.strings(L.FRAMEWORK_COMMANDS)), 12).when(package & F.arrays_overlap(parts, T.strings(L.FRAMEWORK_ROUTES)), 8).otherwise(0)


def first_reads(files: DataFrame, symbols: DataFrame, limit: int = 12) -> DataFrame:
    """OV1: path, score by path, role and what a file declares; best first,
    ties by depth and path."""
    path, role = F.col("path"), F.col("role")
    name, depth, lower = T.file_name(path), T.depth(path), F.lower(path)
    top = depth == 1
    said = F.lower("name")
    telling = F.col("kind").isin("class", "function", "struct", "impl") & (said.isin(L.ENTRY_NAMES) | said.endswith("app"))
    flags = {"project_script": F.col("kind") == "project_script", "package_script": F.col("kind") == "package_script", "route": F.col("kind") == "route", "entry": telling}
    declared = symbols.groupBy(F.col("file_id").alias("id")).agg(*[F.bool_or(c).alias(f"has_{k}") for k, c in flags.items()])
    has = lambda k: F.coalesce(f"has_{k}", F.lit(False))
    score = (
        F.when(name.isin(L.MANIFESTS), F.when(top, 12).otherwise(4)).otherwise(0)
        + F.when(F.lower(name).startswith("readme."), F.when(top, 9).otherwise(4)).otherwise(0)
        + F.when(name.isin(L.OVERVIEW_CONFIGS), 4).when(role == "config", 2).otherwise(0)
        + F.when(name.isin(L.ENTRY_FILES), 8).otherwise(0)
        + framework_points(path)
        + F.when(F.arrays_overlap(F.split(lower, "/"), T.strings(L.ENTRY_PARTS)), 4).otherwise(0)
        + F.when(role == "route", 5).otherwise(0)
        - F.when(role.isin("asset", "migration"), 3).otherwise(0)
        + F.when(has("project_script"), 4).otherwise(0)
        + F.when(has("package_script"), 3).otherwise(0)
        + F.when(has("route") & (role != "test"), 3).otherwise(0)
        + F.when(has("entry"), 7).otherwise(0)
        + F.when(lower.contains("/src/") | lower.startswith("src/"), 1).otherwise(0)
        - F.when(lower.contains("/docs/") | lower.startswith("docs/"), 2).otherwise(0)
    )
    score = F.when(role == "test", score * 0.2).otherwise(score * 1.0)
    return files.join(declared, "id", "left").select("path", F.round(score, 6).alias("score"), depth.alias("depth")).where("score > 0").orderBy(F.desc("score"), "depth", "path").limit(limit).drop("depth")


def _framework_entry(path) -> Column:
    return framework_points(path) > 0


def entry_points(files: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """OV2: path, name, kind, line: scripts, routes, telling names and entry
    files; by kind of entry, depth, path, line and name, each once."""
    path, name = F.col("path"), F.lower("name")
    named = symbols.join(files.select(F.col("id").alias("file_id"), "path", "role"), "file_id")
    told = F.col("kind").isin("project_script", "package_script", "route") | name.isin(L.ENTRY_NAMES) | name.endswith("app")
    from_symbols = named.where(told & ~((F.col("role") == "test") & (F.col("kind") == "route"))).select("path", "name", "kind", F.coalesce("line", F.lit(0)).alias("line"), F.lit(0).alias("late"))
    is_entry = T.file_name(path).isin(L.ENTRY_FILES)
    from_files = files.where(is_entry | _framework_entry(path)).select("path", T.file_name(path).alias("name"), F.lit("file").alias("kind"), F.lit(0).alias("line"), F.lit(1).alias("late"))
    each = from_symbols.unionByName(from_files).groupBy("path", "kind", "name").agg(F.min(F.struct("late", "line")).alias("at"))
    priority = F.when(F.col("kind") == "project_script", 0).when(is_entry, 1).when(_framework_entry(path), 2).when(F.col("kind") == "route", 3).when(F.col("kind") == "package_script", 4).otherwise(5)
    order = [priority, T.depth(path), "path", "at", "name", "kind"]
    return each.orderBy(*order).limit(limit).select("path", "name", "kind", F.col("at.line").alias("line"))


def manifests(files: DataFrame, symbols: DataFrame, most_symbols: int = 5, limit: int = 10) -> DataFrame:
    """OV3: path, language, role, symbols (kind:name, by line): manifests first,
    then readmes, other manifests and configuration; by depth and path."""
    path = F.col("path")
    name = T.file_name(path)
    readme = name.isin(L.README_NAMES) | F.lower(name).startswith("readme.")
    wanted = files.where(name.isin(L.MANIFESTS) | name.isin(L.OVERVIEW_CONFIGS) | readme | (F.col("role") == "config"))
    priority = F.when(name.isin(L.FIRST_MANIFESTS), 0).when(readme, 1).when(name.isin(L.MANIFESTS), 2).otherwise(3)
    top = wanted.orderBy(priority, T.depth(path), "path").limit(limit).select("id", "path", "language", "role")
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("line", "name", "kind"))
    own = symbols.join(F.broadcast(top.select(F.col("id").alias("file_id"))), "file_id", "left_semi").withColumn("rank", rank).where(F.col("rank") <= most_symbols)  # ``limit`` files
    listed = own.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "kind", "name").alias("label")))).alias("s"))
    return top.join(listed, "id", "left").select("path", "language", "role", F.coalesce(F.array_join(F.col("s.label"), ","), F.lit("")).alias("symbols"))


def _role_bias(role, path, tokens: list[str]):
    lower = F.lower(path)
    tests = 2.0 if any("test" in t for t in tokens) else -4.0
    docs = 1.0 if set(tokens) & set(L.TRACE_DOCS) else -3.0
    return (
        F.when(role == "test", tests).otherwise(0.0)
        + F.when((role == "documentation") | lower.rlike(r"\.(md|rst)$"), docs).otherwise(0.0)
        - F.when(lower.contains("/versions/") | lower.startswith("alembic/") | lower.contains("/migrations/"), 3.0).otherwise(0.0)
        - F.when(lower.rlike(r"\.(css|png|jpg|jpeg|gif|webp|svg)$"), 4.0).otherwise(0.0)
    )


def trace_starts(files: DataFrame, symbols: DataFrame, tokens: list[str], by_query: int = 4, limit: int = 8) -> DataFrame:
    """TR3: id, path, place: files that score by long or test tokens in path
    and content, negative scores too (ties by id), then the overview's entry
    points, or files with a usual name or a route where it has none."""
    strong = [t for t in tokens if len(t) >= 8 or "test" in t]
    path, text = F.lower("path"), F.lower(F.coalesce("content", F.lit("")))
    score = sum((F.when(path.contains(t), 4.0).otherwise(0.0) + F.when(text.contains(t), 2.0).otherwise(0.0) for t in strong), F.lit(0.0)) + _role_bias(F.col("role"), F.col("path"), tokens)
    queried = files.select("id", "path", score.alias("score")).where("score <> 0").orderBy(F.desc("score"), "id").limit(by_query)
    rows = queried.select("id", "path", F.struct(F.lit(0).alias("part"), (-F.col("score")).alias("first"), F.col("id").cast("double").alias("second")).alias("place"))
    entries = entry_points(files, symbols, 4)
    at = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # four rows in their order
    known = entries.withColumn("at", at).join(files.select("id", "path"), "path").groupBy("id", "path").agg(F.min("at").cast("double").alias("at"))
    from_entries = known.select("id", "path", F.struct(F.lit(1).alias("part"), F.col("at").alias("first"), F.lit(0.0).alias("second")).alias("place"))
    usual = F.when(F.lower(T.file_name(F.col("path"))).isin(L.START_FILES), 10.0).otherwise(0.0) + F.when(F.col("role") == "route", 4.0).otherwise(0.0)
    fallback = files.select("id", "path", usual.alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("id")).limit(6)
    none = entries.agg(F.count("*").alias("n")).where("n = 0")
    from_names = fallback.crossJoin(F.broadcast(none)).select("id", "path", F.struct(F.lit(1).alias("part"), (-F.col("score")).alias("first"), (-F.col("id")).cast("double").alias("second")).alias("place"))  # one row at most
    each = rows.unionByName(from_entries).unionByName(from_names).groupBy("id", "path").agg(F.min("place").alias("order"))
    return each.withColumn("place", F.row_number().over(Window.orderBy("order"))).where(F.col("place") <= limit).select("id", "path", "place")  # at most 14 rows


def emits_markup(text: Column) -> Column:
    return text.rlike(r"<h[1-6]\b|echo\s+['\"]<|<main\b|<title\b|render\(|template")


def trace_scores(files: DataFrame, tokens: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """TR4: path, score, and the kept columns, of files (path, content,
    distance) on a trace."""
    lower, text = F.lower("path"), F.lower(F.coalesce("content", F.lit("")))
    score = F.greatest(F.lit(0.1), 3.0 - F.col("distance") * 0.35)
    name = T.file_name(lower)
    for t in sorted(set(tokens)):
        score = score + F.when(lower.contains(t), 4.0).otherwise(0.0) + F.when(text.contains(t), 2.0).when(name.contains(t), 1.5).otherwise(0.0)
    role = F.when(lower.contains("/test") | lower.startswith("test"), "test").when(lower.rlike(r"\.(md|rst)$"), "documentation").otherwise("")
    service = F.greatest(*[lower.contains(p) for p in L.SERVICE_PARTS])
    acts = text.rlike(r"\b(handle|process|dispatch|orchestrat|route|persist|create)_?[a-z_]*\b")
    score = score + _role_bias(role, lower, tokens) + F.when(service, 1.0).otherwise(0.0) + F.when(acts, 0.75).otherwise(0.0) + F.when(emits_markup(text), 2.0).otherwise(0.0)
    return files.select("path", F.round(F.greatest(F.lit(0.0), score), 6).alias("score"), *keep)


def trace_profile(tokens) -> Column:
    """TR6 over a column of token lists."""
    return F.when(F.arrays_overlap(tokens, T.strings(L.RENDER_TOKENS)), "entrypoint_render").when(F.exists(tokens, lambda t: t.contains("test")), "test_trace").otherwise("entrypoint_trace")
