"""Term weights of a query, and why a context pack lists what it lists (AGG1,
AGG3, CX12 to CX14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as L, text as T
from ..sources.shared import stage
from . import listing, memory, ranking, term_index
from .ranking import Weights, weight
from .relations import linked_edges
from .term_index import source_documents


def all_term_stats(files: DataFrame, symbols: DataFrame, commits: DataFrame) -> DataFrame:
    """AGG1: term, source, document_count, total_count, weight, for every
    source and for ``all`` of them together."""
    docs = source_documents(files, symbols, commits)
    return term_index.weighed(term_index.counts(docs), term_index.sizes(docs))


def query_weights(stats: DataFrame, tokens: list[str], texts: DataFrame) -> Weights:
    """AGG3: the weights of a query's tokens by source, from the statistics; a
    token without any weighs 0.25.  If no token has statistics, AGG2's weights
    over ``texts`` (text) count for all sources.  At most eight numbers a token
    come to the driver."""
    found: Weights = {}
    for r in stats.where(F.col("term").isin(tokens)).select("term", "source", "weight").collect():
        found.setdefault(r.term, {})[r.source] = r.weight
    if found or not tokens:
        return {t: found.get(t, {"all": 0.25}) for t in tokens}
    return {r.token: {"all": r.weight} for r in listing.fallback_weights(texts, tokens).collect()}


def _weight_reason(token: str, w: float) -> str | None:
    return f'common token "{token}" downweighted' if w <= 1.2 else f'specific token "{token}" boosted' if w >= 1.4 else None


def _when(condition: Column, reason: str | None, *order) -> Column:
    """A reason with its place in the list, null where it doesn't hold."""
    place = F.array(*[F.lit(x).cast("string") if isinstance(x, str) else F.lit(f"{x:04d}") for x in order])
    return F.when(condition, F.struct(place.alias("place"), F.lit(reason).alias("reason"))) if reason else F.lit(None)


def _listed(df: DataFrame, reasons: list[Column]) -> DataFrame:
    return df.select("path", F.explode(F.array_compact(F.array(*reasons))).alias("r")).select("path", "r.place", "r.reason")


def _padded(x: Column) -> Column:
    """Numbers as texts that sort alike."""
    return F.lpad(x.cast("string"), 20, "0")


def pack_reasons(
    pack: DataFrame, files: DataFrame, symbols: DataFrame, commits: DataFrame, commit_files: DataFrame, feedback: DataFrame, relations: DataFrame, candidates: DataFrame, weights: Weights, query: str, most: int = 8, targets: DataFrame | None = None
) -> DataFrame:
    """CX13: path, reasons (array): why the files of a pack are in it, in the
    order in which the rules are applied, each once, at most ``most``.  What
    lowers or prefers a file comes first, the last rule foremost.

    ``pack`` (path) has few rows, which are read once and sent to every task;
    ``candidates`` (path) are all files with a score before CX5, ``targets`` the
    ``targets_among`` them where the caller has those."""
    tokens = list(weights)
    paths = [r.path for r in pack.select("path").distinct().collect()]  # as many rows as a pack lists
    listed_paths = pack.sparkSession.range(1).select(F.explode(T.strings(paths)).alias("path"))  # without a Python process a task
    top = F.broadcast(listed_paths)
    own = files.join(top, "path", "left_semi")
    name = T.file_name(F.col("path"))
    soft = ranking.soft_path_matches(own, tokens) if any(len(t) >= 6 for t in tokens) else None
    prepared = own.select("id", "path", F.lower("role").alias("role"), F.lower("language").alias("language"), T.path_tokens(F.col("path")).alias("in_path"), T.path_tokens(name).alias("in_name"), ranking.name_stem(F.col("path")).alias("stem"))
    if soft is not None:
        prepared = prepared.join(soft.groupBy("id").agg(F.collect_set(F.when(F.col("in_path") >= 0.78, F.col("token"))).alias("soft_path"), F.collect_set(F.when(F.col("in_name") >= 0.78, F.col("token"))).alias("soft_name")), "id", "left")
    each = []
    for i, t in enumerate(tokens):
        w = {s: weight(weights, t, s) for s in ("path", "filename", "role", "language")}
        in_path, in_name = F.array_contains("in_path", t), F.array_contains("in_name", t)
        contains = ~in_name & F.contains("stem", F.lit(t)) if len(t) >= 5 else F.lit(False)
        labelled, w_label = F.contains("role", F.lit(t)) | F.contains("language", F.lit(t)), max(w["role"], w["language"])
        each += [_when(in_path, f'path matches "{t}"', "a", i, 0), _when(in_path, _weight_reason(t, w["path"]), "a", i, 1)]
        each += [_when(in_name, f'filename matches "{t}"', "a", i, 2), _when(contains, f'filename contains "{t}"', "a", i, 2), _when(in_name | contains, _weight_reason(t, w["filename"]), "a", i, 3)]
        if soft is not None:
            each += [_when(~in_path & F.array_contains("soft_path", t), f'path softly matches "{t}"', "a", i, 4), _when(~in_name & F.array_contains("soft_name", t), f'filename softly matches "{t}"', "a", i, 5)]
        each += [_when(labelled, f'role/language matches "{t}"', "a", i, 6), _when(labelled, _weight_reason(t, w_label), "a", i, 7)]
    rows = [_listed(prepared, each)]

    def by_token(df: DataFrame, part: str, source: str, at: Column, reason: Column) -> DataFrame:
        """A reason and the remark on the token's weight, of rows (path, token)."""
        remark = F.lit(None).cast("string")
        for t in tokens:
            remark = F.when(F.col("token") == t, F.lit(_weight_reason(t, weight(weights, t, source)))).otherwise(remark)
        place = lambda k: F.array(F.lit(part), at, _padded(F.array_position(T.strings(tokens), F.col("token"))), F.lit(k))
        both = F.array(F.struct(place("0").alias("place"), reason.alias("reason")), F.struct(place("1").alias("place"), remark.alias("reason")))
        return df.select("path", F.explode(both).alias("r")).select("path", "r.place", "r.reason").where("reason is not null")

    matched = ranking.matched_symbols(symbols.join(own.select(F.col("id").alias("file_id")), "file_id", "left_semi"), own, tokens)
    rows.append(by_token(matched, "b", "symbol", _padded(F.col("id")), F.concat(F.lit('symbol matches "'), F.col("token"), F.lit('"'))))

    message = F.lower("message")
    said = ranking.matched_commits(commits, tokens).select("id", "date", F.array_compact(F.array(*[F.when(message.contains(t), F.lit(t)) for t in tokens])).alias("tokens")).where(F.size("tokens") > 0)
    touched = stage(commit_files.join(top, "path", "left_semi").join(said.withColumnRenamed("id", "commit_id"), "commit_id"), "pack-touched")  # read twice below
    # newest first: the date's characters are turned round
    newest = F.concat(F.translate("date", "0123456789", "9876543210"), F.lit("/"), _padded(F.lit(10**18) - F.col("commit_id")))
    rows.append(by_token(touched.select("path", newest.alias("at"), F.explode("tokens").alias("token")).groupBy("path", "token").agg(F.min("at").alias("at")), "c", "commit", F.col("at"), F.concat(F.lit('commit message matches "'), F.col("token"), F.lit('"'))))
    rows.append(touched.groupBy("path").agg(F.min(newest).alias("at")).select("path", F.array(F.lit("c"), F.col("at"), F.lit("z")).alias("place"), F.lit("modified in recent query-related commit").alias("reason")))

    called = ranking.matched_calls(relations, own, tokens)
    rows.append(by_token(called, "d", "symbol", F.col("target"), F.concat(F.lit('calls "'), F.col("target"), F.lit('"'))))

    edges = linked_edges(relations, files, candidates, targets).join(top, "path", "left_semi")
    nth = F.row_number().over(Window.partitionBy("path").orderBy("source_id", "relation", "target_type", "target_id", "id"))
    first = edges.withColumn("nth", nth).where("nth <= 3")  # what three edges add is all that edges add
    rows.append(first.select("path", F.array(F.lit("e"), _padded(F.col("nth"))).alias("place"), F.concat(F.lit("related to "), F.col("other")).alias("reason")))

    # rules that lower or prefer a file stand before all others, the last one first
    role, ext, lower = F.col("role"), T.extension(F.col("path")), F.lower("path")
    asked = {k: bool(set(tokens) & set(v)) for k, v in (("test", L.TEST_AWARE), ("ui", L.UI_INTENT), ("db", L.DB_INTENT), ("docs", L.DOCS_INTENT), ("example", L.EXAMPLE_INTENT))}
    docs = (role == "documentation") | ext.isin(".md", ".rst", ".txt")
    example = F.arrays_overlap(F.split(lower, "/"), T.strings(L.EXAMPLE_PARTS))
    rules = [_when(role == "test", "test-aware query" if asked["test"] else "test file deprioritized for non-test query", "-", 7)]
    if not asked["ui"]:
        rules.append(_when((role == "asset") | ext.isin(".css", ".scss", ".less"), "asset file deprioritized for non-UI query", "-", 6))
    if not asked["db"]:
        rules.append(_when((role == "migration") | (ext == ".sql"), "migration file deprioritized for non-database query", "-", 5))
    rules.append(_when(docs, "documentation preferred for docs query", "f", 0) if asked["docs"] else _when(docs, "documentation deprioritized for non-docs query", "-", 4))
    if not asked["example"]:
        rules.append(_when(example, "example/playground deprioritized for non-example query", "-", 3))
    rules.append(_when((role == "source") & ext.isin(".php", ".py", ".js", ".ts", ".go", ".rs"), "source file preferred", "f", 1))
    rows.append(_listed(own, rules))
    marked = memory.contributions(feedback, query).join(top, "path", "left_semi").groupBy("path").agg(
        F.max(F.when(F.col("contribution") > 0, F.when(F.col("rating") == "crucial", 2).when(F.col("rating") == "missing", 1).otherwise(0))).alias("best"), F.min("contribution").alias("worst")
    )
    past = [_when(F.col("best") == k, f"previously marked {text} similar query", "-", 2) for k, text in ((2, "crucial for"), (1, "missing from"), (0, "useful for"))]
    rows.append(_listed(marked, [*past, _when(F.col("worst") < 0, "previously marked noisy for similar query", "-", 1)]))

    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    once = out.groupBy("path", "reason").agg(F.min("place").alias("place"))
    listed = once.groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "reason"))), 1, most).alias("x"))
    return listed_paths.join(listed, "path", "left").select("path", F.coalesce(F.col("x.reason"), F.array().cast("array<string>")).alias("reasons"))


#: What a strong reason says (CX12).
STRONG = ("previously marked", "symbol matches", "calls ", "filename matches", "filename contains", "path matches", "modified in recent query-related commit")


#: Doubts about a pack, the names of what to do next, and its commands.
NO_CANDIDATES, SIMILAR = "no candidate files were found", "many candidates have similar scores"
UNSUPPORTED = "top candidate is not supported by strong symbol, call, feedback or exact filename signals"
SOFT_PATHS = "ranking is driven by broad soft path matches"
HIGH_LEVEL = "symptom or failing-test query may point at high-level files before the underlying cause"
SOFTLY = "softly matches"


def _quoted(text: str) -> str:
    """FN25: a shell argument in double quotes."""
    escaped = text.replace("\\", "\\\\").replace('"', '\\"')
    return f'"{escaped}"'


def diagnose(pack: DataFrame, reasons: DataFrame, query: str, tokens: list[str], command: str = "codemap") -> DataFrame:
    """CX12, CX14: part (level, reason, action), position, name, text: how far a
    pack (path, role, raw, score) with its reasons (path, reasons) can be
    trusted, why not further, and what to do next.

    One aggregate over the few rows of the pack gives what the rules ask for;
    an empty pack has a diagnosis, too."""
    words = T.path_tokens(F.col("path"))
    symptom = bool(set(tokens) & {*L.SYMPTOM_WORDS, *L.TEST_AWARE})
    said = F.coalesce("reasons", F.array().cast("array<string>"))
    place = F.row_number().over(Window.orderBy(F.desc("raw"), "path"))  # over the rows of a pack
    ranked = pack.join(reasons, "path", "left").select("path", "role", "score", said.alias("said"), words.alias("words"), place.alias("place"))
    at_top, early = F.col("place") == 1, F.col("place") <= 8
    strong = F.exists("said", lambda r: F.greatest(*[F.contains(r, F.lit(mark)) for mark in STRONG]))
    is_test = (F.col("role") == "test") | F.arrays_overlap("words", T.strings(("test", "tests")))
    facts = ranked.agg(
        F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("broad"), F.coalesce(F.bool_or(at_top & strong), F.lit(False)).alias("strong"),
        F.coalesce(F.sum(F.when(early, F.size(F.filter("said", lambda r: F.contains(r, F.lit(SOFTLY)))))), F.lit(0)).alias("soft"),
        F.min(F.when(early & is_test & F.lit(symptom), F.struct("place", "path")))["path"].alias("test"),
        F.coalesce(F.bool_or((F.col("place") <= 5) & F.arrays_overlap("words", T.strings(L.GENERAL_PARTS))), F.lit(False)).alias("general"),
        F.max(F.when(at_top, F.col("path"))).alias("first"),
    )
    some, strong = F.col("n") > 0, F.col("strong")
    conditions = ((NO_CANDIDATES, ~some), (SIMILAR, some & (F.col("broad") >= 6)), (UNSUPPORTED, some & ~strong), (SOFT_PATHS, some & (F.col("soft") >= 5)), (HIGH_LEVEL, some & F.col("test").isNotNull() & F.col("general")))
    judged = facts.withColumn("doubts", F.array_compact(F.array(*[F.when(c, text) for text, c in conditions])))
    level = F.when(~some | (F.size("doubts") >= 2) | ((F.size("doubts") > 0) & ~strong), "low").when(F.size("doubts") > 0, "medium").otherwise("high")
    asked = _quoted(query)
    step = lambda name, *text, on=F.lit(True): F.when(on, F.struct(F.lit(name).alias("name"), F.concat(F.lit(f"{command} "), *[F.lit(x) if isinstance(x, str) else x for x in text]).alias("text")))
    found = F.array(step("inspect_top_candidate", "related ", F.col("first")), step("record_feedback_after_verification", f"feedback add {asked} ", F.col("first"), ' --rating useful --source agent --reason "verified relevant"'))
    doubtful = F.array_compact(
        F.array(
            step("inspect_failing_test_neighborhood", "related ", F.col("test"), on=F.col("test").isNotNull()), step("check_index", "doctor"), step("refresh_index", "map"), step("narrow_query", f"run {asked} --markdown"),
            step("record_feedback_after_verification", f'feedback add {asked} <path> --rating noisy --source agent --reason "verified irrelevant suggestion"'),
        )
    )
    told = judged.withColumn("level", level).withColumn("actions", F.when(F.col("level") == "high", found).otherwise(doubtful))
    row = lambda part, name, text: F.struct(F.lit(part).alias("part"), name.alias("name"), text.alias("text"))
    none = F.lit("")
    each = (
        F.array(row("level", F.col("level"), none)), F.transform("doubts", lambda r: row("reason", r, none)), F.transform("actions", lambda x: row("action", x["name"], x["text"])),
    )
    placed = [F.transform(rows, lambda x, i: F.struct(x["part"].alias("part"), i.cast("int").alias("position"), x["name"].alias("name"), x["text"].alias("text"))) for rows in each]
    return told.select(F.explode(F.concat(*placed)).alias("x")).select("x.*")
