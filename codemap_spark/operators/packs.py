"""The context packs of many queries in one plan (CX1 to CX9, EV1).

Everything is keyed by the query: a table of weights takes the place of one
query's expressions, tokens meet names through ``substrings``, and each query's
best files are chosen before they are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as L, text as T
from ..sources.shared import stage
from . import memory, ranking, substrings

SOURCES = ("path", "filename", "language", "role", "symbol", "commit")
#: Most pairs of a path and a query that a task works out.
PAIRS = 1 << 18


def _tasks(paths: DataFrame, queries: DataFrame) -> int:
    """Tasks for what the queries have at the paths.  A path travels with its
    queries as a list, so bytes shuffled tell little about the rows that a task
    makes of them: a number that is asked for isn't lowered by Spark."""
    n = paths.agg(F.approx_count_distinct("path")).first()[0] * queries.count()
    return max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PAIRS))


def query_tokens(queries: DataFrame) -> DataFrame:
    """name, token of every query (name, query)."""
    return queries.select("name", F.explode(T.query_tokens(F.col("query"))).alias("token"))


def token_weights(tokens: DataFrame, stats: DataFrame, texts: DataFrame) -> DataFrame:
    """AGG3: name, token and a weight in each source, from AGG1's statistics:
    the source's own, or that of all, or 1; a token without any 0.25.

    If no token of a query has statistics, AGG2's weights by the share of the
    texts (text) that hold the token count everywhere."""
    pivot = [F.max(F.when(F.col("source") == s, F.col("weight"))).alias(f"w_{s}") for s in ("all", *SOURCES)]
    distinct = tokens.select("token").distinct()
    known = stats.join(distinct.withColumnRenamed("token", "term"), "term", "left_semi").groupBy(F.col("term").alias("token")).agg(*pivot).withColumn("known", F.lit(True))
    rows = tokens.join(known, "token", "left")
    any_known = F.coalesce(F.bool_or("known").over(Window.partitionBy("name")), F.lit(False))  # the tokens of a query
    rows = stage(rows.withColumn("any_known", any_known), "query-weights")
    own = [F.when(F.col("known"), F.coalesce(f"w_{s}", "w_all", F.lit(1.0))).otherwise(0.25).alias(s) for s in SOURCES]
    found = rows.where("any_known").select("name", "token", *own)
    lost = rows.where("NOT any_known").select("name", "token")
    if lost.isEmpty():
        return found
    named = texts.groupBy(F.lower("text").alias("name")).agg(F.count("*").alias("n"))
    held = substrings.containing(named.select("name"), lost.select("token")).join(named, "name").groupBy("token").agg(F.sum("n").alias("held"))
    share = F.log((F.col("n") + 1) / (F.coalesce("held", F.lit(0)) + 1))
    weight = F.round(F.least(F.lit(2.4), F.greatest(F.lit(0.35), 0.65 + share)), 6)
    total = F.broadcast(texts.agg(F.count("*").alias("n")))  # one row
    back = lost.join(held, "token", "left").crossJoin(total).select("name", "token", *[weight.alias(s) for s in SOURCES])
    return found.unionByName(back)


def _path_points(files: DataFrame, weights: DataFrame, soft: bool) -> DataFrame:
    """CX1: name, path, score."""
    tokens = weights.select("token").distinct()
    name = T.file_name(F.col("path"))
    prepared = files.select("id", "path", F.lower("role").alias("role"), F.lower("language").alias("language"), T.path_tokens(F.col("path")).alias("in_path"), T.path_tokens(name).alias("in_name"), ranking.name_stem(F.col("path")).alias("stem"))
    prepared = stage(prepared, "pack-files")
    terms = prepared.select("id", "path", F.explode("in_path").alias("token"), "in_name")
    named = F.array_contains("in_name", F.col("token"))
    exact = terms.join(weights, "token").select("name", "path", (7.0 * F.col("w.path") + F.when(named, 5.0 * F.col("w.filename")).otherwise(0.0)).alias("score"))

    long = tokens.where(F.char_length("token") >= 5)
    stems = substrings.containing(prepared.select(F.col("stem").alias("name")).distinct(), long).withColumnRenamed("name", "stem")
    inside = prepared.join(stems, "stem").where(~named).join(weights, "token").select("name", "path", (4.0 * F.col("w.filename")).alias("score"))

    labels = prepared.select(F.col("role").alias("name")).unionAll(prepared.select("language")).distinct()
    said = stage(substrings.containing(labels, tokens).withColumnRenamed("name", "label"), "pack-labels")
    by_label = [prepared.join(said, F.col(c) == F.col("label")).select("path", "token") for c in ("role", "language")]
    labelled = by_label[0].unionAll(by_label[1]).distinct().join(weights, "token").select("name", "path", (1.5 * F.greatest("w.role", "w.language")).alias("score"))

    out = exact.unionByName(inside).unionByName(labelled)
    if soft:
        out = out.unionByName(_soft_points(prepared, weights))
    return out


def _soft_points(prepared: DataFrame, weights: DataFrame) -> DataFrame:
    """CX1's soft part: name, path, score.  Two terms that are nearly alike
    share two letters in a row, so only such pairs are compared."""
    terms = prepared.select("id", F.explode("in_path").alias("candidate"), "in_name").withColumn("named", F.array_contains("in_name", F.col("candidate")))
    two = lambda c: F.explode(substrings.grams(F.col(c), 2)).alias("gram")
    long = weights.select("token").distinct().where((F.char_length("token") >= 6) & ~T.is_noise(F.col("token")))
    words = terms.select("candidate").distinct().where((F.char_length("candidate") >= 5) & ~T.is_noise(F.col("candidate")))
    pairs = words.select("candidate", two("candidate")).join(long.select("token", two("token")), "gram").select("token", "candidate").distinct()
    found = ranking.soft_matches(pairs).where("score >= 0.78")
    best = terms.join(found, "candidate").groupBy("id", "token").agg(F.max("score").alias("near_path"), F.max(F.when(F.col("named"), F.col("score"))).alias("near_name"))
    rows = best.join(prepared.select("id", "path", "in_path", "in_name"), "id").join(weights, "token")
    at_path = F.when(~F.array_contains("in_path", F.col("token")), F.coalesce("near_path", F.lit(0.0)) * 2.5 * F.col("w.path")).otherwise(0.0)
    at_name = F.when(~F.array_contains("in_name", F.col("token")), F.coalesce("near_name", F.lit(0.0)) * 2.0 * F.col("w.filename")).otherwise(0.0)
    return rows.select("name", "path", (at_path + at_name).alias("score"))


def _held(df: DataFrame, text: Column, tokens: DataFrame) -> DataFrame:
    """``df`` with the tokens that ``text`` holds, whatever the case: a row per token."""
    keyed = df.withColumn("__text", F.lower(text))
    found = substrings.containing(keyed.select(F.col("__text").alias("name")).distinct(), tokens).withColumnRenamed("name", "__text")
    return keyed.join(found, "__text").drop("__text")


def _points(files: DataFrame, symbols: DataFrame, commits: DataFrame, commit_files: DataFrame, relations: DataFrame, weights: DataFrame, wants: DataFrame, soft: bool) -> tuple[DataFrame, DataFrame]:
    """CX1 to CX4: (path, key, amount) and (key, name, worth): a path's score
    for a query is the sum of amount times worth.

    The key of what a query has by itself is even; a message's is odd, so that
    a commit is one row a file, however many queries its message concerns."""
    tokens = weights.select("token").distinct()
    first = _held(symbols.select("file_id", "id", "kind", F.col("name").alias("symbol")), F.col("symbol"), tokens).groupBy("file_id", "token").agg(F.min(F.struct("id", "kind")).alias("s"))
    owned = first.join(files.select(F.col("id").alias("file_id"), "path", "role"), "file_id").join(weights, "token").join(wants.select("name", "docs"), "name")
    share = F.when(F.col("docs") | (F.col("role") != "documentation"), 1.0).when(F.col("s.kind").isin("heading", "command_example"), 0.25).otherwise(0.5)
    from_symbols = owned.select("name", "path", (3.5 * F.col("w.symbol") * F.coalesce(share, F.lit(1.0))).alias("score"))

    called = relations.where("relation = 'calls' AND target_type = 'symbol_name'").select(F.col("source_id").alias("id"), "target_id").distinct()
    calls = _held(called, F.col("target_id"), tokens).select("id", "token").distinct().join(files.select("id", "path"), "id").join(weights, "token")
    from_calls = calls.select("name", "path", (2.2 * F.col("w.symbol")).alias("score"))
    own = _path_points(files, weights, soft).unionByName(from_symbols).unionByName(from_calls).select("path", (F.col("name") * 2).alias("key"), F.col("score").alias("amount"))

    messages = stage(commits.select(F.lower("message").alias("message")).where("message IS NOT NULL").distinct().withColumn("key", F.monotonically_increasing_id() * 2 + 1), "pack-messages")
    told = _held(messages, F.col("message"), tokens).join(weights, "token").groupBy("key", "name").agg((F.sum(1.2 * F.col("w.commit")) + 0.8).alias("worth"))
    worth = stage(told.unionByName(wants.select((F.col("name") * 2).alias("key"), "name", F.lit(1.0).alias("worth"))), "pack-worth")
    keyed = messages.join(worth.select("key").distinct(), "key", "left_semi")
    said = commits.select(F.col("id").alias("commit_id"), F.lower("message").alias("message")).join(keyed, "message").select("commit_id", "key")
    from_commits = commit_files.join(said, "commit_id").select("path", "key", F.lit(1.0).alias("amount"))
    return own.unionByName(from_commits), worth


def _names(own: str) -> Column:
    return F.transform(own, lambda x: x["name"])


def _related(relations: DataFrame, files: DataFrame, candidates: DataFrame, step: float = 0.5, most: float = 1.5, tasks: int | None = None) -> DataFrame:
    """CX5 of every query: path, name, score; ``candidates`` are (path, names),
    a row a path, whose list of queries goes along with the edges whole."""
    normal = F.regexp_replace("target_id", r"^[./]+", "")
    targets = relations.where("target_id IS NOT NULL").select("target_id", normal.alias("normal")).distinct()
    wanted = targets.select("target_id", F.explode(F.array(F.struct(F.lit(0).alias("by"), F.col("normal").alias("suffix")), F.struct(F.lit(1).alias("by"), T.file_name(F.col("normal")).alias("suffix")))).alias("w")).select("target_id", "w.*")
    suffixes = candidates.select("path", F.explode(T.path_suffixes(F.regexp_replace("path", r"^[./]+", ""))).alias("suffix"))
    links = stage(suffixes.join(wanted, "suffix").groupBy("target_id", "path").agg(F.min("by").alias("by")), "pack-links")
    spread = stage(links.groupBy("target_id").agg(F.min("path").alias("least"), F.max("path").alias("most")), "pack-spread")
    # a target that one path answers to is that path for all of its queries
    single = spread.where("least = most").select("target_id", F.col("least").alias("linked")).join(candidates.select(F.col("path").alias("linked"), "names"), "linked")
    several = links.join(spread.where("least <> most").select("target_id"), "target_id").join(candidates, "path").select("target_id", F.explode("names").alias("name"), F.struct("by", "path").alias("at"))
    chosen = several.groupBy("target_id", "name").agg(F.min("at").alias("x")).groupBy("target_id", F.col("x.path").alias("linked")).agg(F.collect_list("name").alias("names"))
    edges = relations.groupBy(F.col("source_id").alias("id"), "target_id").agg(F.count("*").alias("n")).join(files.select("id", F.col("path").alias("source")), "id").select("source", "target_id", "n")
    inside = candidates.select(F.col("path").alias("source"), F.col("names").alias("own"))
    found = edges.join(single.unionByName(chosen), "target_id").join(inside, "source", "left").withColumn("own", F.coalesce("own", F.array().cast("array<bigint>")))
    both = F.array(F.struct(F.col("linked").alias("path"), F.when(F.col("linked") != F.col("source"), F.array_intersect("names", "own")).alias("names")), F.struct(F.col("source").alias("path"), F.array_except("names", "own").alias("names")))
    rows = found.select("n", F.explode(both).alias("x")).where("size(x.names) > 0").select("x.path", "x.names", "n")
    return (rows.repartition(tasks, "path") if tasks else rows.repartition("path")).select("path", F.explode("names").alias("name"), "n").groupBy("path", "name").agg(F.least(step * F.sum("n"), F.lit(most)).alias("score"))


def feedback_signals(feedback: DataFrame, files: DataFrame, queries: DataFrame) -> DataFrame:
    """FB1 of every query: name, path, boost, penalty.  Queries and those of
    the feedback meet by a shared token, without which they aren't similar."""
    asked = feedback.select(F.col("query").alias("past")).distinct().withColumn("past_tokens", T.query_tokens(F.col("past")))
    own = queries.select("name", T.query_tokens(F.col("query")).alias("tokens"))
    meet = asked.select("past", "past_tokens", F.explode("past_tokens").alias("token")).join(own.select("name", "tokens", F.explode("tokens").alias("token")), "token").drop("token").distinct()
    similar = meet.select("name", "past", T.jaccard(F.col("tokens"), F.col("past_tokens")).alias("similarity")).where(F.col("similarity") >= L.MIN_SIMILARITY)
    rows = feedback.select("path", "rating", "source", F.col("query").alias("past")).join(similar, "past").join(files.select("path"), "path", "left_semi")
    c = memory.contribution(F.col("similarity"))
    boost, penalty = F.least(F.lit(L.MAX_BOOST), F.sum(F.greatest(c, F.lit(0.0)))), F.greatest(F.lit(L.MAX_PENALTY), F.sum(F.least(c, F.lit(0.0))))
    return rows.groupBy("name", "path").agg(F.round(boost, 6).alias("boost"), F.round(penalty, 6).alias("penalty"))


def context_packs(files: DataFrame, symbols: DataFrame, commits: DataFrame, commit_files: DataFrame, relations: DataFrame, feedback: DataFrame, queries: DataFrame, stats: DataFrame, texts: DataFrame, limit: int = 10, soft: bool = True) -> DataFrame:
    """name, rank, path, language, role, raw, score: for every query (name,
    query) what ``ranking.context_pack`` gives for it alone.

    ``stats`` are AGG1's, ``texts`` (text) those of AGG2.  Queries without a
    token have no rows."""
    called = stage(queries.select("name").distinct().withColumn("q", F.monotonically_increasing_id()), "pack-queries")
    tasks = _tasks(commit_files.select("path").unionAll(files.select("path")), called)
    queries = stage(queries.join(called, "name").select(F.col("q").alias("name"), "query"), "pack-asked")  # numbers in place of names
    tokens = query_tokens(queries)
    weights = stage(token_weights(tokens, stats, texts).select("name", "token", F.struct(*SOURCES).alias("w")), "pack-weights")
    asked = {"tests": L.TEST_AWARE, "ui": L.UI_INTENT, "db": L.DB_INTENT, "docs": L.DOCS_INTENT, "examples": L.EXAMPLE_INTENT}
    wants = stage(tokens.groupBy("name").agg(*[F.bool_or(F.col("token").isin(words)).alias(k) for k, words in asked.items()]), "pack-wants")
    points, worth = _points(files, symbols, commits, commit_files, relations, weights, wants, soft)
    # rows meet by path, so the queries of a path are worked out where it is, and aren't shuffled
    total = points.repartition(tasks, "path").join(worth, "key").groupBy("path", "name").agg(F.sum(F.col("amount") * F.col("worth")).alias("score")).where("score > 0")
    indexed = files.repartition(tasks, "path").groupBy("path").agg(F.collect_list(F.struct("language", "role")).alias("indexed"))
    total = stage(_listed(total, "score").join(indexed, "path", "full_outer"), "pack-totals")
    related = _listed(_related(relations, files, total.where("own IS NOT NULL").select("path", _names("own").alias("names")), tasks=tasks), "score").withColumnRenamed("own", "near")
    learned = _listed(feedback_signals(feedback, files, queries), "boost", "penalty").withColumnRenamed("own", "learned")
    own = total.where("indexed IS NOT NULL").select("path", F.inline("indexed"), "own").repartition(tasks, "path")
    known = own.join(related, "path", "left").join(learned, "path", "left").where("own IS NOT NULL OR near IS NOT NULL")
    none = F.array().cast("array<struct<name:bigint,score:double,boost:double,penalty:double>>")
    each = F.explode(F.concat(*[F.coalesce(c, none) for c in ("own", "near", "learned")])).alias("x")
    sums = F.sum("x.score").alias("score"), F.max("x.boost").alias("boost"), F.max("x.penalty").alias("penalty")
    scored = known.select("path", "language", "role", each).groupBy("path", "language", "role", F.col("x.name").alias("name")).agg(*sums).where("score IS NOT NULL")
    rows = ranking.with_feedback(ranking.adjusted_by(scored.join(wants, "name"), F.col)).where("raw > 0")
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("raw"), "path"))  # Spark keeps each task's best before it shuffles
    top = rows.withColumn("rank", rank).where(F.col("rank") <= limit).withColumn("score", T.round_even(F.col("raw") / F.max("raw").over(Window.partitionBy("name")), 2))
    return top.withColumnRenamed("name", "q").join(called, "q").select("name", "rank", "path", "language", "role", "raw", "score")


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    """path, own: a list of what the queries have there, as many as there are."""
    values = [(F.col(c) if c in columns else F.lit(None)).cast("double").alias(c) for c in ("score", "boost", "penalty")]
    return rows.groupBy("path").agg(F.collect_list(F.struct("name", *values)).alias("own"))
