"""Lists and small reports (FLT2 to FLT7, AGG2, AGG6, ME1, RP2, RP6, RP8, TK1)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

#: No list of notes is longer, whatever is asked.
MOST_NOTES, SCANNED_NOTES = 100, 500
EVENTS = ("read", "verified", "useful", "noisy", "missing")


def _chosen(rows: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def feedback(rows: DataFrame, query: str | None = None, path: str | None = None) -> DataFrame:
    """FLT2: feedback of exactly that query and path, newest first."""
    return _chosen(rows, query=query, path=path).orderBy(F.desc("id"))


def notes(rows: DataFrame, limit: int = 20, stale_only: bool = False, **wanted: str | None) -> DataFrame:
    """FLT3: the newest notes by id of that path, topic or scope.

    Stale ones are looked for among the newest 500: file notes whose staleness
    is true or unknown."""
    limit = max(1, min(limit, MOST_NOTES))
    found = _chosen(rows, **wanted).orderBy(F.desc("id"))
    if not stale_only:
        return found.limit(limit)
    return found.limit(SCANNED_NOTES).where("scope = 'file' AND coalesce(stale, true)").orderBy(F.desc("id")).limit(limit)


def tasks(rows: DataFrame, status: str | None = None, topic: str | None = None, limit: int = 20) -> DataFrame:
    """FLT4: tasks by last change, then id; done ones only if asked for."""
    found = _chosen(rows, status=status, topic=topic)
    if status is None:
        found = found.where("status <> 'done'")
    return found.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def plans(rows: DataFrame, items: DataFrame, events: DataFrame, limit: int = 20, unfinished: bool = False, most_items: int = 10) -> DataFrame:
    """FLT5: id, finished, items, events of the newest plans: up to
    ``most_items`` paths by rank, and all events as path=event by rank."""
    top = (rows.where("NOT finished") if unfinished else rows).orderBy(F.desc("id")).limit(limit).select("id", "finished")
    ids = F.broadcast(top.select(F.col("id").alias("plan_id")))  # ``limit`` rows
    few = items.join(ids, "plan_id", "left_semi").where(F.col("rank") <= most_items)
    listed = few.groupBy(F.col("plan_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("i"))
    said = events.join(ids, "plan_id", "left_semi").groupBy(F.col("plan_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("=", "path", "event").alias("said")))).alias("e"))
    text = [F.coalesce(F.array_join(c, ","), F.lit("")).alias(name) for c, name in ((F.col("i.path"), "items"), (F.col("e.said"), "events"))]
    return top.join(listed, "id", "left").join(said, "id", "left").select("id", "finished", *text)


def focused(entries: DataFrame) -> DataFrame:
    """FLT6: entry points that are no headings, examples or documents."""
    return entries.where(~F.col("kind").isin("heading", "command_example") & ~T.extension(F.col("path")).isin(".md", ".rst", ".txt"))


def supporting(reads: DataFrame, entries: DataFrame, limit: int = 10) -> DataFrame:
    """FLT7: the best suggested reads besides the entry points, as many as the
    list of both has room for."""
    room = F.lit(limit) - F.coalesce(F.first("n"), F.lit(0))
    space = entries.select("path").distinct().agg(F.count("*").alias("n")).agg(room.alias("room"))
    others = reads.join(F.broadcast(entries.select("path").distinct().limit(limit)), "path", "left_anti").orderBy(F.desc("score"), "path").limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "path"))  # over at most ``limit`` rows
    return others.withColumn("place", place).crossJoin(F.broadcast(space)).where("place <= room").select("path", "score")  # one row of room


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """AGG6: name, rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def fallback_weights(texts: DataFrame, tokens: list[str]) -> DataFrame:
    """AGG2: token, weight by the share of texts (paths, symbol names, commit
    messages in the column ``text``) that the token is inside of.  One pass:
    a counter a token, so no text is dealt out."""
    lower = F.lower("text")
    found = texts.agg(F.count("*").alias("n"), *[F.count_if(lower.contains(t)).alias(f"c{k}") for k, t in enumerate(tokens)])
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.col(f"c{k}").alias("found")) for k, t in enumerate(tokens)]))
    weight = F.least(F.lit(2.4), F.greatest(F.lit(0.35), 0.65 + F.log((F.col("n") + 1) / (F.col("x.found") + 1))))
    return found.select("n", pairs.alias("x")).select("x.token", F.round(weight, 6).alias("weight"))


def note_tags(path: Column, topic: Column, query: Column, note: Column, explicit: Column | None = None) -> Column:
    """ME1: tokens of the given tags, else the first 12 tokens of path, topic,
    query and note; distinct, 20 at most."""
    derived = F.slice(T.query_tokens(F.concat_ws(" ", path, topic, query, note)), 1, 12)
    if explicit is None:
        return derived
    given = T.query_tokens(F.array_join(explicit, " "))
    return F.slice(F.when(F.size(F.coalesce(explicit, F.array().cast("array<string>"))) > 0, given).otherwise(derived), 1, 20)


def tag_scores(tags: DataFrame, files: DataFrame, tokens: list[str], most: float = 8.0) -> DataFrame:
    """RP2: path, score: the weights of a file's tags that are query tokens."""
    found = tags.where(F.col("tag").isin(tokens)).groupBy(F.col("file_id").alias("id")).agg(F.least(F.lit(most), F.sum("weight")).alias("score"))
    return found.join(files.select("id", "path"), "id").select("path", F.round("score", 6).alias("score"))


def combined_tags(notes_: DataFrame, tags: DataFrame, files: DataFrame, newest: int = 3, of_files: int = 12, most: int = 16) -> DataFrame:
    """RP6: path, tags: those of a path's newest notes, then its heaviest file
    tags (ties by tag), each once."""
    by_age = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("id")))
    recent = notes_.select("path", "id", "tags").withColumn("k", by_age).where(F.col("k") <= newest)
    said = recent.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "tags"))).alias("n"))
    best = tags.groupBy("file_id", "tag").agg(F.max("weight").alias("weight"))
    by_weight = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("weight"), "tag"))
    heavy = best.withColumn("k", by_weight).where(F.col("k") <= of_files).groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("k", "tag"))).alias("t"))
    on_files = heavy.join(files.select("id", "path"), "id").select("path", "t")
    empty = F.array().cast("array<string>")
    joint = F.concat(F.coalesce(F.flatten(F.col("n.tags")), empty), F.coalesce(F.col("t.tag"), empty))
    return said.join(on_files, "path", "full_outer").select("path", F.slice(F.array_distinct(joint), 1, most).alias("tags"))


def finish_plan(plan_id: int, query: str, outcomes: Mapping[str, list[str]], rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RP8: (events, feedback) that finishing a plan appends: one event per
    kind and path, and feedback for the useful, noisy and missing ones.
    ``rows`` gives the session."""
    unknown = set(outcomes) - set(EVENTS)
    if unknown:
        raise ValueError(f"no such event: {sorted(unknown)}")
    said = [(plan_id, kind, path) for kind in EVENTS for path in dict.fromkeys(outcomes.get(kind, ()))]
    events = rows.sparkSession.createDataFrame(said, "plan_id long, event string, path string")
    return events, events.where(F.col("event").isin("useful", "noisy", "missing")).select(F.lit(query).alias("query"), "path", F.col("event").alias("rating"), F.lit("agent").alias("source"))


def missing_tables(have: Iterable[str], required: Iterable[str]) -> list[str]:
    """FLT8: the required tables that aren't there, in order."""
    return sorted(set(required) - set(have))


def save_plan(plans_: DataFrame, items: DataFrame, ranked: DataFrame, query: str, now: str, read_budget: int = 3) -> tuple[DataFrame, DataFrame]:
    """RP7: (plans, items) with a new plan of the ranked items (rank, path,
    score, action, confidence, read_priority), whose id is the next."""
    row = plans_.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    plan = row.withColumns({"query": F.lit(query), "read_budget": F.lit(max(1, min(read_budget, 10))), "created_at": F.lit(now), "finished": F.lit(False)})
    own = ranked.crossJoin(F.broadcast(row.withColumnRenamed("id", "plan_id")))  # one row
    return plans_.unionByName(plan.select(*plans_.columns)), items.unionByName(own.select(*items.columns))


def record_reads(events: DataFrame, plan_id: int, paths: Sequence[str]) -> DataFrame:
    """RP8: the events with an ``opened`` one for each path, once."""
    rows = [(plan_id, "opened", p) for p in dict.fromkeys(paths) if p]
    return events.unionByName(events.sparkSession.createDataFrame(rows, "plan_id long, event string, path string").select(*events.columns))


def close_task(rows: DataFrame, task_id: int, now: str) -> DataFrame:
    """TK1: the tasks with that one done; it keeps its first closing date."""
    mine = F.col("id") == task_id
    return rows.withColumns({"status": F.when(mine, F.lit("done")).otherwise(F.col("status")), "closed_at": F.when(mine, F.coalesce("closed_at", F.lit(now))).otherwise(F.col("closed_at")), "updated_at": F.when(mine, F.lit(now)).otherwise(F.col("updated_at"))})
