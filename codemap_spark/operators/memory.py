"""Feedback signals, notes, plans and tasks (FB, ME, RP, TK)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as L, text as T


def _lookup(values: dict[str, float], key: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), key), F.lit(0.0))


def contributions(feedback: DataFrame, query: str) -> DataFrame:
    """FB1: feedback rows similar enough to the query, with their contribution."""
    tokens = T.query_tokens(F.lit(query))
    similarity = T.jaccard(tokens, T.query_tokens(F.col("query")))
    out = feedback.withColumn("similarity", similarity).where(F.col("similarity") >= L.MIN_SIMILARITY)
    return out.withColumn("contribution", contribution(F.col("similarity")))


def contribution(similarity: Column) -> Column:
    """FB1: what a row (rating, source) of feedback of that similarity counts."""
    return _lookup(L.RATING_WEIGHTS, F.col("rating")) * _lookup(L.SOURCE_WEIGHTS, F.col("source")) * similarity


def feedback_signals(feedback: DataFrame, files: DataFrame, query: str) -> DataFrame:
    """FB1: path, boost, penalty of indexed paths; capped sums."""
    rows = contributions(feedback, query).join(files.select("path"), "path", "left_semi")
    c = F.col("contribution")
    boost = F.least(F.lit(L.MAX_BOOST), F.sum(F.greatest(c, F.lit(0.0))))
    penalty = F.greatest(F.lit(L.MAX_PENALTY), F.sum(F.least(c, F.lit(0.0))))
    return rows.groupBy("path").agg(F.round(boost, 6).alias("boost"), F.round(penalty, 6).alias("penalty"), F.count("*").alias("items"))


def feedback_explain(feedback: DataFrame, files: DataFrame, query: str) -> DataFrame:
    """FB2: id, path, status (used, not-indexed, below-threshold), contribution,
    and of those used the net of their path and the place by size in it."""
    tokens = T.query_tokens(F.lit(query))
    rows = feedback.withColumn("similarity", T.jaccard(tokens, T.query_tokens(F.col("query")))).where("similarity > 0")
    known = files.select("path", F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "not-indexed").when(F.col("similarity") < L.MIN_SIMILARITY, "below-threshold").otherwise("used")
    c = F.round(_lookup(L.RATING_WEIGHTS, F.col("rating")) * _lookup(L.SOURCE_WEIGHTS, F.col("source")) * F.col("similarity"), 6)
    judged = rows.join(known, "path", "left").select("id", "path", status.alias("status"), c.alias("contribution"))
    used = judged.where("status = 'used'")
    net = F.least(F.lit(L.MAX_BOOST), F.sum(F.greatest(F.col("contribution"), F.lit(0.0)))) + F.greatest(F.lit(L.MAX_PENALTY), F.sum(F.least(F.col("contribution"), F.lit(0.0))))
    nets = used.groupBy("path").agg(F.round(net, 6).alias("net"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc(F.abs("contribution")), "id"))
    ordered = used.withColumn("place", place).join(nets, "path")
    none = judged.where("status <> 'used'").withColumns({"place": F.lit(None).cast("int"), "net": F.lit(None).cast("double")})
    return ordered.unionByName(none).select("id", "path", "status", "contribution", "net", "place")


def with_staleness(notes: DataFrame, files: DataFrame) -> DataFrame:
    """JN12: adds stale: null for repository notes and for notes without a
    hash, true if the file is gone or differs."""
    now = files.select("path", F.col("sha256").alias("now"))
    stale = (
        F.when(F.col("scope") == "repo", F.lit(None).cast("boolean"))
        .when(F.col("now").isNull(), True)
        .when(F.coalesce("file_sha256", F.lit("")) == "", F.lit(None).cast("boolean"))
        .otherwise(F.col("file_sha256") != F.col("now"))
    )
    return notes.join(now, "path", "left").withColumn("stale", stale).drop("now")


def dashboard_staleness(notes: DataFrame, files: DataFrame) -> DataFrame:
    """JN13: the dashboard's rule: no hash comes first, scope doesn't count."""
    now = files.select("path", F.col("sha256").alias("now"))
    stale = F.when(F.coalesce("file_sha256", F.lit("")) == "", F.lit(None).cast("boolean")).when(F.col("now").isNull(), True).otherwise(F.col("file_sha256") != F.col("now"))
    return notes.join(now, "path", "left").withColumn("stale", stale).drop("now")


def search_notes(notes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """ME2: id, path, scope, score of all notes: the share of the query's tokens that are
    among the note's stored tokens, 0.5 for the query inside the topic, 0.2 for
    a token inside the path, 0.4 for a token among the tags.

    ``notes`` may have ``note_tokens``; if not, they are those of path, topic,
    query, note and tags."""
    tokens = T.query_tokens(F.lit(query))
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in notes.columns else F.array().cast("array<string>")
    asked = F.coalesce("query", F.lit("")) if "query" in notes.columns else F.lit("")
    derived = T.query_tokens(F.concat_ws(" ", "path", "topic", asked, "note", F.array_join(tags, " ")))
    own = F.coalesce("note_tokens", derived) if "note_tokens" in notes.columns else derived
    shared = F.size(F.array_intersect(tokens, own)) / F.greatest(F.size(tokens), F.lit(1))
    in_topic = F.when(F.lower("topic").contains(query.lower()) & F.lit(bool(query)), 0.5).otherwise(0.0)
    in_path = F.when(F.exists(tokens, lambda t: F.contains(F.lower(F.col("path")), t)), 0.2).otherwise(0.0)
    in_tags = F.when(F.arrays_overlap(tokens, tags), 0.4).otherwise(0.0)
    score = F.when(F.size(tokens) > 0, shared + in_topic + F.coalesce(in_path, F.lit(0.0)) + F.coalesce(in_tags, F.lit(0.0))).otherwise(0.0)
    return notes.select("id", "path", "scope", F.round(score, 4).alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("id")).limit(max(1, min(limit, 50)))


def topics(notes: DataFrame, limit: int = 20, per_topic: int = 5, most_paths: int = 10) -> DataFrame:
    """AGG7: topic, note_count, file_count, repo_count, stale_count, latest_id,
    latest_created_at (of that note), paths (the first ``most_paths``), newest
    (ids of the newest ``per_topic`` notes), over all notes; most notes first,
    then by topic.

    Spark keeps each task's first few of a topic before it shuffles, so a topic
    with very many notes doesn't meet in one task."""
    counted = notes.groupBy("topic").agg(
        F.count("*").alias("note_count"), F.count_if(F.col("scope") == "repo").alias("repo_count"), F.count_if(F.col("stale")).alias("stale_count"),
        F.max("id").alias("latest_id"), F.max_by("created_at", "id").alias("latest_created_at"),
    )
    top = counted.orderBy(F.desc("note_count"), "topic").limit(max(1, min(limit, 100)))
    own = notes.where("path <> ''").select("topic", "path").distinct()
    by_topic = Window.partitionBy("topic")
    first = own.withColumn("place", F.row_number().over(by_topic.orderBy("path"))).where(F.col("place") <= most_paths)
    late = notes.select("topic", "id").withColumn("place", F.row_number().over(by_topic.orderBy(F.desc("id")))).where(F.col("place") <= max(1, min(per_topic, 20)))
    parts = (
        own.groupBy("topic").agg(F.count("*").cast("int").alias("file_count")),
        first.groupBy("topic").agg(F.array_sort(F.collect_list("path")).alias("paths")),
        late.groupBy("topic").agg(F.sort_array(F.collect_list("id"), asc=False).alias("newest")),
    )  # a row per topic
    for part in parts:
        named = part.withColumnRenamed("topic", "t")
        top = top.join(named, F.col("topic").eqNullSafe(F.col("t")), "left").drop("t")
    lists = top.select(
        "topic", "note_count", F.coalesce("file_count", F.lit(0)).alias("file_count"), "repo_count", "stale_count", "latest_id", "latest_created_at",
        F.coalesce("paths", F.array().cast("array<string>")).alias("paths"), F.coalesce("newest", F.array().cast("array<bigint>")).alias("newest"),
    )
    return lists.orderBy(F.desc("note_count"), "topic")


def audit(notes: DataFrame) -> DataFrame:
    """AGG13: id, issue: stale, short_note (under five useful words), no_hash."""
    short = F.size(T.query_tokens(F.col("note"))) < 5
    issues = F.array_compact(F.array(F.when(F.col("stale"), "stale"), F.when(short, "short_note"), F.when((F.col("scope") == "file") & (F.col("file_sha256") == ""), "no_hash")))
    return notes.select("id", F.explode(issues).alias("issue"))


def duplicate_topics(notes: DataFrame, most: int = 20) -> DataFrame:
    """AGG13: path, topic, notes, latest_id and ids (the newest ``most``, newest
    first) of file notes that share path and topic.

    Spark keeps each task's newest few of a group before it shuffles, so a
    topic with very many notes doesn't meet in one task."""
    own = notes.where("scope = 'file'")
    twice = own.groupBy("path", "topic").agg(F.count("*").alias("notes"), F.max("id").alias("latest_id")).where("notes > 1")
    place = F.row_number().over(Window.partitionBy("path", "topic").orderBy(F.desc("id")))
    few = own.select("path", "topic", "id").withColumn("place", place).where(F.col("place") <= most)
    listed = few.groupBy(F.col("path").alias("p"), F.col("topic").alias("t")).agg(F.sort_array(F.collect_list("id"), asc=False).alias("ids"))
    same = F.col("path").eqNullSafe(F.col("p")) & F.col("topic").eqNullSafe(F.col("t"))
    return twice.join(listed, same).select("path", "topic", "notes", "latest_id", "ids")


def plan_stats(plans: DataFrame, items: DataFrame) -> DataFrame:
    """AGG10 in one row: plans, finished and unfinished ones, average budget,
    opened or read events per finished plan, shares of finished plans with a
    useful file at rank 1 and up to 3, missing events."""
    totals = plans.agg(F.count("*").alias("plans"), F.count_if("finished").alias("finished"), F.count_if(~F.col("finished")).alias("unfinished"), F.round(F.avg("read_budget"), 4).alias("average_budget"))
    seen = items.join(plans.where("finished").select(F.col("id").alias("plan_id")), "plan_id", "left_semi")
    events = seen.agg(F.count_if(F.col("event").isin("opened", "read")).alias("opened"))
    useful = items.where("event = 'useful' AND rank > 0").agg(F.count_distinct(F.when(F.col("rank") <= 1, F.col("plan_id"))).alias("top1"), F.count_distinct(F.when(F.col("rank") <= 3, F.col("plan_id"))).alias("top3"))
    missing = items.agg(F.count_if(F.col("event") == "missing").alias("missing"))
    share = lambda c: F.round(F.when(F.col("finished") > 0, F.col(c) / F.col("finished")).otherwise(0.0), 4)
    joint = totals.crossJoin(events).crossJoin(useful).crossJoin(missing)  # one row each
    return joint.select("plans", "finished", "unfinished", "average_budget", share("opened").alias("opened_per_plan"), share("top1").alias("top1_rate"), share("top3").alias("top3_rate"), "missing")


def event_items(events: DataFrame, items: DataFrame) -> DataFrame:
    """JN17: events with item_rank and read_priority of their plan's item of the
    same path, null without one.  Of a path's items in a plan the last one
    (position) counts, also where its rank is null.

    The last items are found by an ordered aggregate, which combines before its
    shuffle; events are joined to one row per plan and path."""
    last = F.max_by(F.struct("rank", "read_priority"), "position")
    latest = items.groupBy("plan_id", "path").agg(last.alias("item"))
    return events.join(latest, ["plan_id", "path"], "left").select(*[events[c] for c in events.columns if c not in ("plan_id", "path")], "plan_id", "path", F.col("item.rank").alias("item_rank"), F.col("item.read_priority").alias("read_priority"))


def plan_histogram(items: DataFrame) -> DataFrame:
    """AGG10: rank, useful, noisy: outcomes by the rank of their item; events
    without a ranked item don't count."""
    said = items.where("rank > 0 AND event IN ('useful', 'noisy')")
    return said.groupBy("rank").agg(F.count_if(F.col("event") == "useful").alias("useful"), F.count_if(F.col("event") == "noisy").alias("noisy"))


#: Actions of files that a reading budget is spent on (RP5).
READ_ACTIONS = ("read", "verify_stale", "inspect_related")


def assign_budget(items: DataFrame, budget: int = 3) -> DataFrame:
    """RP5: plan_id, rank, path, read_priority, read_budget_rank: the first
    ``budget`` items (1 to 10) by rank of each plan whose action is reading are
    read now, later ones if needed; others give context or are skipped."""
    budget = max(1, min(budget, 10))
    eligible = F.col("action").isin(*READ_ACTIONS)
    run = F.sum(F.when(eligible, 1).otherwise(0)).over(Window.partitionBy("plan_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    now = eligible & (F.col("run") <= budget)
    priority = F.when(F.col("action") == "skip_unless_needed", "skip_unless_needed").when(now, "read_now").when(eligible, "read_if_needed").otherwise("context_only")
    return items.withColumn("run", run).select("plan_id", "rank", "path", priority.alias("read_priority"), F.when(now, F.col("run")).cast("bigint").alias("read_budget_rank"))


def plan_diff(items: DataFrame, events: DataFrame) -> DataFrame:
    """RP9: plan_id, path, difference: suggested_not_read, read_not_planned,
    read_now_not_read, read_without_outcome, of items (plan_id, path,
    read_priority) and events (plan_id, path, event).  A path counts as read by
    an ``opened`` or ``read`` event, its outcome is useful, noisy or missing."""
    event = F.col("event")
    no = F.lit(False)
    said = events.select("plan_id", "path", no.alias("planned"), no.alias("now"), event.isin("opened", "read").alias("was_read"), event.isin("useful", "noisy", "missing").alias("judged"))
    listed = items.select("plan_id", "path", F.lit(True).alias("planned"), (F.col("read_priority") == "read_now").alias("now"), no.alias("was_read"), no.alias("judged"))
    flags = [F.coalesce(F.bool_or(c), no).alias(c) for c in ("planned", "now", "was_read", "judged")]
    both = listed.unionByName(said).where("path <> ''").groupBy("plan_id", "path", F.when(F.col("plan_id").isNull(), F.col("planned")).alias("side")).agg(*flags)  # in place of a join, where null plans don't meet
    read = F.col("was_read")
    kinds = F.array(
        F.when(F.col("planned") & ~read, "suggested_not_read"), F.when(read & ~F.col("planned"), "read_not_planned"), F.when(F.col("now") & ~read, "read_now_not_read"), F.when(read & ~F.col("judged"), "read_without_outcome")
    )
    return both.select("plan_id", "path", F.explode(F.array_compact(kinds)).alias("difference"))


def recent_notes(notes: DataFrame, newest: int = 3) -> DataFrame:
    """RP1: path, notes, fresh, stale: of the newest notes of each path, how
    many, and whether one is known to be fresh or stale."""
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("id")))
    few = notes.where("scope <> 'repo'").withColumn("place", place).where(F.col("place") <= newest)
    return few.groupBy("path").agg(F.count("*").alias("notes"), F.coalesce(F.bool_or(~F.col("stale")), F.lit(False)).alias("fresh"), F.coalesce(F.bool_or("stale"), F.lit(False)).alias("stale"))


def fusion(scores: DataFrame, notes: DataFrame, limit: int = 10) -> DataFrame:
    """RP1, RP3, RP4: rank, path, score, sources, action, confidence.

    ``scores`` are long rows (path, source, score, boost, penalty) of the
    sources graph, trace, memory, feedback and tags; ``notes`` is of
    ``recent_notes``, and adds to paths that a source names."""
    by = lambda s: F.coalesce(F.max(F.when(F.col("source") == s, F.col("score"))), F.lit(0.0))
    has = lambda s: F.coalesce(F.bool_or(F.col("source") == s), F.lit(False))
    merged = scores.groupBy("path").agg(
        (10 * by("graph") + 0.35 * by("trace") + 5 * by("memory") + 1.5 * F.least(by("tags"), F.lit(8.0)) + 0.4 * F.coalesce(F.max("boost"), F.lit(0.0)) + 0.8 * F.coalesce(F.min("penalty"), F.lit(0.0))).alias("points"),
        F.count_distinct("source").alias("sources"), F.coalesce(F.min("penalty"), F.lit(0.0)).alias("penalty"), has("graph").alias("graph"), has("trace").alias("trace"), has("memory").alias("memory"),
    )
    known = merged.join(notes, "path", "left").na.fill(False, ["fresh", "stale"]).na.fill(0, ["notes"])
    score = F.round(F.col("points") + F.when(F.col("fresh"), 3.0).otherwise(0.0) + F.when(F.col("stale"), 1.0).otherwise(0.0), 4)
    graph, fresh, stale = F.col("graph"), F.col("fresh"), F.col("stale")
    action = (
        F.when((F.col("penalty") < 0) & ~(graph | F.col("trace") | F.col("memory")), "skip_unless_needed")
        .when(stale, "verify_stale")
        .when(F.col("trace") & ~graph, "inspect_related")
        .when(fresh & ~graph, "use_memory_context")
        .otherwise("read")
    )
    confidence = F.when((F.col("sources") >= 3) | fresh, "high").when((F.col("sources") >= 2) | (F.col("notes") > 0), "medium").otherwise("low")
    top = known.select("path", score.alias("score"), "sources", action.alias("action"), confidence.alias("confidence")).orderBy(F.desc("score"), "path").limit(max(1, min(limit, 30)))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))  # over at most ``limit`` rows


def merge_tasks(old: DataFrame, new: DataFrame) -> DataFrame:
    """SNK9: id, files: the new list appended to the old one, repeats dropped."""
    empty = F.array().cast("array<string>")
    return old.join(new.select("id", F.col("files").alias("added")), "id", "left").select("id", F.array_union("files", F.coalesce("added", empty)).alias("files"))
