"""Queries over the derived tables, by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import bucket_store, context, evaluation, listing, memory, packs, ranking, relations, sessions, stats, store, substrings, term_index, tracing
from ..sources import corpus as C
from ..sources.shared import shared_root, stage

QUERY = "red widget"
TOKENS = ["red", "widget"]
#: The context pack's query: "sprockets" is no term of the corpus, but nearly one.
PACK_QUERY = "red widget sprockets"
PACK_TOKENS = PACK_QUERY.split()
PATH = "part/1000"
VARIANTS = (".git/", "vendor/", "lib/x.egg-info/", "src/", ".hidden/", "")


class Project:
    """The tables of one query's project, each written to the shared folder the
    first time it is asked for, so that no stage derives it again."""

    def __init__(self, s: SparkSession, d: str) -> None:
        self._from = s, d

    def __getattr__(self, name: str) -> DataFrame:
        found = stage(getattr(C, name)(*self._from), f"project-{name}")
        setattr(self, name, found)
        return found

    def touched(self, tokens: list[str]) -> DataFrame:
        """The files of the commits that a token is in."""
        if "_touched" not in self.__dict__:
            self._touched = stage(C.commit_files(*self._from, among=ranking.matched_commits(self.commits, tokens)), "project-touched")
        return self._touched


def file_language_role(s, d):
    return C.files(s, d)


def ignore_filter(s, d):
    prefix = F.element_at(T.strings(VARIANTS), (F.col("id") % 6 + 1).cast("int"))
    return C.paths(s, d).select("id", F.concat(prefix, "path").alias("path")).where(T.is_indexable(F.col("path")))


def content_fingerprint(s, d):
    return C.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("sha256"))


def identifier_terms(s, d):
    mixed = F.concat_ws("", F.upper("source"), F.initcap("p_name"), F.lit("HTTPServer_v2"), F.lit("HTTP2x"))
    docs = C.table(s, d, "documents").join(F.broadcast(C._part_names(s, d)), F.col("doc_id") % 200 == F.col("name_key"))
    return docs.select(F.col("doc_id").alias("id"), F.array_join(T.identifier_terms(mixed), " ").alias("terms"))


def query_tokens(s, d):
    return C.commits(s, d).select("id", F.array_join(T.query_tokens(F.concat_ws(" ", "message", F.lit("how the apiHandler of go_db"))), " ").alias("tokens"))


def term_stats(s, d):
    return stats.term_stats(C.table(s, d, "documents"))


def term_weight_lookup(s, d):
    paths = stats.term_stats(C.paths(s, d), "path", "path")
    return stats.token_weights(paths, [*TOKENS, "absentterm"])


def file_tags(s, d):
    return stats.file_tags(C.files(s, d), C.symbols(s, d), C.relations(s, d))


def keyword_search(s, d):
    return relations.keyword_search(C.files(s, d), C.symbols(s, d), C.commits(s, d), "widget")


def term_stats_all(s, d):
    return context.all_term_stats(C.files(s, d), C.symbols(s, d), C.commits(s, d))


def _hits(s, d):
    """Files that the plain tokens hit, all weighing 1."""
    return ranking.path_scores(C.files(s, d), ranking.flat(TOKENS))


def context_pack_path_role(s, d):
    return _hits(s, d).select("path", F.round("score", 6).alias("score"))


def _pack_weights(p):
    counted = context.all_term_stats(p.files, p.symbols, p.commits)
    return context.query_weights(counted, PACK_TOKENS, context.source_documents(p.files, p.symbols, p.commits).where("source in ('path', 'symbol', 'commit')"))


def _scores(p, weights):
    """The scores before CX5, which the pack and its reasons start from."""
    return stage(ranking.pack_scores(p.files, p.symbols, p.commits, p.touched(list(weights)), weights, p.relations), "pack-scores")


def _pack(p, weights, scores=None, targets=None):
    signals = memory.feedback_signals(p.feedback, p.files, PACK_QUERY)
    scores = _scores(p, weights) if scores is None else scores
    return ranking.context_pack(p.files, p.symbols, p.commits, p.touched(list(weights)), signals, weights, relations=p.relations, scores=scores, targets=targets)


def context_pack_full(s, d):
    p = Project(s, d)
    return _pack(p, _pack_weights(p))


def _pack_and_reasons(p):
    """The pack and its reasons, of the pack's query."""
    weights = _pack_weights(p)
    scores = _scores(p, weights)
    candidates = scores.where("score > 0").select("path")
    targets = stage(relations.targets_among(p.relations, candidates), "pack-targets")
    pack = stage(_pack(p, weights, scores, targets), "pack")
    return pack, context.pack_reasons(pack, p.files, p.symbols, p.commits, p.touched(list(weights)), p.feedback, p.relations, candidates, weights, PACK_QUERY, targets=targets)


def context_reasons(s, d):
    """Why the files of the pack are in it."""
    return _pack_and_reasons(Project(s, d))[1].select("path", F.array_join("reasons", "; ").alias("reasons"))


def context_diagnostics(s, d):
    return context.diagnose(*_pack_and_reasons(Project(s, d)), PACK_QUERY, PACK_TOKENS)


def context_related_symbols(s, d):
    candidates = _hits(s, d).orderBy(F.desc("score"), "path").limit(10)
    return ranking.related_symbols(C.symbols(s, d), C.files(s, d), TOKENS, candidates)


SOFT = ("widgets", "gadgett", "sprockets")


def soft_match(s, d):
    """Distinct terms of all part names against long query tokens."""
    names = C.table(s, d, "part").select(F.explode(T.identifier_terms(F.col("p_name"))).alias("candidate")).distinct()
    return ranking.soft_matches(names.select(F.explode(T.strings(SOFT)).alias("token"), "candidate")).where("score > 0")


def feedback_signals(s, d):
    return memory.feedback_signals(C.feedback(s, d), C.paths(s, d), QUERY)


def feedback_explain(s, d):
    return memory.feedback_explain(C.feedback(s, d), C.paths(s, d), QUERY)


def cochanged_files(s, d):
    return relations.cochanged(C.commits(s, d), C.commit_files(s, d), PATH)


def file_recent_commits(s, d):
    return relations.recent_commits(C.commits(s, d), C.commit_files(s, d), PATH)


def commits_left_join_files(s, d):
    return relations.commits_with_files(C.commits(s, d), C.commit_files(s, d))


def callers_of_symbol(s, d):
    return relations.callers(C.calls(s, d), C.paths(s, d), "click")


def symbol_definitions(s, d):
    return relations.definitions(C.symbols(s, d), C.paths(s, d), "blue anvil")


def _named_calls(s, d):
    """Events as calls of part names."""
    e = C.table(s, d, "events").select(F.col("user_id").alias("source_id"), (F.col("event_id") % 200).alias("key"))
    return e.join(F.broadcast(C._part_names(s, d)), F.col("key") == F.col("name_key")).select("source_id", F.col("p_name").alias("target_id"))


def callers_for_file_symbols(s, d):
    return relations.callers_of_file_symbols(C.symbols(s, d), _named_calls(s, d), C.paths(s, d), 7)


def relation_dedupe_max_confidence(s, d):
    return relations.distinct_relations(C.relations(s, d))


def path_suffix_index(s, d):
    return relations.suffix_index(C.paths(s, d))


def edge_resolution(s, d):
    targets = C.paths(s, d).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("./"), T.file_name(F.col("path")))).when(F.col("id") % 3 == 1, F.col("path")).otherwise(F.concat(F.lit("x/"), T.file_name(F.col("path")))).alias("target"))
    return relations.resolve(targets, C.paths(s, d))


def _stale(s, d):
    return memory.with_staleness(C.notes(s, d), C.files(s, d, content=True))


def note_staleness(s, d):
    return _stale(s, d).select("id", "path", "stale")


def note_staleness_dashboard(s, d):
    return memory.dashboard_staleness(C.notes(s, d), C.files(s, d, content=True)).select("id", "path", "stale")


def memory_search(s, d):
    return memory.search_notes(_tagged_notes(s, d), "user widget").select("id", "score")


def memory_topics(s, d):
    notes = _stale(s, d).select("id", "path", "scope", "topic", "created_at", "stale")
    found = memory.topics(stage(notes, "notes"))
    return found.withColumns({"paths": F.array_join("paths", ","), "newest": F.array_join(F.transform("newest", lambda i: i.cast("string")), ",")})


def memory_audit(s, d):
    return memory.audit(_stale(s, d))


def duplicate_topics(s, d):
    return memory.duplicate_topics(C.notes(s, d)).withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


def file_activity(s, d):
    return stats.activity(C.notes(s, d), C.feedback(s, d), C.plan_items(s, d))


def subsystem_rollup(s, d):
    return stats.subsystems(C.files(s, d))


def overview_first_reads(s, d):
    return ranking.first_reads(C.project_files(s, d), C.project_symbols(s, d))


def estimate_tokens(s, d):
    return stats.size_estimate(C.files(s, d, content=True))


def read_sizes(s, d):
    p = Project(s, d)
    lengths = C.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.char_length("text").alias("length"))
    return stats.read_sizes(p.files.join(lengths, "id"), stage(_pack(p, _pack_weights(p)), "pack"))


def _before(s, d):
    now = C.files(s, d, content=True).select("id", "path", "sha256")
    old = now.where("id % 10 <> 0").select("path", F.when(F.col("id") % 10 == 1, "altered").otherwise(F.col("sha256")).alias("sha256"))
    return old.unionByName(now.where("id % 10 = 0").select(F.concat(F.lit("removed/"), "path").alias("path"), "sha256"))


def refresh_diff(s, d):
    return relations.refresh_diff(_before(s, d), C.files(s, d, content=True).select("path", "sha256"))


def _earlier(s, d):
    """Files and symbols as they were: a tenth under other paths, a tenth with
    another role and other names."""
    files, symbols = C.files(s, d), C.symbols(s, d)
    fresh = F.col("id") % 10 == 0
    old_files = files.select(
        F.when(fresh, -F.col("id") - 1).otherwise(F.col("id")).alias("id"), F.when(fresh, F.concat(F.lit("removed/"), "path")).otherwise(F.col("path")).alias("path"), "language",
        F.when(F.col("id") % 10 == 1, "legacy page").otherwise(F.col("role")).alias("role"),
    )
    owner = F.when(F.col("file_id") % 10 == 0, -F.col("file_id") - 1).otherwise(F.col("file_id"))
    name = F.when(F.col("file_id") % 10 == 1, F.concat(F.lit("former_"), "name")).otherwise(F.col("name"))
    return old_files, symbols.select("id", owner.alias("file_id"), name.alias("name"))


def refresh_term_stats(s, d):
    """Term statistics after a refresh: the stored counts of the earlier state
    with the difference that its changed files and a quarter of new commits make."""
    files, symbols, commits = C.files(s, d), C.symbols(s, d), C.commits(s, d)
    old_files, old_symbols = _earlier(s, d)
    fresh = F.col("id") % 4 == 0
    before = term_index.source_documents(old_files, old_symbols, commits.where(~fresh))
    counts, sizes = stage(term_index.counts(before), "stored-terms"), stage(term_index.sizes(before), "stored-term-sizes")
    touched = stage(refresh_diff(s, d).where("change <> 'unchanged'").select("path"), "touched-paths")

    def of(files, symbols, commits=None):
        own = files.join(touched, "path", "left_semi")
        return term_index.source_documents(own, symbols.join(own.select(F.col("id").alias("file_id")), "file_id", "left_semi"), commits)

    change, size_change = term_index.delta(of(old_files, old_symbols), of(files, symbols, commits.where(fresh)))
    return term_index.weighed(term_index.applied(counts, change), term_index.applied_sizes(sizes, size_change))


def bucket_update(s, d):
    """Two versions of the symbols in buckets: the second one rewrites those of
    a tenth of the files."""
    columns = "id long, file_id long, kind string, line int"
    symbols = C.symbols(s, d).select("id", "file_id", "kind", F.col("line").cast("int").alias("line"))
    kept = bucket_store.BucketStore(s, f"{shared_root(s)}/buckets-{uuid.uuid4().hex}", {"symbols": columns}, {"symbols": "file_id"}, buckets=64)
    kept.commit([bucket_store.Change("symbols", symbols, lambda stored: symbols)])
    touched = symbols.where("file_id % 10 = 7").select("file_id").distinct()
    incoming = symbols.where("file_id % 10 = 7 AND line % 2 = 0").withColumn("kind", F.lit("moved"))
    kept.commit([bucket_store.Change("symbols", touched, lambda stored: store.replace_children(stored, incoming, touched))])
    return kept.read("symbols", 1).select(F.lit(1).alias("version"), "id", "kind").unionByName(kept.read("symbols").select(F.lit(2).alias("version"), "id", "kind"))


def doctor_diff(s, d):
    return relations.index_health(_before(s, d).select("path"), C.paths(s, d).select("path"))


def task_merge(s, d):
    lines = C.table(s, d, "lineitem")
    old = lines.where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("files"))
    new = lines.where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("files"))
    return memory.merge_tasks(old, new).select("id", F.size("files").alias("n_files"), F.array_join(F.array_sort("files"), ",").alias("files"))


def _actions(items):
    """Plan items with the action that their event calls for."""
    return items.withColumn("action", F.when(F.col("event") == "noisy", "skip_unless_needed").when(F.col("rank") % 4 == 0, "use_memory_context").otherwise("read"))


def _planned(s, d):
    return _actions(C.plan_items(s, d))


def plan_diff(s, d):
    items = stage(C.plan_items(s, d), "plan-items")
    events = items.where("rank % 2 = 1").select("plan_id", "path", F.lit("opened").alias("event")).unionByName(items.where("event = 'useful' AND rank % 3 = 1").select("plan_id", "path", "event"))
    events = events.unionByName(items.where("rank = 1").select("plan_id", F.concat(F.lit("extra/"), "path").alias("path"), F.lit("read").alias("event")))
    return memory.plan_diff(memory.assign_budget(_actions(items)), events)


def plan_stats(s, d):
    return memory.plan_stats(C.plans(s, d), C.plan_items(s, d))


def plan_event_items(s, d):
    """Events with the last item of their path: every third item comes twice,
    the second time without a rank or with another one."""
    items = memory.assign_budget(_planned(s, d)).select("plan_id", "path", "rank", "read_priority", F.col("rank").alias("position"))
    again = items.where("rank % 3 = 0").select("plan_id", "path", F.when(F.col("rank") % 2 == 0, F.col("rank") + 10).alias("rank"), F.lit("skip_unless_needed").alias("read_priority"), (F.col("position") + 100).alias("position"))
    events = C.plan_items(s, d).select("plan_id", "path", "event").unionByName(items.where("rank = 1").select("plan_id", F.concat(F.lit("extra/"), "path").alias("path"), F.lit("read").alias("event")))
    return memory.event_items(events, items.unionByName(again))


def plan_histogram(s, d):
    return memory.plan_histogram(C.plan_items(s, d))


def reading_plan_budget(s, d):
    return memory.assign_budget(_planned(s, d))


def reading_plan_fusion(s, d):
    """All five sources of one query, over the context pack's query."""
    p = Project(s, d)
    none = F.lit(None).cast("double")

    def rows(df, source, score=none, boost=none, penalty=none):
        return df.select("path", F.lit(source).alias("source"), score.alias("score"), boost.alias("boost"), penalty.alias("penalty"))

    graph = rows(stage(_pack(p, _pack_weights(p)), "pack"), "graph", F.col("score"))
    best = trace_scores(s, d).where("score > 0").orderBy(F.desc("score"), "path").limit(10)
    traced = rows(best, "trace", F.col("score"))
    stale = stage(_stale(s, d), "notes")
    noted = memory.search_notes(_tags_of(stale), PACK_QUERY, 20).where("scope <> 'repo'").groupBy("path").agg(F.max("score").alias("score"))
    signals = rows(memory.feedback_signals(p.feedback, p.files, PACK_QUERY), "feedback", none, F.col("boost"), F.col("penalty"))
    tagged = rows(listing.tag_scores(stats.file_tags(p.files, p.symbols), p.files, PACK_TOKENS), "tags", F.col("score"))
    scores = graph.unionByName(traced).unionByName(rows(noted, "memory", F.col("score"))).unionByName(signals).unionByName(tagged)
    return memory.fusion(stage(scores, "fusion-scores"), memory.recent_notes(stale), 30)


def _includes(s, d):
    """Include relations to whole paths, every second one from the root."""
    found = C.relations(s, d).where("relation = 'includes' AND target_id IS NOT NULL")
    return found.withColumn("relation", F.lit("include")).withColumn("target_id", F.concat(F.when(F.col("id") % 2 == 0, "/").otherwise(""), "target_id"))


def include_edges(s, d):
    return tracing.resolved_edges(_includes(s, d), C.paths(s, d), C.symbols(s, d)).select("source", "target", "target_id", "confidence")


def _include_steps(s, d):
    return tracing.resolved_edges(_includes(s, d), C.paths(s, d), C.symbols(s, d))


def trace_query(s, d):
    """The best files along include edges from the trace's starts."""
    found = tracing.trace(_include_steps(s, d), C.files(s, d, content=True), trace_starts(s, d), TRACE)
    step = F.transform("edges", lambda e: F.concat_ws(" ", e["from"], e["to"], e["relation"], e["confidence"].cast("string"), e["reason"]))
    return found.withColumns({"edges": F.array_join(step, "; "), "reasons": F.array_join("reasons", "; ")})


def _tasks(s, d):
    text = lambda c: F.lit(c).cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return C.table(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string")).alias("title"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"),
        F.col("o_orderpriority").alias("topic"), text("").alias("summary"), F.array(F.concat(F.lit("c/"), F.col("o_custkey").cast("string"))).alias("files"), T.strings(()).alias("tests"), T.strings(()).alias("remaining"),
        text("agent").alias("source"), day.alias("created_at"), day.alias("updated_at"), F.when(F.col("o_orderstatus") == "F", day).alias("closed_at"),
    )


def task_changes(s, d):
    """A task added, one done with more files, and a note on another."""
    tasks = sessions.add_task(_tasks(s, d), " new one ", "2030-01-01", files=["./a/b.py"])
    tasks = sessions.update_task(tasks, 1, "2030-01-02", status="done", topic=" t ", files=["x.py", "x.py"])
    notes = s.createDataFrame([], sessions.NOTE_SCHEMA)
    tasks, _ = sessions.add_task_note(tasks, notes, 2, "said", "2030-01-03", files=["y.py"])
    return tasks.select("id", "title", "status", "topic", F.array_join("files", ",").alias("files"), "updated_at", "closed_at")


def session_summary(s, d):
    return sessions.summary(_stale(s, d), C.feedback(s, d), _tasks(s, d), C.plans(s, d), [" M a.py"], 5)


def session_close(s, d):
    return sessions.close_checklist(_stale(s, d), _tasks(s, d), C.plans(s, d), [" M a.py", "?? b"])


def session_suggestions(s, d):
    return sessions.suggestions(_stale(s, d), C.plans(s, d), C.plan_items(s, d))


def audit_counts(s, d):
    return sessions.audit_counts(_stale(s, d))


def _traced(s, d):
    """The strongest include edges, and a tenth of the files that include others."""
    strong = stage(tracing.strongest(_include_steps(s, d)), "trace-edges")
    return strong, C.relations(s, d).where("source_id % 10 = 1").select(F.col("source_id").alias("id")).distinct().join(C.paths(s, d), "id").select(F.col("id").alias("node"))


def _ids():
    return F.array_join(F.concat(F.array("start"), "ids"), ">").alias("path")


def trace_paths(s, d):
    """The first shortest path from each start to every file in reach."""
    return tracing.path_labels(*_traced(s, d)).select("start", "target", "hops", _ids())


def retrieval_cases(s, d):
    """A case per query of the feedback: its three first useful files by path."""
    useful = C.feedback(s, d).where("rating = 'useful'").groupBy(F.col("query").alias("name")).agg(F.array_sort(F.collect_set("path")).alias("p"))
    return useful.select("name", F.col("name").alias("query"), F.slice("p", 1, 3).alias("expected_files"), T.strings(("tests/", ".css")).alias("noise_patterns"))


def _packs_of(p, cases):
    counted = stage(context.all_term_stats(p.files, p.symbols, p.commits), "term-stats")
    texts = context.source_documents(p.files, p.symbols, p.commits).where("source in ('path', 'symbol', 'commit')")
    return packs.context_packs(p.files, p.symbols, p.commits, p.commit_files, p.relations, p.feedback, cases, counted, texts)


def packs_of_queries(s, d):
    """The context packs of all queries of the feedback, in one plan."""
    return _packs_of(Project(s, d), stage(retrieval_cases(s, d), "cases")).select("name", "rank", "path", F.round("raw", 3).alias("raw"))  # sums of doubles in another order differ by 10^-6


def retrieval_eval(s, d):
    cases = stage(retrieval_cases(s, d), "cases")
    ranked = stage(_packs_of(Project(s, d), cases).select("name", "path", "rank"), "ranked")
    return evaluation.evaluate(cases, ranked).drop("manual_scan_file_count", "manual_scan_reduction_percent")


def substring_matches(s, d):
    """Which part names and priorities hold which word endings of part names, by the rarest letters."""
    part = C.table(s, d, "part")
    names = part.select(F.lower("p_name").alias("name")).unionByName(C.table(s, d, "orders").select(F.col("o_orderpriority").alias("name"))).distinct()
    words = part.select(F.explode(F.split(F.lower(F.expr("substring(p_name, 2)")), " ")).alias("token"))
    return substrings.containing(names, words.unionByName(s.createDataFrame([("e",), ("ed",)], "token string")).where("token <> ''"))


def savings(s, d):
    by = C.files(s, d, content=True).groupBy("language").agg(F.sum(F.char_length("content")).alias("all"), F.sum(F.when(F.col("id") % 10 == 0, F.char_length("content")).otherwise(0)).alias("read"))
    return by.select("language", T.savings_percent(F.col("read"), F.col("all")).alias("saved"), T.reduction_percent(F.col("all"), F.col("read")).alias("reduction"))


def session_events(s, d):
    """Events per day and type: what the streaming query sums up."""
    return C.table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("events"))


def context_calls(s, d):
    return ranking.call_scores(C.relations(s, d), C.paths(s, d), ranking.flat(TOKENS)).select("path", F.round("score", 6).alias("score"))


def context_related_files(s, d):
    return relations.related_scores(C.relations(s, d), C.paths(s, d), _hits(s, d).select("path"))


def context_commits(s, d):
    return ranking.pack_commits(C.commits(s, d), C.commit_files(s, d), _hits(s, d).select("path"), TOKENS)


def resolved_calls(s, d):
    """The calls of a PHP file; definitions are symbols of the same language."""
    return relations.resolved_calls(C.relations(s, d), C.symbols(s, d), C.files(s, d), 9)


def export_relations(s, d):
    return store.export_relations(C.relations(s, d), C.paths(s, d), C.symbols(s, d))


def export_commits(s, d):
    return store.export_commits(C.commits(s, d), C.commit_files(s, d)).select("id", "date", "message", F.array_join("files", ",").alias("files"))


def _incoming(s, d):
    """A third of the files altered, and a new one for every seventh."""
    now = C.files(s, d, content=True).select("id", "path", "language", "sha256")
    return now.where("id % 3 = 0").select("path", "language", F.lit("altered").alias("sha256")).unionByName(now.where("id % 7 = 0").select(F.concat(F.lit("new/"), "path").alias("path"), "language", "sha256"))


def upsert_files(s, d):
    return store.upsert_files(C.files(s, d, content=True).select("id", "path", "language", "sha256"), _incoming(s, d))


def append_notes(s, d):
    notes = C.notes(s, d).select("id", "path", "note")
    return store.append(notes, notes.where("id % 2 = 1").select("path", F.concat_ws(" ", F.lit("again"), F.col("id").cast("string"), "note").alias("note")), "note")


def replace_symbols(s, d):
    symbols = C.symbols(s, d).select("id", "file_id", "name", "kind", "line")
    touched = symbols.where("file_id % 4 < 2").select("file_id")
    return store.replace_children(symbols, symbols.where("file_id % 4 = 0 AND line % 2 = 0").withColumn("kind", F.lit("function")), touched)


def defines_edges(s, d):
    return store.defines_edges(C.symbols(s, d)).select("source_id", "relation", "target_type", "target_id", "confidence", "metadata")


def _after_delete(s, d):
    files = C.files(s, d)
    tags = stats.file_tags(files, C.symbols(s, d))
    return store.delete_files(files, C.symbols(s, d), C.relations(s, d), tags, files.where("id % 5 = 0").select("path"))


def cascade_delete(s, d):
    """What is left of each table, by row."""
    left = _after_delete(s, d)
    rows = left["files"].select(F.lit("files").alias("section"), F.col("id").cast("string").alias("row"))
    rows = rows.unionByName(left["symbols"].select(F.lit("symbols").alias("section"), F.col("id").cast("string").alias("row")))
    rows = rows.unionByName(left["relations"].select(F.lit("relations").alias("section"), F.col("id").cast("string").alias("row")))
    return rows.unionByName(left["file_tags"].select(F.lit("file_tags").alias("section"), F.concat_ws("/", F.col("file_id").cast("string"), "source", "tag").alias("row")))


def upsert_meta(s, d):
    nation = C.table(s, d, "nation")
    region = C.table(s, d, "region").select(F.upper("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    return store.upsert_meta(nation.select(F.upper("n_name").alias("key"), F.lit("old").alias("value")), region.unionByName(nation.where("n_nationkey % 2 = 0").select(F.upper("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))))


def _tagged_notes(s, d):
    return _tags_of(_stale(s, d))


def _tags_of(notes):
    return notes.withColumn("tags", F.when(F.col("id") % 2 == 1, F.array("topic", F.lit("Widget"))).otherwise(F.array("topic")))


def update_notes(s, d):
    notes = _tagged_notes(s, d).select("id", "path", "scope", "topic", "note", "tags", F.array().cast("array<string>").alias("note_tokens"), "file_sha256", F.lit("2024-01-01").alias("created_at"))
    changes = notes.where("id % 3 = 0").select("id", F.lit("  moved ").alias("topic"), F.when(F.col("id") % 2 == 0, "new ApiHandler text").alias("note"))
    out = store.update_notes(notes, changes, C.files(s, d, content=True), "2025-01-01")
    return out.select("id", "topic", "note", "file_sha256", "created_at", (F.size("note_tokens") > 0).alias("tokenised"))


def delete_notes(s, d):
    return store.delete_notes(C.notes(s, d), [1000, 2001, 3000, -1])[0].select("id", "path")


def clear_feedback(s, d):
    return store.clear_feedback(C.feedback(s, d), query="red widget").select("id", "path", "query")


def flow_topics(s, d):
    files = C.files(s, d)
    return stats.flow_topics(_tagged_notes(s, d), stats.file_tags(files, C.symbols(s, d)), files)


def plan_activity(s, d):
    return stats.plan_activity(C.plans(s, d), C.plan_items(s, d).withColumn("event", F.when(F.col("event") == "opened", "read").otherwise(F.col("event"))))


def benchmark_summary(s, d):
    k = F.col("doc_id")
    rows = C.table(s, d, "labels").select(
        F.when(k % 10 == 0, "skipped").otherwise("ok").alias("status"), (F.col("quality") == 1).alias("top1_hit"), ((F.col("quality") == 1) | (k % 2 == 0)).alias("top3_hit"), (k % 9 != 0).alias("top5_hit"),
        F.col("toxic").alias("noise_hit_count"), (k % 7 * 0.25).alias("elapsed_seconds"), F.when(k % 4 != 0, k % 100 * 0.5).alias("manual_scan_reduction_percent"), F.when(k % 3 == 0, k % 5 * 0.125).alias("manual_scan_elapsed_seconds"),
    )
    return stats.benchmark_summary(rows)


def overview_entry_points(s, d):
    return ranking.entry_points(C.project_files(s, d), C.project_symbols(s, d))


def overview_manifests(s, d):
    return ranking.manifests(C.project_files(s, d), C.project_symbols(s, d))


TRACE = ["widget", "test", "product"]


def trace_starts(s, d):
    return ranking.trace_starts(C.files(s, d, content=True), C.project_symbols(s, d), TRACE)


def trace_scores(s, d):
    return ranking.trace_scores(C.files(s, d, content=True).withColumn("distance", F.col("id") % 12), TRACE)


def trace_targets(s, d):
    """Every file in reach once, by the first of its shortest paths."""
    return tracing.first_paths(*_traced(s, d)).select("target", "start", "hops", _ids())


def trace_profile(s, d):
    return C.commits(s, d).select("id", ranking.trace_profile(T.trace_tokens(F.concat_ws(" ", "message", F.when(F.col("id") % 3 == 0, "unittest page").when(F.col("id") % 3 == 1, "unittest")))).alias("profile"))


def list_feedback(s, d):
    return listing.feedback(C.feedback(s, d), query="red widget").select("id", "path", "rating")


def list_notes(s, d):
    return listing.notes(_stale(s, d), 500, scope="file").select("id", "path", "topic")


def list_stale_notes(s, d):
    return listing.notes(_stale(s, d), 50, stale_only=True).select("id", "path", "stale")


def list_tasks(s, d):
    orders = C.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"), F.col("o_orderpriority").alias("topic"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"))
    return listing.tasks(orders, topic="1-URGENT")


def list_plans(s, d):
    items = C.plan_items(s, d)
    return listing.plans(C.plans(s, d), items, items.where("event <> 'opened'"), unfinished=True, most_items=2)


def focused_entry_points(s, d):
    return listing.focused(ranking.entry_points(C.project_files(s, d), C.project_symbols(s, d)))


def supporting_files(s, d):
    entries = C.files(s, d).orderBy("path").limit(4)
    return listing.supporting(_hits(s, d).select("path", F.round("score", 6).alias("score")), entries)


def table_counts(s, d):
    return listing.table_counts({"files": C.paths(s, d), "symbols": C.symbols(s, d), "relations": C.relations(s, d), "commits": C.commits(s, d)})


def fallback_weights(s, d):
    texts = C.paths(s, d).select(F.col("path").alias("text")).unionByName(C.symbols(s, d).select(F.col("name").alias("text"))).unionByName(C.commits(s, d).select(F.col("message").alias("text")))
    return listing.fallback_weights(texts, [*TOKENS, "absentterm"])


def note_tags(s, d):
    tags = listing.note_tags(F.col("path"), F.col("topic"), F.lit("red widget"), F.col("note"), F.when(F.col("id") % 2 == 1, T.strings(("ApiHandler", "the red"))))
    return C.notes(s, d).select("id", F.array_join(tags, ",").alias("tags"))


def tag_scores(s, d):
    files = C.files(s, d)
    return listing.tag_scores(stats.file_tags(files, C.symbols(s, d)), files, TOKENS)


def combined_tags(s, d):
    files = C.files(s, d)
    return listing.combined_tags(_tagged_notes(s, d), stats.file_tags(files, C.symbols(s, d)), files).select("path", F.array_join("tags", ",").alias("tags"))


QUERIES = {
    f.__name__: f
    for f in (
        file_language_role, ignore_filter, content_fingerprint, identifier_terms, query_tokens, term_stats, term_weight_lookup, file_tags, keyword_search,
        term_stats_all, context_pack_path_role, context_pack_full, context_reasons, context_diagnostics, context_related_symbols, soft_match, feedback_signals, feedback_explain, cochanged_files, file_recent_commits,
        commits_left_join_files, callers_of_symbol, symbol_definitions, callers_for_file_symbols, relation_dedupe_max_confidence, path_suffix_index, edge_resolution,
        note_staleness, note_staleness_dashboard, memory_search, memory_topics, memory_audit, duplicate_topics, file_activity, subsystem_rollup, overview_first_reads,
        estimate_tokens, read_sizes, refresh_diff, refresh_term_stats, bucket_update, doctor_diff, task_merge, plan_diff, plan_stats, reading_plan_budget, reading_plan_fusion, plan_histogram, plan_event_items, include_edges, trace_query, task_changes, session_summary, session_close, session_suggestions, audit_counts, trace_paths, retrieval_eval, packs_of_queries, substring_matches, savings, session_events,
        context_calls, context_related_files, context_commits, resolved_calls, export_relations, export_commits, upsert_files, append_notes, replace_symbols, defines_edges,
        cascade_delete, upsert_meta, update_notes, delete_notes, clear_feedback, flow_topics, plan_activity, benchmark_summary, overview_entry_points, overview_manifests,
        trace_starts, trace_scores, trace_targets, trace_profile,
        list_feedback, list_notes, list_stale_notes, list_tasks, list_plans, focused_entry_points, supporting_files, table_counts, fallback_weights, note_tags, tag_scores, combined_tags,
    )
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_pack_full(spark, sf_dir)
