import json

import pytest

from pyspark.sql import functions as F

from codemap_spark.operators import memory, ranking, store
from codemap_spark.plans import oracles


def test_versions_replace_each_other(spark, tmp_path):
    tables = store.TableStore(spark, f"file://{tmp_path}/tables")
    assert not tables.exists("files")
    with pytest.raises(ValueError):
        tables.read("files")
    first = tables.replace("files", spark.createDataFrame([(1, "a")], "id long, path string"))
    for k in range(3):  # each version reads the one before it
        first = tables.replace("files", first.union(spark.createDataFrame([(k + 2, "x")], "id long, path string")))
    assert sorted(r.id for r in tables.read("files").collect()) == [1, 2, 3, 4]
    assert len(list((tmp_path / "tables/files").iterdir())) == 2


def test_an_unfinished_version_is_no_table(spark, tmp_path):
    tables = store.TableStore(spark, f"file://{tmp_path}")
    tables.replace("t", spark.range(3))
    (tmp_path / "t/v2").mkdir()
    assert tables.read("t").count() == 3


def test_upsert_keeps_ids_and_numbers_new_paths(spark):
    old = spark.createDataFrame([(7, "a", "1"), (9, "b", "2")], "id long, path string, sha256 string")
    new = spark.createDataFrame([("b", "3"), ("b", "4"), ("c", "5"), ("d", None)], "path string, sha256 string")
    rows = {r.path: (r.id, r.sha256) for r in store.upsert_files(old, new).collect()}
    assert rows["a"] == (7, "1") and rows["b"] == (9, "4")
    assert sorted([rows["c"][0], rows["d"][0]]) == [10, 11] and rows["d"][1] is None


def test_upsert_into_an_empty_table(spark):
    empty = spark.createDataFrame([], "id long, path string, sha256 string")
    rows = store.upsert_files(empty, spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")).collect()
    assert sorted(r.id for r in rows) == [1, 2]
    assert store.upsert_files(empty, empty.select("path", "sha256")).count() == 0


def test_run_log(spark):
    runs = spark.createDataFrame([], "id long, command string, started_at string, finished_at string, status string")
    runs = store.begin_run(store.begin_run(runs, "scan", "t0"), "refresh", "t1")
    rows = store.finish_run(runs, 1, "t2").orderBy("id").collect()
    assert [(r.id, r.command, r.finished_at, r.status) for r in rows] == [(1, "scan", "t2", "ok"), (2, "refresh", None, "running")]


def test_clearing_feedback_needs_a_choice(spark):
    rows = spark.createDataFrame([("q", "a"), ("q", "b"), (None, "a")], "query string, path string")
    with pytest.raises(ValueError):
        store.clear_feedback(rows)
    assert store.clear_feedback(rows, query="q", path="./a").count() == 2
    assert store.clear_feedback(rows, path="a").count() == 1
    assert store.clear_feedback(rows, everything=True).count() == 0


def test_a_blank_note_is_refused(spark):
    notes = spark.createDataFrame([(1, "a", "file", "t", "n", ["x"], [], "h", "d")], "id long, path string, scope string, topic string, note string, tags array<string>, note_tokens array<string>, file_sha256 string, created_at string")
    files = spark.createDataFrame([("a", "now")], "path string, sha256 string")
    kept = store.update_notes(notes, spark.createDataFrame([(1, None, "fresh")], "id long, topic string, note string"), files, "d2").first()
    assert (kept.topic, kept.note, kept.file_sha256, kept.created_at, kept.tags) == ("t", "fresh", "now", "d2", ["x"])
    with pytest.raises(Exception, match="note is required"):
        store.update_notes(notes, spark.createDataFrame([(1, None, "  ")], "id long, topic string, note string"), files, "d2").collect()


def test_feedback_comes_back_from_json(spark, tmp_path):
    rows = spark.createDataFrame([("q", "a", "useful", None, "user")], "query string, path string, rating string, reason string, source string")
    store.export_feedback(rows, f"file://{tmp_path}/out")
    assert store.import_feedback(spark, f"file://{tmp_path}/out").collect() == rows.collect()
    (tmp_path / "one.json").write_text(json.dumps({"feedback": [{"query": "q", "path": "b", "rating": "noisy"}, {"query": "q"}]}))
    assert [r.path for r in store.import_feedback(spark, f"file://{tmp_path}/one.json").collect()] == ["b"]
    (tmp_path / "two.json").write_text(json.dumps([{"query": "q", "path": "c", "rating": "noisy"}]))
    assert [r.path for r in store.import_feedback(spark, f"file://{tmp_path}/two.json").collect()] == ["c"]


def test_graph_lines(spark):
    files = spark.createDataFrame([(1, "a.py")], "id long, path string")
    symbols = spark.createDataFrame([(5, 1, "f", "function", 3)], "id long, file_id long, name string, kind string, line int")
    relations = spark.createDataFrame([(1, "file", 1, "defines", "symbol", "5", 1.0, "{}"), (2, "file", 1, "calls", "symbol", "five", 0.5, "{}")], "id long, source_type string, source_id long, relation string, target_type string, target_id string, confidence double, metadata string")
    commits = spark.createDataFrame([(1, "m"), (2, "n")], "id long, message string")
    touched = spark.createDataFrame([(1, "b"), (1, "a.py")], "commit_id long, path string")
    lines = [(r.section, json.loads(r.value)) for r in store.export_graph(files, symbols, relations, commits, touched).collect()]
    of = lambda section: [v for s, v in lines if s == section]
    assert of("symbols")[0]["file"] == "a.py"
    assert {r["id"]: r.get("target_symbol") for r in of("relations")} == {1: "f", 2: None}
    assert {c["id"]: c["files"] for c in of("commits")} == {1: ["a.py", "b"], 2: []}


def test_a_trace_without_entry_points_takes_usual_names(spark):
    files = spark.createDataFrame([(1, "x/main.py", "source", "python", ""), (2, "x/other.py", "source", "python", "")], "id long, path string, role string, language string, content string")
    none = spark.createDataFrame([], "id long, file_id long, name string, kind string, line int")
    starts = ranking.trace_starts(files.where("id = 2"), none, ["product"]).collect()
    assert starts == []
    routes = files.where("id = 2").withColumn("role", files.role.substr(1, 0)).replace("", "route", "role")
    assert [r.path for r in ranking.trace_starts(routes, none, ["product"]).collect()] == ["x/other.py"]
    assert [r.path for r in ranking.trace_starts(files, none, ["product"]).collect()] == ["x/main.py"]


def test_a_later_path_with_edges_takes_the_place_of_one_without(spark):
    rows = spark.createDataFrame([(1, "t", 0, "t"), (2, "u", 1, "s>u"), (3, "t", 2, "s>u>t"), (4, "t", 1, "s>t")], "at int, target string, hops int, path string")
    found = {r.target: (r.position, r.path) for r in ranking.dedupe_targets(rows, "at").collect()}
    assert found == {"t": (1, "s>u>t"), "u": (2, "s>u")}


def test_git_log_and_state(spark, tmp_path):
    import subprocess

    from codemap_spark.sources import repository

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    assert repository.git_state(str(tmp_path))["available"] is False
    assert [t.count() for t in repository.git_log(spark, str(tmp_path))] == [0, 0]
    git("init", "-q", "-b", "main")
    (tmp_path / "a b.py").write_text("1")
    (tmp_path / "ü.py").write_text("1")
    git("add", "-A")
    git("commit", "-qm", "first")
    (tmp_path / "a b.py").write_text("2")
    git("commit", "-qam", "second")
    git("commit", "-q", "--allow-empty", "-m", "third")
    (tmp_path / "new").write_text("")
    commits, touched = repository.git_log(spark, str(tmp_path))
    assert [(r.id, r.message, r.author) for r in commits.orderBy("id").collect()] == [(1, "third", "n"), (2, "second", "n"), (3, "first", "n")]
    assert sorted((r.commit_id, r.path) for r in touched.collect()) == [(2, "a b.py"), (3, "a b.py"), (3, "ü.py")]
    assert repository.git_state(str(tmp_path)) == {"available": True, "branch": "main", "status": ["?? new"]}


def test_finishing_a_plan_and_closing_a_task(spark):
    from codemap_spark.operators import listing

    events, feedback = listing.finish_plan(3, "q", {"useful": ["a", "a"], "read": ["a", "b"]}, spark.range(0))
    assert sorted((r.event, r.path) for r in events.collect()) == [("read", "a"), ("read", "b"), ("useful", "a")]
    assert [(r.path, r.rating) for r in feedback.collect()] == [("a", "useful")]
    with pytest.raises(ValueError):
        listing.finish_plan(3, "q", {"liked": ["a"]}, spark.range(0))
    tasks = spark.createDataFrame([(1, "open", None, "d"), (2, "done", "d0", "d")], "id long, status string, closed_at string, updated_at string")
    closed = listing.close_task(listing.close_task(tasks, 1, "d1"), 2, "d2").orderBy("id").collect()
    assert [(r.status, r.closed_at, r.updated_at) for r in closed] == [("done", "d1", "d1"), ("done", "d0", "d2")]


def _many_notes(spark):
    """150 notes; only the oldest one is about the widget."""
    notes = spark.range(1, 151).select("id", F.concat(F.lit("p/"), F.col("id") % 12).alias("path"), F.lit("file").alias("scope"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("topic"))
    return notes.withColumns({"note": F.when(F.col("id") == 1, "the widget").otherwise("nothing"), "created_at": F.col("id").cast("string"), "stale": F.col("id") % 3 == 0})


def test_a_search_sees_every_note(spark):
    assert [r.id for r in memory.search_notes(_many_notes(spark), "widget").collect()] == [1]


def test_topics_count_every_note(spark):
    rows = [tuple(r) for r in memory.topics(_many_notes(spark)).collect()]
    paths = lambda rest: sorted(f"p/{k}" for k in range(12) if k % 2 == rest)
    assert rows == [("even", 75, 6, 0, 25, 150, "150", paths(0), [150, 148, 146, 144, 142]), ("odd", 75, 6, 0, 25, 149, "149", paths(1), [149, 147, 145, 143, 141])]


def test_the_plan_scores_every_note():
    assert "LIMIT 100)" not in oracles.ORACLE_SQL["reading_plan_fusion"]


def test_plan_differences_take_one_grouping(spark):
    items = spark.createDataFrame([(1, "a", "read_now"), (1, "b", "read_if_needed"), (1, "", "read_now"), (None, "n", "read_now")], "plan_id long, path string, read_priority string")
    events = spark.createDataFrame([(1, "b", "opened"), (1, "c", "read"), (1, "c", "useful"), (2, "a", None), (None, "n", "read")], "plan_id long, path string, event string")
    found = memory.plan_diff(items, events)
    # null plans don't meet
    want = {(1, "a", "suggested_not_read"), (1, "a", "read_now_not_read"), (1, "b", "read_without_outcome"), (1, "c", "read_not_planned"), (None, "n", "suggested_not_read"), (None, "n", "read_now_not_read"), (None, "n", "read_not_planned"), (None, "n", "read_without_outcome")}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_relations_without_symbols_do_not_meet_in_one_task(spark):
    files = spark.createDataFrame([(1, "a.py")], "id long, path string")
    symbols = spark.createDataFrame([(5, "f", "function", 3), (6, "g", "class", 4)], "id long, name string, kind string, line int")
    rows = spark.range(4000).select("id", F.lit("file").alias("source_type"), (F.col("id") % 2).alias("source_id"), F.lit("r").alias("relation"), F.when(F.col("id") < 4, "symbol").otherwise("file").alias("target_type"))
    rows = rows.withColumns({"target_id": F.element_at(F.array(F.lit("5"), F.lit("x"), F.lit("9"), F.lit(None).cast("string")), (F.col("id") % 4 + 1).cast("int")), "confidence": F.lit(1.0), "metadata": F.lit("{}")})
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = store.export_relations(rows, files, symbols).withColumn("task", F.spark_partition_id())
        found = out.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(found) == 4000 and [(r.id, r.source_path, r.target_symbol, r.target_line) for r in found if r.target_symbol] == [(0, None, "f", 3)]
    assert {r.source_path for r in found if r.id % 2} == {"a.py"} and all(r.target_path == r.target_id for r in found if r.target_type == "file")
    tasks = [r.task for r in found]
    assert max(tasks.count(t) for t in set(tasks)) < 2000
