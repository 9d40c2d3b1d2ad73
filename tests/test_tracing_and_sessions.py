"""Edges, traces, tasks and sessions on small projects worked out by hand."""

import collections
import random

import pytest

from codemap_spark.operators import sessions, tracing


def test_edges_and_trace(spark):
    paths = ["web/index.php", "web/lib/db.php", "lib/db.php", "app/main.py", "app/core/util.py", "app/core/__init__.py", "src/tool.py", "app/side.ts", "app/views/index.tsx", "shop/templates/shop/item.html", "x/templates/deep/page.html", "app/show.py"]
    files = spark.createDataFrame([(i, p, "source", f"text of {p} widget") for i, p in enumerate(paths, 1)], "id long, path string, role string, content string")
    symbols = spark.createDataFrame([(1, 5, "Helper"), (2, 2, "helper"), (3, 12, "show")], "id long, file_id long, name string")
    rows = [
        (1, "include", "file", "lib/db.php", 0.8), (1, "require_once", "file", "/lib/db.php", 0.8), (1, "include", "file", "other/db.php", 0.8), (1, "include", "file", "none.php", 0.8), (1, "calls", "symbol_name", "HELPER", 0.45),
        (4, "imports", "module", "app.core.util", 0.75), (4, "imports", "module", "app.core", 0.75), (4, "imports", "module", "tool", 0.65), (4, "imports", "module", "os", 0.65), (4, "route_to_handler", "symbol_name", "show", 0.8),
        (8, "imports", "module", "./views", 0.75), (9, "imports", "module", "../side", 0.75), (12, "renders_template", "template", "shop/item.html", 0.7), (12, "renders_template", "template", "deep/page.html", 0.7),
        (5, "calls", "symbol_name", "helper", 0.45), (4, "has_role", "role", "source", 1.0),
    ]
    relations = spark.createDataFrame([(i, "file", *r) for i, r in enumerate(rows)], "id long, source_type string, source_id long, relation string, target_type string, target_id string, confidence double")
    found = {(r.source, r.target, r.relation, r.target_id) for r in tracing.resolved_edges(relations, files, symbols).collect()}
    assert found == {
        (1, 3, "include", "lib/db.php"), (1, 3, "require_once", "/lib/db.php"), (1, 5, "calls", "HELPER"), (1, 2, "calls", "HELPER"),
        (4, 5, "imports", "app.core.util"), (4, 6, "imports", "app.core"), (4, 7, "imports", "tool"), (4, 12, "route_to_handler", "show"),
        (8, 9, "imports", "./views"), (9, 8, "imports", "../side"), (12, 10, "renders_template", "shop/item.html"), (12, 11, "renders_template", "deep/page.html"), (5, 2, "calls", "helper"),
    }
    strong = {(r.source, r.target): (r.place, r.relation) for r in tracing.strongest(tracing.resolved_edges(relations, files, symbols)).collect()}
    assert strong[1, 3] == (1, "include") and strong[1, 2][1] == "calls" and strong[4, 5] == (1, "imports") and strong[4, 12] == (4, "route_to_handler")
    starts = spark.createDataFrame([(4, "app/main.py", 1)], "id long, path string, place int")
    rows = tracing.trace(tracing.resolved_edges(relations, files, symbols), files, starts, ["page", "widget"], max_depth=4).collect()
    # page is in the path (4) and the text (2), widget in the text (2), three steps away 3 - 2 x 0.35, markup by the path's text 2
    first = rows[0]
    assert (first.target, first.distance, first.trail) == ("x/templates/deep/page.html", 2, "app/main.py > app/show.py > x/templates/deep/page.html")
    assert [tuple(e) for e in first.edges] == [("app/main.py", "app/show.py", "route_to_handler", 0.8, "followed route_to_handler relation to show"), ("app/show.py", "x/templates/deep/page.html", "renders_template", 0.7, "followed renders_template relation to deep/page.html")]
    assert first.start_reason == "main.py selected as likely entrypoint/start file" and first.why_this_path == "x/templates/deep/page.html is reachable through route_to_handler -> renders_template; reachable from start at distance 2"
    assert first.reasons == ["reachable from start at distance 2", 'path contains "page"', 'content contains "page"', 'content contains "widget"', "emits HTML/render markup"]
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and len({r.target for r in rows}) == len(rows)
    assert {r.target for r in rows} == {"app/main.py", "app/core/util.py", "app/core/__init__.py", "src/tool.py", "app/show.py", "web/lib/db.php", "shop/templates/shop/item.html", "x/templates/deep/page.html"}


def test_best_paths_equal_the_enumeration(spark):
    """Against every simple path, searched breadth-first as a plain queue, on graphs with equal weights, double edges and circles."""
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(i, rng.randrange(14), rng.randrange(14), rng.choice(["include", "imports", "calls"]), "x", rng.choice([0.0, 0.5, 0.75, None])) for i in range(60)]
        edges = spark.createDataFrame([r for r in rows if r[1] != r[2]], "id long, source long, target long, relation string, target_id string, confidence double")
        base = {"include": 4.0, "imports": 2.0, "calls": 1.0}
        out = {}
        for i, a, b, relation, _, sure in sorted((r for r in rows if r[1] != r[2]), key=lambda r: (-(base[r[3]] + (r[5] or 0.0)), r[0], r[2])):
            out.setdefault(a, []).append((b, relation))
        out = {a: e[:3] for a, e in out.items()}
        want = {}
        for start in (0, 5):
            queue = collections.deque([[start]])
            while queue:
                path = queue.popleft()
                want.setdefault((start, path[-1]), path)
                if len(path) <= 4:
                    queue.extend([*path, b] for b, _ in out.get(path[-1], []) if b not in path)
        found = {(r.start, r.target): [r.start, *[e.target for e in r.edges]] for r in tracing.best_paths(edges, spark.createDataFrame([(0,), (5,)], "node long"), 4, 3).collect()}
        assert found == want


def test_start_that_others_reach(spark):
    """A start stands at its own place, with the path that has edges; a file that scores nothing is left out."""
    files = spark.createDataFrame([(1, "a.py", "source", "word"), (2, "b.py", "source", "word word"), (3, "c.css", "asset", "")], "id long, path string, role string, content string")
    edges = spark.createDataFrame([(1, 1, 2, "include", "b.py", 0.5), (2, 1, 3, "include", "c.css", 0.5)], "id long, source long, target long, relation string, target_id string, confidence double")
    starts = spark.createDataFrame([(2, 1), (1, 2)], "id long, place int")
    rows = tracing.trace(edges, files, starts, ["word"]).collect()
    assert [(r.rank, r.target, r.distance, r.score, r.trail) for r in rows] == [(1, "b.py", 1, 4.65, "a.py > b.py"), (2, "a.py", 0, 5.0, "a.py")]
    assert rows[1].why_this_path == "a.py is a start file; reachable from start at distance 0" and rows[1].edges == []
    assert tracing.trace(edges, files, starts.limit(0), ["word"]).count() == 0


def test_include_beside_the_file(spark):
    files = spark.createDataFrame([(1, "a/b/c.php"), (2, "a/b/d/e.php"), (3, "a/b/f.php")], "id long, path string")
    symbols = spark.createDataFrame([], "id long, file_id long, name string")
    relations = spark.createDataFrame([(1, "file", 1, "include", "file", "d/e.php", 0.8), (2, "file", 1, "require", "file", "gone/f.php", 0.8)], "id long, source_type string, source_id long, relation string, target_type string, target_id string, confidence double")
    assert {(r.target, r.target_id) for r in tracing.resolved_edges(relations, files, symbols).collect()} == {(2, "d/e.php"), (3, "gone/f.php")}


def test_tasks(spark):
    none = spark.createDataFrame([], sessions.TASK_SCHEMA)
    tasks = sessions.add_task(sessions.add_task(none, " one ", "t1", files=["./a.py", " "]), "two", "t2", status="Done")
    assert [(r.id, r.title, r.status, r.files, r.closed_at) for r in tasks.orderBy("id").collect()] == [(1, "one", "open", ["a.py"], None), (2, "two", "done", [], "t2")]
    tasks = sessions.update_task(tasks, 1, "t3", status="done", files=["a.py", "b.py"], tests=["x", "x", ""])
    tasks, notes = sessions.add_task_note(tasks, spark.createDataFrame([], sessions.NOTE_SCHEMA), 1, " said ", "t4", files=["c.py"])
    tasks = sessions.update_task(tasks, 1, "t5", status="done")
    one = tasks.where("id = 1").first()
    assert (one.files, one.tests, one.closed_at, one.updated_at) == (["a.py", "b.py", "c.py"], ["x"], "t3", "t5")
    assert [(r.id, r.task_id, r.note) for r in notes.collect()] == [(1, 1, "said")]
    assert sessions.add_task_note(tasks, notes, 9, "lost", "t6")[1].count() == 1
    for wrong in (lambda: sessions.add_task(none, " ", "t"), lambda: sessions.update_task(tasks, 1, "t", status="later"), lambda: sessions.add_task_note(tasks, notes, 1, " ", "t")):
        with pytest.raises(ValueError):
            wrong()


def test_end_of_session(spark):
    notes = spark.createDataFrame(
        [(1, "a.py", "file", "t", "only four short words", True, "read"), (2, "b.py", "file", "t", "many useful different words stand right here", False, "read"), (3, "", "repo", "", "other useful different words stand right here", None, "read")],
        "id long, path string, scope string, topic string, note string, stale boolean, evidence string",
    )
    feedback = spark.createDataFrame([(1, "a.py", "useful")], "id long, path string, rating string")
    tasks = sessions.add_task(spark.createDataFrame([], sessions.TASK_SCHEMA), "one", "t1")
    plans = spark.createDataFrame([(1, True), (2, False)], "id long, finished boolean")
    events = spark.createDataFrame([(1, 1, "useful", "a.py"), (2, 1, "noisy", "b.py")], "id long, plan_id long, event string, path string")
    rows = {r.id: (r.status, r.amount) for r in sessions.close_checklist(notes, tasks, plans, [" M x"]).collect()}
    assert rows["review_git_status"] == ("needed", 1) and rows["refresh_stale_memory"] == ("needed", 1) and rows["audit_memory_quality"] == ("needed", 2)
    assert rows["review_open_tasks"] == ("needed", 1) and rows["finish_reading_plans"] == ("optional", 1) and rows["close_ready"] == ("no", 0)
    clean = sessions.close_checklist(notes.where("id = 2"), tasks.where("id = 0"), plans).collect()
    assert {r.id: r.status for r in clean}["close_ready"] == "yes"
    assert [(r.section, r.id, r.text) for r in sessions.summary(notes, feedback, tasks, plans, [" M x"], 2).orderBy("section", "position").collect()] == [
        ("audit", None, "duplicate_file_topic: 0"), ("audit", None, "missing_topic: 1"), ("audit", None, "short_note: 1"), ("audit", None, "stale: 1"), ("audit", None, "unknown_evidence: 0"), ("feedback", 1, "useful a.py"), ("git", None, " M x"), ("memory", 3, ": "), ("memory", 2, "b.py: t"), ("plan", 2, "unfinished"), ("plan", 1, "finished"), ("task", 1, "one"),
    ]
    assert [(r.kind, r.position, r.command.split(" --")[1]) for r in sessions.suggestions(notes, plans, events).collect()] == [("finish_plan", 1, "id 2"), ("memory_for_useful_file", 1, 'path "a.py"'), ("refresh_stale_memory", 2, "id 1")]


def _circles(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(30), rng.randrange(30), "include", "x", rng.choice([0.0, 0.5])) for i in range(90)]
    return spark.createDataFrame([r for r in rows if r[1] != r[2]], "id long, source long, target long, relation string, target_id string, confidence double"), spark.createDataFrame([(7,), (0,), (5,)], "node long")


def test_first_paths_are_the_least_of_all_starts(spark):
    for seed in range(2):
        edges, starts = _circles(spark, seed)
        want = {}
        for r in tracing.best_paths(edges, starts, 4, 3).collect():
            want[r.target] = min(want.get(r.target, (9,)), (r.hops, r.start, r.order, [e.target for e in r.edges]))
        strong = tracing.strongest(edges, 3).cache()
        assert {r.target: (r.hops, r.start, r.ids) for r in tracing.first_paths(strong, starts).collect()} == {t: (h, s, ids) for t, (h, s, _, ids) in want.items()}


def test_labels_hold_numbers_only_and_name_the_edges_taken(spark):
    edges, starts = _circles(spark, 3)
    strong = tracing.strongest(edges, 3).cache()
    place = {(r.source, r.target): r.place for r in strong.collect()}
    labels = tracing.path_labels(strong, starts, 4, 3)
    assert "string" not in labels.schema.simpleString()
    rows = labels.collect()
    assert max(r.hops for r in rows) == 4 and len({(r.start, r.target) for r in rows}) == len(rows)
    for r in rows:
        way = [r.start, *r.ids]
        assert way[-1] == r.target and len(r.ids) == r.hops and r.order == [place[e] for e in zip(way, way[1:])]
    with pytest.raises(ValueError):
        tracing.path_labels(strong, starts, 6, 5000)
