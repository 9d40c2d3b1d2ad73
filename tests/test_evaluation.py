"""Retrieval cases by hand."""

import csv
import glob
import json

import pytest

from codemap_spark.operators import evaluation, stats


def test_cases_and_report(spark, tmp_path):
    manifest = tmp_path / "cases.json"
    manifest.write_text(json.dumps([{"name": "a", "query": "login session", "expected_files": ["x/session.py", "gone.py"], "noise_patterns": ["/docs/"]}, {"name": "b", "query": "nothing", "expected_files": ["y.py"]}]))
    cases = evaluation.load_cases(spark, str(manifest))
    assert evaluation.load_cases(spark, str(manifest), ["b"]).count() == 1
    with pytest.raises(ValueError, match="unknown cases: c"):
        evaluation.load_cases(spark, str(manifest), ["a", "c"])
    ranked = spark.createDataFrame([("a", "x/login_session.py", 1), ("a", "x/docs/login.md", 2), ("a", "x/session.py", 3)], "name string, path string, rank int")
    rows = {r.name: r for r in evaluation.evaluate(cases, ranked, 4).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.top1_hit, a.top3_hit, a.top5_hit, a.expected_count, a.expected_hit_count, a.missing_expected_count, a.noise_hit_count, a.candidate_file_count) == (False, True, True, 2, 1, 1, 1, 3)
    assert a.expected_file_ranks == "x/session.py=3; gone.py=missing" and a.missing_expected_files == "gone.py" and a.manual_scan_reduction_percent == 25.0
    assert (b.top5_hit, b.candidate_file_count, b.expected_file_ranks) == (False, 0, "y.py=missing")
    results = evaluation.evaluate(cases, ranked, 4)
    evaluation.write_report(results, str(tmp_path / "report"))
    (name,) = glob.glob(str(tmp_path / "report" / "*.csv"))
    with open(name, newline="") as f:
        report = list(csv.DictReader(f))
    assert tuple(report[0]) == evaluation.REPORT and report[0]["top3_hit"] == "true" and report[1]["top1_hit"] == "false" and report[0]["elapsed_seconds"] == ""
    evaluation.write_report(results, str(tmp_path / "json"), "json")
    (name,) = glob.glob(str(tmp_path / "json" / "*.json"))
    with open(name) as f:
        listed = [json.loads(line) for line in f]
    assert [r["name"] for r in listed] == ["a", "b"] and listed[0]["top3_hit"] is True and listed[0]["expected_file_ranks"] == "x/session.py=3; gone.py=missing"
    evaluation.write_report(results, str(tmp_path / "md"), "markdown")
    (name,) = glob.glob(str(tmp_path / "md" / "*.txt"))
    with open(name) as f:
        lines = f.read().splitlines()
    assert lines[0].startswith("| name | status | top1_hit |") and lines[1].startswith("| --- |") and lines[2].startswith("| a | ok | false | true |") and len(lines) == 4
    with pytest.raises(ValueError, match="form"):
        evaluation.write_report(results, str(tmp_path / "x"), "html")
    from pyspark.sql import functions as F

    summary = stats.benchmark_summary(results.withColumns({"elapsed_seconds": F.lit(1.0), "manual_scan_elapsed_seconds": F.lit(None).cast("double")})).first().asDict()
    assert evaluation.gate_failures(summary) == ["top3_rate 0.5 < 0.85", "top5_rate 0.5 < 1.0"]


def test_assertions_and_plans(spark):
    from codemap_spark.functions import text as T
    from codemap_spark.operators import listing

    files = spark.createDataFrame([(1, "src/a.py")], "id long, path string")
    relations = spark.createDataFrame([("file", 1, "imports", "pkg.core")], "source_type string, source_id long, relation string, target_id string")
    wanted = spark.createDataFrame([("one", "a.py", "imports", "core"), ("two", "a.py", "calls", "core"), ("three", "b.py", "imports", "core")], "name string, source string, relation string, target string")
    results = evaluation.edge_assertions(relations, files, wanted)
    assert {r.name: r.passed for r in results.collect()} == {"one": True, "two": False, "three": False}
    assert tuple(evaluation.assertion_summary(results).first()) == (1, 3, 0.333, "three, two")
    plans = spark.createDataFrame([(4, "old", 3, "t", True)], "id long, query string, read_budget int, created_at string, finished boolean")
    items = spark.createDataFrame([], "plan_id long, rank int, path string, read_priority string")
    ranked = spark.createDataFrame([(1, "a.py", "read_now", 2.0), (2, "b.py", "read_if_needed", 1.0)], "rank int, path string, read_priority string, score double")
    plans, items = listing.save_plan(plans, items, ranked, "q", "t2", 99)
    assert [tuple(r) for r in plans.orderBy("id").collect()][1] == (5, "q", 10, "t2", False) and [tuple(r) for r in items.orderBy("rank").collect()] == [(5, 1, "a.py", "read_now"), (5, 2, "b.py", "read_if_needed")]
    events = listing.record_reads(spark.createDataFrame([], "plan_id long, event string, path string"), 5, ["a.py", "a.py", ""])
    assert [tuple(r) for r in events.collect()] == [(5, "opened", "a.py")]
    assert listing.missing_tables(["files"], ["files", "symbols"]) == ["symbols"]
    scopes = spark.createDataFrame([(None,), ("",), ("repo",)], "scope string").select(T.scope_of(files_scope()).alias("s"))
    assert [r.s for r in scopes.collect()] == ["file", "file", "repo"]


def files_scope():
    from pyspark.sql import functions as F

    return F.col("scope")
