import math
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codemap_spark.functions import text as T
from codemap_spark.operators import memory
from codemap_spark.sources import line_rules, repository


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_terms(spark):
    assert one(spark, T.query_tokens(F.col("q")), q="MCPServer startup graph_search chatIntentRouter") == ["mcp", "server", "startup", "graph", "search", "chat", "intent", "router"]
    assert one(spark, T.identifier_terms(F.col("q")), q="HTTP2Server") == ["2", "server"]


def test_roles_and_languages(spark):
    cases = {"a/docs/x.toml": "config", "docs/a.py": "source", "a/docs/b.py": "documentation", "tests/a.py": "test", "a/b_test.go": "test", "x/migrations/1.sql": "migration", "web/route.py": "route", "a/views/b.py": "view", "a.png": "asset", "x": "unknown"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", T.role_of(F.col("p")).alias("r"), T.language_of(F.col("p")).alias("l")).collect()
    assert {r.p: r.r for r in rows} == cases
    assert {r.p: r.l for r in rows}["a/b_test.go"] == "go"


def test_small_formulas(spark):
    assert [one(spark, T.estimated_tokens(F.lit(n)), a=1) for n in (0, 1, 4, 5)] == [0, 1, 1, 2]
    assert one(spark, T.reduction_percent(F.lit(100), F.lit(10)), a=1) == 90.0
    assert one(spark, T.reduction_percent(F.lit(0), F.lit(10)), a=1) is None
    assert one(spark, T.normal_path(F.col("p")), p="../a//b/./c") == "a/b/c"


def test_feedback_contribution(spark):
    rows = spark.createDataFrame([("a", "useful", "user", "red widget"), ("b", "missing", "agent", "red widget"), ("c", "noisy", "user", "red widget")], "path string, rating string, source string, query string")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    found = {r.path: (r.boost, r.penalty) for r in memory.feedback_signals(rows, files, "red widget").collect()}
    assert found["a"] == (12.0, 0.0) and found["b"] == (8.0, 0.0) and round(found["c"][1], 6) == -3.6


@settings(max_examples=40, deadline=None)
@given(st.text("abAB19_ é.", max_size=12))
def test_tokenizer_against_re(text):
    """The RE2-safe form that the oracles use agrees with the look-ahead form."""
    want = [m.lower() for run in re.findall("[A-Za-z0-9]+", text.replace("_", " ")) for m in re.findall(r"[A-Z]+(?=[A-Z][a-z]|\b)|[A-Z]?[a-z]+|[0-9]+", run, re.A)]
    cut = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("[A-Z]+([0-9])", r" \1", text.replace("_", " ")))
    assert [m.lower() for m in re.findall("[A-Z]?[a-z]+|[A-Z]+|[0-9]+", cut)] == want


def test_rules_over_lines(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\nclass A:\n    def b(self):\n        return helper(one(1))\n")
    (tmp_path / "r.md").write_text("# Title\r\ntext\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "n.py").write_text("import no")
    (tmp_path / "b.bin").write_bytes(b"\0")
    rules = [line_rules.Rule("python", "relation", "imports", r"^import (\w+)", "module", 0.9), line_rules.Rule("python", "symbol", "class", r"^class (\w+)"), line_rules.Rule("python", "relation", "calls", r"(\w+)\((?!self)", "symbol_name", 0.5), line_rules.Rule("markdown", "symbol", "heading", r"^# (.+)$")]
    rows = {(r.path, r.kind, r["name"], r.line, r.signature) for r in line_rules.extracted(repository.scan(spark, str(tmp_path)), rules).collect()}
    assert rows == {("a.py", "imports", "os", 1, None), ("a.py", "class", "A", 2, "class A:"), ("a.py", "calls", "helper", 4, None), ("a.py", "calls", "one", 4, None), ("r.md", "heading", "Title", 1, "# Title")}


def test_stream_counts_like_the_batch(spark, tmp_path):
    from codemap_spark.plans import catalog
    from codemap_spark.streaming import events

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "log"))
    q = events.daily_activity(events.read_events(spark, str(tmp_path / "log"), source.schema)).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, catalog.session_events(spark, "/root/testdata/sf0.001").collect()))


def test_round_like_the_language(spark):
    """Random values, values next to and in the middle, and ones without a fraction."""
    rng = np.random.default_rng(4)
    values = np.concatenate([
        rng.normal(0, 10 ** rng.uniform(-4, 8, 60_000)), np.round(rng.uniform(-100, 100, 20_000), 3) + 0.0005, rng.integers(-4000, 4000, 20_000) / 8, rng.integers(-4000, 4000, 20_000) / 1000 + 0.0005,
        np.nextafter(rng.integers(-4000, 4000, 10_000) / 16, 1e9), [0.0, -0.0, 2.675, 1.005, 0.5, 1.5, 2.5, 1e300, -1e17, 4503599627370495.5, 5e-324],
    ])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    for places in (0, 1, 2, 3, 4):
        rows = df.select("v", T.round_even(F.col("v"), places).alias("r")).collect()
        wrong = [(r.v, r.r, round(r.v, places)) for r in rows if r.r != round(r.v, places)]
        assert not wrong, wrong[:5]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double").select(T.round_even(F.col("v"), 2).alias("r")).collect()
    assert odd[0].r is None and math.isnan(odd[1].r) and odd[2].r == math.inf
    with pytest.raises(ValueError, match="places"):
        T.round_even(F.col("v"), 23)
