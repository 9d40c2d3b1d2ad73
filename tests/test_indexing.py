"""An index built, refreshed by what changed, and checked."""

import os

import pytest

from codemap_spark.operators import indexing, term_index
from codemap_spark.sources import line_rules, repository
from codemap_spark.streaming import refresh as stream

RULES = [
    line_rules.Rule("python", "symbol", "class", r"^class (\w+)"), line_rules.Rule("python", "symbol", "function", r"^\s*def (\w+)"), line_rules.Rule("python", "relation", "imports", r"^import (\w+)", "module", 0.9),
    line_rules.Rule("python", "relation", "calls", r"return (\w+)\(", "symbol_name", 0.45), line_rules.Rule("rust", "symbol", "function", r"fn (\w+)"), line_rules.Rule("markdown", "symbol", "heading", r"^# (.+)"),
]


def extract(files):
    return line_rules.extracted(files, RULES)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small tables, many jobs."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def scan(spark, folder, **settings):
    found = repository.scan(spark, str(folder), **settings)
    return spark.createDataFrame(found.collect(), found.schema)


def stored(spark, index):
    """The index as it is read again from where it has been written."""
    return {name: spark.createDataFrame(df.collect(), df.schema) for name, df in index.items()}


TERMS = ("term", "source", "document_count", "total_count")


def recounted(index):
    return rows(term_index.counts(term_index.source_documents(index["files"], index["symbols"])), *TERMS)


def test_build_and_refresh(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\n\nclass Store:\n    def load(self):\n        return helper()\n")
    (tmp_path / "src" / "b.py").write_text("def helper():\n    return 1\n")
    (tmp_path / "README.md").write_text("# Title\n")
    (tmp_path / "data.bin").write_bytes(b"\0\1")
    first = stored(spark, indexing.build(indexing.empty(spark), scan(spark, tmp_path), extract, at=("t1", "t2")))
    ids = {r.path: r.id for r in first["files"].collect()}
    assert sorted(ids) == ["README.md", "data.bin", "src/a.py", "src/b.py"] and sorted(ids.values()) == [1, 2, 3, 4]

    def of(index, table, path, *columns):
        key = "source_id" if table == "relations" else "file_id"
        return rows(index[table].join(index["files"].where(f"path = '{path}'").selectExpr(f"id {key}"), key), *columns)

    def unique(index, table):
        return index[table].select("id").distinct().count() == index[table].count()

    assert of(first, "symbols", "src/a.py", "name", "kind", "line") == [("Store", "class", 3), ("load", "function", 4)] and of(first, "symbols", "README.md", "name") == [("Title",)]
    assert ("calls", "symbol_name", "helper", 0.45, '{"line":5}') in of(first, "relations", "src/a.py", "relation", "target_type", "target_id", "confidence", "metadata")
    assert first["relations"].count() == 2 + 4 * 2 + 4 and unique(first, "relations") and unique(first, "symbols")
    tags = of(first, "file_tags", "src/a.py", "tag", "source", "weight")
    assert ("store", "symbol", 1.2) in tags and ("os", "relation_target", 1.0) not in tags and ("helper", "relation_target", 1.0) in tags and ("calls", "relation", 0.8) in tags

    (tmp_path / "src" / "b.py").write_text("def other():\n    return 2\n")
    (tmp_path / "README.md").unlink()
    (tmp_path / "c.rs").write_text("pub fn run() {}\n")
    second, changes = indexing.refresh(first, scan(spark, tmp_path), extract, at=("t3", "t4"))
    second = stored(spark, second)
    assert rows(changes, "path", "change") == [("README.md", "removed"), ("c.rs", "added"), ("data.bin", "unchanged"), ("src/a.py", "unchanged"), ("src/b.py", "updated")]
    now = {r.path: r.id for r in second["files"].collect()}
    assert sorted(now) == ["c.rs", "data.bin", "src/a.py", "src/b.py"] and all(now[p] == ids[p] for p in now if p in ids) and now["c.rs"] not in ids.values()
    assert [r.name for p in sorted(now) for r in second["symbols"].where(f"file_id = {now[p]}").orderBy("line").collect()] == ["run", "Store", "load", "other"]
    assert second["relations"].where(f"source_id = {ids['README.md']}").isEmpty() and second["file_tags"].where(f"file_id = {ids['README.md']}").isEmpty()
    assert unique(second, "relations") and unique(second, "symbols")
    assert recounted(second) == rows(second["terms"], *TERMS) and recounted(first) == rows(first["terms"], *TERMS) and recounted(first) != recounted(second)
    assert rows(second["runs"], "id", "command", "started_at", "finished_at", "status") == [(1, "map", "t1", "t2", "ok"), (2, "refresh", "t3", "t4", "ok")]
    assert rows(second["meta"], "key", "value") == [("index_version", indexing.VERSION), ("last_map", "t2"), ("last_refresh", "t4")]
    again, none = indexing.refresh(second, scan(spark, tmp_path), extract)
    assert {r.change for r in none.collect()} == {"unchanged"} and rows(again["symbols"], "file_id", "name") == rows(second["symbols"], "file_id", "name")

    os.utime(tmp_path / "c.rs", (2_000_000_000, 2_000_000_000))
    assert rows(indexing.outdated(first, scan(spark, tmp_path), "2030-01-01T00:00:00+00:00"), "path", "issue") == [("README.md", "missing_on_disk"), ("c.rs", "modified_after_map"), ("c.rs", "not_indexed")]


def test_refresh_needs_an_index(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    scanned = scan(spark, tmp_path)
    with pytest.raises(ValueError, match="no files"):
        indexing.refresh(indexing.empty(spark), scanned, extract)
    built = indexing.build(indexing.empty(spark), scanned, extract)
    with pytest.raises(ValueError, match="other rules"):
        indexing.refresh(built | {"meta": spark.createDataFrame([("index_version", "1")], "key string, value string")}, scanned, extract)


def without_ids(index):
    """What an index holds, with paths and names in place of ids."""
    files = {r.id: r.path for r in index["files"].collect()}
    symbols = {r.id: (files[r.file_id], r.name, r.kind, r.line, r.signature) for r in index["symbols"].collect()}
    relations = sorted(str((files[r.source_id], r.relation, r.target_type, symbols[int(r.target_id)] if r.target_type == "symbol" else r.target_id, r.confidence, r.metadata)) for r in index["relations"].collect())
    tags = sorted((files[r.file_id], r.tag, r.source, r.weight) for r in index["file_tags"].collect())
    return sorted(files.values()), sorted(map(str, symbols.values())), relations, tags, rows(index["terms"], *TERMS), rows(index["term_sizes"], "source", "n")


def test_index_in_buckets(spark, tmp_path):
    code, kept = tmp_path / "code", indexing.IndexStore(spark, f"file://{tmp_path}/index", buckets=32, keep=2)
    code.mkdir()
    for k in range(8):
        (code / f"m{k}.py").write_text(f"import os\nclass Part{k}:\n    def run{k}(self):\n        return help{k}()\n")
    assert kept.change(scan(spark, code), extract, command="map", at=("t1", "t2")) == 1
    assert without_ids(kept.index()) == without_ids(stored(spark, indexing.build(indexing.empty(spark), scan(spark, code), extract)))
    first = kept.manifest()
    ids = {r.path: r.id for r in kept.read("files").collect()}

    (code / "m3.py").write_text("class Other:\n    pass\n")
    (code / "n.md").write_text("# New page\n")
    assert kept.change(scan(spark, code), extract, at=("t3", "t4")) == 2
    second = kept.manifest()
    moved = {t: sum(first["tables"][t].get(b) != f for b, f in second["tables"][t].items()) for t in second["tables"]}
    # one file altered and one new: two buckets of 32 at most hold them, and only those were written again
    assert all(1 <= moved[t] <= 2 for t in ("files", "symbols", "relations", "file_tags")), moved
    assert len(first["tables"]["files"]) > 4 and moved["terms"] < len(second["tables"]["terms"])
    now = {r.path: r.id for r in kept.read("files").collect()}
    assert all(now[p] == i for p, i in ids.items()) and now["n.md"] == 9
    (code / "m5.py").unlink()
    assert kept.change(scan(spark, code), extract, spark.createDataFrame([("m5.py",)], "path string")) == 3
    assert without_ids(kept.index()) == without_ids(stored(spark, indexing.build(indexing.empty(spark), scan(spark, code), extract)))
    assert rows(kept.term_stats(), "term", "weight") == rows(term_index.weighed(kept.read("terms"), kept.read("term_sizes")), "term", "weight")
    assert rows(kept.read("runs"), "id", "command", "finished_at") == [(1, "map", "t2"), (2, "refresh", "t4")]
    # the older versions are as they were, and a change without effect makes none
    assert kept.versions() == [1, 2, 3] and {r.path for r in kept.read("files", 1).collect()} == set(ids)
    assert kept.change(scan(spark, code), extract) == 3
    assert kept.change(scan(spark, code), extract, spark.createDataFrame([("n.md",)], "path string")) == 3  # scanned, so it stays
    (code / "n.md").unlink()
    assert kept.change(scan(spark, code), extract, spark.createDataFrame([("n.md",)], "path string")) == 4
    assert kept.versions() == [2, 3, 4]
    with pytest.raises(ValueError, match="isn't kept"):
        kept.read("files", 1)


def test_broken_change_leaves_the_version(spark, tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.py").write_text("class A:\n    pass\n")
    kept = indexing.IndexStore(spark, f"file://{tmp_path}/index", buckets=8)
    kept.change(scan(spark, tmp_path / "code"), extract)
    before = without_ids(kept.index())
    more = spark.createDataFrame([(7, "b.py")], "id long, path string")

    def broken(rows):
        return rows.unionByName(more.withColumn("role", indexing.F.expr("CAST(raise_error('lost') AS STRING)")), allowMissingColumns=True)

    with pytest.raises(Exception, match="lost"):
        kept.commit([indexing.Change("term_sizes", spark.createDataFrame([("path",)], "source string"), lambda rows: rows.limit(0)), indexing.Change("files", more, broken)])
    with pytest.raises(ValueError, match="outside the touched"):
        kept.commit([indexing.Change("files", more, lambda rows: spark.createDataFrame([(i, f"x{i}") for i in range(40)], "id long, path string").select("*", *[indexing.F.lit(None).alias(c) for c in rows.columns[2:]]))])
    assert kept.versions() == [1] and without_ids(kept.index()) == before


def test_refresh_as_a_stream(spark, tmp_path):
    code, inbox, kept = tmp_path / "code", tmp_path / "inbox", indexing.IndexStore(spark, f"file://{tmp_path}/index", buckets=8)
    code.mkdir()
    gone = indexing.F.lit(None).cast("string")

    def arrive(df):
        df.coalesce(1).write.mode("append").parquet(str(inbox))
        stream.start(spark.readStream.schema(df.schema).parquet(str(inbox)), kept, extract, f"file://{tmp_path}/checkpoint", available_now=True).awaitTermination()

    for k in range(3):
        (code / f"m{k}.py").write_text(f"class Part{k}:\n    pass\n")
    arrive(scan(spark, code))
    (code / "m1.py").write_text("class Late:\n    pass\n")
    late = scan(spark, code).where("path = 'm1.py'").withColumn("modified", indexing.F.lit("2031-01-01"))
    removed = scan(spark, code).where("path = 'm2.py'").withColumns({"modified": indexing.F.lit("2031-01-01"), "sha256": gone, "content": gone})
    arrive(late.unionByName(removed).unionByName(late.withColumns({"modified": indexing.F.lit("2030-01-01"), "sha256": indexing.F.lit("older")})))
    (code / "m2.py").unlink()
    after = without_ids(kept.index())
    assert after == without_ids(stored(spark, indexing.build(indexing.empty(spark), scan(spark, code), extract)))
    version = kept.manifest()["version"]
    # the same batch again, as after a failure between its commit and the stream's own
    assert stream.apply_batch(kept, extract, "refresh", late.withColumn("sha256", indexing.F.lit("again")), 1) == version and without_ids(kept.index()) == after
    assert stream.apply_batch(kept, extract, "other", late.withColumn("sha256", indexing.F.lit("again")), 1) == version + 1


def test_ignore_settings(spark, tmp_path):
    for name in ("a.py", "skip/b.py", ".tools/c.py", ".other/d.py", "e.foo", "f.py", "node_modules/g.py", "x.egg-info/h.py", ".github/i.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    settings = repository.ignore_rules('{"exclude_dirs": ["skip", ""], "exclude_files": ["f.py"], "exclude_extensions": ["foo"], "include_hidden_dirs": [".tools", ".github"]}')
    assert rows(scan(spark, tmp_path, rules=settings), "path") == [(".tools/c.py",), ("a.py",)]
    assert rows(scan(spark, tmp_path), "path") == [("a.py",), ("e.foo",), ("f.py",), ("skip/b.py",)]
    assert repository.ignore_rules("{broken") == repository.ignore_rules(None) == repository.ignore_rules("[1]") == repository.IgnoreRules()
