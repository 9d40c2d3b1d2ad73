"""Retrieval cases and their evaluation (SRC11, EV1, SNK14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T

CASE_SCHEMA = "name string, repo string, query string, expected_files array<string>, noise_patterns array<string>"
#: Columns of a CSV report, in order.
REPORT = (
    "name", "status", "top1_hit", "top3_hit", "top5_hit", "expected_count", "expected_hit_count", "missing_expected_count", "noise_hit_count", "candidate_file_count", "elapsed_seconds",
    "manual_scan_file_count", "manual_scan_reduction_percent", "expected_file_ranks", "missing_expected_files",
)


def load_cases(spark: SparkSession, path: str, names: Sequence[str] = ()) -> DataFrame:
    """SRC11: the cases of a JSON manifest, those of the names if any are given;
    an unknown name is an error."""
    cases = spark.read.schema(CASE_SCHEMA).option("multiLine", True).json(path)
    if not names:
        return cases
    known = {r.name for r in cases.where(F.col("name").isin(list(names))).select("name").collect()}  # as many as were asked for
    if set(names) - known:
        raise ValueError(f"unknown cases: {', '.join(sorted(set(names) - known))}")
    return cases.where(F.col("name").isin(list(names)))


def evaluate(cases: DataFrame, ranked: DataFrame, file_count: int | None = None) -> DataFrame:
    """EV1: one row per case (name, expected_files, noise_patterns) over ranked
    paths (name, path, rank): hits of any expected file among the first 1, 3
    and 5, the rank of each, those missing, and candidates that hold a noise
    pattern.  A case without candidates has none."""
    listed = ranked.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("c"))
    empty = F.array().cast("array<string>")
    rows = cases.select("name", F.array_distinct(F.coalesce("expected_files", empty)).alias("expected"), F.coalesce("noise_patterns", empty).alias("noise")).join(listed, "name", "left")
    rows = rows.withColumn("paths", F.coalesce(F.col("c.path"), empty))
    at = lambda p: F.array_position("paths", p)
    hits = [F.arrays_overlap(F.slice("paths", 1, k), F.col("expected")).alias(f"top{k}_hit") for k in (1, 3, 5)]
    missing = F.array_except("expected", "paths")
    noisy = F.filter("paths", lambda p: F.exists("noise", lambda x: F.contains(p, x)))
    total = F.lit(file_count).cast("bigint")
    return rows.select(
        "name", F.lit("ok").alias("status"), *hits, F.size("expected").alias("expected_count"), (F.size("expected") - F.size(missing)).alias("expected_hit_count"), F.size(missing).alias("missing_expected_count"),
        F.size(noisy).alias("noise_hit_count"), F.size("paths").alias("candidate_file_count"), total.alias("manual_scan_file_count"), T.reduction_percent(total, F.size("paths")).alias("manual_scan_reduction_percent"),
        F.array_join(F.transform("expected", lambda p: F.concat(p, F.lit("="), F.when(at(p) > 0, at(p).cast("string")).otherwise("missing"))), "; ").alias("expected_file_ranks"),
        F.array_join(missing, "; ").alias("missing_expected_files"),
    )


def report_rows(results: DataFrame) -> DataFrame:
    """SNK14: the columns of a CSV report as texts; truth values as true and
    false, what is unknown empty."""
    have = set(results.columns)
    return results.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in REPORT])


def write_report(results: DataFrame, path: str, form: str = "csv") -> None:
    """SNK14: one file, ordered by name: CSV with a header, one JSON object a
    line (values keep their types), or a Markdown table."""
    rows = results if form == "json" else report_rows(results)
    writer = rows.orderBy("name").coalesce(1).write.mode("overwrite")  # a row per case
    if form == "csv":
        writer.option("header", True).option("emptyValue", "").csv(path)
    elif form == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif form == "markdown":
        cells = [F.replace(F.col(c), F.lit("|"), F.lit("\\|")) for c in REPORT]
        lines = rows.select(F.col("name").alias("key"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
        head = [(0, "| " + " | ".join(REPORT) + " |"), (1, "|" + " --- |" * len(REPORT))]
        top = rows.sparkSession.createDataFrame(head, "part int, value string").withColumn("key", F.lit(""))
        every = top.unionByName(lines.withColumn("part", F.lit(2)))
        every.orderBy("part", "key").coalesce(1).select("value").write.mode("overwrite").text(path)
    else:
        raise ValueError("the form of a report is csv, json or markdown")


def gate_failures(summary: dict, least_top3: float = 0.85, least_top5: float = 1.0, most_noise: int = 2) -> list[str]:
    """EV1: which quality gates a summary (AGG12) fails."""
    failed = [f"{k} {summary[k]} < {least}" for k, least in (("top3_rate", least_top3), ("top5_rate", least_top5)) if (summary[k] or 0) < least]
    return failed + ([f"noise_hits {summary['noise_hits']} > {most_noise}"] if summary["noise_hits"] > most_noise else [])


def edge_assertions(relations: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """XP2: name, passed: whether a file whose path ends with ``source`` has
    the relation to a target that ends with ``target``."""
    rows = wanted.select("name", "source", "relation", "target")
    edges = relations.where("source_type = 'file'").join(files.select(F.col("id").alias("source_id"), "path"), "source_id").select("path", F.col("relation").alias("kind"), "target_id").distinct()
    few = F.broadcast(rows)  # the assertions of a case
    held = edges.join(few, (F.col("kind") == F.col("relation")) & F.endswith("path", "source") & F.endswith("target_id", "target"), "inner").select("name").distinct()
    return rows.select("name").join(held.withColumn("passed", F.lit(True)), "name", "left").select("name", F.coalesce("passed", F.lit(False)).alias("passed"))


def assertion_summary(results: DataFrame) -> DataFrame:
    """AGG15: passed, total, pass_rate, failed (names in order) in one row."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name")))), ", ")
    total = F.count("*")
    return results.agg(F.count_if("passed").alias("passed"), total.alias("total"), F.when(total > 0, F.round(F.count_if("passed") / total, 3)).alias("pass_rate"), failed.alias("failed"))
