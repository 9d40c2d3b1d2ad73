"""Code-shaped tables derived from the test tables, deterministically."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T

EXTENSIONS = ("py", "php", "js", "sql", "md", "css", "json", "rs")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part_names(spark, sf_dir) -> DataFrame:
    """200 names: a bounded table, safe to send to every task."""
    return table(spark, sf_dir, "part").where("p_partkey < 200").select(F.col("p_partkey").alias("name_key"), F.col("p_name").alias("p_name"))


def paths(spark, sf_dir) -> DataFrame:
    """id and path of the files, without their content."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    named = docs.join(F.broadcast(_part_names(spark, sf_dir)), F.col("id") % 200 == F.col("name_key"))
    ext = F.element_at(T.strings(EXTENSIONS), (F.col("id") % 8 + 1).cast("int"))
    path = F.concat(F.when(F.col("id") % 11 == 0, "tests/").otherwise(""), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.translate("p_name", " ", "_"), F.lit("_"), F.col("id").cast("string"), F.lit("."), ext)
    return named.select("id", path.alias("path"))


def files(spark, sf_dir, content: bool = False) -> DataFrame:
    """id, path, language, role; and size, sha256, content if asked."""
    # a generator between keeps the long role expression from being copied into every later use
    named = F.struct(T.language_of(F.col("path")).alias("language"), T.role_of(F.col("path")).alias("role"))
    out = paths(spark, sf_dir).select("id", "path", F.explode(F.array(named)).alias("x")).select("id", "path", "x.language", "x.role")
    if content:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("sha256"), F.col("text").alias("content"))
        out = out.join(docs, "id")
    return out


def symbols(spark, sf_dir) -> DataFrame:
    """id, file_id, name, kind, line: one per distinct supplier and part."""
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    named = pairs.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.element_at(T.strings(("function", "method", "class", "heading")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return named.select((F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("id"), F.col("l_suppkey").alias("file_id"), F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_size").alias("line"))


def calls(spark, sf_dir) -> DataFrame:
    """source_id, target_id, confidence, metadata (JSON): events as call edges."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("event_type").alias("target_id"), F.col("value").alias("confidence"), F.col("props").alias("metadata"))


def commits(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(F.broadcast(_part_names(spark, sf_dir)), F.col("o_orderkey") % 200 == F.col("name_key"), "left")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.concat_ws(" ", "o_orderpriority", "p_name").alias("message"))


def commit_files(spark, sf_dir, among: DataFrame | None = None) -> DataFrame:
    """commit_id, path; of the commits of ``among`` (id) only, if it is given:
    the lines of others go before they are made distinct and named."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), "l_partkey")
    if among is not None:
        lines = lines.join(among.select(F.col("id").alias("commit_id")), "commit_id", "left_semi")
    named = lines.distinct().join(paths(spark, sf_dir).withColumnRenamed("id", "l_partkey"), "l_partkey", "left")
    return named.select("commit_id", F.coalesce("path", F.concat(F.lit("part/"), F.col("l_partkey").cast("string"))).alias("path"))


def feedback(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    rows = labels.join(paths(spark, sf_dir), "id").join(F.broadcast(_part_names(spark, sf_dir)), F.col("id") % 200 == F.col("name_key"))
    return rows.select(
        "id",
        F.concat(F.when(F.col("id") % 13 == 0, "gone/").otherwise(""), "path").alias("path"),
        F.when(F.col("toxic") == 1, "noisy").when(F.col("quality") == 1, "useful").otherwise("neutral").alias("rating"),
        F.element_at(T.strings(("agent", "benchmark", "user")), (F.col("id") % 3 + 1).cast("int")).alias("source"),
        F.col("p_name").alias("query"),
    )


def notes(spark, sf_dir) -> DataFrame:
    """id, path (null past the files), scope, topic, note, file_sha256, created_at."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "role", "text", (F.col("conv_id") * 17).alias("file_id"))
    known = files(spark, sf_dir, content=True).select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "sha256")
    joined = turns.join(known, "file_id", "left")
    return joined.select(
        "id",
        F.coalesce("file_path", F.concat(F.lit("gone/"), F.col("file_id").cast("string"))).alias("path"),
        F.when(F.col("conv_id") % 7 == 0, "repo").otherwise("file").alias("scope"),
        F.col("role").alias("topic"),
        F.col("text").alias("note"),
        F.when(F.col("conv_id") % 3 == 0, F.coalesce("sha256", F.lit("0"))).when(F.col("conv_id") % 3 == 1, "altered").otherwise("").alias("file_sha256"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")).alias("created_at"),
    )


def plans(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(3).alias("read_budget"), (F.col("o_orderstatus") != "O").alias("finished"))


def plan_items(spark, sf_dir) -> DataFrame:
    """One item per distinct order and part, ranked by part; and its event."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id"), "l_partkey").agg(F.max("l_returnflag").alias("flag"))
    rank = F.row_number().over(Window.partitionBy("plan_id").orderBy("l_partkey"))
    event = F.when(F.col("flag") == "R", "noisy").when(F.col("flag") == "A", "useful").otherwise("opened")
    return lines.select("plan_id", rank.alias("rank"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"), event.alias("event"))


def relations(spark, sf_dir) -> DataFrame:
    """id, source_type, source_id, relation, target_type, target_id, confidence,
    metadata: events as edges to files, symbol ids and called names.  Include
    edges lead to any file, by its path."""
    kind = (F.col("event_id") % 3 + 1).cast("int")
    rows = table(spark, sf_dir, "events").withColumn("file_key", F.col("event_id") * 7 % (F.col("user_id") * 13 + 50))
    targets = paths(spark, sf_dir).select(F.col("id").alias("file_key"), F.col("path").alias("file_path"))
    events = rows.join(F.broadcast(_part_names(spark, sf_dir)), F.col("event_id") % 200 == F.col("name_key")).join(targets, "file_key", "left")
    symbol = ((F.col("event_id") % 10 + 1) * 1000000 + F.col("event_id") % 200 + 1).cast("string")
    return events.select(
        F.col("event_id").alias("id"),
        F.lit("file").alias("source_type"),
        F.col("user_id").alias("source_id"),
        F.element_at(T.strings(("includes", "defines", "calls")), kind).alias("relation"),
        F.element_at(T.strings(("file", "symbol", "symbol_name")), kind).alias("target_type"),
        F.when(kind == 1, F.col("file_path")).when(kind == 2, symbol).otherwise(F.col("p_name")).alias("target_id"),
        ((F.col("event_id") % 100).cast("double") / 100).alias("confidence"),
        F.col("props").alias("metadata"),
    )


def project_files(spark, sf_dir) -> DataFrame:
    """id, path, language, role of files with telling names."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    names = ("main.py", "__init__.py", "pyproject.toml", "README.md", "app.py", "widget.py", "Makefile", "routes.py")
    name = F.element_at(T.strings(names), (F.col("id") % 8 + 1).cast("int"))
    folder = F.when(F.col("id") % 5 == 0, "src/api/").when(F.col("id") % 5 == 1, "tests/").otherwise("")
    path = F.concat(folder, "lang", F.lit("/d"), F.col("id").cast("string"), F.lit("/"), name)
    named = docs.select("id", path.alias("path"))
    return named.select("id", "path", T.language_of(F.col("path")).alias("language"), T.role_of(F.col("path")).alias("role"))


def project_symbols(spark, sf_dir) -> DataFrame:
    """id, file_id, name, kind, line: seven symbols a file."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.explode(F.array(*[F.lit(k) for k in range(7)])).alias("line"))
    at = F.col("file_id") + F.col("line")
    name = F.element_at(T.strings(("main", "widgetApp", "setup", "Serve", "helper")), (at % 5 + 1).cast("int"))
    kind = F.element_at(T.strings(("project_script", "package_script", "route", "function")), ((F.col("file_id") + F.col("line") * 3) % 4 + 1).cast("int"))
    return docs.select((F.col("file_id") * 10 + F.col("line")).alias("id"), "file_id", name.alias("name"), kind.alias("kind"), "line")
