"""Term statistics, tags, roll-ups and sizes (AGG1 to AGG14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import lexicon as L, text as T


def term_stats(docs: DataFrame, text_col: str = "text", source: str = "text") -> DataFrame:
    """AGG1: term, source, document_count, total_count, weight.

    Documents without a term count towards N.  Texts are cut once: a document's
    sorted terms stand beside their predecessors, so a term's first occurrence
    shows, and both counts combine before their shuffle.
    """
    terms = docs.select(F.sort_array(T.useful_terms(F.col(text_col))).alias("terms"))
    n = docs.agg(F.count("*").alias("n"))
    before = F.concat(F.array(F.lit("")), F.slice("terms", 1, F.greatest(F.size("terms") - 1, F.lit(0))))
    paired = terms.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), before.alias("before"))).alias("x")).where("x.term is not null")
    joined = paired.groupBy(F.col("x.term").alias("term")).agg(F.count_if(F.col("x.before") != F.col("x.term")).alias("document_count"), F.count("*").alias("total_count")).crossJoin(F.broadcast(n))  # n is one row
    weight = F.least(F.lit(2.8), F.greatest(F.lit(0.25), 0.45 + F.log((F.col("n") + 1) / (F.col("document_count") + 1))))
    return joined.select("term", F.lit(source).alias("source"), "document_count", "total_count", F.round(weight, 6).alias("weight"))


def token_weights(stats: DataFrame, tokens: list[str], missing: float = 0.25) -> DataFrame:
    """AGG3: token, weight; tokens without statistics get ``missing``."""
    wanted = stats.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    return wanted.join(stats.where(F.col("term").isin(tokens)).select(F.col("term").alias("token"), "weight"), "token", "left").select("token", F.coalesce("weight", F.lit(missing)).alias("weight"))


def file_tags(files: DataFrame, symbols: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """AGG4: file_id, tag, source, weight: the largest weight per tag and source.

    The file name counts without its suffix.  Names of symbols, kinds and
    relation targets are cut into tokens once each, however many files have
    them."""

    def tagged(df, id_col, source, text):
        return df.select(F.col(id_col).alias("file_id"), F.explode(T.query_tokens(text)).alias("tag"), F.lit(source).alias("source"), F.lit(L.TAG_WEIGHTS[source]).alias("weight"))

    def by_text(df, source, text):
        """Tags of (file_id, text) rows by way of the distinct texts."""
        pairs = df.select("file_id", F.col(text).alias("text")).distinct()
        tokens = df.select(F.col(text).alias("text")).distinct().select("text", T.query_tokens(F.col("text")).alias("tokens"))
        return pairs.join(tokens, "text").select("file_id", F.explode("tokens").alias("tag"), F.lit(source).alias("source"), F.lit(L.TAG_WEIGHTS[source]).alias("weight"))

    known = files.select(F.col("id").alias("file_id"))
    own = symbols.join(known, "file_id", "left_semi")
    parts = [
        tagged(files, "id", "path", F.col("path")),
        tagged(files, "id", "filename", F.regexp_replace(T.file_name(F.col("path")), r"(?<=.)\.[^.]*$", "")),
        tagged(files, "id", "language", F.col("language")),
        tagged(files, "id", "role", F.col("role")),
        by_text(own, "symbol", "name"),
        by_text(own, "symbol_kind", "kind"),
    ]
    if relations is not None:
        edges = relations.where("source_type = 'file'").withColumnRenamed("source_id", "file_id").join(known, "file_id", "left_semi")
        parts += [by_text(edges, "relation", "relation"), by_text(edges, "relation_target", "target_id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("file_id", "tag", "source").agg(F.max("weight").alias("weight"))


def subsystems(files: DataFrame, top: int = 3, limit: int = 10) -> DataFrame:
    """AGG5: prefix, files, top languages and roles (ties by the first path
    that has them), largest prefixes first."""
    rows = files.select("path", T.subsystem(F.col("path")).alias("prefix"), "language", "role").where(~F.col("prefix").isin(".agent", ".git", "__pycache__"))
    labels = F.explode(F.array(F.struct(F.lit("language").alias("what"), F.col("language").alias("label")), F.struct(F.lit("role").alias("what"), F.col("role").alias("label"))))
    counted = rows.select("path", "prefix", labels.alias("x")).groupBy("prefix", "x.what", "x.label").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("prefix", "what").orderBy(F.desc("n"), "first")))

    def listed(what):
        some = F.collect_list(F.when((F.col("what") == what) & (F.col("rank") <= top) & (F.coalesce("label", F.lit("")) != ""), F.struct("rank", "label")))
        return F.array_join(F.transform(F.array_sort(some), lambda s: s["label"]), ",")

    size = F.sum(F.when(F.col("what") == "language", F.col("n"))).alias("files")
    return ranked.groupBy("prefix").agg(size, listed("language").alias("languages"), listed("role").alias("roles")).orderBy(F.desc("files"), "prefix").limit(limit)


def activity(notes: DataFrame, feedback: DataFrame, events: DataFrame) -> DataFrame:
    """AGG9: path, notes, feedback, events, total."""
    rows = notes.select("path", F.lit("n").alias("k")).unionByName(feedback.select("path", F.lit("f").alias("k"))).unionByName(events.select("path", F.lit("e").alias("k")))
    counts = [F.count_if(F.col("k") == k).alias(name) for k, name in (("n", "notes"), ("f", "feedback"), ("e", "events"))]
    return rows.where(F.col("path") != "").groupBy("path").agg(*counts, F.count("*").alias("total"))


def size_estimate(files: DataFrame) -> DataFrame:
    """AGG11, FN12: language, files, characters, estimated tokens."""
    chars = F.sum(F.char_length("content"))
    return files.groupBy("language").agg(F.count("*").alias("files"), chars.cast("bigint").alias("characters"), T.estimated_tokens(chars).cast("bigint").alias("tokens"))


#: Roles of files that are read as texts (AGG11).
READABLE = ("source", "test", "route", "view", "migration", "documentation", "config", "unknown")


def read_sizes(files: DataFrame, pack: DataFrame) -> DataFrame:
    """AGG11: section, files, characters, tokens: of the first five files of a
    pack (path, raw), of its first ten, and of all that the index can read.
    ``files`` have their ``content`` or, so that no text travels, its ``length``."""
    length = F.col("length") if "length" in files.columns else F.char_length("content")
    files = files.select("path", "language", "role", length.alias("length"))
    place = F.row_number().over(Window.orderBy(F.desc("raw"), "path"))  # as many rows as a pack lists
    few = F.broadcast(pack.select("path", place.alias("place")).where("place <= 10"))
    own = files.join(few, "path").select("place", "length")
    rows = own.where("place <= 5").select(F.lit("suggested_first_reads").alias("section"), "length").unionByName(own.select(F.lit("top_candidates").alias("section"), "length"))
    rows = rows.unionByName(files.where(F.col("role").isin(*READABLE) & (F.col("language") != "unknown")).select(F.lit("indexed_project").alias("section"), "length"))
    chars = F.coalesce(F.sum("length"), F.lit(0))
    return rows.groupBy("section").agg(F.count("*").alias("files"), chars.cast("bigint").alias("characters"), T.estimated_tokens(chars).cast("bigint").alias("tokens"))


def flow_topics(notes: DataFrame, tags: DataFrame, files: DataFrame, newest: int = 100, limit: int = 20) -> DataFrame:
    """AGG8: tag, file_count, note_count, stale_count, file_tag_count,
    memory_tag_count, needs_summary; most notes first, then most files, then
    the tag.  Of the notes the ``newest`` by id count, whose tags go by case;
    a topic of three or more files whose five newest notes are about files
    only needs a summary."""
    recent = notes.orderBy(F.desc("id")).limit(newest)
    tagged = recent.select("id", "path", "scope", "stale", F.explode("tags").alias("tag")).withColumn("tag", F.lower("tag"))
    place = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("id")))  # over at most ``newest`` notes
    from_notes = tagged.withColumn("place", place).select(
        "tag", F.when(F.col("path") != "", F.col("path")).alias("path"), F.lit(1).alias("note"), F.coalesce("stale", F.lit(False)).cast("int").alias("stale"),
        F.lit(0).alias("file_tag"), ((F.col("scope") == "repo") & (F.col("place") <= 5)).alias("about_repo"),
    )
    on_files = tags.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").groupBy(F.lower("tag").alias("tag"), "path").agg(F.count("*").cast("int").alias("file_tag"))
    from_files = on_files.select("tag", "path", F.lit(0).alias("note"), F.lit(0).alias("stale"), "file_tag", F.lit(False).alias("about_repo"))
    by_path = from_notes.unionByName(from_files).groupBy("tag", "path").agg(*[F.sum(c).alias(c) for c in ("note", "stale", "file_tag")], F.max("about_repo").alias("about_repo"))
    out = by_path.groupBy("tag").agg(
        F.count("path").alias("file_count"), F.sum("note").alias("note_count"), F.sum("stale").alias("stale_count"), F.sum("file_tag").alias("file_tag_count"), F.max("about_repo").alias("about_repo")
    )
    needs = (F.col("file_count") >= 3) & ~F.col("about_repo")
    return out.select("tag", "file_count", "note_count", "stale_count", "file_tag_count", F.col("note_count").alias("memory_tag_count"), needs.alias("needs_summary")).orderBy(F.desc("note_count"), F.desc("file_count"), "tag").limit(limit)


def plan_activity(plans: DataFrame, events: DataFrame, limit: int = 20) -> DataFrame:
    """AGG14: one row over the newest ``limit`` plans by id; ``read_count``
    counts ``read`` events and not ``opened`` ones."""
    recent = plans.orderBy(F.desc("id")).limit(limit).select(F.col("id").alias("plan_id"), "finished")
    counts = [F.count_if(F.col("event") == e).alias(f"{e}_count") for e in ("read", "verified", "useful", "noisy", "missing")]
    of_events = events.join(F.broadcast(recent.select("plan_id")), "plan_id", "left_semi").agg(F.count("*").alias("event_count"), *counts)  # at most ``limit`` rows
    of_plans = recent.agg(F.count("*").alias("recent_plans"), F.count_if(~F.col("finished")).alias("unfinished_plans"), F.count_if("finished").alias("finished_plans"))
    return of_plans.crossJoin(of_events)  # one row each


def benchmark_summary(results: DataFrame) -> DataFrame:
    """AGG12: one row over the results with status ok: hits, rates, noise and
    averages; nulls don't count in an average."""
    hits = [F.count_if(f"top{k}_hit").alias(f"top{k}_hits") for k in (1, 3, 5)]
    rates = [F.round(F.count_if(f"top{k}_hit") / F.count("*"), 3).alias(f"top{k}_rate") for k in (1, 3, 5)]
    means = [
        F.round(F.avg("elapsed_seconds"), 3).alias("average_elapsed_seconds"),
        F.round(F.avg("manual_scan_reduction_percent"), 1).alias("average_manual_scan_reduction_percent"),
        F.round(F.avg("manual_scan_elapsed_seconds"), 3).alias("average_manual_scan_elapsed_seconds"),
    ]
    return results.where("status = 'ok'").agg(F.count("*").alias("cases"), *hits, *rates, F.coalesce(F.sum("noise_hit_count"), F.lit(0)).alias("noise_hits"), *means)
