"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are the spans of three base kinds and of further kinds.  Every
candidate's value is hashed, and the hash is counted over the whole corpus by
distinct repositories and owners.  A value that most owners or more than
``wide_owners`` hold is a widely copied example; any other looks like a live
credential, in however many documents and in a few sources alike.  Base spans
always stay; a further span is reported where its value isn't widely copied.

Positions come from splitting a text at the matches of a pattern: the pieces
between the matches and the matches themselves add up to every start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, join_counted, materialise

#: The base patterns, in the order that breaks ties of a start.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Further kinds: issued key formats, signed tokens, private keys and long
#: mixed strings.
KEYED = r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,})"
SIGNED = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
#: The whole block up to its END mark.  Where the next mark is another one, the
#: block is cut off: then its headers and the runs of key text that follow, with
#: a short last line.  Key text may be quoted, indented or on one line with \n.
PRIVATE = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:(?>(?s:.*?)-----)END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s*+(?:Proc-Type|DEK-Info): [^\r\n]*+){0,2}+(?:[\s\\\"',>|#*]*+[A-Za-z0-9+/=]{16,}+)*+(?:\r?\n[ \t]*+[A-Za-z0-9+/]{1,15}+={0,2}(?=[ \t\r]*+(?:\n|\z)))?)"
)
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}+"
#: kind, pattern, group of the value, least length of that group.
KINDS = (
    ("assign", ASSIGN, 1, 6),
    ("access", ACCESS, 0, 20),
    ("hex", HEX, 0, 24),
    ("keyed", KEYED, 0, 1),
    ("signed", SIGNED, 0, 1),
    ("private", PRIVATE, 0, 1),
    ("mixed", MIXED, 0, 1),
)
BASE = 3
#: A run shorter than the least length can't match; leftmost runs are maximal,
#: so these find the same spans as the patterns above with less work.
SCANNED = {"access": r"AKIA[A-Z0-9]{16,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+"}


def _found(text: Column, order: int) -> Column:
    """array<struct<kind, at, before, width, value>> of one kind's matches;
    ``before`` counts the characters since the last match of the kind."""
    name, pattern, group, _ = KINDS[order]
    scanned = SCANNED.get(name, pattern)
    matches = F.regexp_extract_all(text, F.lit(scanned), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(scanned), F.lit(group)) if group else matches
    fields = "array<struct<kind:int,at:int,before:int,width:int,value:string>>"
    pieces = F.transform(F.split(text, scanned, -1), lambda x: F.char_length(x))
    found = F.transform(
        F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(pieces, F.lit(1), F.size(matches)).alias("b")),
        lambda x, i: F.struct(F.lit(order).alias("kind"), i.cast("int").alias("at"), x["b"].cast("int").alias("before"), F.char_length(x["m"]).cast("int").alias("width"), x["v"].alias("value")),
    )
    return F.when(text.rlike(scanned), found.cast(fields)).otherwise(F.array().cast(fields))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """A row per candidate span, and one per document with none: row, id, kind
    (null if none), start, end, digest of the value, owner, repository.  The
    values themselves go no further."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    null = F.lit("\x00")
    owner = F.coalesce(F.col(owner_col).cast("string"), null)
    repository = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), null) for c in repository_cols])
    # the row's number only tells rows apart within this one result, which callers write before use
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), owner.alias("owner"), repository.alias("repository"), text.alias("text"), F.md5(text.cast("binary")).alias("text_key"))
    found = F.concat(*[_found(F.col("text"), k) for k in range(len(KINDS))])
    each = rows.select("row", "id", "text_key", "owner", "repository", F.explode_outer(found).alias("f")).select("row", "id", "text_key", "owner", "repository", "f.*")
    # starts need the matches of the same row and kind only
    run = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("before") + F.col("width")).over(run)
    placed = each.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.col("width")).cast("int"))
    least = F.lit(False)
    for k, (_, _, group, n) in enumerate(KINDS):
        least = least | ((F.col("kind") == k) & ((F.char_length("value") if group else F.col("width")) >= n))
    # one row of every document stays as its anchor, whatever its candidates
    return placed.select("row", "id", "text_key", "owner", "repository", F.when(least, F.col("kind")).alias("kind"), "start", "end", F.sha2("value", 256).alias("digest"))


def scan_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, wide_owners: int = 10) -> DataFrame:
    """A row per input row: row, id, text_key (digest of the text), spans array<struct<start, kind, end, owners,
    repositories, copied>> in order of start and kind.

    A value is widely copied if more than ``max_owners`` owners hold it, and
    more than ``wide_owners`` or half of the table's owners (rounded up),
    whichever is less.  Of three owners or more, two never make it so.
    """
    found = materialise(candidates(docs, id_col, text_col, owner_col, repository_cols), "secret-candidates")
    most = max(max_owners, min(wide_owners, (found.select("owner").distinct().count() + 1) // 2))
    spans = found.where("kind is not null")
    # distinct (value, owner, repository), then (value, owner), then value: every
    # step combines before its shuffle, so a common value stays small
    owned = spans.groupBy("digest", "owner", "repository").agg(F.count("*").alias("n")).groupBy("digest", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    frequency = owned.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))
    frequency = materialise(frequency, "secret-values", small=True)
    counted = join_counted(spans, frequency, "digest", "n", spans.count()).select("row", "id", "text_key", "kind", "start", "end", "owners", "repositories")
    # rows without a candidate meet no value
    none = F.lit(None)
    anchors = found.where("kind is null").select("row", "id", "text_key", none.cast("int").alias("kind"), none.cast("int").alias("start"), none.cast("int").alias("end"), none.cast("bigint").alias("owners"), none.cast("bigint").alias("repositories"))
    joined = counted.unionByName(anchors)
    reported = F.col("kind").isNotNull() & ((F.col("kind") < BASE) | (F.col("owners") <= most))
    span = F.when(reported, F.struct("start", "kind", "end", "owners", "repositories", (F.col("owners") > most).alias("copied")))
    out = materialise(joined.groupBy("row", "id", "text_key").agg(F.array_sort(F.collect_list(span)).alias("spans")), "secret-spans")
    discard(found, frequency)
    return out


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name, *_ in KINDS]), kind + 1)


def _joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_owners: int = 1, wide_owners: int = 10, **columns) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied,
    ownership: one row per input row.

    Null and empty texts have no spans; repeated rows repeat, null ids too; an
    empty table gives an empty one.  n_live counts the reported spans whose
    value isn't widely copied (see ``scan_spans``), n_copied the others;
    ownership gives owners:repositories:live or owners:repositories:copied of
    every reported span, in the order of ``spans``.  Null owners count as one.
    """
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < BASE)

    def count(k: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint")

    return scan_spans(docs, id_col, text_col, max_owners=max_owners, wide_owners=wide_owners, **columns).select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: ~s["copied"])).cast("bigint").alias("n_live"),
        F.size(F.filter(spans, lambda s: s["copied"])).cast("bigint").alias("n_copied"),
        F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["owners"].cast("string"), s["repositories"].cast("string"), F.when(s["copied"], "copied").otherwise("live"))), ",").alias("ownership"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", max_owners: int = 1, wide_owners: int = 10, **columns) -> DataFrame:
    """The rows of ``docs``, same columns, every reported span replaced by
    ``mark``; overlapping spans become one mark.  Texts without spans, null
    ones included, stay as they are, and so do all columns but the text; rows
    with a null id are edited like others."""
    found = scan_spans(docs, id_col, text_col, max_owners=max_owners, wide_owners=wide_owners, **columns).where(F.size("spans") > 0)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the whole row goes into one column, so no name of its own can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), text.alias("text"), F.md5(text.cast("binary")).alias("key"))
    # equal ids with different texts are told apart by the text's digest
    spans = found.groupBy(F.col("id").alias("found_id"), F.col("text_key").alias("found_key")).agg(F.max("spans").alias("spans"))
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), acc["end"] + 1, s["start"] - acc["end"])
        more = F.when(s["start"] >= acc["end"], F.concat(acc["text"], before, F.lit(mark))).otherwise(acc["text"])
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), more.alias("text"))

    edited = rows.join(spans, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
    edited = edited.withColumn("cut", F.when(F.col("spans").isNotNull(), F.aggregate("spans", start, step)))
    done = F.concat(F.col("cut.text"), F.substring(F.col("text"), F.col("cut.end") + 1, F.char_length("text")))
    kept = {c: F.col("doc").getField(c) for c in docs.columns}
    kept[text_col] = F.when(F.col("spans").isNotNull(), done).otherwise(kept[text_col])
    return edited.select(*[kept[c].alias(c) for c in docs.columns])
