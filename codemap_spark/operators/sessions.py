"""Tasks and the end of a session (TK1, SE1 to SE3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from . import listing

STATUSES = ("open", "in_progress", "blocked", "done")
#: Lists of a task that only grow.
LISTS = ("files", "tests", "remaining")
TASK_SCHEMA = (
    "id long, title string, status string, topic string, summary string, files array<string>, tests array<string>, remaining array<string>, source string, created_at string, updated_at string, closed_at string"
)
NOTE_SCHEMA = "id long, task_id long, note string, files array<string>, source string, created_at string"


def _paths(paths: Sequence[str]) -> list[str]:
    return [p.replace("\\", "/").lstrip("./") for p in paths if p and p.strip()]


def _status(status: str) -> str:
    status = status.lower().strip()
    if status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    return status


def add_task(tasks: DataFrame, title: str, now: str, topic: str = "", summary: str = "", files: Sequence[str] = (), status: str = "open", source: str = "agent") -> DataFrame:
    """TK1: the tasks with a new one, whose id is the next."""
    if not title.strip():
        raise ValueError("a task needs a title")
    status = _status(status)
    row = tasks.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    values = {"title": title.strip(), "status": status, "topic": topic.strip(), "summary": summary.strip(), "source": source, "created_at": now, "updated_at": now, "closed_at": now if status == "done" else None}
    new = row.withColumns({k: F.lit(v).cast("string") for k, v in values.items()} | {"files": T.strings(_paths(files)), "tests": T.strings(()), "remaining": T.strings(())})
    return tasks.unionByName(new.select(*tasks.columns))


def update_task(tasks: DataFrame, task_id: int, now: str, status: str | None = None, topic: str | None = None, summary: str | None = None, **added: Sequence[str]) -> DataFrame:
    """TK1: the tasks with that one changed: texts replace, lists (files, tests,
    remaining) grow by what they lack.  Being done stamps the first closing."""
    mine = F.col("id") == task_id
    change = {"updated_at": F.lit(now)}
    if status is not None:
        change["status"] = F.lit(_status(status))
        if _status(status) == "done":
            change["closed_at"] = F.coalesce("closed_at", F.lit(now))
    change |= {k: F.lit(v.strip()) for k, v in (("topic", topic), ("summary", summary)) if v is not None}
    for name in LISTS:
        new = _paths(added.get(name, ())) if name == "files" else [x.strip() for x in added.get(name, ()) if x.strip()]
        if new:
            change[name] = F.concat(F.col(name), F.array_except(T.strings(new), F.col(name)))
    return tasks.withColumns({k: F.when(mine, v).otherwise(F.col(k)) for k, v in change.items()})


def add_task_note(tasks: DataFrame, notes: DataFrame, task_id: int, note: str, now: str, source: str = "agent", **added: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """TK1: (tasks, notes) with a note on a task, whose lists grow; without
    that task both stay."""
    if not note.strip():
        raise ValueError("a note needs a text")
    task = tasks.where(F.col("id") == task_id).select(F.col("id").alias("task_id"))
    next_id = notes.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    row = next_id.crossJoin(F.broadcast(task)).withColumns({"note": F.lit(note.strip()), "files": T.strings(_paths(added.get("files", ()))), "source": F.lit(source), "created_at": F.lit(now)})  # one row each
    return update_task(tasks, task_id, now, **added), notes.unionByName(row.select(*notes.columns))


def audit_counts(notes: DataFrame) -> DataFrame:
    """AGG13: issue, notes: how many of the notes (newest 100) are stale, have
    unknown evidence, no topic, fewer than five useful words, or share path and
    topic with another one of a file."""
    recent = notes.orderBy(F.desc("id")).limit(100)
    evidence = F.coalesce("evidence", F.lit("unknown")) if "evidence" in notes.columns else F.lit("unknown")
    checks = {
        "stale": F.coalesce("stale", F.lit(False)), "unknown_evidence": evidence == "unknown", "missing_topic": F.trim(F.coalesce("topic", F.lit(""))) == "",
        "short_note": F.size(T.query_tokens(F.col("note"))) < 5,
    }
    rows = recent.select(F.explode(F.array(*[F.when(c, name) for name, c in checks.items()])).alias("issue")).where("issue is not null")
    twice = recent.where("scope = 'file'").groupBy("scope", "path", "topic").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_file_topic").alias("issue"))
    names = notes.sparkSession.createDataFrame([(n,) for n in (*checks, "duplicate_file_topic")], "issue string")
    return names.join(rows.unionByName(twice).groupBy("issue").agg(F.count("*").alias("n")), "issue", "left").select("issue", F.coalesce("n", F.lit(0)).alias("notes"))


def summary(notes: DataFrame, feedback: DataFrame, tasks: DataFrame, plans: DataFrame, git_status: Sequence[str] = (), limit: int = 10) -> DataFrame:
    """SE1: section, position, id, text: the newest notes, feedback, open tasks
    and plans, and lines of the git status; ``limit`` (1 to 50) of each."""
    limit = max(1, min(limit, 50))
    parts = {
        "memory": notes.orderBy(F.desc("id")).limit(limit).select("id", F.concat_ws(": ", "path", "topic").alias("text"), F.col("id").cast("string").alias("key")),
        "feedback": feedback.orderBy(F.desc("id")).limit(limit).select("id", F.concat_ws(" ", "rating", "path").alias("text"), F.col("id").cast("string").alias("key")),
        "task": listing.tasks(tasks, limit=limit).select("id", F.col("title").alias("text"), F.concat("updated_at", F.lpad(F.col("id").cast("string"), 20, "0")).alias("key")),
        "plan": plans.orderBy(F.desc("id")).limit(limit).select("id", F.when(F.col("finished"), "finished").otherwise("unfinished").alias("text"), F.col("id").cast("string").alias("key")),
    }
    counted = audit_counts(notes).withColumn("id", F.lit(None).cast("long"))  # five rows
    parts["audit"] = counted.select("id", F.concat_ws(": ", "issue", F.col("notes").cast("string")).alias("text"), F.col("issue").alias("key"))
    out = None
    for name, rows in parts.items():
        # over at most ``limit`` rows
        order = Window.orderBy(F.desc("key") if name == "task" else F.asc("key") if name == "audit" else F.desc("id"))
        part = rows.select(F.lit(name).alias("section"), F.row_number().over(order).alias("position"), "id", "text")
        out = part if out is None else out.unionByName(part)
    lines = notes.sparkSession.createDataFrame([("git", i, None, x) for i, x in enumerate(git_status[:limit], 1)], "section string, position int, id long, text string")
    return out.unionByName(lines)


#: The steps of the checklist, and whether one that is open keeps a session from being closed.
STEPS = (("review_git_status", True), ("refresh_stale_memory", True), ("audit_memory_quality", True), ("review_open_tasks", True), ("finish_reading_plans", False))
LAST_STEPS = (("record_durable_learning", "optional"), ("report_verification", "manual"))
QUALITY = ("unknown_evidence", "missing_topic", "short_note", "duplicate_file_topic")


def close_checklist(notes: DataFrame, tasks: DataFrame, plans: DataFrame, git_status: Sequence[str] = (), limit: int = 10) -> DataFrame:
    """SE2: position, id, status, amount: what is left to do; and the row
    ``close_ready``, whose status is yes if git, stale notes, note quality and
    open tasks have nothing left (plans don't count)."""
    limit = max(1, min(limit, 50))

    def amount(issues):
        return F.sum(F.when(F.col("issue").isin(*issues), F.col("notes")).otherwise(0))

    left = audit_counts(notes).agg(amount(["stale"]).alias("stale"), amount(QUALITY).alias("quality"))
    open_tasks = listing.tasks(tasks, limit=limit).agg(F.count("*").alias("tasks"))
    unfinished = plans.orderBy(F.desc("id")).limit(limit).agg(F.count_if(~F.col("finished")).alias("plans"))
    one = left.crossJoin(open_tasks).crossJoin(unfinished)  # a row each
    amounts = (F.lit(min(len(git_status), limit)), F.col("stale"), F.col("quality"), F.col("tasks"), F.col("plans"))
    rows, blocking = [], F.lit(0)
    for (name, needed), n in zip(STEPS, amounts, strict=True):
        rows.append((name, F.when(n > 0, "needed" if needed else "optional").otherwise("clean"), n))
        blocking = blocking + n if needed else blocking
    rows += [(name, F.lit(status), F.lit(0)) for name, status in LAST_STEPS]
    rows.append(("close_ready", F.when(blocking > 0, "no").otherwise("yes"), F.lit(0)))
    listed = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(name).alias("id"), status.alias("status"), n.cast("long").alias("amount")) for i, (name, status, n) in enumerate(rows, 1)])
    return one.select(F.explode(listed).alias("x")).select("x.*")


def suggestions(notes: DataFrame, plans: DataFrame, events: DataFrame, limit: int = 10, command: str = "codemap") -> DataFrame:
    """SE3: kind, position, command: finish unfinished plans, note useful files
    of finished ones, refresh stale notes; at most eight each of feedback and
    memory, from the newest ``limit`` plans and notes."""
    recent = plans.orderBy(F.desc("id")).limit(limit).select(F.col("id").alias("plan_id"), "finished")
    newest = Window.partitionBy("finished").orderBy(F.desc("plan_id"))
    ordered = recent.withColumn("place", F.row_number().over(newest)).where("place <= 5")  # ten rows at most
    finish = F.concat(F.lit(f"{command} plan finish --id "), F.col("plan_id").cast("string"), F.lit(" --summary <summary>"))
    kind = lambda name, text, *at: (F.lit(name).alias("kind"), text.alias("command"), F.struct(*[x.cast("long").alias(f"k{i}") for i, x in enumerate(at)]).alias("at"))
    feedback = ordered.where("NOT finished").select(*kind("finish_plan", finish, F.lit(0), F.col("place"), F.lit(0)))
    own = F.broadcast(ordered.where("finished").select("plan_id", "place"))  # five rows
    first = Window.partitionBy("plan_id").orderBy(*[c for c in ("id", "rank") if c in events.columns], "path")
    useful = events.where("event = 'useful'").join(own, "plan_id").withColumn("nth", F.row_number().over(first)).where("nth <= 3")
    note = F.concat(F.lit(f'{command} memory add --path "'), F.col("path"), F.lit('" --topic <topic> --note <note>'))
    stale = notes.orderBy(F.desc("id")).limit(limit).where("stale")
    again = F.concat(F.lit(f"{command} memory update --id "), F.col("id").cast("string"), F.lit(" --note <updated-note>"))
    memory = useful.select(*kind("memory_for_useful_file", note, F.lit(1), F.col("place"), F.col("nth"))).unionByName(stale.select(*kind("refresh_stale_memory", again, F.lit(2), -F.col("id"), F.lit(0))))
    rows = feedback.withColumn("part", F.lit("feedback")).unionByName(memory.withColumn("part", F.lit("memory")))
    order = Window.partitionBy("part").orderBy("at")
    return rows.withColumn("position", F.row_number().over(order)).where("position <= 8").select("kind", "position", "command")
