"""Reading plans as they go on: the event log as a stream with state per plan (RP8 to RP10).

Plans and their items open a plan's state, events count against it, and a timer
in event time closes a plan that nothing has happened to for a while.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What goes in: an item (kind item: rank, path), an event (kind event: event, path) or an end (kind finish) of a plan.
INPUT = "plan_id long, seq long, kind string, path string, event string, rank int, at timestamp"
#: The newest row of a plan has its present state; ``status`` is open, finished or idle.
OUTPUT = "plan_id long, version long, status string, items long, events long, opened long, useful long, noisy long, missing long, unplanned long, unread long"
_COUNTED = ("opened", "useful", "noisy", "missing")


def use_state_store(spark: SparkSession) -> None:
    """State by key needs the store on local disks with changelogs in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class PlanState(StatefulProcessor):
    """A plan's items by path, the numbers of the rows that have been counted, and its sums.

    A row that comes again (same seq) counts once.  Rows may come in any order
    within what the watermark lets through; later ones are dropped by Spark.
    An event before its item counts when the item comes.  Rows that come after
    a plan was closed as idle open it again, with its sums."""

    def __init__(self, idle_seconds: int) -> None:
        self.idle_ms = 1000 * idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "seq long", "one int")
        self.items = handle.getMapState("items", "path string", "rank int, seq long")
        self.happened = handle.getMapState("happened", "path string", "opened int")
        self.sums = handle.getValueState("sums", "version long, finished boolean, newest long, events long, " + ", ".join(f"{c} long" for c in _COUNTED))

    def _row(self, key, sums: tuple, status: str) -> pd.DataFrame:
        planned = {k[0] for k in self.items.keys()}
        touched = {k[0]: v[0] for k, v in self.happened.iterator()}
        unplanned, unread = len(set(touched) - planned), sum(not touched.get(p) for p in planned)
        version, _, _, events, *counted = sums
        return pd.DataFrame([(key[0], version, status, len(planned), events, *counted, unplanned, unread)], columns=[c.split(" ")[0] for c in OUTPUT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, finished, newest, events, *counted = self.sums.get() if self.sums.exists() else (0, False, 0, 0, 0, 0, 0, 0)
        changed = False
        for batch in rows:
            for r in batch.itertuples(index=False):
                if self.seen.containsKey((int(r.seq),)):
                    continue
                self.seen.updateValue((int(r.seq),), (1,))
                changed, newest = True, max(newest, int(r.at_ms))
                if r.kind == "item":
                    old = self.items.getValue((r.path,)) if self.items.containsKey((r.path,)) else None
                    if old is None or old[1] < r.seq:  # of a path's items the last one counts
                        self.items.updateValue((r.path,), (None if pd.isna(r.rank) else int(r.rank), int(r.seq)))
                elif r.kind == "finish":
                    finished = True
                else:
                    events += 1
                    if r.event in _COUNTED:
                        counted[_COUNTED.index(r.event)] += 1
                    if isinstance(r.path, str):
                        was = self.happened.getValue((r.path,))[0] if self.happened.containsKey((r.path,)) else 0
                        self.happened.updateValue((r.path,), (int(was or r.event in ("opened", "read", "useful", "noisy")),))
        if changed:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if not finished:
                self.handle.registerTimer(newest + self.idle_ms)
            sums = (version + 1, finished, newest, events, *counted)
            self.sums.update(sums)
            yield self._row(key, sums, "finished" if finished else "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, *rest = self.sums.get()
        sums = (version + 1, *rest)
        self.sums.update(sums)
        yield self._row(key, sums, "idle")


def plan_states(log: DataFrame, idle_seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """A row per plan and batch that changed it (see ``OUTPUT``), of a stream
    with the columns of ``INPUT``; call ``use_state_store`` before it starts.

    Rows that are more than ``late`` behind the newest one are dropped."""
    timed = log.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("plan_id").transformWithStateInPandas(PlanState(idle_seconds), OUTPUT, "Update", "EventTime")


def newest(states: DataFrame) -> DataFrame:
    """The present state of every plan, of rows that ``plan_states`` has written."""
    columns = [c for c in states.columns if c != "plan_id"]
    last = states.groupBy("plan_id").agg(F.max_by(F.struct(*columns), "version").alias("x"))
    return last.select("plan_id", *[F.col(f"x.{c}").alias(c) for c in columns])


def batch_states(log: DataFrame) -> DataFrame:
    """What the stream comes to, from the whole log at once."""
    once = log.dropDuplicates(["plan_id", "seq"])
    events = once.where("kind = 'event'")
    touched = events.where("path IS NOT NULL").groupBy("plan_id", "path").agg(F.bool_or(F.col("event").isin("opened", "read", "useful", "noisy")).alias("was"))
    items = once.where("kind = 'item'").groupBy("plan_id", "path").agg(F.max_by("rank", "seq").alias("rank")).withColumn("planned", F.lit(True))
    both = items.join(touched, ["plan_id", "path"], "full_outer").groupBy("plan_id").agg(
        F.count("planned").alias("items"), F.count_if(F.col("planned").isNull()).alias("unplanned"), F.count_if(F.col("planned") & ~F.coalesce("was", F.lit(False))).alias("unread")
    )
    sums = once.groupBy("plan_id").agg(
        F.bool_or(F.col("kind") == "finish").alias("finished"), F.count_if(F.col("kind") == "event").alias("events"), *[F.count_if((F.col("kind") == "event") & (F.col("event") == c)).alias(c) for c in _COUNTED]
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sums.join(both, "plan_id", "left").select("plan_id", F.when(F.col("finished"), "finished").otherwise("open").alias("status"), zero("items"), "events", *_COUNTED, zero("unplanned"), zero("unread"))
