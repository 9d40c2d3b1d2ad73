"""The event log of reading plans as a stream, against the same log at once."""

import random

from pyspark.sql import functions as F

from codemap_spark.streaming import plans


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


COLUMNS = ("plan_id", "status", "items", "events", "opened", "useful", "noisy", "missing", "unplanned", "unread")


def log_rows(rng, n_plans):
    out, seq = [], 0
    for plan in range(n_plans):
        paths = [f"p{k}" for k in range(rng.randrange(1, 5))]
        own = [("item", p, None, k + 1) for k, p in enumerate(paths)] + [("item", paths[0], None, None)]
        own += [("event", rng.choice([*paths, "extra", None]), rng.choice(["opened", "read", "useful", "noisy", "missing"]), None) for _ in range(rng.randrange(6))]
        if plan % 2:
            own.append(("finish", None, None, None))
        rng.shuffle(own)
        for kind, path, event, rank in own:
            seq += 1
            out.append((plan, seq, kind, path, event, rank))
    return out


def arrive(spark, folder, part, minutes=0):
    """Rows put into the inbox and taken in by the stream, from where it was."""
    at = F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minutes) + F.col("seq"))
    df = spark.createDataFrame(part, "plan_id long, seq long, kind string, path string, event string, rank int").withColumn("at", at)
    df.coalesce(1).write.mode("append").parquet(f"{folder}/log")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # every partition has a state store of its own
    states = plans.plan_states(spark.readStream.schema(plans.INPUT).parquet(f"{folder}/log"), 600, "5 minutes")
    written = states.writeStream.outputMode("update").foreachBatch(lambda found, _: found.write.mode("append").parquet(f"{folder}/states"))
    try:
        written.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    return df


def test_end_state_equals_the_whole_log(spark, tmp_path):
    plans.use_state_store(spark)
    log = log_rows(random.Random(5), 6)
    cut = len(log) // 2
    # rows come twice, within a batch and in a later one
    whole = arrive(spark, tmp_path, log[:cut] + log[:7]).unionByName(arrive(spark, tmp_path, log[cut - 9 :]))
    states = spark.read.parquet(str(tmp_path / "states"))
    assert rows(plans.newest(states), *COLUMNS) == rows(plans.batch_states(whole), *COLUMNS)
    assert states.where("version > 2").isEmpty()


def test_idle_plans_are_closed_and_late_rows_dropped(spark, tmp_path):
    plans.use_state_store(spark)
    arrive(spark, tmp_path, [(1, 1, "item", "a", None, 1), (2, 2, "item", "a", None, 1), (2, 3, "finish", None, None, None)])
    arrive(spark, tmp_path, [(3, 4, "item", "b", None, 1)], minutes=30)
    arrive(spark, tmp_path, [(3, 5, "event", "b", "opened", None)], minutes=30)
    arrive(spark, tmp_path, [(3, 6, "event", "b", "useful", None)], minutes=2)  # behind the watermark
    found = rows(plans.newest(spark.read.parquet(str(tmp_path / "states"))), "plan_id", "status", "items", "unread", "opened", "useful")
    assert found == [(1, "idle", 1, 1, 0, 0), (2, "finished", 1, 1, 0, 0), (3, "open", 1, 0, 1, 0)]
