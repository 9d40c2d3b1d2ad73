"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialise


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, component) of every id in the edges (a, b); the component is the
    smallest id reachable.

    Each round takes the least label of an id's neighbours, then the label of
    that label, so long chains shrink by halves; rounds end when no label
    changes.  Labels are written every round, which cuts the lineage; nothing
    but the number of changes comes to the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges", small=True)
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels", small=True)
    for _ in range(max_rounds):
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        nearer = labels.join(around, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        stepped = materialise(nearer.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("next", "component")).alias("component")), "labels", small=True)
        discard(labels)
        settled = stepped.where("component <> old").isEmpty()
        labels = stepped.select("id", "component")
        labels._shared_path = stepped._shared_path
        if settled:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
