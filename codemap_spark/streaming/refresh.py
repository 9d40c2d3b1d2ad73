"""The index kept up by a stream of scanned files (RF1 as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.indexing import Extract, IndexStore


def apply_batch(store: IndexStore, extract: Extract, name: str, rows: DataFrame, number: int) -> int:
    """One batch of scanned rows; a null ``sha256`` says that the file is gone.

    Of a path's rows in a batch the last modified one counts.  The batch's
    number is written in the manifest with its rows, so a batch that comes
    again after a failure, before or after its commit, counts once."""
    last = rows.groupBy("path").agg(F.max(F.struct("modified", *[c for c in rows.columns if c not in ("path", "modified")])).alias("x"))
    rows = last.select("path", *[F.col(f"x.{c}").alias(c) for c in rows.columns if c != "path"])
    return store.change(rows.where("sha256 IS NOT NULL"), extract, rows.where("sha256 IS NULL").select("path"), batch=(name, number))


def start(scanned: DataFrame, store: IndexStore, extract: Extract, checkpoint: str, name: str = "refresh", available_now: bool = False) -> StreamingQuery:
    """A running refresh of ``store`` by ``scanned``, a stream of rows with the
    columns of ``repository.scan``.

    ``checkpoint`` is a shared folder; ``name`` tells the streams of one store
    apart.  With ``available_now`` it ends after what is there."""
    writer = scanned.writeStream.foreachBatch(lambda rows, number: apply_batch(store, extract, name, rows, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
