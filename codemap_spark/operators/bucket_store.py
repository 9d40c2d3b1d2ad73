"""Tables in hash buckets with a manifest per version (SNK1 to SNK4).

A change rewrites only the buckets that its keys fall into.  New buckets go to
a folder of their own; a version is a small manifest that names the folder of
every bucket of every table, and is put in place last by a rename.  So a
version holds all tables of one change or none of them, a run that breaks off
leaves the older version, and older versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Change(NamedTuple):
    """What becomes of a table: ``rows`` makes the new rows of all touched
    buckets from their old ones; ``touched`` holds the keys, in the table's key
    column, of all rows that may come, go or change."""

    table: str
    touched: DataFrame
    rows: Callable[[DataFrame], DataFrame]


class BucketStore:
    """Tables by name under a folder that all executors share.

    ``schemas`` gives each table's columns (DDL) and ``keys`` its key column.
    ``buckets`` is fixed when the store is made; a manifest has at most so many
    entries a table.  Of older versions ``keep`` stay."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, str], buckets: int = 256, keep: int = 1) -> None:
        self.spark, self.root, self.schemas, self.keys, self.keep = spark, root.rstrip("/"), schemas, keys, keep
        self._made = buckets

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        folder = self._path(*parts)
        return [s.getPath().getName() for s in self._fs().listStatus(folder)] if self._fs().exists(folder) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("manifests") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, buckets, meta, batches, tables (name: {bucket: folder})."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "buckets": self._made, "meta": {}, "batches": {}, "tables": {n: {} for n in self.schemas}}
        if version is not None and version not in known:
            raise ValueError(f"version {version} isn't kept; there are {known}")
        stream = self._fs().open(self._path("manifests", f"v{version or known[-1]}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _bucket(self, key: Column, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(manifest["buckets"])).cast("int")

    def _numbers(self, name: str, keys: DataFrame, manifest: dict) -> list[int]:
        """The buckets of keys: at most as many numbers as there are buckets."""
        found = keys.select(self._bucket(F.col(self.keys[name]), manifest).alias("b")).distinct().collect()
        return sorted(r.b for r in found)

    def _folders(self, name: str, numbers: list[int], manifest: dict) -> DataFrame:
        known = manifest["tables"].get(name, {})
        paths = [f"{self.root}/{known[str(b)]}" for b in numbers if str(b) in known]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def read(self, name: str, version: int | None = None, touching: DataFrame | None = None) -> DataFrame:
        """A table as of a version (the newest by default); only the buckets
        of the keys in ``touching``, if given."""
        manifest = self.manifest(version)
        numbers = range(manifest["buckets"]) if touching is None else self._numbers(name, touching, manifest)
        return self._folders(name, list(numbers), manifest)

    def applied(self, stream: str) -> int:
        """The last batch of a stream that the newest version holds, or -1."""
        return self.manifest()["batches"].get(stream, -1)

    def commit(self, changes: list[Change], meta: dict | None = None, batch: tuple[str, int] | None = None) -> int:
        """The changes as one new version; the number of the newest version.

        A ``batch`` (stream, number) that the newest version holds already
        changes nothing, so a batch can be put in again after a failure.  Two
        writers at once: the second one's rename fails, and so does its commit.
        """
        old = self.manifest()
        if batch and old["batches"].get(batch[0], -1) >= batch[1]:
            return old["version"]
        new = json.loads(json.dumps(old)) | {"version": old["version"] + 1}
        own = f"data/{uuid.uuid4().hex}"
        for change in changes:
            name = change.table
            numbers = self._numbers(name, change.touched, old)
            if not numbers:
                continue
            columns = [c.strip().split(" ")[0] for c in self.schemas[name].split(",")]
            rows = change.rows(self._folders(name, numbers, old)).select(*columns)
            # rebalanced by size: a bucket with a very common key gets several files
            placed = rows.withColumn("bucket", self._bucket(F.col(self.keys[name]), old)).hint("rebalance", "bucket")
            placed.write.partitionBy("bucket").parquet(f"{self.root}/{own}/{name}")
            written = {n.split("=")[1] for n in self._names(own, name) if n.startswith("bucket=")}
            if strays := written - {str(b) for b in numbers}:
                raise ValueError(f"{name}: rows outside the touched keys, in buckets {sorted(strays)[:5]}")
            tables = new["tables"].setdefault(name, {})
            for b in map(str, numbers):
                tables.pop(b, None)
                if b in written:
                    tables[b] = f"{own}/{name}/bucket={b}"
        new["meta"] |= meta or {}
        if batch:
            new["batches"][batch[0]] = batch[1]
        self._publish(new)
        self._prune(new)
        return new["version"]

    def _publish(self, manifest: dict) -> None:
        fs, draft = self._fs(), self._path("manifests", f".draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        final = self._path("manifests", f"v{manifest['version']}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise ValueError(f"version {manifest['version']} has been written meanwhile")

    def _prune(self, newest: dict) -> None:
        """Manifests older than ``keep`` go, then folders that no kept one names."""
        kept = self.versions()
        gone = kept[: max(0, len(kept) - self.keep - 1)]
        if not gone:
            return
        held = {folder for v in kept[len(gone) :] for t in self.manifest(v)["tables"].values() for folder in t.values()}
        dropped = {folder for v in gone for t in self.manifest(v)["tables"].values() for folder in t.values()} - held
        for v in gone:
            self._fs().delete(self._path("manifests", f"v{v}.json"), False)
        for folder in dropped:
            self._fs().delete(self._path(folder), True)
