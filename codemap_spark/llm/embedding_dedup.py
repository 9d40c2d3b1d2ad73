"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated at random and split into blocks.  If two vectors'
squared distance is at most T, some block's is at most T times the block's
share of the dimensions, so each block is joined on its own within its budget.
A tree of median splits over all coordinates of the block cuts the rows into
leaves of alike size; every leaf has the exact bounding box of its rows, and a
row visits the later leaves whose boxes are within its budget.  Pairs in reach
of a block are verified exactly, in double precision, where the first block
that finds them meets.  Equal vectors are joined as one with a count, and a leaf
sums links and keeps a spanning forest of its pairs, so large groups never
become lists of pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import join_counted, materialise, prepare
from .components import components

BLOCK_DIMENSIONS = 16
#: Rows of a leaf, and rows that the trees are fitted on.
LEAF_ROWS, SAMPLE_ROWS = 32_768, 65_536
SLACK = 1e-9


def rotation(dimensions: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(31).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


class Tree:
    """Median splits of a block's coordinates, fitted on a sample.

    Leaves are numbered from left to right.  A node is (coordinate, value,
    first leaf, last leaf); its children are the next node and ``right``.
    """

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.axis, self.value, self.first, self.last, self.right = [], [], [], [], []
        self._grow(sample, 0, leaves if len(sample) else 1)
        self.axis, self.value, self.first, self.last, self.right = map(np.array, (self.axis, self.value, self.first, self.last, self.right))
        self.leaves = int(self.last[0]) + 1

    def _grow(self, rows: np.ndarray, first: int, leaves: int) -> None:
        node = len(self.axis)
        for column, x in ((self.axis, -1), (self.value, 0.0), (self.first, first), (self.last, first + leaves - 1), (self.right, -1)):
            column.append(x)
        if leaves == 1:
            return
        low = leaves // 2
        axis = int(np.argmax(rows.std(0))) if len(rows) else 0
        value = float(np.quantile(rows[:, axis], low / leaves)) if len(rows) else 0.0
        on = rows[:, axis] >= value
        self.axis[node], self.value[node] = axis, value
        self._grow(rows[~on], first, low)
        self.right[node] = len(self.axis)
        self._grow(rows[on], first + low, leaves - low)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Leaves of rows."""
        node = np.zeros(len(x), np.int64)
        while True:
            at = np.flatnonzero(self.axis[node] >= 0)
            if not len(at):
                return self.first[node]
            up = x[at, self.axis[node[at]]] >= self.value[node[at]]
            node[at] = np.where(up, self.right[node[at]], node[at] + 1)

    def bound(self, low: np.ndarray, high: np.ndarray) -> None:
        """Boxes of all nodes from those of the leaves; an empty leaf's is inside out."""
        self.low, self.high = (np.empty((len(self.axis), low.shape[1])) for _ in range(2))
        for node in range(len(self.axis) - 1, -1, -1):
            if self.axis[node] < 0:
                self.low[node], self.high[node] = low[self.first[node]], high[self.first[node]]
            else:
                self.low[node] = np.minimum(self.low[node + 1], self.low[self.right[node]])
                self.high[node] = np.maximum(self.high[node + 1], self.high[self.right[node]])

    def visits(self, x: np.ndarray, home: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf after the row's own within its budget."""
        rows, leaves, waiting = [], [], [(0, np.arange(len(x)))]
        while waiting:
            node, at = waiting.pop()
            at = at[home[at] < self.last[node]]
            if len(at) and (self.low[node] <= self.high[node]).all():
                gap = np.maximum(self.low[node] - x[at], 0) + np.maximum(x[at] - self.high[node], 0)
                at = at[(gap**2).sum(1) <= budget]
                if len(at) and self.axis[node] < 0:
                    rows.append(at)
                    leaves.append(np.full(len(at), self.first[node]))
                elif len(at):
                    waiting += [(node + 1, at), (int(self.right[node]), at)]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _forest(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join trees of ``parent``, which is updated."""
    used = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = x, y
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[max(i, j)] = min(i, j)
            used.append((x, y))
    return used


def units(raw: list[bytes], dimensions: int, kind: str) -> np.ndarray:
    """Unit vectors of raw ones, shorter ones filled up with zeros.  Scaled by
    the largest component first, so that no square over- or underflows."""
    out = np.zeros((len(raw), dimensions))
    size = dimensions * np.dtype(kind).itemsize
    if all(len(r) == size for r in raw):
        out[:] = np.frombuffer(b"".join(raw), kind).reshape(len(raw), dimensions)
    else:
        for i, r in enumerate(raw):
            v = np.frombuffer(r, kind)
            out[i, : len(v)] = v
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


class Join:
    """What all tasks know: rotation, blocks, budgets and, per block, the tree."""

    def __init__(self, dimensions: int, cosine: float, kind: str) -> None:
        self.dimensions, self.cosine, self.kind = dimensions, cosine, kind
        self.blocks = max(1, round(dimensions / BLOCK_DIMENSIONS))
        self.cuts = np.linspace(0, dimensions, self.blocks + 1).round().astype(int)
        self.budget = (2 - 2 * cosine) * np.diff(self.cuts) / dimensions + SLACK
        self.turn = rotation(dimensions)
        self.trees: list[Tree] = []

    def own(self, block: int) -> slice:
        return slice(self.cuts[block], self.cuts[block + 1])

    def turned(self, raw: list[bytes]) -> np.ndarray:
        return units(raw, self.dimensions, self.kind) @ self.turn

    def fit(self, vectors: DataFrame) -> None:
        """Trees from a bounded sample, chosen by a hash of the id, then the
        exact boxes of their leaves: some 16 numbers a leaf and block reach the
        driver, for LEAF_ROWS rows each."""
        rows = vectors.count()
        leaves = max(1, round(rows / LEAF_ROWS))
        sample = np.zeros((0, self.dimensions))
        if leaves > 1:
            share = min(1.0, SAMPLE_ROWS / rows)
            chosen = vectors.where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "vector").toArrow().sort_by("id")
            sample = self.turned(chosen.column("vector").to_pylist()) if chosen.num_rows else sample
        self.trees = [Tree(sample[:, self.own(b)], leaves) for b in range(self.blocks)]
        self.first = np.cumsum([0, *(t.leaves for t in self.trees)])  # places: leaves of all blocks
        if leaves == 1:
            return

        def boxes(batches):
            low = [np.full((t.leaves, w), np.inf) for t, w in zip(self.trees, np.diff(self.cuts), strict=True)]
            high = [-x for x in low]
            for batch in batches:
                x = self.turned(batch.column("vector").to_pylist())
                for b, t in enumerate(self.trees):
                    leaf = t.leaf(x[:, self.own(b)])
                    np.minimum.at(low[b], leaf, x[:, self.own(b)])
                    np.maximum.at(high[b], leaf, x[:, self.own(b)])
            yield box_rows((self.first[b] + k, low[b][k], high[b][k]) for b in range(self.blocks) for k in np.flatnonzero(low[b][:, 0] <= high[b][:, 0]).tolist())

        def box_rows(rows):
            rows = list(rows)
            return pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows], pa.int32()), *(pa.array([r[k].astype("<f8").tobytes() for r in rows], pa.binary()) for k in (1, 2))], names=["place", "low", "high"])

        def least(batches):
            found: dict[int, list] = {}
            for batch in batches:
                for place, low, high in zip(*(batch.column(c).to_pylist() for c in ("place", "low", "high")), strict=True):
                    low, high = np.frombuffer(low, "<f8"), np.frombuffer(high, "<f8")
                    old = found.get(place)
                    found[place] = [np.minimum(old[0], low), np.maximum(old[1], high)] if old else [low, high]
            yield box_rows((p, *x) for p, x in found.items())

        schema = "place int, low binary, high binary"
        found = vectors.select("vector").mapInArrow(boxes, schema).repartition("place").mapInArrow(least, schema).collect()
        for b, t in enumerate(self.trees):
            low = np.full((t.leaves, self.cuts[b + 1] - self.cuts[b]), np.inf)
            high = -low
            for r in found:
                if self.first[b] <= r.place < self.first[b + 1]:
                    low[r.place - self.first[b]], high[r.place - self.first[b]] = np.frombuffer(r.low, "<f8"), np.frombuffer(r.high, "<f8")
            t.bound(low, high)

    def places(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, visitor) of every row's own leaves and those it visits."""
        x = self.turned(raw)
        out = []
        for b, t in enumerate(self.trees):
            part = x[:, self.own(b)]
            home = t.leaf(part)
            out.append((np.arange(len(x)), home + self.first[b], np.zeros(len(x), bool)))
            if t.leaves > 1:
                # boxes and rows are computed alike, so a row lies in its own box; SLACK covers the distance's rounding
                row, leaf = t.visits(part, home, self.budget[b] + SLACK)
                out.append((row, leaf + self.first[b], np.ones(len(row), bool)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _dealt(vectors: DataFrame, join: Join) -> DataFrame:
    """Each vector at its own leaf in every block, and at those in reach after it."""

    def deal(batches):
        for batch in batches:
            row, place, visitor = join.places(batch.column("vector").to_pylist())
            for k in range(0, len(row), 512):
                part = batch.take(pa.array(row[k : k + 512]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[k : k + 512], pa.int32()), pa.array(visitor[k : k + 512]), *(part.column(c) for c in ("id", "copies", "width", "vector"))],
                    names=["place", "visitor", "id", "copies", "width", "vector"],
                )

    return vectors.mapInArrow(deal, "place int, visitor boolean, id bigint, copies bigint, width int, vector binary")


def _links(vectors: DataFrame, join: Join) -> DataFrame:
    """(id, links, other): sums of links by id (other null), and forest edges
    (links 0), over the distinct vectors (id, copies, width, vector)."""
    cosine, budget, turn, cuts = join.cosine, join.budget, join.turn, join.cuts

    def meet(batches):
        """One leaf after another: home rows first, then visitors in batches."""
        place, home, parent, links, edges = None, [], [], {}, []
        held: dict[str, np.ndarray] = {}

        def load(rows):
            v = units([r[3] for r in rows], join.dimensions, join.kind)
            return {"id": np.array([r[0] for r in rows], np.int64), "copies": np.array([r[1] for r in rows], np.int64), "width": np.array([r[2] for r in rows]), "unit": v, "turned": v @ turn}

        def compare(left, right, same: bool):
            """Links of left rows with right rows; with themselves if ``same``."""
            b = int(np.searchsorted(join.first, place, "right")) - 1
            own = join.own(b)
            step = max(1, (1 << 21) // max(1, len(right["id"])))

            def raised(rows, turned: bool):
                """Rows whose products are minus half the squared distance."""
                x = rows["turned"][:, own]
                half, one = (x**2).sum(1, keepdims=True) / -2, np.ones((len(x), 1))
                return np.hstack([x, one, half] if turned else [x, half, one]).astype(np.float32)

            x, y = raised(left, False), raised(right, True).T.copy()
            for k in range(0, len(x), step):
                # single precision with room to spare; the exact distances follow
                at = np.flatnonzero(x[k : k + step] @ y >= np.float32(-budget[b] / 2 - 1e-5))
                i, j = at // y.shape[1] + k, at % y.shape[1]
                if same:
                    on = i < j
                    i, j = i[on], j[on]
                for m in range(0, len(i), 1 << 16):
                    p, q = i[m : m + (1 << 16)], j[m : m + (1 << 16)]
                    on = np.einsum("ij,ij->i", left["unit"][p], right["unit"][q]) >= cosine
                    on &= left["width"][p] == right["width"][q]
                    on &= ((left["turned"][p][:, own] - right["turned"][q][:, own]) ** 2).sum(1) <= budget[b]
                    p, q = p[on], q[on]
                    for e in range(b):  # an earlier block within its budget has counted the pair
                        part = slice(cuts[e], cuts[e + 1])
                        gap = left["turned"][p][:, part] - right["turned"][q][:, part]
                        later = (gap**2).sum(1) > budget[e]
                        p, q = p[later], q[later]
                    yield p, q

        def count(ids, counts):
            for i, n in zip(ids.tolist(), counts.tolist(), strict=True):
                if n:
                    links[i] = links.get(i, 0) + int(n)

        def settle():
            """All home rows are there: links among them."""
            held.update(load(home))
            parent[:] = range(len(home))
            total = np.zeros(len(home), np.int64)
            for p, q in compare(held, held, True):
                np.add.at(total, p, held["copies"][q])
                np.add.at(total, q, held["copies"][p])
                edges.extend((int(held["id"][x]), int(held["id"][y])) for x, y in _forest(p, q, parent))
            count(held["id"], total)

        def visit(rows):
            guest = load(rows)
            n = len(home)
            roots = [*parent, *range(n, n + len(rows))]
            at_home, abroad = np.zeros(n, np.int64), np.zeros(len(rows), np.int64)
            for p, q in compare(guest, held, False):
                np.add.at(abroad, p, held["copies"][q])
                np.add.at(at_home, q, guest["copies"][p])
                edges.extend((int(guest["id"][x - n]), int(held["id"][y])) for x, y in _forest(p + n, q, roots))
            count(held["id"], at_home)
            count(guest["id"], abroad)
            parent[:] = roots[:n]

        def record():
            rows = [(i, n, None) for i, n in links.items()] + [(a, 0, b) for a, b in edges]
            links.clear()
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["id", "links", "other"])

        guests, settled = [], False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("place", "visitor", "id", "copies", "width", "vector")]
            for at, visitor, *row in zip(*columns, strict=True):
                if at != place:
                    if place is not None:
                        if not settled:
                            settle()
                        if guests:
                            visit(guests)
                    place, home, guests, settled = at, [], [], False
                if not visitor:
                    home.append(row)
                    continue
                if not settled:
                    settle()
                    settled = True
                guests.append(row)
                if len(guests) >= 1024:
                    visit(guests)
                    guests = []
            if len(links) + len(edges) > 200_000:
                yield record()
        if place is not None:
            if not settled:
                settle()
            if guests:
                visit(guests)
        yield record()

    placed = _dealt(vectors, join).repartitionById(int(join.first[-1]), F.col("place")).sortWithinPartitions("place", "visitor")
    return placed.mapInArrow(meet, "id bigint, links bigint, other bigint")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """id, n_links, component_id, kept: one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing and are their own component; vectors of different
    lengths never link.  Rows with equal vectors link with one another, rows
    that repeat an id too.  Rows with a null id link like others; a component's
    id is null only if all its ids are.  Kept are the rows with the component's
    id.  An empty table gives an empty one.  Other columns aren't read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    single = isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"

    def read(batches):
        for batch in batches:
            digest, raw, width = [], [], []
            for x in batch.column("vector").to_pylist():
                v = np.array([np.nan if c is None else c for c in x], kind) if x else np.zeros(0, kind)
                fine = len(v) > 0 and bool(np.isfinite(v).all()) and bool((v != 0).any())
                v = v + np.zeros(1, kind)  # -0 and 0 are one value
                digest.append(hashlib.sha256(v.tobytes()).digest() if fine else None)
                raw.append(v.tobytes() if fine else None)
                width.append(len(v) if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digest, pa.binary()), pa.array(width, pa.int32()), pa.array(raw, pa.binary())], names=["id", "digest", "width", "vector"])

    source = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    rows = materialise(source.mapInArrow(read, "id bigint, digest binary, width int, vector binary").withColumn("row", F.monotonically_increasing_id()), "vectors")
    known = rows.where("digest is not null")
    # a class of equal vectors is known by its first row's number, as ids can be null or repeat
    classes = known.groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("first"), F.count("*").alias("copies"), F.first("width").alias("width"), F.first("vector").alias("vector"))
    classes = materialise(classes, "vector-classes")
    dimensions = classes.agg(F.max("width")).first()[0]
    alone = rows.where("digest is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = alone
    if dimensions is not None:
        join = Join(dimensions, cosine, kind)
        distinct = classes.select(F.col("node").alias("id"), "copies", "width", "vector")
        join.fit(distinct)
        found = materialise(_links(distinct, join), "vector-links")
        links = found.where("other is null").groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
        labels = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "node")
        group = classes.select("digest", "node", "first", "copies").join(links, "node", "left").join(labels, "node", "left").select(
            "digest", "first", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")
        )
        group = materialise(group, "vector-groups", small=True)
        named = group.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
        by_class = materialise(join_counted(group, named, "component", "n", group.count()).select("digest", "copies", "n_links", "component_id"), "vector-named", small=True)
        linked = join_counted(known.select("id", "digest"), by_class, "digest", "copies", known.count()).select("id", "n_links", "component_id")
        out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
