"""Embedding near-duplicates against brute force in double precision."""

import collections

import numpy as np
import pytest

from codemap_spark.llm import embedding_dedup


def truth(x):
    """(links, component) of every row of finite, non-zero vectors."""
    x = np.asarray(x, float)
    x = x / np.abs(x).max(1, keepdims=True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(label, np.where(links, label, len(x)).min(1))
        if (new == label).all():
            break
        label = new
    return links.sum(1), label


def vectors(seed, n=300):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64))
    near = [x[:60] + rng.standard_normal((60, 64)) * 0.45, x[:20], np.repeat(x[5:6], 40, 0) + rng.standard_normal((40, 64)) * 0.3]
    # chains whose steps link and whose ends don't
    chain = [x[100] + k * 0.3 * x[101] for k in range(30)]
    return np.vstack([x, *near, chain]).astype(np.float32)


@pytest.mark.parametrize("leaf_rows, kind", [(1 << 15, "float"), (40, "float"), (13, "double")])
def test_like_brute_force(spark, monkeypatch, leaf_rows, kind):
    monkeypatch.setattr(embedding_dedup, "LEAF_ROWS", leaf_rows)
    x = vectors(4)
    odd = [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [1.0, None])]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], f"vec_id long, embedding array<{kind}>, place int, digest string").repartition(3)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    links, label = truth(x)
    assert found == {i: (int(links[i]), int(label[i]), bool(label[i] == i)) for i in range(len(x))} | {i: (0, i, True) for i, _ in odd}


def test_clusters_are_pruned(spark, monkeypatch):
    """Of vectors in tight, distant clusters each visits few leaves, and none is lost."""
    monkeypatch.setattr(embedding_dedup, "LEAF_ROWS", 20)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((40, 64)), 20, 0) + rng.standard_normal((800, 64)) * 0.05
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links, label = truth(x)
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert found == {i: (int(links[i]), int(label[i])) for i in range(len(x))}
    join = embedding_dedup.Join(64, 0.9, "<f8")
    rows = df.selectExpr("vec_id id", "1L copies", "64 width", "embedding").rdd.map(lambda r: (r.id, r.copies, r.width, bytearray(np.array(r.embedding, "<f8").tobytes())))
    source = spark.createDataFrame(rows, "id long, copies long, width int, vector binary")
    join.fit(source)
    dealt = embedding_dedup._dealt(source, join).count()
    assert join.first[-1] == 160 and dealt < 800 * 4 * 8


def test_edges(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(5, [1.0, 0.0]), (4, [1e-200, 0.0]), (3, [1e200, 1e150]), (None, [2.0, 0.01]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (6, [1.0, 0.0, 0.0]), (5, [1.0, 0.0]), (None, None), (8, [5e-324, 0.0])]
    found = collections.Counter(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert found == {(5, 5, 3, False): 2, (4, 5, 3, False): 1, (3, 5, 3, True): 1, (8, 5, 3, False): 1, (None, 5, 3, False): 1, (None, 1, None, True): 2, (6, 0, 6, True): 1, (None, 0, None, True): 1}
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([(1, None)], schema)).collect()[0].kept
