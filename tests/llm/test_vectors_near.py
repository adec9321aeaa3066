"""Cover trees and KD-trees against all pairs."""

import numpy as np
import pytest

from strandline.llm import covertree, kdtree
from pyspark.sql import functions as F


def cloud(seed, width=6):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(60, width))]
    for spread, n in ((0.05, 30), (0.12, 40), (0.3, 40), (1e-4, 20)):
        parts.append(rng.normal(size=(1, width)) * rng.uniform(0.1, 9) + spread * rng.normal(size=(n, width)))
    parts.append(np.repeat(rng.normal(size=(2, width)), 15, axis=0))
    out = np.concatenate(parts)
    return out[rng.permutation(len(out))]


def brute(points, least):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    label = np.arange(len(points))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(points)).min(1))
        if (new == label).all():
            return near.sum(1), label
        label = new


@pytest.mark.parametrize("seed,shard,centers", [(1, 4096, 1), (2, 20, 8), (3, 50, 3)])
def test_links(spark, shared, seed, shard, centers):
    points = cloud(seed)
    counts, labels = brute(points, 0.95)
    df = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(points)], "vec_id long, embedding array<double>, n int")
    got = covertree.near_vectors(df, shard_rows=shard, centers=centers).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id, r.kept) for r in got] == [
        (int(n), int(x), i == x) for i, (n, x) in enumerate(zip(counts, labels))]


def test_tree_covers_and_halves():
    points = cloud(4)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    tree = covertree.CoverTree(unit, np.arange(len(unit)), np.ones(len(unit), int))
    assert sorted(tree.ids) == list(range(len(unit)))
    for node, (first, last) in enumerate(tree.spans):
        gaps = np.linalg.norm(tree.points[first:last] - tree.points[tree.centers[node]], axis=1)
        assert gaps.max() <= tree.radii[node] + 1e-9
        for child in tree.children[node]:
            assert first <= tree.spans[child][0] and tree.spans[child][1] <= last


def test_vector_edges(spark, shared):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (2, [2.0, 0.0]), (10, [1e-300, 0.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, covertree.near_vectors(df).collect()), key=repr)
    lone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (10, 3, 1, False), (None, 0, None, None), *lone], key=repr)
    assert covertree.near_vectors(df.limit(0)).collect() == []
    top = kdtree.top_products(df, F.lit(True), k=2).collect()
    assert {r.query_id for r in top} == {1, 2, 3, 10, 11} and all(r.query_id != r.vec_id for r in top)
    assert kdtree.top_products(df.limit(0), F.lit(True)).collect() == []


@pytest.mark.parametrize("seed,shard,block,leaf", [(1, 2048, 4096, 64), (2, 30, 7, 4), (3, 10, 50, 1)])
def test_top_products(spark, shared, seed, shard, block, leaf):
    points = cloud(seed)
    whole = np.floor(256 * points).astype(int)
    df = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(points)], "vec_id long, embedding array<double>, score int")
    got = kdtree.top_products(df, F.col("vec_id") % 5 == 0, shard_rows=shard, block_rows=block, leaf=leaf).collect()
    scores = whole @ whole.T
    expected = []
    for q in range(0, len(points), 5):
        best = sorted((-scores[q, i], i) for i in range(len(points)) if i != q)[:5]
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(expected)


def whole(x):
    return int(np.floor(np.float64(256) * np.float64(x)))


@pytest.mark.parametrize("scale", [1.0, 1e6, 3e6])
@pytest.mark.parametrize("shard", [4096, 8])
def test_scores_of_huge_components(spark, shared, scale, shard):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=5) * scale).tolist()) for i in range(40)]
    if scale == 1e6:
        rows += [(101, [1e6, 0.0, 0.0, 0.0, 0.0]), (102, [6e5, 0.0, 0.0, 0.0, 0.0]), (150, [9e5, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in kdtree.top_products(
        df, F.col("vec_id") % 10 == 0, shard_rows=shard, leaf=4).collect()}
    cells = {i: [whole(x) for x in v] for i, v in rows}
    for query in (i for i in cells if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(cells[query], v)), i) for i, v in cells.items() if i != query)[:5]
        assert [got[query, n + 1] for n in range(5)] == [(i, -score) for score, i in best]


def test_probe_of_large_components(spark, shared):
    df = spark.createDataFrame([(0, [1e6, 0.0]), (1, [6e5, 0.0]), (2, [9e5, 0.0])], "vec_id long, embedding array<double>")
    got = kdtree.top_products(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 58982400000000000), (1, 39321600000000000)]


def test_scores_beyond_a_long(spark, shared):
    small = [(0, [1e13, 1.0]), (1, [1.0, -3.0]), (2, [1e-3, 5.0])]
    got = kdtree.top_products(spark.createDataFrame(small, "vec_id long, embedding array<double>"), F.col("vec_id") == 1).collect()
    cells = {i: [whole(x) for x in v] for i, v in small}
    assert {(r.vec_id, r.score) for r in got} == {(i, sum(a * b for a, b in zip(cells[1], cells[i]))) for i in (0, 2)}
    df = spark.createDataFrame([(0, [1e30, 0.0]), (1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a 64-bit integer"):
        kdtree.top_products(df, F.col("vec_id") == 0).collect()
