"""What the comparison of many shards writes, and its links over lists of shards and shortened vectors."""

import numpy as np
import pytest

from strandline.llm import covertree
from test_vectors_near import brute, cloud


def shuffled(spark) -> int:
    """Bytes of shuffle that this session has written so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def table(spark, points, kind="double"):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], f"vec_id long, embedding array<{kind}>")


def groups(seed, width, lone=300):
    """Lone vectors, and groups on both sides of the least cosine."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(lone, width))]
    for spread, n in ((0.02, 60), (0.2, 60), (0.23, 80), (1e-4, 30)):
        parts.append(rng.normal(size=(1, width)) + spread * rng.normal(size=(n, width)))
    out = np.concatenate([*parts, parts[1][:20], parts[1][:20]])
    return out[rng.permutation(len(out))]


def expected(points):
    counts, labels = brute(points, 0.95)
    return [(i, int(n), int(x), i == x) for i, (n, x) in enumerate(zip(counts, labels))]


def test_vectors_cross_the_network_once(spark, shared):
    """60 shards that all meet: no tree may be sent to each of the others."""
    points = np.random.default_rng(3).normal(size=(3000, 32))
    df = table(spark, points)
    before = shuffled(spark)
    assert len(covertree.near_vectors(df, shard_rows=40, centers=1).collect()) == 3000
    assert shuffled(spark) - before < 2.5 * points.nbytes
    assert not list(shared.rglob("cover-trees-*"))     # the trees are gone


@pytest.mark.parametrize("seed,shard,centers,kind", [(1, 8, 1, "double"), (2, 10, 6, "float"), (3, 60, 4, "float"), (4, 4096, 9, "double")])
def test_lists_of_shards(spark, shared, seed, shard, centers, kind):
    points = groups(seed, 40)
    if kind == "float":
        points = points.astype(np.float32).astype(np.float64)
    got = covertree.near_vectors(table(spark, points, kind), shard_rows=shard, centers=centers).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == expected(points)


@pytest.mark.parametrize("seed", [1, 2])
def test_small_tiles(spark, monkeypatch, seed):
    """Tiles, edges in bulk and tiles in which most pairs are near."""
    points = groups(seed, 40, lone=400)
    unit = covertree._unit(points)
    basis = covertree.short_basis(np.random.default_rng(9).normal(size=(600, 40)) / 40 ** 0.5, 0.95)
    assert basis is not None
    counts = (unit @ unit.T >= 0.95).sum(1) - 1
    for tile, edges in (((256, 1024), 1 << 18), ((7, 11), 5), ((3, 1000), 1)):
        monkeypatch.setattr(covertree, "TILE", tile)
        monkeypatch.setattr(covertree, "EDGES", edges)
        tree = covertree.CoverTree(unit, np.arange(len(unit)), np.ones(len(unit), int))
        tree = covertree.CoverTree.unpack(tree.pack(points), basis)
        links = covertree.Links(tree, tree, 0.95)
        links.run()
        rows = links.rows().set_index("id")
        assert rows["n"].reindex(range(len(unit)), fill_value=0).tolist() == counts.tolist()


def test_shortened_products_are_bounds():
    unit = covertree._unit(cloud(5, width=24))
    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(24, 7)))[0]
    short = covertree.shortened(unit, basis)
    assert np.allclose(np.linalg.norm(short, axis=1), 1)
    assert (short @ short.T >= unit @ unit.T - 1e-12).all()
    assert covertree.short_basis(unit[:100], 0.95) is None       # too few to tell


def test_signed_zeros_and_many_copies(spark, shared):
    """Copies of one vector, more than an Arrow batch, are one class whichever sign their zeros have."""
    rows = [(i, [1.0, -0.0 if i % 2 else 0.0, 0.5]) for i in range(25000)] + [(25000, [0.0, 1.0, 0.0])]
    got = covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=64).collect()
    assert {(r.n_links, r.component_id) for r in got if r.vec_id < 25000} == {(24999, 0)}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id == 25000] == [(0, 25000, True)]


def test_regions_of_equal_rows():
    """A row's region doesn't depend on the batch it comes in."""
    rng = np.random.default_rng(2)
    unit = covertree._unit(rng.normal(size=(400, 64)))
    unit[200:] = unit[:200]
    centers = np.concatenate([unit[:30], unit[:30]])
    whole = covertree._regions(unit, centers)
    assert (whole[200:] == whole[:200]).all() and whole.max() < 30
    for n in (1, 3, 17):
        assert (np.concatenate([covertree._regions(unit[i:i + n], centers) for i in range(0, 400, n)]) == whole).all()
