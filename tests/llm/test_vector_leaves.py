"""Leaves of several members about the least cosine apart."""

import signal

import numpy as np
import pytest

from strandline.llm import covertree
from test_vectors_near import brute


@pytest.fixture
def limited():
    """Fail instead of running for ever."""
    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(60)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


def leaves(sizes, width=5, seed=1):
    """Groups of vectors within 1e-7 of each other, the others at a cosine of about 0.95 to the first."""
    rng = np.random.default_rng(seed)
    parts = []
    for k, size in enumerate(sizes):
        center = np.zeros(width)
        center[0], center[max(k, 1)] = (0.95, (1 - 0.95 ** 2) ** 0.5) if k else (1, 0)
        parts.append((center + rng.uniform(-1e-7, 1e-7, (size, width))) * rng.uniform(0.5, 2, (size, 1)))
    return np.concatenate(parts)


@pytest.mark.parametrize("sizes", [(12, 15), (1, 20, 9), (40, 1, 30, 12), (9, 10)])
def test_leaves_of_several(limited, monkeypatch, sizes):
    monkeypatch.setattr(covertree, "BLOCK", 7, raising=False)
    points = leaves(sizes)
    unit = covertree._unit(list(points))
    rng = np.random.default_rng(2)
    weights = rng.integers(1, 4, len(unit))
    ids = np.arange(len(unit))
    near = unit @ unit.T >= 0.95
    assert 0 < near[:sizes[0], sizes[0]:].sum() < near[:sizes[0], sizes[0]:].size
    for cut in (0, sizes[0]):      # one tree, and two of which the first is a single leaf
        if cut:
            a, b = (covertree.CoverTree(unit[at], ids[at], weights[at]) for at in (slice(0, cut), slice(cut, None)))
            expected = np.concatenate([near[:cut, cut:] @ weights[cut:], near[cut:, :cut] @ weights[:cut]])
        else:
            a = b = covertree.CoverTree(unit, ids, weights)
            expected = near @ weights - weights
        links = covertree.Links(a, b, 0.95)
        links.run()
        rows = links.rows()
        got = dict(zip(rows["id"], rows["n"]))
        assert [got.get(i, 0) for i in ids] == expected.tolist()
        for i, root in zip(rows["id"], rows["root"]):
            assert root in got or root == i


def test_links_of_leaves(limited, spark, shared):
    points = leaves((12, 15, 30))
    counts, labels = brute(points, 0.95)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = covertree.near_vectors(df).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id) for r in got] == [(int(n), int(x)) for n, x in zip(counts, labels)]
