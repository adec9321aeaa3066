"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from conftest_tables import text_rows
from strandline.llm import jaccard


def groups_of(texts, words, percent):
    """Number of shingles and smallest linked row, by comparing every pair."""
    sets = []
    for text in texts:
        found = (text or "").encode().lower().split()
        sets.append({tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def family(rng, size, words, edits):
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"e{rng.randint(0, 10 ** 6)}"
        out.append(" ".join(copy))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one", "One", "one two", "a b c d", "A B C D", "a b c e", "é à ü ö", "É à ü ö"]
    passage = " ".join(f"p{i}" for i in range(60))
    for size, words, edits in ((40, 120, 4), (15, 60, 2), (30, 300, 20), (5, 30, 1), (60, 80, 3)):
        texts += family(rng, size, words, edits)
    texts += [passage + " " + " ".join(f"u{rng.randint(0, 10 ** 6)}" for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += texts[20:40] * 3
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,words,percent,rows", [(1, 4, 85, 256), (2, 5, 80, 16), (3, 2, 90, 7)])
def test_groups(spark, shared, seed, words, percent, rows):
    texts = corpus(seed)
    got = jaccard.near_groups(text_rows(spark, texts).repartition(5), words, percent, region_rows=rows)
    assert sorted(map(tuple, got.collect())) == groups_of(texts, words, percent)


def test_no_shingle_known_to_be_frequent(spark, shared, monkeypatch):
    monkeypatch.setattr(jaccard, "frequent_shingles", lambda *a: np.zeros(0, np.uint64))
    texts = corpus(4)
    got = jaccard.near_groups(text_rows(spark, texts), 4, 85, region_rows=32)
    assert sorted(map(tuple, got.collect())) == groups_of(texts, 4, 85)


def test_region_recursion():
    rng = random.Random(5)
    texts = [t for k in range(12) for t in family(rng, 25, 100, 6)]
    sets = jaccard.shingle_sets(texts, 4)
    region = jaccard.Region(range(len(texts)), sets, range(len(texts)), jaccard.Bounds(85, 30))
    region.join(np.arange(len(texts)), leaf=8, pivots=12)
    assert [region.root(i) for i in range(len(texts))] == [r for _, _, r in groups_of(texts, 4, 85)]


@pytest.mark.parametrize("percent,lead", [(85, 30), (80, 30), (95, 20), (50, 80)])
def test_leads_share_enough(percent, lead):
    bounds = jaccard.Bounds(percent, lead)
    for a in range(1, 120):
        for b in range(a, 120):
            common = -(-percent * (a + b) // (100 + percent))
            if common <= a:
                least = min(int(bounds.lead_size(np.array([x]))[0]) - x + common for x in (a, b))
                assert bounds.shared(np.array([a]))[0] <= least and bounds.shared(np.array([b]))[0] <= least
            assert bounds.shared(np.array([a]))[0] >= 1


def test_edges_of_the_domain(spark, shared):
    rows = [(5, "a b c d e f", 1), (None, "a b c d e f", 2), (3, "a b c d e f", 3), (3, "a b c d e f", 3),
            (5, "x y z u v w", 4), (9, "x y z u v w", 5), (7, None, 6), (None, None, 7), (11, "q " * 5000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted(map(tuple, jaccard.near_groups(docs, 4, 85).collect()), key=repr)
    assert got == sorted([(5, 3, 3), (None, 3, None), (3, 3, 3), (3, 3, 3), (5, 3, 3), (9, 3, 3), (7, 0, 7),
                          (None, 0, None), (11, 1, 11)], key=repr)
    assert jaccard.near_groups(docs.limit(0), 4, 85).collect() == []
