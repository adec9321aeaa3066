"""Benchmark passages against a scan of every place of every document."""

import random
import re
from hashlib import sha256

import pytest

from strandline.llm import decontamination as d


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def phrases(items, size):
    out = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            out.setdefault(tuple(w[i:i + size]), set()).add(item)
    return out


def expected(docs, items, size):
    known, out = phrases(items, size), []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for i in range(len(w)):
            for n in {len(p) for p in known}:
                if tuple(w[i:i + n]) in known and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    named |= known[tuple(w[i:i + n])]
        ids = sorted(str(x) for x in named if x is not None)
        out.append((doc, len(w), len(hit), len(ids), sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame([(*r, 1, "w", 2) for r in docs], "doc_id long, text string, n int, word string, pos int").repartition(4),
            spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, window int, n int"))


def made(seed, n):
    rng = random.Random(seed)
    letters = ["a", "B", "c", "é", "7", "dd"]
    def prose(k):
        return "".join(rng.choice(letters) + rng.choice([" ", ", ", "\n", " -- "]) for _ in range(k))
    items = [(i, prose(rng.randint(0, 9))) for i in range(12)] + [(3, "a b c é"), (40, None), (41, ""), (42, "..."), (None, "dd dd dd dd")]
    items += [(100 + i, "zz yy xx ww vv") for i in range(30)]
    docs = [(i, prose(rng.randint(0, 40))) for i in range(n)] + [(i, f"{prose(5)} zz YY xx ww vv. {prose(3)}") for i in range(n, n + 20)]
    docs += [(1, "é a B c é dd"), (None, "dd dd dd dd dd"), (None, None), (n + 50, ""), (n + 51, "\0a\0b")] + [(9, "a b c é a b c é")] * 5
    return docs + [(n + 60, "x " * 5000 + "zz yy xx ww vv " + "a " * 5000)], items


@pytest.mark.parametrize("seed, size", [(1, 4), (2, 3), (3, 1)])
def test_contamination(spark, shared, seed, size):
    docs, items = made(seed, 80)
    got = d.contamination(*frames(spark, docs, items), size)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(docs, items, size)


def test_empty_tables(spark, shared):
    docs, items = made(5, 10)
    some, bench = frames(spark, docs, items)
    assert d.contamination(some.limit(0), bench).collect() == []
    got = d.contamination(some, bench.limit(0))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(docs, [], 10)


def test_shuffled_beyond_the_broadcast_limit(spark, shared, monkeypatch):
    from strandline.plans import sizing
    docs, items = made(7, 60)
    monkeypatch.setattr(sizing, "text_bytes", lambda df: 1 << 40)
    got = d.contamination(*frames(spark, docs, items), 4)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(docs, items, 4)


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity(spark, shared, slop):
    rng = random.Random(slop)
    docs = [(i, " ".join(rng.choices("abcdefg", [9, 5, 4, 3, 3, 2, 2], k=30))) for i in range(40)]
    items = [(0, "a b c"), (1, "g a b"), (2, "f e d a")]
    some, bench = frames(spark, docs, items)
    windows = d.windows_of(bench, 4)
    index = d.index_texts(some, d.terms_of(windows))
    got = {(tuple(r.phrase), r.doc_id, r.start) for r in d.occurrences(index, windows, slop).join(
        windows.select("window", "phrase"), "window").collect()}
    every = [w for _, t in docs for w in words(t)]
    wanted = set()
    for _, text in items:
        p = words(text)
        rare = min(range(len(p)), key=lambda i: (every.count(p[i]), i))
        for doc, body in docs:
            w = words(body)
            for at in range(len(w)):
                start = at - rare
                if w[at] == p[rare] and start >= -slop and all(
                        i == rare or p[i] in w[max(start + i - slop, 0):max(start + i + slop + 1, 0)] for i in range(len(p))):
                    wanted.add((tuple(p), doc, start))
    assert got == wanted and got


def test_no_python(spark, shared):
    docs, items = made(8, 10)
    plan = d.contamination(*frames(spark, docs, items), 4)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
