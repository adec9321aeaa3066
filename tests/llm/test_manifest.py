"""Manifests against trees hashed level by level, closed-form places against a list of nodes."""

import random
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strandline.llm import manifest
from strandline.llm.queries import op13_merkle_manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest int, tree string, path string"


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def by_levels(leaves, arity=3):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i:i + arity]) for i in range(0, len(found[-1]), arity)])
    return found


def path(found, at, arity=3):
    out = []
    for nodes in found[:-1]:
        first = at // arity * arity
        out.append((nodes[first:at], nodes[at + 1:first + arity]))
        at //= arity
    return out


def expected(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for source in order:
        trees[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[source] = by_levels([leaf(r) for r in trees[source]])
    top = by_levels([built[s][-1][0] for s in order])
    out = []
    for n, source in enumerate(order):
        for at, row in enumerate(trees[source]):
            steps = path(built[source], at) + path(top, n)
            other = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                other = (*row[:4], row[4].replace("\n", ""))
            node = leaf(other)
            for before, after in steps:
                node = h(*before, node, *after)
            out.append((row[0], leaf(row), built[source][-1][0], top[-1][0], h(*(x for b, a in steps for x in [*b, *a])),
                        node, node == top[-1][0]))
    return sorted(out, key=repr)


@given(st.integers(1, 200))
@settings(max_examples=60, deadline=None)
def test_places_are_those_of_the_appender(leaves):
    digests = [bytes([i % 256]) * 32 for i in range(leaves)]
    nodes = manifest.grown(digests, manifest.levels(leaves))
    assert [manifest.place_of(level, index, leaves) for level, index, _ in nodes] == list(range(len(nodes)))
    assert nodes[-1][2].hex() == by_levels([d.hex() for d in digests])[-1][0]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_audit(spark, shared, height):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "é", "=", ""]), rng.choice(["en", None]), i if i % 5 else None, f"x\n{i}" * (i % 3), 1, "t", "p")
            for i in range(150)]
    rows += [(i, None, None, None, None, 1, "t", "p") for i in range(10)] + [(500, "one", "en", 1, "\n" * 50_000 + "é", 1, "t", "p")]
    rows += [(7, "a", "en", 1, "same", 1, "t", "p")] * 30 + [(None, "b", "en", 1, "no\nkey", 1, "t", "p"), (None, None, None, None, None, 1, "t", "p")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = manifest.audit(docs, FIELDS, {"text": F.replace("text", F.lit("\n"), F.lit(""))},
                         F.crc32(F.col("doc_id").cast("string")) % 2 == 0, height=height)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_log_holds_the_appenders_nodes(spark, shared):
    leaves = [(t, i, sha256(f"{t}{i}".encode()).digest()) for t, n in (("x", 100), ("y", 1), ("z", 27)) for i in range(n)]
    built = manifest.build(spark.createDataFrame(leaves, "tree string, n long, digest binary"), ["n"], height=2)
    for tree, n in (("x", 100), ("y", 1), ("z", 27)):
        rows = sorted((r.start, bytes(r.nodes)) for r in built.log.where(F.col("tree") == tree).collect())
        whole = b"".join(nodes for _, nodes in rows)
        own = [d for t, _, d in leaves if t == tree]
        assert whole == b"".join(d for _, _, d in manifest.grown(own, manifest.levels(n)))
        assert [start for start, _ in rows] == [sum(len(b) for _, b in rows[:i]) // 32 for i in range(len(rows))]


def test_empty(spark, shared):
    none = spark.createDataFrame([], SCHEMA)
    assert manifest.audit(none, FIELDS, {}, F.lit(False)).collect() == []


def test_query(spark, shared):
    from conftest_tables import TABLES
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select(FIELDS).collect()]
    got = op13_merkle_manifest(spark, str(TABLES))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)
