"""Merkle manifests of datasets: hash trees kept as append logs in postorder.

A tree hashes runs of ``ARITY`` consecutive nodes into their parent until one node remains; the last run
of a level may be shorter. The log of a tree holds a node right behind its last descendant, as an
appender that closes every run as soon as it is full would write it. A node's place in it follows
from its level and index alone (``place_of``).

Builders are aligned: builder ``b`` takes the leaves from ``b * ARITY^height``, so that its nodes are a
whole subtree and lie side by side in the log. What is above the builders' tops is built
the same way, tier upon tier.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.plans.sizing import hinted, lookup_side, settle

ARITY = 3
HEIGHT = 7
DIGEST = 32
SEGMENT = "tree string, block long, start long, nodes binary, top binary"
NODE = "tree string, level int, index long, place long, digest binary"
STEP = "array<struct<before:string,after:string>>"


class Manifest(NamedTuple):
    """``leaves``: the rows with ``tree``, ``index`` and ``block``. ``log``: ``tree``, ``block``, ``start`` and ``nodes``, the
    32-byte digests of the places from ``start`` on, those of the tiers above among them. ``spine``: the nodes from the builders' tops
    upward, by place. ``roots``: ``tree``, ``size``, ``root``."""

    leaves: DataFrame
    log: DataFrame
    spine: DataFrame
    roots: DataFrame
    height: int


def row_text(columns: list[Column]) -> Column:
    """The columns as one text: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of ``row_text`` as 32 bytes."""
    return F.unhex(F.sha2(row_text(columns), 256))


def hex_digest(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def parent(children: list[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def levels(leaves: int, arity: int = ARITY) -> int:
    """Levels above the leaves of a tree of ``leaves`` leaves."""
    found = 0
    while leaves > 1:
        leaves, found = -(-leaves // arity), found + 1
    return found


def place_of(level: int, index: int, leaves: int, arity: int = ARITY) -> int:
    """Place in the log of node ``index`` of ``level``.

    Before its last leaf ``i``, the log holds ``i // arity^l`` nodes of each level ``l``; behind that leaf come the nodes
    that end with it, from the lowest level up.
    """
    last = min((index + 1) * arity ** level, leaves) - 1
    place = level
    while last:
        place, last = place + last, last // arity
    return place


def grown(leaves: list[bytes], height: int, arity: int = ARITY) -> list[tuple[int, int, bytes]]:
    """Level, index and digest of all nodes over ``leaves`` up to level ``height``, in the order they are complete."""
    out, open_runs, counts = [], [[] for _ in range(height + 1)], [0] * (height + 1)

    def append(level: int, digest: bytes) -> None:
        while True:
            out.append((level, counts[level], digest))
            counts[level] += 1
            open_runs[level].append(digest)
            if level == height or len(open_runs[level]) < arity:
                return
            digest, open_runs[level] = parent(open_runs[level]), []
            level += 1

    for leaf in leaves:
        append(0, leaf)
    for level in range(height):
        if open_runs[level]:
            rest, open_runs[level] = open_runs[level], []
            append(level + 1, parent(rest))
    return out


def siblings(level: int, index: int, nodes: int, arity: int = ARITY) -> tuple[list[int], list[int]]:
    """Indices of the others of a node's run, before and behind it; ``nodes`` are on its level."""
    first = index - index % arity
    return list(range(first, index)), list(range(index + 1, min(first + arity, nodes)))


def _numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``index`` in their tree, and the ``size`` of every tree.

    Rows are dealt in ranges of the whole order, so a large tree is spread like many small ones; the rows of the ranges before are
    added up in a table of one row a tree and range. Equal rows are told apart by their place in the settled input.
    """
    keys = ["tree", *order, "__nth"]
    ranged = settle(settle(rows.withColumn("__nth", F.monotonically_increasing_id())).repartitionByRange(
        *[F.asc_nulls_first(k) for k in keys]).sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys]).drop("__nth").withColumns(
        {"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    counts = ranged.groupBy("tree", "__range").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    in_tree = Window.partitionBy("tree").orderBy("__range")
    counts = settle(counts.withColumns({
        "before": F.coalesce(F.sum("n").over(in_tree.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "size": F.sum("n").over(Window.partitionBy("tree"))}))
    placed = ranged.join(hinted(counts.select("tree", "__range", "first", "before", "size")), ["tree", "__range"]).withColumn(
        "index", F.col("before") + F.col("__at") - F.col("first")).drop("__range", "__at", "first", "before")
    return placed, counts.groupBy("tree").agg(F.max("size").alias("size"))


def _segments(height: int, arity: int):
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("index")
        size, block = int(frame["size"].iloc[0]), int(frame["block"].iloc[0])
        nodes = grown(frame["digest"].to_list(), min(height, levels(size, arity)), arity)
        start = place_of(0, block * arity ** height, size, arity)
        return pd.DataFrame({"tree": [frame["tree"].iloc[0]], "block": [block], "start": [start],
                             "nodes": [b"".join(d for _, _, d in nodes)], "top": [nodes[-1][2]]})

    return build


def _tier(level: int, height: int, arity: int):
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("index")
        size, first = int(frame["size"].iloc[0]), int(frame["index"].iloc[0])
        nodes = grown(frame["digest"].to_list(), min(height, levels(size, arity) - level), arity)
        rows = [(frame["tree"].iloc[0], level + up, first // arity ** up + at, d) for up, at, d in nodes]
        return pd.DataFrame([(tree, lv, at, place_of(lv, at, size, arity), d) for tree, lv, at, d in rows],
                            columns=["tree", "level", "index", "place", "digest"])

    return build


def build(leaves: DataFrame, order: list[str], height: int = HEIGHT, arity: int = ARITY) -> Manifest:
    """The manifest of rows with ``tree`` (not null) and ``digest``, in ascending ``order`` (nulls first) inside every tree.

    Rows equal in ``order`` stand in any order. Builders hold ``arity^height`` leaves; the number of tiers is the logarithm
    of the largest tree to that base.
    """
    wide = arity ** height
    placed, sizes = _numbered(leaves, order)
    placed = settle(placed.withColumn("block", F.floor(F.col("index") / wide).cast("long")))
    sizes = lookup_side(sizes)
    segments = settle(placed.select("tree", "block", "index", "size", "digest").groupBy("tree", "block").applyInPandas(
        _segments(height, arity), SEGMENT))
    spine, level = None, height
    tops = segments.join(sizes.where(F.col("size") > wide), "tree").select(
        "tree", F.col("block").alias("index"), "size", F.col("top").alias("digest"))
    while not tops.isEmpty():
        tier = settle(tops.withColumn("__group", F.floor(F.col("index") / wide)).groupBy("tree", "__group").applyInPandas(
            _tier(level, height, arity), NODE))
        whole = tier if spine is None else tier.where(F.col("level") > level)
        spine = whole if spine is None else spine.unionByName(whole)
        level += height
        tops = tier.where(F.col("level") == level).join(sizes, "tree").where(
            F.col("size") > F.lit(arity) ** level).select("tree", "index", "size", "digest")
    if spine is None:
        spine = leaves.sparkSession.createDataFrame([], NODE)
    ends = spine.where(F.col("level") > height).join(sizes, "tree").withColumn("block", F.floor((F.least(
        ((F.col("index") + 1) * F.lit(arity) ** F.col("level")).cast("long"), F.col("size")) - 1) / wide).cast("long"))
    above = ends.groupBy("tree", "block").agg(F.array_sort(F.collect_list(F.struct("level", "digest"))).alias("above"))
    log = segments.drop("top").join(lookup_side(above), ["tree", "block"], "left").withColumn("nodes", F.aggregate(
        F.coalesce("above", F.array()), F.col("nodes"), lambda held, node: F.concat(held, node["digest"]))).drop("above")
    highest = spine.groupBy("tree").agg(F.max_by("digest", "level").alias("root"))
    roots = sizes.join(segments.where("block = 0").select("tree", "top"), "tree").join(highest, "tree", "left").select(
        "tree", "size", F.coalesce("root", "top").alias("root"))
    return Manifest(placed, settle(log), spine, settle(roots), height)


def _addresses(size: int, block: int, height: int, arity: int) -> list[tuple]:
    """Level, whether it stands before the path, and place of the siblings above a builder's top; a run
    of one node has none and still is a step."""
    out = []
    for level in range(height, levels(size, arity)):
        index, nodes = block // arity ** (level - height), -(-size // arity ** level)
        before, behind = siblings(level, index, nodes, arity)
        out += [(level, i < index, place_of(level, i, size, arity)) for i in [*before, *behind]] or [(level, None, None)]
    return out


def _above(manifest: Manifest, arity: int) -> DataFrame:
    """The steps from every builder's top to its root: ``tree``, ``block``, ``above``; only for trees of several builders."""
    height = manifest.height

    def address(frames):
        for frame in frames:
            rows = [(tree, block, *found) for tree, block, size in zip(frame["tree"], frame["block"], frame["size"])
                    for found in _addresses(size, block, height, arity)]
            yield pd.DataFrame(rows, columns=["tree", "block", "level", "before", "place"]).astype(
                {"before": "boolean", "place": "Int64"})

    wanted = manifest.log.select("tree", "block").join(hinted(manifest.roots.select("tree", "size")), "tree").where(
        F.col("size") > arity ** height).mapInPandas(address, "tree string, block long, level int, before boolean, place long")
    found = wanted.join(lookup_side(manifest.spine.select("tree", "place", hex_digest(F.col("digest")).alias("text"))),
                        ["tree", "place"], "left")
    before, after = (F.array_join(F.transform(F.array_sort(F.collect_list(F.when(side, F.struct("place", "text")))),
                                              lambda x: x["text"]), "") for side in (F.col("before"), ~F.col("before")))
    steps = found.groupBy("tree", "block", "level").agg(before.alias("before"), after.alias("after"))
    return steps.groupBy("tree", "block").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("level", "before", "after"))),
        lambda s: F.struct(s["before"].alias("before"), s["after"].alias("after"))).alias("above"))


def _steps(height: int, arity: int, carried: list[str]):
    def extract(rows: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or segment.empty:
            return pd.DataFrame(columns=[*carried, "tree", "block", "path"])
        nodes, start = segment["nodes"].iloc[0], int(segment["start"].iloc[0])
        size, tall = int(rows["size"].iloc[0]), min(height, levels(int(rows["size"].iloc[0]), arity))

        made: dict[tuple[int, int], dict] = {}

        def step(level: int, index: int) -> dict:
            if (level, index) not in made:
                texts = [[nodes[DIGEST * at:DIGEST * (at + 1)].hex() for at in (
                    place_of(level, i, size, arity) - start for i in side)]
                    for side in siblings(level, index, -(-size // arity ** level), arity)]
                made[level, index] = {"before": "".join(texts[0]), "after": "".join(texts[1])}
            return made[level, index]

        paths = [[step(level, index // arity ** level) for level in range(tall)] for index in rows["index"].to_list()]
        return rows[[*carried, "tree", "block"]].assign(path=paths)

    return extract


def prove(manifest: Manifest, arity: int = ARITY) -> DataFrame:
    """The leaves with ``path``: for each level up to the root of their tree the hex digests that stand
    ``before`` and ``after`` the node in its run, read from the log by place."""
    carried = [c for c in manifest.leaves.columns if c not in ("tree", "block", "size", "index")]
    fields = {f.name: f.dataType.simpleString() for f in manifest.leaves.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in carried), "tree string, block long", f"path {STEP}"])
    own = manifest.leaves.groupBy("tree", "block").cogroup(
        manifest.log.groupBy("tree", "block")).applyInPandas(_steps(manifest.height, arity, carried), schema)
    return own.join(lookup_side(_above(manifest, arity)), ["tree", "block"], "left").withColumn(
        "path", F.concat("path", F.coalesce("above", F.array().cast(STEP)))).drop("above", "block")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a hex digest and a path lead to."""
    return F.aggregate(path, leaf, lambda held, step: F.sha2(F.concat(step["before"], held, step["after"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of all digests of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def audit(docs: DataFrame, fields: list[str], changed: dict[str, Column], suspect: Column, key: str = "doc_id", group: str = "source",
          height: int = HEIGHT) -> DataFrame:
    """Prove every row of a dataset, some of them after changes, against a manifest of the unchanged rows.

    Rows are leaves of the tree of their ``group``, by ascending ``key``; the groups' roots, by group (null first, then by
    bytes), are the leaves of the tree above them. A row's digest covers ``fields``; where ``suspect`` is true, the row is checked
    with the columns of ``changed`` in place of its own.

    Returns ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``. Null keys come
    first; rows of the same key go by their digest; repeated rows are a leaf each. A null ``suspect`` counts as false. An empty table
    gives no rows. Columns beside ``fields``, ``key`` and ``group`` are not read.
    """
    leaf = row_digest([F.col(c) for c in fields])
    other = row_digest([changed.get(c, F.col(c)) for c in fields])
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
                       leaf.alias("digest"), F.when(suspect, other).alias("__other"))
    proven = prove(whole := build(rows, ["__key", "digest"], height))
    upper = prove(top := build(whole.roots.select(F.col("tree").alias("__group"), F.lit("").alias("tree"), F.col("root").alias("digest")),
                               ["__group"], height))
    root = top.roots.select(hex_digest(F.col("root"))).first()
    trees = lookup_side(upper.select(F.col("__group").alias("tree"), F.col("digest").alias("__subroot"), F.col("path").alias("__rest")))
    found = proven.join(trees, "tree").withColumns({"path": F.concat("path", "__rest"), "leaf": hex_digest(F.col("digest")),
                                                    "root": F.lit(root[0] if root else None).cast("string")})
    return found.withColumn("folded_root", folded(hex_digest(F.coalesce("__other", "digest")), F.col("path"))).select(
        F.col("__key").alias(key), "leaf", hex_digest(F.col("__subroot")).alias("subroot"), "root",
        path_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
