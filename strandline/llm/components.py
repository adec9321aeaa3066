"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandline.plans.sizing import settle


def _nearest(edges: DataFrame) -> DataFrame:
    """Of every node, the least of itself and the nodes its edges lead to."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The least node of the component of every node that has an edge: ``node``, ``root``.

    Large-star and small-star steps in turn (a logarithmic number of them), each written to the
    checkpoint folder, until no edge changes: then every node points to its root. A hub's
    edges meet no single task: least neighbours are combined map-side, and the joins have a
    plain side that adaptive execution splits. Nulls and edges from a node to itself are left out.
    """
    now = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    seen = _fingerprint(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _nearest(large)
        small = large.join(least, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        after = settle(small)
        found = _fingerprint(after)
        if found == seen:
            break
        now, seen = after, found
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return settle(roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
