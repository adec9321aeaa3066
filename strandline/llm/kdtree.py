"""Exact top-k inner products: a KD-tree per shard, searched best-first with a propagated bound."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.llm.common import rows_of
from strandline.plans.sizing import settle

FOUND = "query_id long, vec_id long, score long"
WHOLE = float(1 << 53)  # from here on every double is a whole number
NONE_YET, MOST = -(1 << 63), (1 << 63) - 1


def integer_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as doubles without a fraction.

    Null where the vector is null, empty, or holds a null or non-finite component.
    """
    def whole(v):
        x = v.cast("double") * scale
        return F.when(F.abs(x) < WHOLE, F.floor(x).cast("double")).otherwise(x)

    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, whole))


class KDTree:
    """Median splits along the widest side, with the tight bounding box of every node.

    Rows that all sit in one place stay together in a leaf whatever their number.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 64):
        order = np.argsort(ids, kind="stable")
        self.points, self.ids = points[order], ids[order]
        self.low, self.high, self.least, self.spans, self.children = [], [], [], [], []
        self.order = np.arange(len(ids))
        self._split(0, len(ids), leaf)
        self.points, self.ids = self.points[self.order], self.ids[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, start: int, end: int, leaf: int) -> None:
        waiting = [(start, end, None)]
        while waiting:
            start, end, parent = waiting.pop()
            rows = self.order[start:end]
            inside = self.points[rows]
            low, high = inside.min(0), inside.max(0)
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.least.append(int(self.ids[rows].min()))
            self.spans.append((start, end))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            axis = int(np.argmax(high - low))
            if end - start <= leaf or high[axis] == low[axis]:
                continue
            half = (end - start) // 2
            self.order[start:end] = rows[np.argsort(inside[:, axis], kind="stable")] if inside.dtype == object else rows[
                np.argpartition(inside[:, axis], half)]
            waiting += [(start, start + half, node), (start + half, end, node)]

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The largest product that ``query`` can have with a point of each node's box."""
        return self.high @ np.maximum(query, 0) + self.low @ np.minimum(query, 0)

    def search(self, query: np.ndarray, own: int, k: int, kth: int) -> list[tuple[int, int]]:
        """The ``k`` best (score, id), ties to the smaller id, leaving out ``own``.

        Products under ``kth`` are not looked for: ``k`` rows elsewhere are known to reach it.
        """
        bounds = self.bounds(query)
        best: list[tuple[int, int]] = []  # (score, -id), worst first
        waiting = [(-bounds[0], self.least[0], 0)]
        while waiting:
            bound, least, node = heapq.heappop(waiting)
            if -bound < kth:
                break
            if len(best) == k and (-bound, -least) < best[0]:
                continue
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(waiting, (-bounds[child], self.least[child], child))
                continue
            start, end = self.spans[node]
            scores = self.points[start:end] @ query
            ids = self.ids[start:end]
            for i in np.flatnonzero((scores >= kth) & (ids != own)):
                found = (int(scores[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return [(score, -negative) for score, negative in best]


def _exact(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in numbers whose products and sums are exact: doubles or 64-bit integers while these hold every sum
    there can be, else Python's integers."""
    most = float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * points.shape[1]
    if most < 2 ** 52:
        return points, queries
    if most < 2 ** 62 and max(np.abs(points).max(initial=0), np.abs(queries).max(initial=0)) < 2 ** 62:
        return points.astype(np.int64), queries.astype(np.int64)
    return tuple(np.array([[int(x) for x in row] for row in rows.tolist()], object).reshape(rows.shape) for rows in (points, queries))


def _search_shard(k: int, leaf: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        wide = right["vector"].map(len)
        for width, queries in left.groupby(left["query"].map(len)):
            points = right[wide == width]
            if points.empty:
                continue
            p, q = _exact(np.stack(points["vector"].to_list()), np.stack(queries["query"].to_list()))
            tree = KDTree(p, points["vec_id"].to_numpy(), leaf)
            for own, query, kth in zip(queries["query_id"].tolist(), q, queries["kth"].tolist()):
                found += [(own, other, score) for score, other in tree.search(query, own, k, kth)]
        if any(not NONE_YET <= score <= MOST for _, _, score in found):
            raise OverflowError("an inner product is beyond a 64-bit integer")
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return search


def _numbers(count: int) -> Column:
    """A row for each of 0 to ``count`` - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))


def top_products(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    scale: int = 256,
    shard_rows: int = 2048,
    block_rows: int = 4096,
    leaf: int = 64,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The ``k`` largest integer inner products of every query row with all rows but itself.

    Rows are dealt by the hash of key and content into shards of about ``shard_rows`` rows, each
    with a KD-tree; queries go in blocks of ``block_rows`` to every shard. Each query is first
    searched in one shard alone; its kth score there is the bound that the search of all others
    starts with. Boxes whose bound is under it are never opened.

    Returns ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties go to the smaller key, all
    rows where there are fewer than ``k``. Rows with null key, null or empty vector, or null or
    non-finite components take no part; only vectors of the same length are compared.
    Scores are exact whatever the components; one that a long can't hold is an error. Repeated rows of one key count as one (any
    of them, the same in every run). Other columns are not read.
    """
    whole = settle(vectors.select(F.col(key).cast("long").alias("vec_id"), queries.alias("asks"),
                                  integer_components(F.col(vector), scale).alias("vector"))
                   .where("vec_id is not null and vector is not null")
                   .groupBy("vec_id").agg(F.max("asks").alias("asks"), F.min("vector").alias("vector")))
    shards = max(1, -(-rows_of(whole) // shard_rows))
    asked = whole.where("asks")
    blocks = max(1, -(-rows_of(asked) // block_rows))
    shard = F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(shards))
    block = F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(blocks))

    dealt = whole.select("vec_id", "vector", shard.alias("shard"), _numbers(blocks).alias("block"))
    asking = asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"),
                          shard.alias("home"), block.alias("block"))

    def searched(rows: DataFrame) -> DataFrame:
        return rows.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(
            _search_shard(k, leaf), FOUND)

    first = settle(searched(asking.select(
        "query_id", "query", F.col("home").alias("shard"), "block",
        F.lit(NONE_YET).cast("long").alias("kth"))))
    bound = first.groupBy("query_id").agg(F.when(
        F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(NONE_YET)).alias("kth"))
    bounded = asking.join(bound, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(NONE_YET)))
    others = bounded.select("*", _numbers(shards).alias("shard")).where(
        F.col("shard") != F.col("home")).drop("home")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(searched(others)).withColumn(
        "rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
