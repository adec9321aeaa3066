"""Exact near-duplicate links of embeddings by cover trees, traversed two at a time.

On unit vectors a cosine of ``least`` is a distance of sqrt(2 - 2 least). Nodes of a tree nest in
levels of halving radii. Two nodes farther apart than their covering radii and the
link distance hold no link; two close enough that even their farthest members link are counted whole.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strandline.llm.common import open_store, replace_file, shared_folder, tidy
from strandline.llm.components import components
from strandline.plans.sizing import lookup_side, settle

SLACK = 1e-5
FINEST = 1e-6
COARSE = 0.1
BLOCK = 1024
TILE = (256, 1024)     # cosines compared at once stay in a core's cache
SIDE = 16              # trees on one side of a task, at most
SIDE_BYTES = 64 * 1024 * 1024
EDGES = 1 << 18
SHARE = 1e-4           # of unrelated pairs, so many may pass the shortened vectors
FEW = 8     # so few members are children of their own: a wide node of them would meet almost every other


def net(points: np.ndarray, radius: float) -> np.ndarray:
    """Rows no nearer to each other than ``radius`` that together cover all rows; first come first."""
    free = np.arange(len(points))
    centers = []
    while len(free):
        centers.append(free[0])
        free = free[np.linalg.norm(points[free] - points[free[0]], axis=1) > radius]
    return np.array(centers)


class CoverTree:
    """Nodes with centre, covering radius, members and children; members of a node are one span."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        self.centers, self.radii, self.spans, self.children = [], [], [], []
        close = points.astype(np.float32)
        cosines = close @ close.T
        order: list[int] = []
        self._build(points, cosines, np.arange(len(points)), 0, 2.0, order)
        place = np.empty(len(points), np.int64)
        place[order] = np.arange(len(points))
        self.order = np.array(order, np.int64)
        self.points, self.ids, self.weights = points[order], ids[order], weights[order]
        self.close, self.short = self.points.astype(np.float32), None
        self.centers = place[np.array(self.centers, np.int64)]
        self.radii, self.spans = np.array(self.radii), np.array(self.spans)
        self.inner = np.array([len(c) > 0 for c in self.children])

    def pack(self, raw: np.ndarray) -> bytes:
        """The tree with ``raw``, its vectors as they came, in place of the points made from them."""
        return pickle.dumps((raw[self.order], self.ids, self.weights, self.centers.astype(np.int32), self.radii,
                             self.spans.astype(np.int32), self.children))

    @classmethod
    def unpack(cls, packed: bytes, basis: np.ndarray | None = None) -> CoverTree:
        """A packed tree, with points shortened to ``basis`` if that is given."""
        tree = cls.__new__(cls)
        raw, tree.ids, tree.weights, centers, tree.radii, spans, tree.children = pickle.loads(packed)
        tree.order, tree.points = np.arange(len(raw)), _unit(raw)
        tree.inner = np.array([len(c) > 0 for c in tree.children])
        tree.centers, tree.spans = centers.astype(np.int64), spans.astype(np.int64)
        tree.close, tree.short = tree.points.astype(np.float32), None
        if basis is not None:
            tree.short = shortened(tree.points, basis).astype(np.float32)
        return tree

    def _build(self, points, cosines, members, center: int, radius: float, order: list[int]) -> None:
        waiting = [(members, center, radius, None)]
        while waiting:
            members, center, radius, parent = waiting.pop()
            node = len(self.centers)
            gaps = np.linalg.norm(points[members] - points[center], axis=1)
            self.centers.append(center)
            self.radii.append(float(gaps.max()) + (1e-12 if len(members) > 1 else 0.0))
            self.spans.append((len(order), len(order)))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if len(members) == 1 or self.radii[-1] <= FINEST:
                # Depth first: the members of a node are written one behind the other.
                self.spans[node] = (len(order), len(order) + len(members))
                order += members.tolist()
                continue
            while self.radii[node] <= radius / 2:
                radius /= 2
            parts, free, at = [], members, center
            while len(free):
                if radius < COARSE:   # single precision can't tell such distances apart
                    near = np.linalg.norm(points[free] - points[at], axis=1) <= radius / 2
                else:
                    near = cosines[at, free] >= 1 - radius ** 2 / 8
                    near |= free == at
                inside = free[near]
                parts += [(inside, at)] if len(inside) > FEW else [(inside[i:i + 1], int(inside[i])) for i in range(len(inside))]
                free = free[~near]
                at = int(free[0]) if len(free) else -1
            waiting += [(part, at, radius / 2, node) for part, at in reversed(parts)]
        for node in range(len(self.centers) - 1, -1, -1):
            if self.children[node]:
                spans = [self.spans[c] for c in self.children[node]]
                self.spans[node] = (min(s[0] for s in spans), max(s[1] for s in spans))


def least_labels(label: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """Labels, each the least place of its set, after the sets of ``lefts`` and of ``rights`` have been joined."""
    while True:
        x, y = label[lefts], label[rights]
        apart = x != y
        if not apart.any():
            return label
        lefts, rights, x, y = lefts[apart], rights[apart], x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            nearer = label[label]
            if (nearer == label).all():
                break
            label = nearer


class Links:
    """Link counts and connected rows of two trees, or of one with itself."""

    def __init__(self, a: CoverTree, b: CoverTree, least: float):
        self.a, self.b, self.same, self.least = a, b, a is b, least
        self.reach = float(np.sqrt(2 - 2 * least))
        self.base = 0 if self.same else len(a.ids)
        self.count_a = np.zeros(len(a.ids) + 1, np.int64)
        self.count_b = self.count_a if self.same else np.zeros(len(b.ids) + 1, np.int64)
        self.sums = [np.concatenate([[0], np.cumsum(tree.weights)]) for tree in (a, b)]
        self.label = np.arange(len(a.ids) + (0 if self.same else len(b.ids)))
        self.chained = np.zeros(len(self.label) + 1, np.int64)      # places connected with the one before them
        self.edges, self.kept = [], 0
        self.tile = np.empty(TILE[0] * TILE[1], np.float32)

    def run(self) -> None:
        waiting = list(self._open(0, 0))
        while waiting:
            ps, qs, inner = waiting.pop()
            for left in self._by_radius(self.a, ps):
                for right in self._by_radius(self.b, qs):
                    waiting += self._compare(left, right, inner)
        self.count_a = np.cumsum(self.count_a)[:-1]
        self.count_b = self.count_a if self.same else np.cumsum(self.count_b)[:-1]
        at = np.flatnonzero(np.cumsum(self.chained)[:-1])
        self._connect(at - 1, at)
        self._unite()

    def _open(self, x: int, y: int):
        """Two lists of nodes to compare, and whether they are one list, for the children of two nodes."""
        if self.same and x == y:
            children = np.array(self.a.children[x], np.int64)
            if len(children):
                yield children, children, True
                for child in children[self._size(self.a, children) > 1].tolist():
                    yield from self._open(child, child)
            elif self._size(self.a, np.array([x]))[0] > 1:
                self._inside(x)
        else:
            yield np.array(self.a.children[x] or [x]), np.array(self.b.children[y] or [y]), False

    @staticmethod
    def _by_radius(tree: CoverTree, nodes: np.ndarray) -> list[np.ndarray]:
        """Nodes of single places and all others apart, so that a few wide nodes don't loosen the bound for all."""
        wide = tree.radii[nodes] > 0
        return [part for part in (nodes[~wide], nodes[wide]) if len(part)]

    def _compare(self, ps: np.ndarray, qs: np.ndarray, inner: bool):
        """Settle pairs of nodes by their bounds; returns lists of nodes to compare for the pairs still open."""
        a, b = self.a, self.b
        pairs = []
        # What the largest radii leave out is left out at once; few pairs are looked at closely.
        room = self.reach + a.radii[ps].max() + b.radii[qs].max()
        floor = -2.0 if room >= 2 else 1 - room ** 2 / 2 - SLACK
        for p, q, close in self._near(ps, qs, np.float32(floor)):
            both = a.radii[p] + b.radii[q]
            every = np.sqrt(np.maximum(0, 2 - 2 * (close - SLACK))) + both <= self.reach
            some = (np.sqrt(np.maximum(0, 2 - 2 * (close + SLACK))) - both <= self.reach) & ~every
            if inner:
                every &= p < q
                some &= p < q
            single = some & (both == 0) & (self._size(a, p) == 1) & (self._size(b, q) == 1)
            u, v = a.points[a.centers[p[single]]], b.points[b.centers[q[single]]]
            every[single] = np.einsum("ij,ij->i", u, v) >= self.least
            self._whole(p[every], q[every])
            if (some & ~single).any():
                pairs.append((p[some & ~single], q[some & ~single]))
        if not pairs:
            return
        p, q = (np.concatenate(side) for side in zip(*pairs))
        left, right = a.inner[p], b.inner[q]
        for u, v in zip(p[left & right].tolist(), q[left & right].tolist()):
            yield from self._open(u, v)
        # A node's children meet all that it left open at once.
        for u, vs in self._grouped(p[left & ~right], q[left & ~right]):
            yield np.array(a.children[u]), vs, False
        for v, us in self._grouped(q[right & ~left], p[right & ~left]):
            yield us, np.array(b.children[v]), False
        for u, v in zip(p[~left & ~right].tolist(), q[~left & ~right].tolist()):
            self._members(u, v)

    @staticmethod
    def _grouped(keys: np.ndarray, values: np.ndarray):
        """Each key with its values."""
        order = np.argsort(keys, kind="stable")
        found, starts = np.unique(keys[order], return_index=True)
        return zip(found.tolist(), np.split(values[order], starts[1:])) if len(found) else ()

    def _near(self, ps: np.ndarray, qs: np.ndarray, floor: np.float32):
        """Pairs of nodes whose centres have a cosine of ``floor`` or more, and the cosines, tile by tile.

        Products of shortened points are upper bounds: what they leave out needs no whole product.
        """
        short = self.a.short is not None and self.b.short is not None
        xs, ys = self.a.centers[ps], self.b.centers[qs]
        left, right = (self.a.short[xs], self.b.short[ys]) if short else (self.a.close[xs], self.b.close[ys])
        for at in range(0, len(ps), TILE[0]):
            x = left[at:at + TILE[0]]
            for to in range(0, len(qs), TILE[1]):
                y = right[to:to + TILE[1]]
                cosines = np.matmul(x, y.T, out=self.tile[:len(x) * len(y)].reshape(len(x), len(y)))
                # Few are left: their flat places are found many times faster than pairs of indices.
                flat = np.flatnonzero(cosines.ravel() >= floor)
                whole = not short
                if short and len(flat) > cosines.size // 64:
                    cosines = self.a.close[xs[at:at + len(x)]] @ self.b.close[ys[to:to + len(y)]].T
                    flat, whole = np.flatnonzero(cosines.ravel() >= floor), True
                if not len(flat):
                    continue
                i, j = np.divmod(flat, len(y))
                if whole:
                    close = cosines[i, j]
                else:
                    close = np.einsum("ij,ij->i", self.a.close[xs[at + i]], self.b.close[ys[to + j]])
                    i, j, close = (v[close >= floor] for v in (i, j, close))
                yield ps[at + i], qs[to + j], close.astype(np.float64)

    @staticmethod
    def _size(tree: CoverTree, nodes: np.ndarray) -> np.ndarray:
        return tree.spans[nodes, 1] - tree.spans[nodes, 0]

    def _inside(self, x: int) -> None:
        """All members of a finest node link with each other."""
        first, last = self.a.spans[x]
        total = int(self.a.weights[first:last].sum())
        self.count_a[first:last] += np.diff(np.concatenate([[0], total - self.a.weights[first:last]]))
        self.count_a[last] -= total - self.a.weights[last - 1]
        self._chain(np.array([first]), np.array([last]))

    def _members(self, x: int, y: int) -> None:
        """Compare all members of two nodes without children, in blocks."""
        (first, last), (start, stop) = self.a.spans[x].tolist(), self.b.spans[y].tolist()
        for i in range(first, last, BLOCK):
            left = slice(i, min(i + BLOCK, last))
            for j in range(start, stop, BLOCK):
                right = slice(j, min(j + BLOCK, stop))
                near = self.a.points[left] @ self.b.points[right].T >= self.least
                for counts, at, n in ((self.count_a, left, near @ self.b.weights[right]),
                                      (self.count_b, right, self.a.weights[left] @ near)):
                    counts[at] += n
                    counts[at.start + 1:at.stop + 1] -= n
                u, v = np.nonzero(near)
                self._connect(i + u, self.base + j + v)

    def _whole(self, xs: np.ndarray, ys: np.ndarray) -> None:
        """Count and connect pairs of nodes of which all members link."""
        if not len(xs):
            return
        (x, x_end), (y, y_end) = self.a.spans[xs].T, self.b.spans[ys].T
        for counts, first, last, n in ((self.count_a, x, x_end, self.sums[1][y_end] - self.sums[1][y]),
                                       (self.count_b, y, y_end, self.sums[0][x_end] - self.sums[0][x])):
            np.add.at(counts, first, n)
            np.add.at(counts, last, -n)
        self._chain(x, x_end)
        self._chain(self.base + y, self.base + y_end)
        self._connect(x, self.base + y)

    def _chain(self, first: np.ndarray, last: np.ndarray) -> None:
        """Connect all places of each span."""
        several = last - first > 1
        np.add.at(self.chained, first[several] + 1, 1)
        np.add.at(self.chained, last[several], -1)

    def _connect(self, lefts: np.ndarray, rights: np.ndarray) -> None:
        """Connect the places ``lefts`` with ``rights``, sooner or later."""
        new = self.label[lefts] != self.label[rights]
        self.edges.append((lefts[new], rights[new]))
        self.kept += len(self.edges[-1][0])
        if self.kept > EDGES:
            self._unite()

    def _unite(self) -> None:
        """The least place connected with it as every place's label."""
        if self.kept:
            self.label = least_labels(self.label, *(np.concatenate(side) for side in zip(*self.edges)))
        self.edges, self.kept = [], 0

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places that have links, links counted and the places connected with; those of the second tree follow the first's."""
        counts = self.count_a if self.same else np.concatenate([self.count_a, self.count_b])
        found = np.flatnonzero(counts)
        return found, counts[found], self.label[found]

    def rows(self) -> pd.DataFrame:
        """Id, links counted and the id connected with, of rows that have links."""
        ids = self.a.ids if self.same else np.concatenate([self.a.ids, self.b.ids])
        found, counts, roots = self.found()
        return pd.DataFrame({"id": ids[found], "n": counts, "root": ids[roots]}).astype("int64")


class Gathered:
    """Links of many pairs of trees: one row for each member that has any."""

    def __init__(self):
        self.first, self.size, self.ids, self.parts = {}, 0, [], []

    def add(self, numbers: tuple[int, int], links: Links) -> None:
        found, counts, roots = links.found()
        if not len(found):
            return
        base = [self._base(number, tree) for number, tree in zip(numbers, (links.a, links.b))]
        place = lambda at: np.where(at < len(links.a.ids), base[0] + at, base[1] + at - len(links.a.ids))
        self.parts.append((place(found), counts, place(roots)))

    def _base(self, number: int, tree: CoverTree) -> int:
        if number not in self.first:
            self.first[number] = self.size
            self.size += len(tree.ids)
            self.ids.append(tree.ids)
        return self.first[number]

    def batches(self):
        if not self.parts:
            return
        at, counts, roots = (np.concatenate(column) for column in zip(*self.parts))
        sums, label = np.zeros(self.size, np.int64), least_labels(np.arange(self.size), at, roots)
        np.add.at(sums, at, counts)
        found, ids = np.flatnonzero(sums), np.concatenate(self.ids)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (ids[found], sums[found], ids[label[found]])],
                                         names=["id", "n", "root"])


def _usable(vector):
    """Vectors that can link: not empty, all components finite, not zero."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(
        F.exists(vector, lambda v: v != 0), F.lit(False))


def _unit(vectors) -> np.ndarray:
    wide = np.array(vectors, np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def shortened(points: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors in the few dimensions of ``basis``, and the length of what that leaves out.

    Products of two of them are no less than those of the vectors themselves.
    """
    inside = points @ basis
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", inside, inside)))
    return np.concatenate([inside, rest[:, None]], axis=1)


def short_basis(points: np.ndarray, least: float) -> np.ndarray | None:
    """The principal axes that keep nearly all pairs of less than ``least`` apart; None if too many would be needed."""
    half, width = len(points) // 2, points.shape[1]
    if half < 64 or width < 16:
        return None
    axes = np.linalg.svd(points[:half][:1024], full_matrices=False)[2]
    x, y = np.array_split(points[half:][:1024], 2)
    near = (x @ y.T >= least).mean()
    for count in (8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256):
        if count > min(len(axes), 0.6 * width):
            return None
        basis = axes[:count].T
        if (shortened(x, basis) @ shortened(y, basis).T >= least).mean() <= near + SHARE:
            return np.ascontiguousarray(basis)
    return None


def top_centers(usable: DataFrame, different: int, count: int, sample: int, least: float) -> dict[int, tuple]:
    """Up to ``count`` centres for each vector length and a basis to shorten vectors, from about ``sample`` of them.

    Centres are the coarsest level of nested nets that has as many; the sample bears on speed alone.
    """
    rows = usable.where(F.pmod("h1", F.lit(max(1, -(-different // sample)))) == 0).groupBy("h1", "h2").agg(
        F.first("vector").alias("vector")).limit(sample).collect()
    rows.sort(key=lambda r: (r.h1, r.h2))
    out = {}
    for width in {len(r.vector) for r in rows}:
        points = _unit([r.vector for r in rows if len(r.vector) == width])
        radius, chosen = 2.0, points[:1]
        while len(chosen) < count and radius > 1e-3:
            radius /= 2 ** 0.25
            chosen = points[net(points, radius)]
        out[width] = chosen[:count], short_basis(points, least)
    return out


def _matrices(vectors: pa.ListArray):
    """Width, places and matrix of the vectors of each length."""
    widths = np.asarray(vectors.value_lengths())
    flat, starts = np.asarray(vectors.flatten()), np.cumsum(widths) - widths
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        yield width, at, flat[starts[at][:, None] + np.arange(width)]


def _regions(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The centre nearest to each row, the same one for equal rows of any batch.

    Products of rounded components are whole numbers, whose sums don't depend on their order.
    """
    grid = np.round(centers * 2.0 ** 20).T
    return np.concatenate([(np.round(points[i:i + 4096] * 2.0 ** 20) @ grid).argmax(1)
                           for i in range(0, len(points), 4096)])


def _classes(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, weights: np.ndarray):
    """Equal vectors as one: the place of one of them, the least id and the sum of weights."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return order[starts], np.minimum.reduceat(ids[order], starts), np.add.reduceat(weights[order], starts)


def near_vectors(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding",
                 shard_rows: int = 4096, centers: int = 256, sample: int = 2048) -> DataFrame:
    """Links of every vector with cosine ``least`` or more to others, and its group.

    Returns ``vec_id``, ``n_links`` (other rows linked directly), ``component_id`` (the smallest key that
    links lead to) and ``kept`` (whether that is the row's own).

    Equal vectors are one class. Classes go to the region of the nearest of a few centres, regions to
    shards of about ``shard_rows`` rows by hash, each with a cover tree. Shards meet only if
    their covering radii about the regions' centres allow a link.

    Vectors cross the network once, to their shard. Trees are written to the folder that driver and executors
    share (any store that pyarrow can reach), where tasks read those they compare; nothing is written for
    a pair of trees but its links, summed up for up to 16 trees by 16. The trees are removed afterwards.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows with
    null key link with nothing. Only vectors of the same length link. Repeated rows count each. Rows of one key
    with different vectors share their links. Other columns are not read; the others are read several times.
    """
    spark = vectors.sparkSession
    kind = vectors.select(F.col(vector).alias("vector")).schema["vector"].dataType
    stored = "float" if isinstance(kind.elementType, T.FloatType) else "double"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{stored}>").alias("vector"))
    marks = [F.xxhash64(F.lit(s), "vector").alias(f"h{s}") for s in (1, 2)]
    usable = rows.where(F.col("id").isNotNull() & _usable(F.col("vector"))).select("id", "vector", *marks)
    different = usable.agg(F.approx_count_distinct("h1")).first()[0]
    top = spark.sparkContext.broadcast(top_centers(
        usable, different, min(centers, max(1, different // shard_rows)), sample, least))

    def regions(width, matrix):
        return _regions(_unit(matrix), top.value[width][0]) if width in top.value else np.zeros(len(matrix), np.int64)

    def measure(batches):
        for batch in batches:
            for width, at, matrix in _matrices(batch.column("vector")):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), width)), pa.array(regions(width, matrix)), batch.column("h1").take(pa.array(at))],
                    names=["width", "region", "h1"])

    sizes = usable.select("vector", "h1").mapInArrow(measure, "width long, region long, h1 long").groupBy(
        "width", "region").agg(F.approx_count_distinct("h1").alias("n")).collect()
    shards = {(r.width, r.region): -(-4 * r.n // (5 * shard_rows)) for r in sorted(sizes)}   # a quarter over is no second shard
    starts = dict(zip(shards, np.cumsum([0, *shards.values()]).tolist()))
    home = [k for k, n in shards.items() for _ in range(n)]      # length and region of every shard

    def place(batches):
        for batch in batches:
            for width, at, matrix in _matrices(batch.column("vector")):
                h1, h2, ids = (np.asarray(batch.column(c))[at] for c in ("h1", "h2", "id"))
                one, ids, weights = _classes(h1, h2, ids, np.ones(len(at), np.int64))
                matrix, h1, h2 = matrix[one], h1[one], h2[one]
                region = regions(width, matrix).tolist()
                first, count = (np.array([of[width, r] for r in region]) for of in (starts, shards))
                shard = first + (h2.view(np.uint64) % count.astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (shard, h1, h2, ids, weights)), pa.ListArray.from_arrays(
                    pa.array(np.arange(0, matrix.size + 1, width, dtype=np.int32)), pa.array(matrix.ravel()))],
                    names=["shard", "h1", "h2", "id", "weight", "vector"])

    folder = shared_folder(spark, "cover-trees")

    def grow(keys, table):
        table = table.combine_chunks()
        number = keys[0].as_py()
        width, region = home[number]
        one, ids, weights = _classes(*(table.column(c).to_numpy() for c in ("h1", "h2", "id", "weight")))
        raw = np.asarray(table.column("vector").combine_chunks().flatten()).reshape(-1, width)[one]
        unit = _unit(raw)
        tree = CoverTree(unit, ids, weights)
        packed = tree.pack(raw)
        replace_file(f"{folder}/{number}", lambda out: out.write(packed))
        gaps = _gaps(unit, top.value[width][0][region:region + 1])[:, 0] if width in top.value else np.full(len(unit), 2.0)
        return pa.table({"shard": np.full(len(one), number), "h1": table.column("h1").to_numpy()[one],
                         "h2": table.column("h2").to_numpy()[one], "rep": ids, "weight": weights, "gap": gaps})

    classes = settle(usable.mapInArrow(
        place, f"shard long, h1 long, h2 long, id long, weight long, vector array<{stored}>").groupBy("shard").applyInArrow(
        grow, "shard long, h1 long, h2 long, rep long, weight long, gap double"))
    radii = {r.shard: r.radius for r in classes.groupBy("shard").agg(F.max("gap").alias("radius")).collect()}
    reach = float(np.sqrt(2 - 2 * least)) + SLACK
    tasks = spark.sparkContext.broadcast(_tasks(home, radii, top.value, reach, shard_rows))

    def traverse(batches):
        for batch in batches:
            for at in batch.column(0).to_pylist():
                yield from _links(folder, *tasks.value[at], home, radii, top.value, reach, least).batches()

    found = settle(spark.range(0, len(tasks.value), 1, max(1, len(tasks.value))).mapInArrow(
        lambda batches: tidy(traverse(batches)), "id long, n long, root long"))
    _remove(spark, folder)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.select("h1", "h2", "rep", "weight")
    linked = known.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left").where("n is not null or weight > 1")
    link = lookup_side(linked.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"),
                                     F.coalesce("root", "rep").alias("root")))
    marked = rows.select("id", *[F.when(F.col("id").isNotNull() & _usable(F.col("vector")), m).alias(f"h{s}")
                                 for s, m in zip((1, 2), marks)])
    return marked.join(link, ["h1", "h2"], "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("root", "id").alias("component_id"), (F.coalesce("root", "id") == F.col("id")).alias("kept"))


def _gaps(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distances of rows to centres, in blocks of rows."""
    return np.concatenate([np.sqrt(np.maximum(0, 2 - 2 * points[i:i + 4096] @ centers.T))
                           for i in range(0, len(points), 4096)])


def _meet(xs: list[int], ys: list[int], home: list, radii: dict, top: dict, reach: float) -> np.ndarray:
    """Which shards of one length leave room for a link, by their covering radii about their regions' centres."""
    width = home[xs[0]][0]
    if width not in top:
        return np.ones((len(xs), len(ys)), bool)
    x, y = (top[width][0][[home[n][1] for n in numbers]] for numbers in (xs, ys))
    rx, ry = (np.array([radii[n] for n in numbers]) for numbers in (xs, ys))
    return _gaps(x, y) <= rx[:, None] + ry[None, :] + reach


def _tasks(home: list, radii: dict, top: dict, reach: float, shard_rows: int) -> list[tuple[list[int], list[int]]]:
    """Two lists of shards for each task; neighbouring shards, mostly of one region, stand in one list."""
    out = []
    for width in sorted({home[n][0] for n in radii}):
        numbers = [n for n in sorted(radii) if home[n][0] == width]
        side = max(1, min(SIDE, len(numbers) // 12, SIDE_BYTES // (12 * shard_rows * width)))
        lists = [numbers[i:i + side] for i in range(0, len(numbers), side)]
        out += [(x, y) for i, x in enumerate(lists) for y in lists[i:] if _meet(x, y, home, radii, top, reach).any()]
    return out


def _links(folder: str, xs: list[int], ys: list[int], home: list, radii: dict, top: dict, reach: float, least: float) -> Gathered:
    """Links of the shards ``xs`` with ``ys``, of which one tree is held at a time."""
    basis = top[home[xs[0]][0]][1] if home[xs[0]][0] in top else None

    def read(number):
        store, path = open_store(f"{folder}/{number}")
        with store.open_input_file(path) as file:
            return CoverTree.unpack(file.read(), basis)

    out, held, meet = Gathered(), {}, _meet(xs, ys, home, radii, top, reach)
    for j, y in enumerate(ys):
        other = None
        for i, x in enumerate(xs):
            if not meet[i, j] or xs == ys and x > y:
                continue
            if x not in held:
                held[x] = read(x)
            if other is None:
                if xs == ys and y not in held:
                    held[y] = read(y)
                other = held.get(y) or read(y)
            links = Links(held[x], other, least)
            links.run()
            out.add((x, y), links)
    return out


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that no later step reads, from whatever store it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
