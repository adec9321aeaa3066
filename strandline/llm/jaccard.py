"""Exact Jaccard join of documents' word shingles in their metric space.

1 - Jaccard is a metric, so a document within ``radius`` of another is at most that much
farther from any pivot. Of random documents all are at distance one, where no pivot tells
them apart; the first pivots are therefore sets of one shingle each: documents fall into the cells of
their rarest shingles, and the window that the radius leaves is a number of cells. Documents
that share too few shingles with any other are done with. Inside the cells documents are the pivots: Voronoi regions with
windows of twice the radius, joined recursively.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.llm.common import rows_of, tidy
from strandline.llm.components import components
from strandline.llm.tokens import slices
from strandline.plans.sizing import left_lookup, lookup_side, settle

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
SIGNATURE = "doc_id long, n long, print binary, lead array<long>, hot array<long>"
HOT = 1 << 60


# ---- shingles

def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(raw: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial of its bytes, eight at a time."""
    total = np.zeros(len(first), np.uint64)
    longest = int(sizes.max(initial=0))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    rows = np.arange(len(first))
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for at in range(0, longest, 8):
        rows = rows[sizes[rows] > at]
        left = np.minimum(sizes[rows] - at, 8).astype(np.uint64)
        part = view[first[rows] + at].copy().view("<u8").ravel()
        part &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
        total[rows] = _mix((total[rows] ^ part) + (left + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return total


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles.

    A-Z count in lower case; words are what blanks, tabs and line ends leave. A text of
    fewer words is one shingle; one without words has none.
    """
    packed = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = np.frombuffer(b"\n".join(packed) + b"\n", np.uint8)
    inside = ~SPACES[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, sizes = edges[::2], edges[1::2] - edges[::2]
    hashes = _word_hashes(raw, first, sizes)
    stops = np.cumsum([0] + [len(p) + 1 for p in packed])
    at = np.searchsorted(first, stops)
    total = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i in range(words):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i:len(total) + i] + np.uint64(i + 1))
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= words:
            out.append(np.unique(total[a:b - words + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for i in range(a, b):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[i] + np.uint64(b - a + 101))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _within(items: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which items a sorted array holds."""
    if not len(kept):
        return np.zeros(len(items), bool)
    return kept[np.minimum(np.searchsorted(kept, items), len(kept) - 1)] == items


# ---- what the threshold leaves

class Bounds:
    """Whole-number bounds for links at ``percent`` hundredths, with leads of ``lead`` hundredths."""

    def __init__(self, percent: int, lead: int):
        self.percent, self.lead = percent, lead

    def lead_size(self, n: np.ndarray) -> np.ndarray:
        return -(-n * self.lead // 100)

    def shared(self, n: np.ndarray) -> np.ndarray:
        """Shingles that the leads of linked documents share at least, if one has ``n``.

        A linked document has at least ``percent`` hundredths of ``n`` shingles; of two leads,
        the one that ends first holds all common shingles but those behind it.
        """
        least = -(-n * self.percent // 100)
        m = least[:, None] + np.arange(0, 101)
        m = np.where(m * self.percent <= 100 * np.maximum(n, 1)[:, None], m, n[:, None])
        return (self.lead_size(m) - m + -(-m * self.percent // 100)).min(1)

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (a + b - common)


def signatures(docs: DataFrame, key: str, text: str, words: int, bounds: Bounds, hot) -> DataFrame:
    """Per document: set size, fingerprint of the set, and the first shingles by hash (lead).

    Shingles of the broadcast array ``hot`` are listed apart: they are known to be shared.
    """
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in slices(texts):
                sets = shingle_sets(texts[start:stop], words)
                sizes = np.array([len(s) for s in sets], np.int64)
                lead, frequent = [], []
                for s, size in zip(sets, bounds.lead_size(sizes)):
                    first = s[:size]
                    known = _within(first, hot.value)
                    lead.append(first[~known].view(np.int64))
                    frequent.append(first[known].view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[start:stop], pa.int64()), pa.array(sizes),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array(lead, pa.list_(pa.int64())), pa.array(frequent, pa.list_(pa.int64()))],
                    ["doc_id", "n", "print", "lead", "hot"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(lambda batches: tidy(run(batches)), SIGNATURE)


def full_sets(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Whole shingle sets as packed 64-bit hashes in ascending order."""
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in slices(texts):
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[start:stop], pa.int64()),
                    pa.array([s.tobytes() for s in shingle_sets(texts[start:stop], words)], pa.binary())],
                    ["id", "items"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(lambda batches: tidy(run(batches)), "id long, items binary")


def frequent_shingles(docs: DataFrame, text: str, words: int, sample: int, least: int, most: int) -> np.ndarray:
    """Shingles of at least ``least`` documents of a sample of about ``sample`` documents.

    They only keep very frequent shingles from being counted one by one, and give
    no other result if the sample is poor. At most ``most`` of them come to the driver.
    """
    drawn = F.pmod(F.xxhash64(F.lit(3), text), F.lit(1 << 30)) < F.lit(1 << 30) * F.least(
        F.lit(1.0), F.lit(float(sample) / max(1, rows_of(docs))))
    sets = full_sets(docs.where(drawn).select(F.lit(0).alias("id"), text), "id", text, words)

    def items(batches):
        for batch in batches:
            for packed in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(packed.as_py(), np.int64))], ["item"])

    counts = sets.select("items").mapInArrow(items, "item long").groupBy("item").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "item").limit(most).toPandas()
    return np.sort(found["item"].to_numpy(np.int64).view(np.uint64))


# ---- joining a region

class Region:
    """Documents of one region in memory, and which of them are known to be connected."""

    def __init__(self, ids, sets: list[np.ndarray], known, bounds: Bounds):
        self.ids, self.sets, self.bounds = np.asarray(ids), sets, bounds
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.parent = list(range(len(ids)))
        first: dict = {}
        for i, k in enumerate(known):
            self.parent[i] = first.setdefault(k, i)
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((int(self.ids[i]), int(self.ids[j])))

    def index(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All shingles of ``rows`` in order, and the place in ``rows`` that each comes from."""
        items = np.concatenate([self.sets[i] for i in rows])
        order = np.argsort(items, kind="stable")
        return items[order], np.repeat(np.arange(len(rows)), self.sizes[rows])[order]

    def common(self, i: int, rows: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Number of shingles that document ``i`` shares with each of ``rows``."""
        items, owners = index
        low = np.searchsorted(items, self.sets[i])
        counts = np.searchsorted(items, self.sets[i], "right") - low
        ends = np.cumsum(counts)
        take = np.repeat(low - ends + counts, counts) + np.arange(ends[-1])
        return np.bincount(owners[take], minlength=len(rows))

    def join(self, rows: np.ndarray, leaf: int = 48, pivots: int = 6) -> None:
        """Link all pairs of ``rows`` within the radius that are not connected yet.

        Pivots link what is within the radius of them. Then every row goes to its nearest
        pivot's region, and to each other whose pivot is within its nearest distance and twice the radius;
        a region is joined again by itself. Where regions do not shrink, pairs are compared directly.
        """
        radius = 1 - self.bounds.percent / 100
        waiting = [rows]
        while waiting:
            rows = waiting.pop()
            roots = np.array([self.root(int(i)) for i in rows])
            if len(rows) < 2 or (roots == roots[0]).all():
                continue
            index = self.index(rows)
            if len(rows) <= leaf:
                self._direct(rows, index)
                continue
            distance = np.full((pivots, len(rows)), 2.0)
            nearest = np.full(len(rows), 2.0)
            for k in range(pivots):
                p = int(np.argmax(nearest)) if k else 0
                common = self.common(int(rows[p]), rows, index)
                union = self.sizes[rows] + self.sizes[rows[p]] - common
                for j in np.flatnonzero(self.bounds.linked(common, self.sizes[rows], self.sizes[rows[p]])):
                    self.link(int(rows[p]), int(rows[j]))
                distance[k] = 1 - common / union
                nearest = np.minimum(nearest, distance[k])
            inside = distance <= nearest + 2 * radius + 1e-9
            if max(inside.sum(1)) > 0.8 * len(rows):
                self._direct(rows, index)
                continue
            waiting += [rows[part] for part in inside]

    def _direct(self, rows: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> None:
        sizes = self.sizes[rows]
        least, most = -(-sizes * self.bounds.percent // 100), sizes * 100 // self.bounds.percent
        roots = np.array([self.root(int(i)) for i in rows])
        for k in range(len(rows) - 1):
            near = (sizes >= least[k]) & (sizes <= most[k]) & (roots != roots[k])
            near[:k + 1] = False
            if not near.any():
                continue
            common = self.common(int(rows[k]), rows, index)
            found = np.flatnonzero(near & self.bounds.linked(common, sizes, sizes[k]))
            for j in found:
                self.link(int(rows[k]), int(rows[j]))
            if len(found):
                roots = np.array([self.root(int(i)) for i in rows])


def _join_regions(bounds: Bounds):
    """Edges between the documents of a region."""
    import pandas as pd

    def run(frame):
        sets = [np.frombuffer(s, np.uint64) for s in frame["items"]]
        region = Region(frame["id"].to_numpy(), sets, frame["comp"].to_list(), bounds)
        region.join(np.flatnonzero(region.sizes))
        return pd.DataFrame(region.edges, columns=["a", "b"]).astype("int64")

    return run


def region_edges(rows: DataFrame, sets: DataFrame, bounds: Bounds, most: int, whole: bool) -> DataFrame:
    """Edges inside regions (``region``, ``id``, ``comp``), whose sets are fetched once a row.

    A region of over ``most`` documents is cut into blocks. Not ``whole``: each block with its
    first documents as pivots common to all blocks. ``whole``: every two blocks meet once, so that
    no pair is left out; documents of one component are in few blocks then, and blocks of the same
    component alone have nothing to do.
    """
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("pivot"))
    blocks = F.ceil(F.col("rows") / most)
    marked = rows.join(lookup_side(sizes.select("region", "pivot", blocks.alias("blocks"))), "region")
    block = F.pmod(F.xxhash64(F.lit(9), "id"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    if whole:
        pairs = F.transform(every, lambda k: F.struct(F.least(block, k).alias("i"), F.greatest(block, k).alias("j")))
        dealt = marked.select("id", "comp", "region", F.explode(pairs).alias("part"))
    else:
        own = F.when(F.col("id") == F.col("pivot"), every).otherwise(F.array(block))
        dealt = marked.select("id", "comp", "region", F.explode(F.transform(
            own, lambda k: F.struct(k.alias("i"), k.alias("j")))).alias("part"))
    return dealt.join(sets, "id").groupBy("region", "part").applyInPandas(
        _join_regions(bounds), "a long, b long")


# ---- the join

def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id",
                text: str = "text", lead: int = 30, region_rows: int = 256, sample: int = 4096) -> DataFrame:
    """The group of every document whose shingle set is linked to others, directly or over others.

    Two documents link when their sets' Jaccard similarity is ``percent`` hundredths or more,
    compared in whole numbers. Returns ``doc_id``, ``n_shingles`` and ``component_id``, the smallest
    id that links lead to, its own included. It yields groups only: pairs whose documents are connected already
    are not compared, so neither the linked pairs nor their number per document come out.

    A text without words (null, empty, blanks) has no shingle and links with nothing. Rows with null
    key are returned with a null group and link with nothing. Rows that repeat a key are
    returned each, and count as one document with the links of all of them. Other columns are not read.
    Shingles are 64-bit hashes.
    """
    spark = docs.sparkSession
    bounds = Bounds(percent, lead)
    docs = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"))
    hot = spark.sparkContext.broadcast(frequent_shingles(docs, "__text", words, sample, 6, 100_000))
    signed = settle(signatures(docs, "__id", "__text", words, bounds, hot))
    real = signed.where("doc_id is not null and n > 0")

    # Equal sets are one class, named after their smallest id; only ids and fingerprints move.
    classes = real.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    copies = settle(real.select("doc_id", "print").join(lookup_side(classes.select("print", "rep")), "print")
                    .where("doc_id <> rep").distinct())
    first = left_lookup(real, lookup_side(copies.select("doc_id", "print")), ["doc_id", "print"], "left_anti")

    # How many documents have each lead shingle; those that share too few are left out.
    counted = first.select("doc_id", F.explode("lead").alias("item")).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("item"))).where("n > 1")
    own = counted.groupBy("doc_id").agg(F.collect_list(F.struct("n", "item")).alias("cold"))
    fewest = _fewest(bounds)
    candidates = first.select("doc_id", "n", "hot").join(own, "doc_id", "left").withColumn(
        "shared", F.concat(F.coalesce("cold", F.expr("array()")), F.transform(
            "hot", lambda h: F.struct(F.lit(HOT).alias("n"), h.alias("item"))))).withColumn(
        "fewest", fewest(F.col("n"))).where(F.size("shared") >= F.col("fewest"))
    # Shingles that no other document has come first by rarity, and are in no cell.
    window = F.size("shared") - F.col("fewest") + 1
    cells = settle(candidates.select(
        F.col("doc_id").alias("id"),
        F.transform(F.slice(F.array_sort("shared"), F.lit(1), window.cast("int")), lambda s: s["item"]).alias("cells"),
        F.slice(F.array_sort(F.transform("shared", lambda s: s["item"])), 1, 2).alias("near")))

    wanted = lookup_side(cells.select(F.col("id").alias("__id")).distinct())
    sets = settle(full_sets(docs.join(wanted, "__id", "left_semi"), "__id", "__text", words))

    # First the cells of two shingles each, to connect most of what is near; then all cells in which
    # documents are left that are not connected.
    near = cells.select("id", F.col("id").alias("comp"), F.explode("near").alias("region"))
    edges = region_edges(_shared_regions(near), sets, bounds, region_rows, False)
    same_key = _repeated_keys(real, copies)
    roots = components(edges.unionByName(same_key))
    every = cells.select("id", F.explode("cells").alias("cell"))
    placed = left_lookup(every, lookup_side(roots.withColumnRenamed("node", "id")), ["id"]).select(
        "id", "cell", F.coalesce("root", "id").alias("comp"))
    open_cells = placed.groupBy("cell").agg(F.min("comp").alias("region"), F.max("comp").alias("other")).where(
        "region <> other").select("cell", "region")
    rest = settle(placed.join(open_cells, "cell").select("region", "id", "comp").distinct())
    more = region_edges(rest, sets, bounds, region_rows, True)
    roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    named = left_lookup(signed.select("doc_id", "n", "print"), lookup_side(copies), ["doc_id", "print"])
    named = named.withColumn("__rep", F.coalesce("rep", "doc_id"))
    joined = named.join(lookup_side(roots.withColumnRenamed("node", "__rep")), "__rep", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(
        F.col("n") > 0, F.coalesce("root", "__rep")).otherwise(F.col("doc_id")).alias("component_id"))


def _fewest(bounds: Bounds):
    """``Bounds.shared`` as an expression."""
    def of(n: Column) -> Column:
        least = F.ceil(n * bounds.percent / 100)
        steps = F.sequence(F.lit(0), F.lit(100))
        m = F.transform(steps, lambda i: F.when((least + i) * bounds.percent <= 100 * n, least + i).otherwise(n))
        return F.array_min(F.transform(m, lambda x: F.ceil(x * bounds.lead / 100) - x + F.ceil(x * bounds.percent / 100)))

    return of


def _shared_regions(rows: DataFrame) -> DataFrame:
    """Rows of regions that have more than one document."""
    several = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("region")
    return settle(rows.join(several, "region").select("region", "id", "comp").distinct())


def _repeated_keys(real: DataFrame, copies: DataFrame) -> DataFrame:
    """Edges between the classes of rows that repeat a key with different texts."""
    several = real.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    rows = left_lookup(real.select("doc_id", "print").join(several, "doc_id"),
                       copies, ["doc_id", "print"])
    return rows.select(F.col("doc_id").alias("a"), F.coalesce("rep", "doc_id").alias("b"))
