"""Best-fit packing of documents into sequences by linear grouping of their lengths.

Lengths are whole numbers up to the sequence length, so all that packing needs to know is how many pieces there are of
each: a histogram of bounded size, whatever the corpus. Pieces get their places by
their rank among the pieces of the same length.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.common import tidy
from strandline.llm.tokens import token_arrays
from strandline.plans.sizing import left_lookup, lookup_side, settle

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
Placement = tuple[int, int, int, int, int]  # length, first rank, pieces, first sequence, offset


def token_pieces(docs: DataFrame, tokenizer: str, limit: int, key: str, text: str, end: int) -> DataFrame:
    """Pieces of at most ``limit`` ids; all but the first piece of a cut document are full."""
    rows = docs.select(F.col(key).cast("long"), F.col(text))

    def cut(batches):
        for batch in batches:
            found: list[tuple] = []
            arrays = token_arrays(tokenizer, batch.column(1).to_pylist(), end)
            for doc_id, ids in zip(batch.column(0).to_pylist(), arrays):
                raw = memoryview(ids.astype("<u4").tobytes())
                stops = range(len(ids) % limit or limit, len(ids) + 1, limit)
                start = 0
                for piece, stop in enumerate(stops):
                    found.append((doc_id, piece, start, stop - start, zlib.crc32(raw[4 * start:4 * stop])))
                    start = stop
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return rows.mapInArrow(lambda batches: tidy(cut(batches)), PIECE)


class _Stock:
    """Pieces not yet placed: of each length, how many there are and the next one's rank."""

    def __init__(self, counts: dict[int, int]):
        self.ranks = dict.fromkeys(counts, 0)

    def take(self, length: int, count: int) -> int:
        first = self.ranks[length]
        self.ranks[length] += count
        return first


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Lengths in descending order, cut into groups of equally many pieces.

    Each group is its largest length, to which all are rounded up, and its runs [length, count].
    """
    total = sum(counts.values())
    size = max(1, -(-total // groups))
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = size
            take = min(left, room)
            out[-1][1].append([length, take])
            left, room = left - take, room - take
    return out


def _best_filling(sizes: np.ndarray, left: np.ndarray, room: int) -> dict[int, int]:
    """Groups (and how often each) whose rounded lengths fill ``room`` best; large ones first."""
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    by = np.full(room + 1, -1)
    for i in np.flatnonzero((left > 0) & (sizes <= room)):
        size = int(sizes[i])
        fresh = reached
        for _ in range(min(int(left[i]), room // size)):
            moved = np.zeros_like(reached)
            moved[size:] = fresh[:-size]
            fresh = moved & ~reached
            if not fresh.any():
                break
            by[fresh] = i
            reached = reached | fresh
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    used: dict[int, int] = {}
    while at:
        i = int(by[at])
        used[i] = used.get(i, 0) + 1
        at -= int(sizes[i])
    return used


def configurations(sizes: list[int], counts: list[int], limit: int) -> list[tuple[dict[int, int], int]]:
    """Patterns of groups for one sequence, and how many sequences use each.

    Always the largest length left gets the filling that leaves least room, as often as the
    groups in it last.
    """
    size, left = np.array(sizes), np.array(counts, np.int64)
    out = []
    while (left > 0).any():
        first = int(np.argmax(left > 0))
        left[first] -= 1
        used = _best_filling(size, left, limit - int(size[first]))
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(int(left[i]) // n for i, n in used.items())
        for i, n in used.items():
            left[i] -= times * n
        out.append((used, times))
    return out


def _draw(runs: list[list[int]], count: int) -> list[tuple[int, int]]:
    """The next ``count`` pieces of a group, as runs of equal length."""
    out = []
    while count:
        length, there = runs[0]
        take = min(count, there)
        out.append((length, take))
        count -= take
        if take == there:
            runs.pop(0)
        else:
            runs[0][1] = there - take
    return out


def pack_lengths(counts: dict[int, int], limit: int, groups: int = 800, large: float = 0.125) -> list[Placement]:
    """Places for so many pieces of each length in sequences of ``limit`` ids.

    Lengths over ``large`` of the limit are rounded up within groups of equally many pieces and
    packed by configurations of groups. Pieces of the true lengths take the groups' places,
    which only leaves more room; then the small lengths go, largest first, where they fit best.
    """
    stock = _Stock(counts)
    out: list[Placement] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    sequences = 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            insort(open_gaps, gap)
        gaps[gap].append((first, count))

    big = {length: n for length, n in counts.items() if length > large * limit and n}
    grouped = linear_groups(big, groups)
    sizes, runs = [g[0] for g in grouped], [g[1] for g in grouped]
    for used, times in configurations(sizes, [sum(n for _, n in r) for r in runs], limit) if big else []:
        slots = [_draw(runs[i], times) for i, n in sorted(used.items()) for _ in range(n)]
        while times:
            count = min(slot[0][1] for slot in slots)
            offset = 0
            for slot in slots:
                length, there = slot[0]
                out.append((length, stock.take(length, count), count, sequences, offset))
                offset += length
                if there == count:
                    slot.pop(0)
                else:
                    slot[0] = (length, there - count)
            leave(limit - offset, sequences, count)
            sequences += count
            times -= count
    for length in sorted((x for x in counts if x not in big), reverse=True):
        left = counts[length]
        while left:
            at = int(np.searchsorted(open_gaps, length))
            if at == len(open_gaps):
                new = -(-left // (limit // length))
                leave(limit, sequences, new)
                sequences += new
                continue
            gap = open_gaps[at]
            first, there = gaps[gap].pop()
            count = min(left, there)
            if there > count:
                gaps[gap].append((first + count, there - count))
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(at)
            out.append((length, stock.take(length, count), count, first, limit - gap))
            leave(gap - length, first, count)
            left -= count
    return out


def ranked_by_length(pieces: DataFrame) -> DataFrame:
    """Add the rank of a piece among those of its length; no task gets all of one length.

    Ranks are counted in every partition of the settled pieces, on top of the counts of the
    partitions before it.
    """
    per = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    local = pieces.withColumn("local", F.row_number().over(inside) - 1)
    return left_lookup(local, lookup_side(base), ["length", "part"]).withColumn(
        "rank", F.col("base") + F.col("local")).drop("base", "local", "part")


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id",
                   text: str = "text", end: int = 0, groups: int = 800) -> DataFrame:
    """Pack all documents' ids into few sequences of at most ``limit`` ids.

    Returns per piece ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset``. Only documents over the limit are cut: the first piece takes what is over
    full pieces. A null or empty text is the end id alone. Rows with null or repeated keys are packed as
    documents of their own. Other columns are not read. No documents give no rows. The driver
    holds one count per length, at most ``limit``.
    """
    pieces = settle(token_pieces(docs, tokenizer, limit, key, text, end).withColumn(
        "part", F.spark_partition_id()))
    counts = {row["length"]: row.n for row in
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places: dict[int, list[Placement]] = {}
    for place in pack_lengths(counts, limit, groups):
        places.setdefault(place[0], []).append(place)
    table = {length: np.array(sorted(found)).T[1:] for length, found in places.items()}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                rows = length == value
                first, _, sequences, offsets = shared.value[int(value)]
                at = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows] = sequences[at] + rank[rows] - first[at]
                offset[rows] = offsets[at]
            keep = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, pa.array(sequence), pa.array(offset)],
                [*keep.schema.names, "sequence_id", "offset"])

    return ranked_by_length(pieces).mapInArrow(assign, PIECE + ", sequence_id long, offset long")
