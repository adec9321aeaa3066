"""Conversations put right: the cheapest edits after which the roles are an optional system turn and pairs of user and assistant.

The search is iterative-deepening A*: depth first in the ASCII order of the edits under a bound that grows until a path
is accepted, so the first accepted path is the cheapest, and of equally cheap ones the least as a text. States that failed under
a bound are kept with the budget they failed with; the next bound is the least that was beyond it. The bound below a state's
remaining cost takes blocks of ``AHEAD`` rows by themselves, whosever turn it is where they meet.

Conversations of many rows are cut into segments. For each state a segment may begin and end in, the search gives the
cost of its cheapest edits; passes over these small tables choose the states, and the segments are searched again between them.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import rows_of
from strandline.plans.running import dense_position
from strandline.plans.sizing import hinted, left_lookup, settle

BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
DELETE, INSERT, KEEP, REROLE = "DIKR"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 3, 2, 2, 1
AHEAD = 64
SEGMENT_ROWS = 256
LARGE_ROWS, LARGE_BYTES = 4096, 16 << 20
# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ACCEPTED = (START, ASSISTANT)
FOLLOWING = (USER, USER, ASSISTANT, USER)
NEVER = 1 << 40
LEGAL = ("su", "ua", "au")
# Kinds of rows: by the role's initial, then those that have to go; a truncated row has TRUNCATED added.
KINDS, OTHER, GONE, TRUNCATED = {"s": 0, "u": 1, "a": 2}, 3, 4, 8

SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")
REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"


def _row_edits(kind: int, state: int) -> list[tuple[str, int, int]]:
    """Edits that use up a row: name, cost and next state, in ASCII order."""
    out = [(DELETE, DELETE_COST, state)]
    if kind == GONE:
        return out
    more, role, to = (TRUNCATED_COST if kind >= TRUNCATED else 0), kind % TRUNCATED, FOLLOWING[state]
    if role == KINDS["s"] and state == START:
        out.append((KEEP, more, SYSTEM))
    elif (role == KINDS["u"] and to == USER) or (role == KINDS["a"] and to == ASSISTANT):
        out.append((KEEP, more, to))
    return [*out, (REROLE, REROLE_COST + more, to)]


ROW_EDITS = {(kind, state): _row_edits(kind, state) for state in STATES
             for kind in (*range(GONE + 1), *range(TRUNCATED, TRUNCATED + OTHER + 1))}


def _inserted(costs: list[int]) -> list[int]:
    """Costs from every state where up to two turns may be inserted first."""
    one = [INSERT_COST + costs[FOLLOWING[s]] for s in STATES]
    two = [INSERT_COST + one[FOLLOWING[s]] for s in STATES]
    return [min(costs[s], one[s], two[s]) for s in STATES]


def remaining(kinds: list[int], exits: tuple[int, ...], last: bool, ahead: int = AHEAD) -> list[list[int]]:
    """A lower bound of the cost from each row and state to one of ``exits`` behind the last row.

    Exact inside blocks of ``ahead`` rows; from one block to the next, user and assistant may change places for nothing. Turns may be inserted behind the last row only if ``last``.
    """
    here = [0 if s in exits else NEVER for s in STATES]
    bounds = [_inserted(here) if last else here]
    for row in range(len(kinds) - 1, -1, -1):
        after = bounds[-1]
        if (row + 1) % ahead == 0 and row + 1 < len(kinds):
            phase = min(after[USER], after[ASSISTANT])
            after = [after[START], after[SYSTEM], phase, phase]
        bounds.append(_inserted([min(cost + after[to] for _, cost, to in ROW_EDITS[kinds[row], s]) for s in STATES]))
    return bounds[::-1]


def search(kinds: list[int], entry: int = START, exits: tuple[int, ...] = ACCEPTED, last: bool = True,
           ahead: int = AHEAD) -> tuple[int, str] | None:
    """Cost and edits of the cheapest, then ASCII-least way from ``entry`` to one of ``exits``; None if there is none.

    Before the last row, turns may be inserted anywhere; behind it, only if ``last``.
    """
    rows = len(kinds)
    if not rows and entry in exits:
        return 0, ""
    bounds = remaining(kinds, exits, last, ahead)
    bound = bounds[0][entry]
    if bound >= NEVER or not rows and not last:
        return None

    def edits(row: int, state: int):
        insert = (INSERT, INSERT_COST, row, FOLLOWING[state])
        if row == rows:
            return iter([insert] if last else [])
        first, *others = [(name, cost, row + 1, to) for name, cost, to in ROW_EDITS[kinds[row], state]]
        return iter([first, insert, *others])

    while True:
        failed: dict[tuple[int, int], int] = {}
        path: list[str] = []
        beyond = NEVER
        waiting = [(0, entry, 0, edits(0, entry))]
        while waiting:
            row, state, spent, left = waiting[-1]
            for name, cost, to_row, to in left:
                total = spent + cost
                least = total + bounds[to_row][to]
                if least > bound:
                    beyond = min(beyond, least)
                    continue
                if failed.get((to_row, to), -1) >= bound - total:
                    continue
                path.append(name)
                if to_row == rows and to in exits:
                    return total, "".join(path)
                waiting.append((to_row, to, total, edits(to_row, to)))
                break
            else:
                waiting.pop()
                failed[row, state] = max(failed.get((row, state), -1), bound - spent)
                if path:
                    path.pop()
        bound = beyond


def segment_table(kinds: list[int], last: bool) -> tuple[list[int], list[int]]:
    """For every entry and exit state (entry * 4 + exit) the cost between them (``NEVER`` if none) and the place of
    its edits among those from the same entry in ASCII order. The exit of a last segment is 0."""
    costs, ranks = [], []
    for entry in STATES:
        found = [search(kinds, entry, ACCEPTED, True) if last and exit_ == 0 else None if last else search(kinds, entry, (exit_,), False)
                 for exit_ in STATES]
        order = sorted(f[1] for f in found if f)
        costs += [f[0] if f else NEVER for f in found]
        ranks += [order.index(f[1]) if f else len(STATES) for f in found]
    return costs, ranks


def chosen_exits(costs: list[int], ranks: list[int], later: list[int]) -> tuple[list[int], list[int]]:
    """For every entry state the cost from there on and the best exit; ``later`` has the costs behind each exit.

    Edits of one segment between different states never begin one another, as all end with a row, so that their order decides.
    """
    out = []
    for entry in STATES:
        out.append(min((costs[4 * entry + e] + later[e], ranks[4 * entry + e], e) for e in STATES))
    return [min(cost, NEVER) for cost, _, _ in out], [e for _, _, e in out]


def repaired(kinds: list[int], segment: int = SEGMENT_ROWS) -> str:
    """The edits of a whole conversation held in memory."""
    if len(kinds) <= segment:
        return search(kinds)[1]
    parts = [kinds[i:i + segment] for i in range(0, len(kinds), segment)]
    later, choices = [0] * 4, []
    for number in range(len(parts) - 1, -1, -1):
        later, chosen = chosen_exits(*segment_table(parts[number], number == len(parts) - 1), later)
        choices.append(chosen)
    state, out = START, []
    for number, (part, chosen) in enumerate(zip(parts, reversed(choices))):
        last = number == len(parts) - 1
        out.append(search(part, state, ACCEPTED if last else (chosen[state],), last)[1])
        state = chosen[state]
    return "".join(out)


def kind_of(role: str, text: str, seen: bool) -> int:
    """A row's kind; ``seen`` if a row before it has the same role and text."""
    bare = text.rstrip(BLANKS)
    if not bare or seen:
        return GONE
    return KINDS.get(role[:1], OTHER) + (0 if bare[-1] in STOPS else TRUNCATED)


class _Report:
    """Counts, audit and digest of one conversation, row after row."""

    def __init__(self, conv_id):
        self.conv_id, self.counts, self.cost = conv_id, [0, 0, 0, 0], 0
        self.turns, self.edges, self.before, self.state = 0, [], None, START
        self.audit, self.digest, self.places = [], sha256(), 0

    def _out(self, edit: str, turn, role: str, text: str):
        self.digest.update((f"{role}:{text}" if not self.places else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
        self.places += 1
        return self.conv_id, self.places - 1, edit, turn, role, text

    def _next(self) -> str:
        self.state = FOLLOWING[self.state]
        return "user" if self.state == USER else "assistant"

    def feed(self, rows: list[tuple], edits: str):
        """``rows``: turn, role, text and kind, whose ``edits`` use up all of them; gives the repaired rows."""
        waiting = iter(rows)
        for edit in edits:
            if edit == INSERT:
                self.cost += INSERT_COST
                yield self._out(edit, None, self._next(), "")
                continue
            turn, role, text, kind = next(waiting)
            self._count(turn, role, text, kind)
            if edit == DELETE:
                self.cost += DELETE_COST
                continue
            self.cost += (TRUNCATED_COST if kind >= TRUNCATED else 0) + (REROLE_COST if edit == REROLE else 0)
            if edit == REROLE:
                role = self._next()
            else:
                self.state = SYSTEM if kind % TRUNCATED == KINDS["s"] else FOLLOWING[self.state]
            yield self._out(edit, turn, role, text)
        self.audit.append(edits)

    def _count(self, turn, role: str, text: str, kind: int) -> None:
        fault = 2 if kind >= TRUNCATED else None if kind != GONE else 1 if text.rstrip(BLANKS) else 0
        if fault is not None:
            self.counts[fault] += 1
        if self.before is not None and self.before[:1] + role[:1] not in LEGAL:
            self.counts[3] += 1
        self.before = role
        if turn is not None:
            if not self.edges or turn != self.edges[1]:
                self.turns += 1
            self.edges = [self.edges[0] if self.edges else turn, turn]

    def row(self) -> tuple:
        gaps = self.edges[1] - self.edges[0] + 1 - self.turns if self.edges else 0
        return (self.conv_id, gaps, *self.counts, self.cost, "".join(self.audit), self.digest.hexdigest())


def _batches(rows, schema: str, size: int = 4096):
    fields = pa.schema([(name, pa.int64() if kind == "long" else pa.string())
                        for name, kind in (part.split() for part in schema.split(", "))])
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) == size:
            yield _batch(kept, fields)
            kept = []
    if kept:
        yield _batch(kept, fields)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows), fields)], schema=fields)


def _tuples(batches, names: list[str]):
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _grouped(rows, size: int):
    """Runs of rows with the same first ``size`` values, each as a list."""
    held, key = [], None
    for row in rows:
        if held and row[:size] != key:
            yield key, held
            held = []
        key = row[:size]
        held.append(row[size:])
    if held:
        yield key, held


def _whole(want: str):
    """Repair conversations that come row by row in order, one in memory at a time."""
    def run(batches):
        def out():
            for (conv_id,), rows in _grouped(_tuples(batches, ["conv_id", "turn", "role", "text", "lost"]), 1):
                report, seen, ready = _Report(conv_id), set(), []
                for turn, role, text, lost in rows:
                    if not lost:
                        ready.append((turn, role, text, kind_of(role, text, (role, text) in seen)))
                        seen.add((role, text))
                made = report.feed(ready, repaired([r[3] for r in ready]))
                if want == REPAIRED:
                    yield from made
                else:
                    for _ in made:
                        pass
                    yield report.row()

        yield from _batches(out(), want)

    return run


def _tables(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("pos")
    costs, ranks = segment_table(frame["kind"].to_list(), bool(frame["last"].iloc[0]))
    return pd.DataFrame({"__conv": [frame["__conv"].iloc[0]], "segment": [frame["segment"].iloc[0]], "costs": [costs], "ranks": [ranks]})


def _backward(frames):
    """Best exits of every segment, from a conversation's last one to its first."""
    later, now = None, None
    for frame in frames:
        out = []
        for conv, segment, costs, ranks in zip(frame["__conv"], frame["segment"], frame["costs"], frame["ranks"]):
            later, chosen = chosen_exits([int(c) for c in costs], [int(r) for r in ranks], later if conv == now else [0] * 4)
            out.append((conv, segment, chosen))
            now = conv
        yield pd.DataFrame(out, columns=["__conv", "segment", "chosen"])


def _forward(frames):
    """The state each segment begins and ends in."""
    state, now = START, None
    for frame in frames:
        out = []
        for conv, segment, chosen in zip(frame["__conv"], frame["segment"], frame["chosen"]):
            entry = state if conv == now else START
            state, now = int(chosen[entry]), conv
            out.append((conv, segment, entry, state))
        yield pd.DataFrame(out, columns=["__conv", "segment", "entry", "exit"])


def _segments(want: str):
    """Repair conversations that come row by row in order, one segment in memory at a time."""
    def run(batches):
        def out():
            report = now = None
            names = ["__conv", "conv_id", "segment", "last", "entry", "exit", "turn", "role", "text", "kind"]
            for (conv, conv_id, _, last, entry, exit_), rows in _grouped(_tuples(batches, names), 6):
                if conv != now:
                    if report is not None and want == SUMMARY:
                        yield report.row()
                    report, now = _Report(conv_id), conv
                found = search([int(r[3]) for r in rows], int(entry), ACCEPTED if last else (int(exit_),), bool(last))
                for made in report.feed([(*r[:3], int(r[3])) for r in rows], found[1]):
                    if want == REPAIRED:
                        yield made
            if report is not None and want == SUMMARY:
                yield report.row()

        yield from _batches(out(), want)

    return run


def _in_order(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.repartition("__conv").sortWithinPartitions("__conv", *order)


def _kind_column() -> Column:
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.substring("role", 1, 1)]
    return F.when((bare == "") | F.col("seen"), GONE).otherwise(F.coalesce(initial, F.lit(OTHER)) + F.when(
        F.substring(bare, -1, 1).isin(*STOPS), 0).otherwise(TRUNCATED))


def _large(rows: DataFrame, want: str, hot_rows: int) -> DataFrame:
    """The same for conversations of any size, none of them held in one task, though a conversation's texts
    pass through one, row by row, for the digest."""
    tied = rows.where("not lost").drop("lost").withColumn("__nth", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("__nth")]
    placed = settle(dense_position(settle(tied), ["__conv"], order, "pos", hot_rows).withColumns({
        "segment": F.floor(F.col("pos") / SEGMENT_ROWS).cast("long"), "__text": F.sha2("text", 256)}))
    first = placed.groupBy("__conv", "role", "__text").agg(F.min("pos").alias("first"))
    ends = settle(placed.groupBy("__conv").agg(F.max("segment").alias("end")))
    kinds = settle(placed.join(first, ["__conv", "role", "__text"]).join(hinted(ends), "__conv").withColumn(
        "seen", F.col("pos") > F.col("first")).withColumns({"kind": _kind_column(), "last": F.col("segment") == F.col("end")}).select(
        "__conv", "conv_id", "pos", "segment", "last", "turn", "role", "text", "kind"))
    tables = kinds.select("__conv", "segment", "pos", "kind", "last").groupBy("__conv", "segment").applyInPandas(
        _tables, "__conv string, segment long, costs array<long>, ranks array<int>")
    chosen = _in_order(tables, F.desc("segment")).mapInPandas(_backward, "__conv string, segment long, chosen array<int>")
    states = _in_order(settle(chosen), F.asc("segment")).mapInPandas(
        _forward, "__conv string, segment long, entry int, exit int")
    searched = kinds.join(hinted(settle(states)), ["__conv", "segment"])
    done = _in_order(searched, F.asc("pos")).mapInArrow(_segments(want), want)
    if want == REPAIRED:
        return done
    empty = rows.select("__conv", "conv_id").distinct().join(ends, "__conv", "left_anti").select("conv_id")
    return done.unionByName(empty.mapInArrow(lambda batches: _batches(
        (_Report(conv_id).row() for (conv_id,) in _tuples(batches, ["conv_id"])), want), want))


def _repair(rows: DataFrame, lost: Column, want: str, large_rows: int, large_bytes: int, hot_rows: int) -> DataFrame:
    blank = F.lit(" ")
    rows = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), blank).alias("__conv"), F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"), F.when(~lost, F.coalesce("role", blank)).alias("role"),
        F.when(~lost, F.coalesce("text", blank)).alias("text"), lost.alias("lost"))
    large = settle(rows.groupBy("__conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).where(
        (F.col("n") > large_rows) | (F.col("bytes") > large_bytes)).select("__conv"))
    if not rows_of(large):
        return _in_order(rows, F.asc_nulls_first("turn"), F.col("role"), F.col("text")).mapInArrow(_whole(want), want)
    marked = left_lookup(rows, hinted(large).withColumn("__large", F.lit(True)), ["__conv"])
    small = _in_order(marked.where("__large is null"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"))
    return small.mapInArrow(_whole(want), want).unionByName(_large(marked.where("__large").drop("__large"), want, hot_rows))


def conversation_report(rows: DataFrame, lost: Column | None = None, large_rows: int = LARGE_ROWS,
                        large_bytes: int = LARGE_BYTES, hot_rows: int = 2_000_000) -> DataFrame:
    """Faults and cheapest edits of every conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``.

    ``rows`` holds ``conv_id``, ``turn``, ``role`` and ``text``. Rows go by turn (nulls first), rows of one turn by role and text.
    A null role or text is one space. Rows of a null ``conv_id`` are one conversation. Rows for which ``lost`` is true are no
    part of a conversation, but it is reported: without any rows with zeros, no edits and the digest of an empty text.
    Repeated rows are duplicates. An empty table gives no rows. Other columns are not read.

    A conversation beyond ``large_rows`` rows or ``large_bytes`` of text is not held in memory. Its audit is one value, and its
    texts pass through one task, as their digest asks for.
    """
    return _repair(rows, F.lit(False) if lost is None else F.coalesce(lost, F.lit(False)), SUMMARY, large_rows, large_bytes, hot_rows)


def repaired_conversations(rows: DataFrame, large_rows: int = LARGE_ROWS, large_bytes: int = LARGE_BYTES,
                           hot_rows: int = 2_000_000) -> DataFrame:
    """The rows after the cheapest edits: ``conv_id``, ``place`` from 0, ``edit`` (``I``, ``K`` or ``R``), ``turn`` (null where inserted),
    ``role`` and ``text``. Rows and edge cases as in ``conversation_report``; conversations without rows give none."""
    return _repair(rows, F.lit(False), REPAIRED, large_rows, large_bytes, hot_rows)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with known faults, by crc32 of ``conv_id:turn`` modulo 20: ``lost`` where it is 0; 1 empties the text, 2 takes its
    full stops, question and exclamation marks, 3 repeats the row, 4 makes it the user's. Nulls are one space."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), blank))) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("lost"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
