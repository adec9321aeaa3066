"""Cheapest edits against all edits kept side by side, reports against plain Python."""

import random
import re
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings, strategies as st

from strandline.llm import conversations as c

ROLES = ["user", "assistant", "system", "tool", "user", "assistant"]
TEXTS = ["Yes.", "no", "What?", "", " \n", "a.b", "Well! ", "it is", "ok.\r\n\t"]


def cheapest(rows):
    """Least (cost, audit) with the repaired lines over all edits, by state."""
    following = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}
    states = {0: (0, "", ())}

    def keep(into, state, found):
        if state not in into or found[:2] < into[state][:2]:
            into[state] = found

    def insert(states):
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                to = following[state]
                keep(states, to, (cost + 2, audit + "I", (*lines, f"{name[to]}:")))
        return states

    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, lines) in insert(dict(states)).items():
            keep(after, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more, to = int(fault == "truncated"), following[state]
            if (role[:1] == "s" and state == 0) or role[:1] == name[to][0]:
                keep(after, 1 if role[:1] == "s" else to, (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            keep(after, to, (cost + 2 + more, audit + "R", (*lines, f"{name[to]}:{text}")))
        states = after
    return min(found for state, found in insert(states).items() if state in (0, 3))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def report(rows, lost=True):
    """Reports of (conv_id, turn, role, text) after the known damage if ``lost``."""
    held = {}
    for conv, turn, role, text in rows:
        mine = held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if lost else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, mine in held.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode("utf-8")))
        turns = [r[0] for r in mine if r[0] is not None]
        named = faults([r[1:] for r in mine])
        counts = [sum(f == kind for _, _, f in named) for kind in ("blank", "duplicate", "truncated")]
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _, _), (b, _, _) in zip(named, named[1:]))
        cost, audit, lines = cheapest(named)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit,
                    sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, conversations, rows):
    rng = random.Random(seed)
    out = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, rows)):
            usual = "system" if turn == 0 and conv % 3 == 0 else ROLES[(turn + conv % 3) % 2]
            out.append((conv if conv else None, None if rng.random() < .05 else turn, rng.choice([usual] * 8 + ROLES + [None, "", "aé"]),
                        rng.choice(TEXTS + [f"{turn}."] * 8 + [None])))
    return out + out[:5] + [(2 ** 60 + 1, 2 ** 60, "user", "big."), (2 ** 60 + 1, None, "user", "big?"), (-5, 3, "user", "x " * 100_000)]


@given(st.lists(st.sampled_from([0, 1, 2, 3, c.GONE, 8, 9, 10, 11]), max_size=14), st.sampled_from([2, 3, 5, 16]))
@settings(max_examples=400, deadline=None)
def test_search(kinds, ahead):
    roles = {0: "s", 1: "u", 2: "a", 3: "x"}
    rows = [("u", "", "blank") if k == c.GONE else (roles[k % 8], "", "truncated" if k >= 8 else "") for k in kinds]
    expected = cheapest(rows)[:2]
    assert c.search(kinds, ahead=ahead) == expected
    for segment in (1, 2, 3):
        assert c.repaired(kinds, segment) == expected[1]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", True) for r in rows],
                                 "conv_id long, turn long, role string, text string, pos int, kind string, seen boolean").repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, shared, seed):
    rows = made(seed, 60, 12)
    got = c.conversation_report(c.damaged(frame(spark, rows)), c.F.col("lost"))
    assert sorted(map(tuple, got.collect()), key=repr) == report(rows)
    got = c.conversation_report(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == report(rows, lost=False)


@pytest.mark.parametrize("limits", [(0, 1 << 40, 50), (20, 100, 20), (1 << 40, 0, 1 << 40)])
def test_large_conversations(spark, shared, monkeypatch, limits):
    monkeypatch.setattr(c, "SEGMENT_ROWS", 7)
    rows = made(4, 12, 80)
    damaged = c.damaged(frame(spark, rows))
    got = c.conversation_report(damaged, c.F.col("lost"), *limits)
    assert sorted(map(tuple, got.collect()), key=repr) == report(rows)


def test_repaired_rows(spark, shared):
    rows = made(6, 20, 30)
    digests = {}
    for limits in ((1 << 40, 1 << 40, 1 << 40), (5, 1 << 40, 1 << 40)):
        held = {}
        for r in c.repaired_conversations(frame(spark, rows), *limits).collect():
            held.setdefault(r.conv_id, []).append((r.place, r.edit, r.turn, f"{r.role}:{r.text}"))
        for conv, mine in held.items():
            mine.sort()
            assert [m[0] for m in mine] == list(range(len(mine))) and all((m[1] == "I") <= (m[2] is None) for m in mine)
            assert re.fullmatch("(s?(ua)+)?", "".join(m[3][:1] for m in mine))
            digests.setdefault(conv, set()).add(sha256("\n".join(m[3] for m in mine).encode()).hexdigest())
    expected = {r[0]: {r[-1]} for r in report(rows, lost=False) if r[-1] != sha256(b"").hexdigest()}
    assert digests == expected


def test_empty(spark, shared):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.conversation_report(c.damaged(none), c.F.col("lost")).collect() == []
    assert c.repaired_conversations(none).collect() == []
