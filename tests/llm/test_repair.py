"""Repairs against a search over all edits, and segments against whole conversations."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from pathloom.llm.repair import RepairConfig, Ways, _Edits, damaged, repair_report, segment_matrix

SCHEMA = "conv_id long, turn int, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(own):
    seen, out = set(), []
    for _, _, role, text in own:
        solid = text.rstrip(BLANK)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(own, found):
    """The least (cost, audit) by a search that opens partial repairs from the end backwards."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {}
    # (cost, audit from here, row, last said, lines): backwards, so that audits compare from their start
    heap = [(0, "", len(own), "", ()), (0, "", len(own), "a", ())]
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if (at, last) in best:
            continue
        best[at, last] = (cost, audit, lines)
        for state, following in follow.items():
            for role in ("user", "assistant"):
                if role[0] in following and role[0] == last:
                    heapq.heappush(heap, (cost + 2, "I" + audit, at, state, (role + ":", *lines)))
        if at:
            _, _, role, text = own[at - 1]
            bad = found[at - 1]
            heapq.heappush(heap, (cost + 3, "D" + audit, at - 1, last, lines))
            if bad not in ("blank", "duplicate"):
                more = bad == "truncated"
                for state, following in follow.items():
                    if role[:1] == last and role[:1] and role[:1] in following:
                        heapq.heappush(heap, (cost + more, "K" + audit, at - 1, state, (f"{role}:{text}", *lines)))
                    for new in ("user", "assistant"):
                        if new[0] == last and new[0] in following:
                            heapq.heappush(heap, (cost + 2 + more, "R" + audit, at - 1, state, (f"{new}:{text}", *lines)))
    return best[0, ""]


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = after_damage([r for r in rows if r[0] == conv])
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(own, found)
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(n, seed, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system"] + ["user", "assistant"] * 4 + ["tool", "s", "", "ua", None])
            text = rng.choice([None, "", " \n", "Yes.", "No!", "what", "é? \t", "a\nb.", f"own {rng.random()}."])
            rows.append((None if conv == 3 else conv, rng.choice([None, turn, turn, turn, 3]), role, text))
    return rows + rows[5:8]


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, repair_report(damaged(frame), frame).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_equals_search(spark, seed):
    """Nulls in all columns, blank texts, odd roles, ties, repeated rows."""
    check(spark, conversations(80, seed))


def test_one_long_conversation(spark):
    """Most rows are one conversation's, which all partitions share; a long text is one of its turns."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "tool"]), rng.choice(["Yes.", "no", f"{t}.", f"{t}!", f"{t}"])) for t in range(400)]
    rows[200] = (1, 200, "user", "long " * 50000)
    check(spark, rows + conversations(20, 7))


def test_empty_and_dropped(spark):
    check(spark, [])
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(dropped, 0, "user", "Hello.")])


def test_clashing_columns(spark):
    rows = conversations(10, 3)
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", pos int, part string, kind string")
    assert sorted(map(tuple, repair_report(damaged(frame), frame).collect()), key=str) == brute(rows)


def test_segments_compose():
    """A conversation cut anywhere costs what it costs whole, and the ways go through the same states."""
    edits, rng = _Edits(RepairConfig()), np.random.default_rng(0)
    for _ in range(200):
        kinds = rng.integers(0, 12, rng.integers(2, 30))
        cut = int(rng.integers(1, len(kinds)))
        over = np.array([True])
        whole = Ways(kinds, np.array([0, len(kinds)]), edits.ends[None], over, edits)
        right = (segment_matrix(kinds[cut:], edits) + edits.ends).min(1)
        left = Ways(kinds[:cut], np.array([0, cut]), right[None], ~over, edits)
        assert (whole.costs[0] == (segment_matrix(kinds, edits) + edits.ends).min(1)).all() and (left.costs[0] == whole.costs[0]).all()
        rest = Ways(kinds[cut:], np.array([0, len(kinds) - cut]), edits.ends[None], over, edits)
        letters = lambda ways, node: "".join(map(str, ways.letter[ways.ways(np.array([node]))[0]]))
        assert letters(whole, 0).rstrip("0") == letters(left, 0).rstrip("0") + letters(rest, left.exits(0)[0]).rstrip("0")


def test_ranks_order_audits():
    edits, rng = _Edits(RepairConfig()), np.random.default_rng(1)
    kinds, bounds = rng.integers(0, 12, 60), np.array([0, 7, 8, 30, 60])
    ways = Ways(kinds, bounds, np.tile(edits.ends, (4, 1)), np.ones(4, bool), edits)
    nodes, start = ways.ways(np.arange(64 * 4))
    audits = ["".join(map(str, ways.letter[nodes[start == i]])).rstrip("0") for i in range(64 * 4)]
    order = {a: i for i, a in enumerate(sorted(set(audits)))}
    assert ways.rank.tolist() == [order[a] for a in audits]
