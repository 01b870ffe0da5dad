"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from editloom.llm import conversations as cv
from editloom.llm.queries import QUERIES


def cheapest(rows):
    """(cost, audit, roles and texts) over all edits of rows (initial, must go, truncated, role, text)."""
    legal = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    full = {"u": "user", "a": "assistant"}

    @cache
    def go(i, state, inserts):
        ways = []
        if i == len(rows):
            if state in (0, 3):
                ways.append((0, "", ()))
        else:
            initial, must, cut, role, text = rows[i]
            add = lambda cost, op, x, line=(): ways.append((x[0] + cost, op + x[1], line + x[2]))
            add(3, "D", go(i + 1, state, 0))
            if not must:
                for to, name in full.items():
                    if to in legal[state]:
                        add(2 + cut, "R", go(i + 1, legal[state][to], 0), (f"{name}:{text}",))
                if initial in legal[state]:
                    add(cut, "K", go(i + 1, legal[state][initial], 0), (f"{role}:{text}",))
        if inserts < 3:
            for to, name in full.items():
                if to in legal[state]:
                    x = go(i, legal[state][to], inserts + 1)
                    ways.append((x[0] + 2, "I" + x[1], (f"{name}:",) + x[2]))
        return min(ways) if ways else (10 ** 9, "", ())
    return go(0, 0, 0)


def plain(conversations):
    by = {}
    for conv, turn, role, text in conversations:
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked, counts = set(), [], [0, 0, 0]
        for turn, role, text in rows:
            seen_here = (role, text) in seen
            seen.add((role, text))
            body = text.strip(" \t\n\x0b\f\r")
            fault = 0 if not body else 1 if seen_here else 2 if body[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            marked.append((role[:1], fault in (0, 1), fault == 2, role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(tuple(marked))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def sample(rng, conversations=120, longest=9):
    rows, texts = [], ["Yes.", "No!", "half", "", " \t", "Why? ", "Yes.", None, "a.b", "é."]
    for conv in [*range(conversations), None]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "U"])
            rows.append((conv, turn if rng.random() < .9 else None, role, rng.choice(texts)))
    return rows


@pytest.mark.parametrize("segment", [4096, 2])
def test_query_equals_search(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(cv, "SEGMENT", segment)
    rows = sample(random.Random(segment)) + [(7777, i, ["user", "assistant"][i % 2], f"t{i % 50}.") for i in range(150)] + [(8, 1, "user", "same.")] * 30
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, seg int").repartition(5)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()), key=str)
    assert got == plain(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.repair(df).count() == 0


def test_segments_chain():
    rng, (to, state) = random.Random(2), cv._tables()
    for _ in range(500):
        text = "".join(rng.choice(cv.SYMBOLS) for _ in range(rng.randint(0, 14)))
        cut = rng.randint(0, len(text))
        node, _ = cv._fold(text[cut:], to, state)
        _, ends = cv._fold(text[:cut], to, state)
        one, a = cv.spell(text[:cut], int(node[0]), 0, False)
        two, b = cv.spell(text[cut:], 0, int(ends[node[0], 0]))
        whole, cost = cv.spell(text)
        assert a + b == cost and [e[:2] for e in one + two] == [e[:2] for e in whole]


def test_automaton_is_small_and_minimal():
    nodes, steps, _ = cv.automaton()
    assert len(nodes) == len(set(nodes)) < 100 and len(steps) == len(nodes) * len(cv.SYMBOLS)
