"""Repair of conversations to the turn grammar (s?(ua)+)? by cheapest edits, with one automaton shared by all of them.

Each row becomes a symbol of its role and fault, each conversation a signature. Signatures are minimised from the end: two
suffixes are one node when, from every grammar state, their costs-to-go differ by one same amount and their best audits
rank alike, as nothing before them can then tell them apart. There are few such nodes. For each node, symbol and grammar
state the best edits and where they lead are computed once; a signature is read from the end to name its nodes and from the
start to spell its edits, once for all conversations that share it.

A conversation may hold any share of all rows: rows are sorted by range, cut into segments of at most SEGMENT neighbours, and
only conversations of several segments are chained, by what each segment makes of every node. Texts are exchanged twice and
hashed as a stream, segment by segment.

Costs: keep 0, rerole to user or assistant 2, delete 3 (the only edit of a blank or duplicate row), insert an empty user or
assistant row 2, and 1 for a truncated row that stays. Of cheapest audits the ASCII-least is taken. Null role and text count
as one space; a null conv_id is a conversation of its own. Rows go by turn (nulls first), equal turns by role and digest of the
text. Empty tables give empty results; columns other than conv_id, turn, role and text are left behind."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage

#: Rows of a segment, a power of two.
SEGMENT = 4096
#: Symbols: D must go; else the role (s, u, a, or x for any other), in capitals when truncated.
SYMBOLS = "DsuaxSUAX"
#: Grammar states: at the start, after s, after u, after a. An inserted or changed row takes the role that fits.
FITS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
SPACES = " \t\n\x0b\f\r"


# --- automaton -----------------------------------------------------------------------------------

def _with_inserts(own: dict) -> dict:
    """Per state the best of going on at once or inserting rows first. Options: (cost, audit key, edits, state)."""
    best = {}
    for s in range(4):
        options, path, at = [own[s]] if s in own else [], [], s
        for k in range(1, 4):
            role, at = NEXT[at]
            path.append(("I", role))
            if at in own:
                cost, key, edits, end = own[at]
                options.append((cost + 2 * k, ("I",) * k + key, (*path, *edits), end))
        best[s] = min(options, key=lambda o: o[:2])
    return best


def _node(best: dict) -> tuple:
    low = min(o[0] for o in best.values())
    keys = sorted({o[1] for o in best.values()})
    return tuple(best[s][0] - low for s in range(4)), tuple(keys.index(best[s][1]) for s in range(4))


@cache
def automaton() -> tuple[list, dict, dict]:
    """Nodes (costs-to-go and ranks of audits by state; 0 is the end), steps (node after, symbol) -> (node before, edits and
    state by state), and the edits by state at the end."""
    end = _with_inserts({0: (0, (), (), 0), 3: (0, (), (), 3)})
    nodes, steps, todo = [_node(end)], {}, [0]
    while todo:
        after = todo.pop()
        costs, ranks = nodes[after]
        for symbol in SYMBOLS:
            own, role, late = {}, symbol.lower(), int(symbol in "SUAX")
            for s in range(4):
                options = [(3, "D", "", s)]
                if symbol != "D":
                    options.append((2 + late, "R", *NEXT[s]))
                    if role in FITS[s]:
                        options.append((late, "K", "", FITS[s][role]))
                own[s] = min(((c + costs[t], (op, ranks[t]), ((op, to),), t) for c, op, to, t in options), key=lambda o: o[:2])
            best = _with_inserts(own)
            node = _node(best)
            if node not in nodes:
                nodes.append(node)
                todo.append(len(nodes) - 1)
            steps[after, symbol] = nodes.index(node), {s: (best[s][2], best[s][3]) for s in range(4)}
    return nodes, steps, {s: end[s][2] for s in range(4)}


def spell(signature: str, terminal: int = 0, state: int = 0, last: bool = True) -> tuple[list[tuple[str, str, int]], int]:
    """Edits (operation, new role, row or -1) of a signature before a node, from a grammar state, and their cost."""
    _, steps, closing = automaton()
    after = [terminal]
    for symbol in reversed(signature):
        after.append(steps[after[-1], symbol][0])
    out, cost = [], 0
    price = {"K": 0, "R": 2, "D": 3, "I": 2}
    for row, symbol in enumerate(signature):
        edits, state = steps[after[len(signature) - 1 - row], symbol][1][state]
        for op, role in edits:
            out.append((op, role, -1 if op == "I" else row))
            cost += price[op] + (symbol in "SUAX" and op in "KR")
    if last:
        out += [(op, role, -1) for op, role in closing[state]]
        cost += 2 * len(closing[state])
    return out, cost


def _tables() -> tuple[np.ndarray, np.ndarray]:
    nodes, steps, _ = automaton()
    to = np.zeros((len(nodes), len(SYMBOLS)), np.int32)
    state = np.zeros((len(nodes), len(SYMBOLS), 4), np.int32)
    for (after, symbol), (before, moves) in steps.items():
        k = SYMBOLS.index(symbol)
        to[after, k] = before
        state[after, k] = [moves[s][1] for s in range(4)]
    return to, state


def _fold(signature: str, to: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every node after a segment, the node before it and where each grammar state ends."""
    path = [np.arange(len(to), dtype=np.int32)]
    ks = [SYMBOLS.index(c) for c in signature]
    for k in reversed(ks):
        path.append(to[path[-1], k])
    ends = np.tile(np.arange(4, dtype=np.int32), (len(to), 1))
    for row, k in enumerate(ks):
        ends = np.take_along_axis(state[path[len(ks) - 1 - row], k], ends, axis=1)
    return path[-1], ends


# --- rows to segments ----------------------------------------------------------------------------

def _key(conv_id: str = "conv_id") -> Column:
    return F.concat(F.when(F.col(conv_id).isNull(), "n").otherwise("v"), F.coalesce(F.col(conv_id).cast("string"), F.lit("")))


def sorted_rows(conversations: DataFrame) -> DataFrame:
    """All rows in order, staged: key, conv_id, turn, role, text, digest and ``pos``, which rises along the whole table."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(_key().alias("key"), "conv_id", "turn", space("role").alias("role"), space("text").alias("text"),
                                F.sha2(space("text"), 256).alias("digest"))
    # Rows equal in all of it are dealt out by a number, as one key may hold a third of all rows.
    order = ["key", "turn", "role", "digest", "__row"]
    rows = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(rows.withColumn("pos", F.monotonically_increasing_id()).drop("__row"), "conversation-rows")


def segments(rows: DataFrame) -> DataFrame:
    """Staged: key, seg, signature, roles (initials), n_rows, blank, duplicate, truncated of each segment."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    first = F.substring("role", 1, 1)
    small = rows.select("key", "pos", "role", "digest", F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"),
                        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    seen = small.where("not blank").groupBy("key", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    small = small.join(seen, ["key", "role", "digest"], "left").withColumn("again", ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False)))
    cut = ~F.col("blank") & ~F.col("again") & F.col("cut")
    symbol = F.when(F.col("blank") | F.col("again"), "D").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    count = lambda c: F.sum(c.cast("long"))
    listed = small.groupBy("key", F.shiftright("pos", SEGMENT.bit_length() - 1).alias("seg")).agg(
        F.array_sort(F.collect_list(F.struct("pos", symbol.alias("symbol"), "initial"))).alias("l"), F.count("*").alias("n_rows"),
        count(F.col("blank")).alias("blank"), count(F.col("again")).alias("duplicate"), count(cut).alias("truncated"))
    return stage(listed.select("key", "seg", F.array_join("l.symbol", "").alias("signature"), F.array_join("l.initial", "").alias("roles"),
                               "n_rows", "blank", "duplicate", "truncated"), "conversation-segments")


PLACED = "key string, seg long, terminal int, state int, last boolean"
SPELT = "signature string, terminal int, state int, last boolean, cost long, edits array<struct<op:string,role:string,row:int>>"


def plans(segs: DataFrame) -> DataFrame:
    """Staged: the segments with cost and edits; ``alone`` tells conversations of one segment."""
    several = stage(segs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "conversation-long")
    chained = segs.join(several, "key", "left_semi").select("key", "seg", "signature")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, state = _tables()
        for b in batches:
            both = [_fold(s, to, state) for s in b["signature"]]
            yield pd.DataFrame({"key": b["key"], "seg": b["seg"], "before": [x.tolist() for x, _ in both], "ends": [y.ravel().tolist() for _, y in both]})

    def chain(b: pd.DataFrame) -> pd.DataFrame:
        """One row per segment of a conversation: nodes from the end, then states from the start."""
        b = b.sort_values("seg", ignore_index=True)
        terminal, state = [0] * len(b), [0] * len(b)
        for i in range(len(b) - 2, -1, -1):
            terminal[i] = int(b["before"][i + 1][terminal[i + 1]])
        for i in range(1, len(b)):
            state[i] = int(b["ends"][i - 1][4 * terminal[i - 1] + state[i - 1]])
        return pd.DataFrame({"key": b["key"], "seg": b["seg"], "terminal": terminal, "state": state, "last": [i == len(b) - 1 for i in range(len(b))]})

    def spell_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [spell(*x) for x in zip(b["signature"], b["terminal"], b["state"], b["last"])]
            out = b.copy()
            out["cost"] = [c for _, c in both]
            out["edits"] = [[{"op": o, "role": r, "row": i} for o, r, i in e] for e, _ in both]
            yield out

    folded = chained.mapInPandas(fold, "key string, seg long, before array<int>, ends array<int>")
    places = folded.groupBy("key").applyInPandas(chain, PLACED)
    placed = segs.join(several, "key", "left_anti").withColumns({"terminal": F.lit(0), "state": F.lit(0), "last": F.lit(True), "alone": F.lit(True)})
    placed = placed.unionByName(segs.join(places, ["key", "seg"]).withColumn("alone", F.lit(False)))
    placed = stage(placed, "conversation-placed")
    how = ["signature", "terminal", "state", "last"]
    spelt = placed.select(*how).distinct().mapInPandas(spell_all, SPELT)
    return stage(placed.join(spelt, how), "conversation-plans")


def repaired_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per segment its repaired rows: key, seg, alone, lines array<struct<op,role,text>>. Both sides are dealt by segment once."""
    texts = rows.groupBy("key", F.shiftright("pos", SEGMENT.bit_length() - 1).alias("seg")).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("l"))
    both = texts.join(plan.select("key", "seg", "alone", "edits"), ["key", "seg"])
    kept = F.filter("edits", lambda e: e["op"] != "D")
    names = {"u": "user", "a": "assistant"}

    def line(e):
        own = F.get(F.col("l"), F.when(e["row"] >= 0, e["row"]))
        role = F.when(e["role"] == "u", names["u"]).when(e["role"] == "a", names["a"]).otherwise(own["role"])
        return F.struct(e["op"].alias("op"), role.alias("role"), F.coalesce(own["text"], F.lit("")).alias("text"))
    return both.select("key", "seg", "alone", F.transform(kept, line).alias("lines"))


def _stream_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each key's segment texts, which come sorted; only the running hash is kept."""
    key, running, empty = None, None, True

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([running.hexdigest()], pa.string())], ["key", "repaired_sha256"])
    for batch in batches:
        for k, text in zip(batch.column(0), batch.column(1)):
            k, text = k.as_py(), text.as_py()
            if k != key:
                if running is not None:
                    yield row()
                key, running, empty = k, hashlib.sha256(), True
            if text is not None:
                running.update((b"" if empty else b"\n") + text.encode())
                empty = False
    if running is not None:
        yield row()


def repair(conversations: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and the hash of the repaired rows
    (``role:text``, joined by newlines). ``names``: the conversations to report, by default those that have rows."""
    prepare(conversations.sparkSession)
    rows = sorted_rows(conversations)
    plan = plans(segments(rows))
    turns = rows.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    part = F.struct("seg", "roles", F.array_join("edits.op", "").alias("audit"))
    sums = plan.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_rows", "blank", "duplicate", "truncated", "cost")], F.array_sort(F.collect_list(part)).alias("l"))
    legal = F.size(F.regexp_extract_all(F.array_join("l.roles", ""), F.lit("(?=su|ua|au)"), F.lit(0)))
    sums = sums.select("key", "blank", "duplicate", "truncated", (F.col("n_rows") - 1 - legal).alias("illegal"), "cost", F.array_join("l.audit", "").alias("audit"))
    lines = F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    fixed = repaired_rows(rows, plan).select("key", "seg", "alone", F.when(F.size("lines") > 0, F.array_join(lines, "\n")).alias("text"))
    fixed = stage(fixed.select("key", "seg", "alone", F.when(F.col("alone"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("repaired_sha256"),
                               F.when(~F.col("alone"), F.col("text")).alias("text")), "conversation-repaired")
    alone = fixed.where("alone").select("key", "repaired_sha256")
    long = fixed.where("not alone").repartition("key").sortWithinPartitions("key", "seg").select("key", "text").mapInArrow(_stream_hash, "key string, repaired_sha256 string")
    names = (conversations if names is None else names).select("conv_id").distinct().withColumn("key", _key())
    out = names.join(sums, "key", "left").join(turns, "key", "left").join(alone.unionByName(long), "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes its
    full stops, exclamation and question marks, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("__kind")).where("__kind <> 0")
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"))
    return rows.drop("__copy")
