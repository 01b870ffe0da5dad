"""Top pairs of two candidate lists by a rank join with early stop.

Both sides come sorted by cost. No pair of two blocks can score above minus the sum of their first costs, so blocks of pairs are
taken from a queue in the order of that bound, and the search of a target ends when the next block cannot reach the score of
its last kept pair. Within a block, pairs are measured in full in the order of their own bound (the score without hetero-dimers),
again only while that can reach the last kept score. Both bounds leave out penalties only, so the result is that of all pairs.
The work of a target is one group of an Arrow pass: its candidates are limited by its search windows.

Dimers and hairpins of the candidates themselves are looked for as late (``lazy_pairs``): the cheapest candidates without these
penalties give a first score, and only candidates that may stand in a pair of that score are measured in full."""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from ..functions.oligo import PrimerTexts, bit_runs, end_bits, primer_penalties

#: Candidates of a side in one block, and pairs measured at once.
BLOCK, MEASURED = 96, 64
#: Candidates of a side that are measured in full before anything is known of the pairs.
FIRST = 64
# Covers rounding of the pair penalty (1 decimal, divided by 8) and of the score (2 decimals).
SLACK = 0.02


def half_up(x, digits: int):
    scale = 10.0 ** digits
    return np.floor(x * scale + 0.5) / scale


class Side:
    """Candidates of one side as columns, cheapest first; ``order`` is their place in search order."""

    def __init__(self, rows: pa.StructArray, per_side: int | None):
        columns = {n: rows.field(n).to_numpy(zero_copy_only=False) for n in ("placing", "start", "len", "end", "cost", "gc", "tm", "clamp", "pen")}
        p = rows.field("p")
        offsets = np.frombuffer(p.buffers()[1], np.int32)[p.offset:p.offset + len(p) + 1] if len(p) else np.zeros(1, np.int32)
        raw = np.frombuffer(p.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(p) else np.zeros(0, np.uint8)
        self._take(columns, PrimerTexts(raw), (offsets[:-1] - offsets[0]).astype(np.int64), per_side)

    @classmethod
    def of(cls, columns: dict[str, np.ndarray], texts: PrimerTexts, at: np.ndarray) -> "Side":
        """The candidates of these columns, whose letters stand at ``at`` in ``texts``."""
        out = object.__new__(cls)
        out._take(columns, texts, at, None)
        return out

    def _take(self, columns: dict[str, np.ndarray], texts: PrimerTexts, at: np.ndarray, per_side: int | None) -> None:
        search = np.lexsort((columns["len"], columns["start"], columns["placing"]))[:per_side]
        place = np.arange(len(search))
        cheap = np.lexsort((place, columns["cost"][search]))
        take = search[cheap]
        self.order = place[cheap]
        for n in ("start", "len", "end", "cost", "gc", "tm", "clamp", "pen"):
            setattr(self, n, columns[n][take])
        self.texts, self.at = texts, at[take]
        self.ahead, self.back = texts.bits(self.at, self.len)

    def __len__(self):
        return len(self.cost)

    def text(self, i: int) -> str:
        return self.texts.raw[self.at[i]:self.at[i] + self.len[i]].tobytes().decode()


def _terms(mode: str, t: dict, f: Side, r: Side, i: np.ndarray, j: np.ndarray, c: dict):
    """Pairs (i, j) that may stand together: a mask, amplicon length, reach and placement penalty."""
    fs, fe, rs, re = f.start[i], f.end[i], r.start[j], r.end[j]
    reach = re - fs
    left, right = t["a"] - fs, re - t["b"]
    amp, extra = reach, np.zeros(len(i))
    if mode == "screen":
        room, nearest = np.maximum(0, t["n"] - r.len[j]), fe + 50
        ok = (rs >= np.maximum(nearest, np.minimum(room, t["center"] - c["screen_shift"]))) & (rs <= np.maximum(nearest, np.minimum(room, t["center"] + c["screen_shift"])))
        amp = np.maximum(2 * c["least"], left + right)
        extra = (np.abs(left - t["offset"]) + np.abs(right - t["offset"])) / 20.0
    else:
        ok = (reach >= t["amp_lo"]) & (reach <= t["amp_hi"])
        if mode == "centred":
            top = np.maximum(0, t["n"] - reach)
            ideal = np.full(len(i), t["center"] - t["offset"]) if t["offset"] > 0 else np.floor(t["center"] - reach / 2.0 + 0.5).astype(np.int64)
            ok &= (fs >= np.maximum(0, np.minimum(top, ideal - c["centre_shift"]))) & (fs <= np.maximum(0, np.minimum(top, ideal + c["centre_shift"]))) & (rs > fe)
            extra = np.abs((t["center"] - fs) - t["offset"]) / 5.0 if t["offset"] > 0 else np.abs(t["center"] - (fs + reach / 2.0)) / 5.0
        elif mode == "outside":
            extra = (np.abs(left - c["outside_flank"]) + np.abs(right - c["outside_flank"])) / 25.0
    return ok & (np.abs(f.tm[i] - r.tm[j]) <= c["tm_delta"]), amp, reach, extra


def _score(f: Side, r: Side, i, j, amp, wanted, penalty, extra):
    return half_up(-(np.abs(f.tm[i] - 60) + np.abs(r.tm[j] - 60)) - (np.abs(f.gc[i] - 50) + np.abs(r.gc[j] - 50)) / 10
                   + (f.clamp[i] + r.clamp[j]) * 2 - np.abs(amp - wanted) / 100 - penalty / 8 - extra, 2)


def _penalty(f: Side, r: Side, i, j, hetero, three):
    return half_up(f.pen[i] + r.pen[j] + np.maximum(0, hetero - 4) * 3 + np.maximum(0, three - 2) * 7 + np.abs(f.tm[i] - r.tm[j]) / 2, 1)


def _ends_pair(f: Side, r: Side, tails: tuple[np.ndarray, np.ndarray], i, j) -> np.ndarray:
    """Whether the last four bases of both primers are complementary."""
    return tails[0][i] == tails[1][j]


def _tails(f: Side, r: Side) -> tuple[np.ndarray, np.ndarray]:
    """The last four bases of the one side and, complemented and turned, of the other as numbers; other letters meet nothing."""
    def number(bits, other):
        low = [x.astype(np.int64) & 15 for x in bits[:3]]
        return np.where(low[2] == 15, low[0] + 16 * low[1], other)
    by = (f.len - 4).astype(np.uint32)
    return number([x >> by for x in f.ahead], -1), number(r.back, -2)


def best_pairs(mode: str, t: dict, f: Side, r: Side, top: int, c: dict, floor: float = -np.inf) -> tuple[list[tuple], int]:
    """The best ``top`` pairs as (score, amp, reach, i, j), of those that reach the score ``floor``, and how many pairs were measured in full."""
    if not len(f) or not len(r):
        return [], 0
    tails, width = None if mode == "screen" else _tails(f, r), int(max(f.len.max(), r.len.max()))
    ends = [end_bits(f.ahead, f.len), [x.astype(np.uint8) for x in r.back]]
    kept: list[tuple] = []
    ties = {"centred": lambda x: (x[2], f.start[x[3]], f.len[x[3]], r.len[x[4]]), "outside": lambda x: (f.order[x[3]], r.order[x[4]])}.get(
        mode, lambda x: (f.start[x[3]], f.len[x[3]], r.start[x[4]], r.len[x[4]]))
    measured = 0
    queue, seen = [(f.cost[0] + r.cost[0], 0, 0)], {(0, 0)}
    while queue:
        cost, a, b = heapq.heappop(queue)
        if SLACK - cost < floor:
            break
        for x, y in ((a + BLOCK, b), (a, b + BLOCK)):
            if x < len(f) and y < len(r) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(queue, (f.cost[x] + r.cost[y], x, y))
        i, j = np.nonzero(SLACK - (f.cost[a:a + BLOCK, None] + r.cost[None, b:b + BLOCK]) >= floor)
        i, j = i + a, j + b
        ok, amp, reach, extra = _terms(mode, t, f, r, i, j, c)
        if tails is not None:
            ok &= ~_ends_pair(f, r, tails, i, j)
        i, j, amp, reach, extra = i[ok], j[ok], amp[ok], reach[ok], extra[ok]
        bound = _score(f, r, i, j, amp, t["wanted"], _penalty(f, r, i, j, 0, 0), extra)
        order = np.argsort(-bound, kind="stable")
        for at in range(0, len(order), MEASURED):
            use = order[at:at + MEASURED]
            use = use[bound[use] >= floor]
            if not len(use):
                break
            left, right = i[use], j[use]
            three = bit_runs([x[left] for x in ends[0]], [x[right] for x in ends[1]], 8)
            hetero = bit_runs([x[left] for x in f.ahead], [x[right] for x in r.back], width)
            measured += len(use)
            pen = _penalty(f, r, i[use], j[use], hetero, three)
            score = _score(f, r, i[use], j[use], amp[use], t["wanted"], pen, extra[use])
            good = (three < 4) & (pen <= c["pair_limit"]) & (score >= floor)
            kept += [(float(s), int(m), int(e), int(x), int(y)) for s, m, e, x, y in zip(score[good], amp[use][good], reach[use][good], i[use][good], j[use][good])]
            if len(kept) > top:
                kept.sort(key=lambda x: (-x[0], *ties(x)))
                kept = kept[:top]
            if len(kept) == top:
                floor = min(x[0] for x in kept)
    kept.sort(key=lambda x: (-x[0], *ties(x)))
    return kept[:top], measured


def _least_extra(mode: str, t: dict[str, np.ndarray], start: np.ndarray, end: np.ndarray, right: np.ndarray, c: dict) -> np.ndarray:
    """What the place of a candidate costs a pair at least, its two sides added; ``t`` holds the limits of each candidate's target."""
    left, after = t["a"] - start, end - t["b"]
    out = np.where(right, after, left)
    if mode == "outside":
        return np.abs(out - c["outside_flank"]) / 25.0
    if mode == "screen":
        return np.abs(out - t["offset"]) / 20.0
    if mode == "centred":
        apart = np.where(right, end - t["center"], t["center"] - start)
        # The middle of a pair lies off the centre by what each side asks for at least, so by half their sum.
        middle = np.maximum(0, np.maximum(apart - t["amp_hi"] / 2.0, t["amp_lo"] / 2.0 - apart)) / 10.0
        return np.where(t["offset"] > 0, np.where(right, 0.0, np.abs(t["center"] - start - t["offset"]) / 5.0), middle)
    return np.zeros(len(start))


def lazy_pairs(mode: str, targets: list[dict], singles: dict, columns: dict[str, np.ndarray], owner: np.ndarray, right: np.ndarray, top: int, c: dict) -> list[tuple]:
    """For each target its best pairs and the two sides they stand in: those of :func:`best_pairs` over all candidates that pass.

    ``singles``: the candidates before their dimers are known; ``columns``: their placing, start, len, end, gc, tm and clamp; ``owner``
    and ``right``: target and side of each."""
    limits = {n: np.array([t[n] for t in targets])[owner] for n in ("a", "b", "center", "offset", "amp_lo", "amp_hi")}
    light = (np.abs(columns["tm"] - 60) + np.abs(columns["gc"] - 50) / 10 - columns["clamp"] * 2
             + _least_extra(mode, limits, columns["start"], columns["end"], right, c))
    pen, state = half_up(singles["part"], 1), np.zeros(len(owner), np.int8)
    cost = light + pen / 8
    key = owner * 2 + right
    by_key = np.argsort(key, kind="stable")
    ends = np.searchsorted(key[by_key], np.arange(2 * len(targets) + 1))
    groups = [by_key[ends[k]:ends[k + 1]] for k in range(2 * len(targets))]

    def measure(which: np.ndarray) -> None:
        pen[which], good = primer_penalties(singles, which)
        cost[which] = light[which] + pen[which] / 8
        state[which] = np.where(good, 1, 2)

    def side(which: np.ndarray, limit: float) -> Side:
        which = which[(state[which] == 1) & (cost[which] <= limit)]
        return Side.of({**{n: v[which] for n, v in columns.items()}, "cost": cost[which], "pen": pen[which]}, singles["texts"], singles["at"][which])

    measure(np.concatenate([g if len(g) <= FIRST else g[np.argpartition(cost[g], FIRST)[:FIRST]] for g in groups]))
    found: list = [None] * len(targets)
    floors, open_ = np.full(len(targets), -np.inf), list(range(len(targets)))
    reach = np.full((len(targets), 2), np.inf)
    while open_:
        more = []
        for k in open_:
            f, r = side(groups[2 * k], reach[k, 0]), side(groups[2 * k + 1], reach[k, 1])
            pairs, _ = best_pairs(mode, targets[k], f, r, top, c, floors[k])
            found[k] = (pairs, f, r)
            if len(pairs) == top:
                floors[k] = pairs[-1][0]
        # A candidate counts on while it can stand in a pair of the last kept score, beside the cheapest of the other side.
        for k in open_:
            least = [cost[g][state[g] != 2].min(initial=np.inf) for g in groups[2 * k:2 * k + 2]]
            reach[k] = [-np.inf if x == np.inf else SLACK - floors[k] - x for x in least[::-1]]
            for s in (0, 1):
                g = groups[2 * k + s]
                more.append(g[(state[g] == 0) & (cost[g] <= reach[k, s])])
        again = [len(more[2 * n]) + len(more[2 * n + 1]) > 0 for n in range(len(open_))]
        open_ = [k for k, x in zip(open_, again) if x]
        if open_:
            measure(np.concatenate(more))
    return found


# Ship this module's functions with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
