"""Validation primers: best primer pairs for a table of targets.

Every target becomes one row with its own stretch of bases and search limits. Its sides meet in one exchange, a row each; candidates
are cut from them, filtered cheap-to-dear and searched in one Arrow pass (their number is limited by the search windows, not
by the data). The pair search is exact but lazy: a rank join over both sides, cheapest first, stops when no further pair can
reach the last one kept.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed as fx
from ..functions import seq as sq
from ..functions.frame import barrier
from ..functions.numeric import clamp, half_up
from ..functions.oligo import pair_runs, primer_bytes, primer_penalties, primer_singles
from .rankjoin import Side, best_pairs, lazy_pairs

TOP = 5
FALLBACK_SCORE = -999.0
# Highest penalty of a pair that is kept.
PAIR_LIMIT = 30
OUTSIDE_REACH = 650
OUTSIDE_FLANK = 120
# Candidates per side that the outside search of one interactive design looks at; design jobs look at all.
OUTSIDE_LIMIT = 90
CENTRE_SHIFT = 35
SCREEN_SHIFT = 40
_LMIN, _LMAX = fx.PRIMER_LEN_MIN, fx.PRIMER_LEN_MAX


def _limits(**columns) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast("bigint").alias(n) for n, c in columns.items()])


@dataclass
class Targets:
    """Targets of one search mode: target_id, t (limits), bases from bases_start."""

    mode: str
    df: DataFrame


def _as_target(df: DataFrame, mode: str, limits: Column, low: Column, high: Column) -> Targets:
    """target_id, t (limits), bases of [low, high)."""
    df = barrier(df.select("target_id", "_seq", limits.alias("t"), F.greatest(F.lit(0).cast("bigint"), low.cast("bigint")).alias("_l0"),
                           F.least(F.col("_n"), high.cast("bigint")).alias("_h0")), {"_low": F.col("_l0"), "_high": F.col("_h0")})
    return Targets(mode, df.select("target_id", "t", F.col("_low").alias("bases_start"),
                                   F.substring("_seq", F.col("_low").cast("int") + 1, F.greatest(
                                       F.lit(0), (F.col("_high") - F.col("_low")).cast("int"))).alias("bases")))


def _prepare(df: DataFrame, seq: str) -> DataFrame:
    return df.withColumns({"_seq": F.col(seq), "_n": F.length(seq).cast("bigint")})


def _centre_ideal(center, length, offset) -> Column:
    c = center.cast("double")
    return F.when(offset > 0, half_up(c - offset)).otherwise(half_up(c - length / F.lit(2.0)))


def centred_targets(df: DataFrame, center: str = "center", seq: str = "seq", offset: int = 0,
                    min_amp: int = fx.AMP_MIN, max_amp: int = fx.AMP_MAX, wanted: int = fx.AMP_WANTED) -> Targets:
    """Pairs around one position; ``offset`` > 0 asks for that distance from primer start to position."""
    df = _prepare(df, seq)
    n, c, off = F.col("_n"), F.col(center), F.lit(offset)
    lo_amp, hi_amp = max(2 * _LMIN, min_amp), max(2 * _LMIN, min_amp, max_amp)
    start = lambda amp, shift: clamp(_centre_ideal(c, F.lit(amp), off) + shift, 0,
                                     F.greatest(F.lit(0).cast("bigint"), n - amp))
    f_lo, f_hi = start(hi_amp, -CENTRE_SHIFT), start(lo_amp, CENTRE_SHIFT)
    fb_len = F.greatest(F.lit(48).cast("bigint"), F.least(n, F.lit(wanted)))
    fb_start = clamp(half_up(c.cast("double") - fb_len / F.lit(2.0)), 0, F.greatest(F.lit(0).cast("bigint"), n - fb_len))
    fb_end = F.least(n, fb_start + fb_len)
    limits = _limits(n=n, center=c, offset=off, amp_lo=lo_amp, amp_hi=hi_amp, wanted=wanted, f_lo=f_lo, f_hi=f_hi,
                     r_lo=f_lo + lo_amp - _LMAX, r_hi=F.least(n, f_hi + hi_amp) - _LMIN, a=c, b=c, fb_start=fb_start,
                     fb_end=fb_end)
    return _as_target(df, "centred", limits, F.least(f_lo, fb_start), F.greatest(f_hi + hi_amp, fb_end))


def flanking_targets(df: DataFrame, start: str = "anchor_start", end: str = "anchor_end", seq: str = "seq",
                     min_amp: int = fx.AMP_MIN, max_amp: int = fx.AMP_MAX, wanted: int = fx.AMP_WANTED) -> Targets:
    """Pairs on both sides of an interval."""
    df = _prepare(df, seq)
    n, a, b = F.col("_n"), F.col(start), F.col(end)
    zero = F.lit(0).cast("bigint")
    f_lo, f_hi = F.greatest(zero, a - 500), F.greatest(zero, a - 80) - 1
    r_lo, r_hi = F.least(n, b + 80), F.least(n, b + 460) - 1
    fb_len = F.greatest(F.lit(48).cast("bigint"), F.least(n, F.lit(wanted)))
    fb_start = clamp(half_up((a + b) / F.lit(2.0) - fb_len / F.lit(2.0)), 0, F.greatest(zero, n - fb_len))
    fb_end = F.least(n, fb_start + fb_len)
    limits = _limits(n=n, center=a, offset=0, amp_lo=min_amp, amp_hi=max_amp, wanted=wanted, f_lo=f_lo, f_hi=f_hi,
                     r_lo=r_lo, r_hi=r_hi, a=a, b=b, fb_start=fb_start, fb_end=fb_end)
    return _as_target(df, "flanking", limits, F.least(f_lo, fb_start), F.greatest(r_hi + _LMAX, fb_end))


def outside_targets(df: DataFrame, start: str = "arm_start", end: str = "arm_end", seq: str = "seq") -> Targets:
    """Pairs outside both homology arms [start, end)."""
    df = _prepare(df, seq)
    n = F.col("_n")
    df = barrier(df, {"_left": clamp(F.col(start), 0, n).cast("bigint")})
    left = F.col("_left")
    df = barrier(df, {"_right": F.greatest(left, F.least(n, F.col(end))).cast("bigint")})
    right = F.col("_right")
    room = (left >= _LMIN) & (n - right >= _LMIN)
    span = right - left
    lo_amp = F.greatest(span + 2 * _LMIN, span + 48)
    hi_amp = F.greatest(lo_amp, span + 2 * OUTSIDE_REACH + 2 * _LMAX)
    f_lo = F.greatest(F.lit(0).cast("bigint"), left - OUTSIDE_REACH)
    fb_f = left - F.least(F.lit(24).cast("bigint"), left)
    fb_r = right + F.least(F.lit(24).cast("bigint"), n - right)
    limits = _limits(n=n, center=left, offset=0, amp_lo=lo_amp, amp_hi=hi_amp,
                     wanted=F.greatest(lo_amp, span + 2 * OUTSIDE_FLANK), f_lo=f_lo, f_hi=left - _LMIN, r_lo=right,
                     r_hi=F.least(n - _LMIN, right + OUTSIDE_REACH), a=left, b=right, fb_start=fb_f, fb_end=fb_r)
    return _as_target(df.where(room), "outside", limits, f_lo, right + OUTSIDE_REACH + _LMAX)


def screen_targets(df: DataFrame, left: str = "left_cut", right: str = "right_cut", seq: str = "seq",
                   flank: int = fx.SCREEN_FLANK) -> Targets:
    """Pairs that span a deletion between two cuts."""
    df = _prepare(df, seq)
    n, lc, rc = F.col("_n"), F.col(left), F.col(right)
    top = F.greatest(F.lit(0).cast("bigint"), n - _LMIN)
    want_f, want_r = clamp(lc - flank, 0, top), clamp(rc + flank - _LMIN, 0, top)
    f_lo, f_hi = clamp(want_f - SCREEN_SHIFT, 0, top), clamp(want_f + SCREEN_SHIFT, 0, top)
    r_lo = F.greatest(f_lo + _LMIN + 50, F.least(F.greatest(F.lit(0).cast("bigint"), n - _LMAX), want_r - SCREEN_SHIFT))
    r_hi = F.greatest(f_hi + _LMAX + 50, F.least(top, want_r + SCREEN_SHIFT))
    fb_r = F.greatest(want_f + 74, want_r)
    fb_end = F.least(n, fb_r + 24)
    limits = _limits(n=n, center=want_r, offset=flank, amp_lo=0, amp_hi=0, wanted=500, f_lo=f_lo, f_hi=f_hi, r_lo=r_lo,
                     r_hi=r_hi, a=lc, b=rc, fb_start=want_f, fb_end=fb_end)
    return _as_target(df, "screen", limits, F.least(f_lo, want_f), F.greatest(r_hi + _LMAX, fb_end))


WHOLE = "whole"
# Sides that are measured together in one task.
ROWS_AT_ONCE = 32


_CANDIDATE = ("struct<placing:double,start:bigint,len:int,end:bigint,cost:double,p:string,gc:double,tm:double,clamp:int,pen:double>")


def _sides(targets: Targets, with_targets: bool) -> DataFrame:
    """target_id, n, a, b, side, lo, hi, piece_start, piece, g: one row per side with its own stretch of bases, so a substring never has
    to walk over the whole amplicon. ``with_targets`` adds one row per target (side WHOLE) that carries t, bases and bases_start in g."""
    def side_of(name, lo, hi):
        first = F.greatest(F.lit(0).cast("bigint"), F.col("bases_start"), lo)
        piece = F.substring("bases", (first - F.col("bases_start")).cast("int") + 1, (hi - first).cast("int") + _LMAX)
        return F.struct(F.lit(name).alias("side"), lo.alias("lo"), hi.alias("hi"), first.alias("piece_start"),
                        piece.alias("piece"), F.lit(None).cast(wide).alias("g"))

    kept = F.lit(None).cast("string") if targets.mode == "screen" else F.col("bases")
    whole = F.struct("t", kept.alias("bases"), "bases_start")
    wide = targets.df.select(whole.alias("g")).schema["g"].dataType
    zero = F.lit(0).cast("bigint")
    sides = [side_of("f", F.col("t.f_lo"), F.col("t.f_hi")), side_of("r", F.col("t.r_lo"), F.col("t.r_hi"))]
    if with_targets:
        sides.append(F.struct(F.lit(WHOLE).alias("side"), zero.alias("lo"), zero.alias("hi"), zero.alias("piece_start"),
                              F.lit("").alias("piece"), whole.alias("g")))
    return targets.df.select("target_id", F.col("t.n").alias("n"), F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.inline(F.array(*sides))).where("hi >= lo")


def _singles(part: pa.Table, outside: bool, flank_wanted: int) -> tuple[dict, dict[str, np.ndarray]]:
    """The candidates of a few sides before their dimers are known (``row``: the row of each in ``part``, in order), and their columns."""
    of = lambda name: part.column(name).to_numpy()
    right, first, a, b, n = of("side") == "r", of("piece_start"), of("a"), of("b"), of("n")
    end = np.where(right | (not outside), n, np.minimum(n, a))
    w = primer_singles(part.column("piece").to_pylist(), list(right), of("lo") - first, of("hi") - first, end - first)
    row, size, start = w["row"], w["n"], w["start"] + first[w["row"]]
    placing = np.zeros(len(row))
    if outside:
        flank = np.where(right[row], start + size - b[row], a[row] - start)
        placing = np.abs(flank - flank_wanted) + np.abs(w["tm"] - 60) * 8 + np.abs(w["gc"] - 50) * 2 - w["clamp"] * 4
    return w, {"placing": placing, "start": start, "len": size, "end": start + size, "gc": w["gc"], "tm": w["tm"], "clamp": w["clamp"]}


def _measure(part: pa.Table, outside: bool, flank_wanted: int) -> tuple[np.ndarray, pa.StructArray]:
    """The candidates of a few sides that pass all limits: the row of each in ``part``, in order, and its measures."""
    w, columns = _singles(part, outside, flank_wanted)
    pen, good = primer_penalties(w, np.arange(len(w["n"])))
    return _candidates(w, columns, pen[good], np.flatnonzero(good))


def _first_measured(part: pa.Table, outside: bool, flank_wanted: int, per_side: int) -> tuple[np.ndarray, pa.StructArray]:
    """As ``_measure``, the first ``per_side`` candidates of each row in search order. Dimers are looked for in that order, until as
    many have passed."""
    w, columns = _singles(part, outside, flank_wanted)
    placing, row = columns["placing"], w["row"]
    ends = np.searchsorted(row, np.arange(len(part) + 1))
    pen, state, high = np.zeros(len(row)), np.zeros(len(row), np.int8), np.full(len(part), np.inf)
    looked, open_ = 2 * per_side, np.flatnonzero(np.diff(ends)).tolist()
    while open_:
        more = []
        for k in open_:
            own = placing[ends[k]:ends[k + 1]]
            # All of one place in search order are taken together, so ties are cut by start and length below.
            high[k] = np.inf if len(own) <= looked else np.partition(own, looked)[looked]
            more.append(ends[k] + np.flatnonzero((own <= high[k]) & (state[ends[k]:ends[k + 1]] == 0)))
        which = np.concatenate(more)
        pen[which], good = primer_penalties(w, which)
        state[which] = np.where(good, 1, 2)
        open_ = [k for k in open_ if high[k] < np.inf and (state[ends[k]:ends[k + 1]] == 1).sum() < per_side]
        looked *= 2
    which = np.flatnonzero(state == 1)
    which = which[np.lexsort((columns["len"][which], columns["start"][which], placing[which], row[which]))]
    first = np.searchsorted(row[which], row[which])
    which = which[np.arange(len(which)) - first < per_side]
    return _candidates(w, columns, pen[which], which)


def _candidates(w: dict, columns: dict[str, np.ndarray], pen: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
    """The candidates at places ``which`` with their penalties: the row of each and its measures."""
    columns = {n: v[which] for n, v in columns.items()}
    gc, tm, clamp_count, size = (columns[n] for n in ("gc", "tm", "clamp", "len"))
    cost = -(-np.abs(tm - 60) - np.abs(gc - 50) / 10 + clamp_count * 2 - pen / 8)
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    p = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(primer_bytes(w, which)))
    c = {"placing": pa.array(columns["placing"], pa.float64()), "start": pa.array(columns["start"], pa.int64()), "len": pa.array(size, pa.int32()), "end": pa.array(columns["end"], pa.int64()),
         "cost": pa.array(cost, pa.float64()), "p": p, "gc": pa.array(gc, pa.float64()), "tm": pa.array(tm, pa.float64()), "clamp": pa.array(clamp_count, pa.int32()), "pen": pa.array(pen, pa.float64())}
    return w["row"][which], pa.StructArray.from_arrays(list(c.values()), names=list(c))


def primer_candidates(targets: Targets, per_side: int | None = None) -> DataFrame:
    """All single primers that pass the quality limits: target_id, side, c (candidate: the oligo and a few numbers only); with
    ``per_side`` those of each row of ``targets`` that are first in search order, by placing, start and length."""
    df = _sides(targets, False).drop("g")
    schema = StructType([df.schema["target_id"], *StructType.fromDDL(f"side string, c {_CANDIDATE}").fields])
    outside, flank_wanted, rows_at_once = targets.mode == "outside", OUTSIDE_FLANK, ROWS_AT_ONCE
    measure = _measure if per_side is None else lambda *a, first=_first_measured: first(*a, per_side)

    def run(batches):
        names = ["target_id", "side", "c"]
        for batch in batches:
            sides = pa.Table.from_batches([batch])
            sides = sides.filter(pc.is_valid(sides.column("piece")))
            for at in range(0, len(sides), rows_at_once):
                part = sides.slice(at, rows_at_once)
                row, c = measure(part, outside, flank_wanted)
                picked = part.select(names[:2]).take(pa.array(row))
                yield from pa.Table.from_arrays([*(picked.column(name) for name in names[:2]), c], names=names).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def ranked_pairs(targets: Targets, top: int = TOP, per_side: int | None = None) -> DataFrame:
    """The best pairs of each target (no row for a target without any), rank 1..top.

    ``per_side`` limits the candidates of each side, those first in search order; by default all take part. The sides of a target
    meet in one exchange, a row each; their candidates are cut and searched where they meet, so no exchange carries candidates.
    The rank join of a target (see ``rankjoin``) looks at few of its pairs."""
    mode = targets.mode
    limits = {"screen_shift": SCREEN_SHIFT, "centre_shift": CENTRE_SHIFT, "outside_flank": OUTSIDE_FLANK, "least": _LMIN, "tm_delta": fx.PRIMER_TM_DELTA,
              "pair_limit": PAIR_LIMIT}
    # The number keeps the few bytes of many targets from being gathered in few tasks.
    parts = int(targets.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = _sides(targets, True).repartition(parts, "target_id").sortWithinPartitions("target_id")
    schema = StructType([df.schema["target_id"], *StructType.fromDDL(
        "rank int, fw_seq string, fw_start bigint, fw_end bigint, rev_seq string, rev_start bigint, rev_end bigint, amp bigint, reach bigint, amp_gc double, score double").fields])
    measure, light, whole_side, flank_wanted, rows_at_once, names = _measure, _singles, WHOLE, OUTSIDE_FLANK, ROWS_AT_ONCE, schema.names

    def listed(whole: dict, found: list[tuple], f: Side, r: Side) -> list[tuple]:
        out = []
        for rank, (score, amp, reach, i, j) in enumerate(found, 1):
            gc = None
            if whole["bases"] is not None:
                low = int(f.start[i]) - whole["bases_start"]
                text = whole["bases"][low:low + reach].upper()
                gc = float(np.floor((text.count("G") + text.count("C")) / len(text) * 1000.0 + 0.5) / 10.0) if text else 0.0
            out.append((rank, f.text(i), int(f.start[i]), int(f.end[i]), r.text(j), int(r.start[j]), int(r.end[j]), amp, reach, gc, score))
        return out

    def first_of(table: pa.Table, wholes: list[dict], side: np.ndarray, used: np.ndarray, ends: list[int]):
        """Pairs and sides of each target, with the first candidates of each side in search order."""
        row, c = measure(table.take(pa.array(used)), mode == "outside", flank_wanted)
        row, low = used[row], 0
        for end, whole in zip(ends, wholes):
            first, last = np.searchsorted(row, [low, end])
            mine, kind = c.slice(first, last - first), side[row[first:last]]
            f, r = (Side(mine.filter(pa.array(kind == s)), per_side) for s in "fr")
            yield best_pairs(mode, whole["t"], f, r, top, limits)[0], f, r
            low = end

    def all_of(table: pa.Table, wholes: list[dict], side: np.ndarray, used: np.ndarray, ends: list[int]):
        """Pairs and sides of each target, with all its candidates."""
        w, columns = light(table.take(pa.array(used)), mode == "outside", flank_wanted)
        row = used[w["row"]]
        return lazy_pairs(mode, [whole["t"] for whole in wholes], w, columns, np.searchsorted(ends, row, side="right"), side[row] == "r", top, limits)

    def pairs_of(table: pa.Table, ends: list[int]):
        """The pairs of whole targets; the rows of each end at a place of ``ends``."""
        side = np.array(table.column("side").to_pylist(), object)
        used = np.flatnonzero((side != whole_side) & pc.is_valid(table.column("piece")).to_numpy())
        own = [low + int(np.flatnonzero(side[low:end] == whole_side)[0]) for low, end in zip([0, *ends], ends)]
        wholes = table.column("g").take(pa.array(own)).to_pylist()
        ids, out = [], []
        for at, whole, found in zip(own, wholes, (all_of if per_side is None else first_of)(table, wholes, side, used, ends)):
            rows = listed(whole, *found)
            ids += [at] * len(rows)
            out += rows
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        columns = [list(x) for x in zip(*out)] if out else [[] for _ in kinds]
        of_target = table.column("target_id").take(pa.array(ids, pa.int64()))
        return pa.Table.from_arrays([of_target, *(pa.array(x, k) for x, k in zip(columns, kinds))], names=names).combine_chunks().to_batches()

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            if not len(table):
                continue
            ends = pc.run_end_encode(table.column("target_id").chunk(0)).run_ends.to_pylist()
            low = 0
            # The rows of the last target may go on in the next batch.
            whole = ends[:-1]
            for at in range(0, len(whole), rows_at_once // 2):
                some = whole[at:at + rows_at_once // 2]
                yield from pairs_of(table.slice(low, some[-1] - low).combine_chunks(), [x - low for x in some])
                low = some[-1]
            held = table.slice(low)
        if held is not None and len(held):
            yield from pairs_of(held.combine_chunks(), [len(held)])

    return df.mapInArrow(run, schema)


def with_fallback(targets: Targets, pairs: DataFrame) -> DataFrame:
    """Every target's pairs; a target without any gets one pair from the ends of the wanted amplicon
    (score -999, is_fallback)."""
    t, start = F.col("t"), F.col("bases_start")
    piece = lambda lo, hi: F.substring("bases", (lo - start).cast("int") + 1, (hi - lo).cast("int"))
    outside, screen = targets.mode == "outside", targets.mode == "screen"
    f_end = t["a"] if outside else F.least(t["n"], t["fb_start"] + 24)
    r_start = t["b"] if outside else F.greatest(F.lit(0).cast("bigint"), t["fb_end"] - 24)
    reach = t["fb_end"] - t["fb_start"]
    deletion = F.greatest(F.lit(48).cast("bigint"), (t["a"] - t["fb_start"]) + (t["fb_end"] - t["b"]))
    fb = targets.df.select(
        "target_id", piece(t["fb_start"], f_end).alias("_fs"), t["fb_start"].alias("_f0"), f_end.alias("_f1"),
        sq.revcomp_clean(piece(r_start, t["fb_end"])).alias("_rs"), r_start.alias("_r0"), t["fb_end"].alias("_r1"),
        (deletion if screen else reach).alias("_amp"), reach.alias("_reach"),
        (sq.gc_percent(piece(t["fb_start"], t["fb_end"])) if outside else F.lit(None).cast("double")).alias("_gc"))
    df = fb.join(pairs, "target_id", "left")
    none = F.col("rank").isNull()
    use = lambda new, old: F.when(none, F.col(old)).otherwise(F.col(new)).alias(new)
    no_length = F.lit(None).cast("bigint")
    return df.select(
        "target_id", F.lit(targets.mode).alias("mode"), F.coalesce("rank", F.lit(1)).alias("rank"), use("fw_seq", "_fs"),
        use("fw_start", "_f0"), use("fw_end", "_f1"), use("rev_seq", "_rs"), use("rev_start", "_r0"), use("rev_end", "_r1"),
        use("amp", "_amp"), (F.when(none, F.col("_reach")).otherwise(F.col("reach")) if screen else no_length).alias("wt_amp"),
        (F.when(none, F.col("_amp")).otherwise(F.col("amp")) if screen else no_length).alias("del_amp"),
        use("amp_gc", "_gc"), F.when(none, F.lit(FALLBACK_SCORE)).otherwise(F.col("score")).alias("score"),
        none.alias("is_fallback"))


def with_quality(pairs: DataFrame) -> DataFrame:
    """Add the quality of both primers (fw_*, rev_*) and of the pair."""
    df = sq.with_assessment(pairs, "fw_seq", "fw_")
    df = sq.with_assessment(df, "rev_seq", "rev_")
    df = df.withColumn("_runs", pair_runs(F.col("fw_seq"), F.col("rev_seq")))
    df = df.select(*[c for c in df.columns if c != "_runs"], F.col("_runs.hetero").alias("hetero"),
                   F.col("_runs.hetero_three").alias("hetero_three"))
    df = df.withColumns({
        "pair_penalty": sq.pair_penalty(F.col("fw_penalty"), F.col("rev_penalty"), F.col("hetero"),
                                        F.col("hetero_three"), F.col("fw_tm"), F.col("rev_tm")),
        "tm_delta": half_up(F.abs(F.col("fw_tm") - F.col("rev_tm")), 1)})
    warn = sq.pair_warnings(F.col("fw_warnings"), F.col("rev_warnings"), F.col("hetero"), F.col("hetero_three"))
    high_gc = F.coalesce(F.col("amp_gc") > 65, F.lit(False)) if "amp_gc" in pairs.columns else F.lit(False)
    return df.withColumns({
        "confidence": sq.pair_confidence(F.col("pair_penalty")),
        "pair_warnings": F.when(high_gc, F.concat(warn, F.array(F.lit("high-GC amplicon (>65%)")))).otherwise(warn)})


def design_pairs(targets: Targets, top: int = TOP, per_side: int | None = None) -> DataFrame:
    """Search plus fallback: the pairs every design job uses."""
    return with_fallback(targets, ranked_pairs(targets, top, per_side))


def outside_warning(arm_start: Column, arm_end: Column, seq_len: Column, has_pair: Column, is_fallback: Column) -> Column:
    up = F.when(arm_start < 18, "upstream of the 5' homology arm")
    down = F.when(seq_len - arm_end < 18, "downstream of the 3' homology arm")
    missing = F.array_compact(F.array(up, down))
    return (F.when(has_pair & is_fallback, "Only fallback validation primers could be placed outside the homology arms; "
                                           "review primer QC before ordering.")
            .when(has_pair, "")
            .when(F.size(missing) > 0, F.concat(
                F.lit("Outside-homology-arm validation primers need at least 18 bp of reference sequence "),
                F.array_join(missing, " and "),
                F.lit(". Upload a reference with additional flank or shorten the homology arms.")))
            .otherwise("No validated primer pair could be placed outside both homology arms; review this locus manually."))


def outside_strategy(has_pair: Column, is_fallback: Column) -> Column:
    return (F.when(~has_pair, "outside-homology-arms-unavailable").when(is_fallback, "outside-homology-arms-fallback")
            .otherwise("validated-outside-homology-arms"))


# Ship this module's functions with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
