"""Guide sites of stretches of bases, found for a whole Arrow batch at once.

A site is two G at its end or two C at its start, so sites are looked for on the bytes of all stretches and only those found are
cut out; no row is made for a base that starts none."""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

SITE, SPACER = 23, 20
#: Bytes of stretches that are searched at once.
BYTES_AT_ONCE = 1 << 18

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_FLIP = np.full(256, ord("N"), np.uint8)
for _a, _b in zip(b"ACGT", b"TGCA"):
    _FLIP[_a] = _FLIP[_a + 32] = _b
_BASE = np.zeros(256, bool)
_BASE[list(b"ACGT")] = True
_IS_GC = np.isin(_UPPER, list(b"GC"))
_TO_PAIR = str.maketrans("ACGT", "TGCA")


def _cut_out(raw: np.ndarray, low: np.ndarray, high: np.ndarray, any_pam: bool):
    """Stretch, place, strand (minus or not) and bases of each site that starts from ``low`` to ``high`` of the stretches."""
    if len(raw) < SITE:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool), np.zeros((0, SITE), np.uint8)
    g, c = raw == ord("G"), raw == ord("C")
    plus, minus = g[SITE - 2:-1] & g[SITE - 1:], (c[:-1] & c[1:])[:len(raw) - SITE + 1]
    if not any_pam:
        plus &= _BASE[raw[SPACER:len(raw) - 2]]
        minus &= _BASE[raw[2:len(raw) - SPACER]]
    plus, minus = np.flatnonzero(plus), np.flatnonzero(minus)
    at, back = np.concatenate((plus, minus)), np.repeat([False, True], (len(plus), len(minus)))
    row = np.searchsorted(low, at, side="right") - 1
    own = (row >= 0) & (at <= high[row])
    row, at, back = row[own], at[own], back[own]
    order = np.lexsort((back, at))
    row, at, back = row[order], at[order], back[order]
    site = np.empty((len(at), SITE), np.uint8)
    place = np.arange(SITE)
    site[~back] = raw[at[~back, None] + place]
    site[back] = _FLIP[raw[at[back, None] + (SITE - 1 - place)]]
    return row, at - low[row], back, site


def _slow(texts: list[str], last: list[int], any_pam: bool):
    """As ``_cut_out``, as texts, for stretches with letters of several bytes."""
    for row, (text, end) in enumerate(zip(texts, last)):
        for at in range(end + 1):
            w = text[at:at + SITE]
            if w.endswith("GG") and (any_pam or w[20] in "ACGT"):
                yield row, at, False, w
            if w.startswith("CC") and (any_pam or w[2] in "ACGT"):
                yield row, at, True, re.sub("[^ACGTN]", "N", w.upper()[::-1].translate(_TO_PAIR))


def _texts(site: np.ndarray, low: int, high: int) -> pa.Array:
    part = np.ascontiguousarray(site[:, low:high])
    return pa.StringArray.from_buffers(len(part), pa.py_buffer(np.arange(len(part) + 1, dtype=np.int32) * (high - low)), pa.py_buffer(part))


def _groups(offsets: np.ndarray):
    """Ranges of rows of about BYTES_AT_ONCE bytes, one row at least."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BYTES_AT_ONCE, side="right")) - 1)
        yield low, high
        low = high


def find_sites(keep: list[str], any_pam: bool, drop_runs: bool, tile: int):
    """A function for ``mapInArrow`` over rows of ``keep``, bases, bases_start and _own (the end of what the stretch owns)."""
    names = [*keep, "spacer", "pam", "strand", "cut", "ps", "gc"]

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.filter(pc.is_valid(table.column("bases"))).combine_chunks()
            if not len(table):
                continue
            bases = table.column("bases").combine_chunks().cast(pa.string())
            bases = bases.chunk(0) if isinstance(bases, pa.ChunkedArray) else bases
            start = table.column("bases_start").cast(pa.int64())
            owned = pc.fill_null(pc.subtract(table.column("_own").cast(pa.int64()), start), tile).to_numpy()
            offsets = np.frombuffer(bases.buffers()[1], np.int32)[bases.offset:bases.offset + len(bases) + 1].astype(np.int64)
            data = bases.buffers()[2]
            every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            for first, end in _groups(offsets):
                raw, part = every[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
                if (raw < 128).all():
                    last = np.minimum(owned[first:end] - 1, np.diff(part) - SITE)
                    row, at, back, site = _cut_out(raw, part[:-1], part[:-1] + last, any_pam)
                    if drop_runs:
                        run_of = lambda letter: np.lib.stride_tricks.sliding_window_view(site[:, :SPACER] == ord(letter), 5, axis=1).all(axis=2).any(axis=1)
                        good = ~(run_of("T") | run_of("A"))
                        row, at, back, site = row[good], at[good], back[good], site[good]
                    spacer, pam, gc = _texts(site, 0, SPACER), _texts(site, SPACER, SITE), 5 * _IS_GC[site[:, :SPACER]].sum(axis=1)
                else:
                    texts = bases.slice(first, end - first).to_pylist()
                    found = list(_slow(texts, [min(int(o) - 1, len(t) - SITE) for t, o in zip(texts, owned[first:end])], any_pam))
                    if drop_runs:
                        found = [x for x in found if "TTTTT" not in x[3][:SPACER] and "AAAAA" not in x[3][:SPACER]]
                    row, at, back = (np.array([x[i] for x in found], kind) for i, kind in enumerate((np.int64, np.int64, bool)))
                    spacer, pam = pa.array([x[3][:SPACER] for x in found], pa.string()), pa.array([x[3][SPACER:SITE] for x in found], pa.string())
                    gc = np.array([5 * sum(b in "GC" for b in x[3][:SPACER].upper()) for x in found], np.int64)
                if not len(row):
                    continue
                picked = table.slice(first, end - first).take(pa.array(row))
                ps = pc.add(picked.column("bases_start").cast(pa.int64()), pa.array(at, pa.int64()))
                cut = pc.add(ps, pa.array(np.where(back, 6, 17), pa.int64()))
                strand = pa.array(["+", "-"]).take(pa.array(back.astype(np.int8)))
                out = pa.Table.from_arrays([*(picked.column(k) for k in keep), spacer, pam, strand, cut, ps, pa.array(gc, pa.int32())], names=names)
                yield from out.combine_chunks().to_batches()

    return run


# Ship this module's functions with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
