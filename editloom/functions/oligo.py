"""Arrow-batched oligo quality.

The dimer and hairpin searches compare every pair of positions of an oligo. As column expressions the whole
assessment takes about 300 microseconds of core time per oligo (measured); over an Arrow batch they are made on bits
for all oligos at once, so candidate tables use these functions. ``functions.seq`` holds the same measures as plain
column expressions.
"""

from __future__ import annotations

import math
import sys
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import NN_PARAMS, PRIMER_GC_MAX, PRIMER_GC_MIN, PRIMER_LEN_MAX, PRIMER_LEN_MIN, PRIMER_PENALTY_MAX, PRIMER_TM_MAX, PRIMER_TM_MIN

_FIELDS = {
    "gc": T.DoubleType(), "tm": T.DoubleType(), "dg3": T.DoubleType(), "clamp": T.IntegerType(), "run4": T.BooleanType(),
    "low": T.BooleanType(), "self_run": T.IntegerType(), "self_three": T.IntegerType(), "hairpin": T.IntegerType(),
    "penalty": T.DoubleType(),
}
QUALITY_TYPE = T.StructType([T.StructField(n, t) for n, t in _FIELDS.items()])
RUNS_TYPE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("hetero", "hetero_three")])

_CODE = np.full(256, 5, np.uint8)
for _i, _b in enumerate(b"ACGTN"):
    _CODE[_b] = _i
_COMPLEMENT = np.array([3, 2, 1, 0, 4, 4, 6, 7, 8, 9], np.uint8)
_H, _S10 = np.zeros((10, 10)), np.zeros((10, 10))
for _p, (_h, _s) in NN_PARAMS.items():
    _H["ACGT".index(_p[0]), "ACGT".index(_p[1])] = _h
    _S10["ACGT".index(_p[0]), "ACGT".index(_p[1])] = round(10 * _s)
_LEFT_PAD, _RIGHT_PAD = 9, 8
_CODE_OR_PAD = _CODE.copy()
_CODE_OR_PAD[0] = _LEFT_PAD


def _half_up(x, digits):
    scale = 10.0**digits
    return np.floor(x * scale + 0.5) / scale


def _upper(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= ord("a")) & (raw <= ord("z")), raw - 32, raw)


class Oligos:
    """A batch of oligos as byte and base-code matrices, left- and right-aligned."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.string())
        if column.null_count:
            column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        raw = _upper(raw)
        self.n = np.diff(offsets).astype(np.int64)
        self.width = max(8, int(self.n.max(initial=0)))
        self._fill(raw, offsets[:-1] - offsets[0])

    def _fill(self, raw: np.ndarray, first: np.ndarray) -> None:
        place = np.arange(self.width, dtype=np.int32)
        # Places beyond an oligo's end point to a byte that stands for none.
        self.bytes = np.append(raw, np.uint8(0))[np.where(place < self.n[:, None], first[:, None] + place, np.int32(len(raw)))]
        self.left = _CODE_OR_PAD[self.bytes]

    @classmethod
    def cut(cls, raw: np.ndarray, first: np.ndarray, n: np.ndarray) -> "Oligos":
        """The stretches of ``n`` upper-case bytes from ``first``."""
        out = object.__new__(cls)
        out.n, out.width = n.astype(np.int64), max(8, int(n.max(initial=0)))
        out._fill(raw, first)
        return out

    @cached_property
    def right(self) -> np.ndarray:
        place = np.arange(self.width) - (self.width - self.n[:, None])
        return np.where(place >= 0, np.take_along_axis(self.left, np.maximum(place, 0), axis=1), _LEFT_PAD).astype(np.uint8)

    def where(self, keep: np.ndarray) -> "Oligos":
        """The oligos at these places of the batch."""
        out = object.__new__(Oligos)
        out.n, out.width, out.bytes, out.left = self.n[keep], self.width, self.bytes[keep], self.left[keep]
        return out

    def reverse_complement(self) -> np.ndarray:
        codes = _COMPLEMENT[self.right[:, ::-1]]
        codes[self.right[:, ::-1] == _LEFT_PAD] = _RIGHT_PAD
        return codes


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of at most 64 truth values as one number each (bit i for column i)."""
    size = 32 if bits.shape[1] <= 32 else 64
    room = np.zeros((len(bits), size), bool)
    room[:, :bits.shape[1]] = bits
    return np.packbits(room, axis=1, bitorder="little").view(f"u{size // 8}").ravel()


#: Rows whose diagonals are held at once.
_ROWS = 2048


def _longest_run(left: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Longest common stretch of each row pair (length of equal diagonals).

    A diagonal is one number, a bit for each equal place; anding it with itself shifted by one shortens all its runs by one, so the
    number of such steps until nothing is left is the longest run."""
    return _runs_and_stems(left, other)[0]


def _runs_and_stems(left: np.ndarray, other: np.ndarray, n: np.ndarray | None = None, loop: int = 3) -> tuple[np.ndarray, np.ndarray | None]:
    """Longest common stretches, and where ``n`` gives the lengths of oligos that are compared with their own reverse complement, also
    those whose places are more than ``loop`` bases apart."""
    width = max(left.shape[1], other.shape[1])
    if width > 64 or (other > _LEFT_PAD).any():
        return _longest_run_wide(left, other), None if n is None else _longest_run_wide(left, other, n, loop)
    pad = lambda m, by: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])), constant_values=by)
    runs, stems = np.zeros(len(left), np.int32), None if n is None else np.zeros(len(left), np.int32)
    for at in range(0, len(left), _ROWS):
        part = slice(at, at + _ROWS)
        equal = _diagonals(pad(left[part], _LEFT_PAD), pad(other[part], _RIGHT_PAD))
        if n is not None:
            # On diagonal d, place i of an oligo of n bases meets its place n - 1 - d - i.
            far = _words(np.abs(np.arange(-width, 2 * width)[:, None] - 2 * np.arange(width)[None, :]) > loop)
            stems[part] = _longest_ones(equal & far[n[part] + (width - 1 - np.arange(1 - width, width))[:, None]])
        runs[part] = _longest_ones(equal)
    return runs, stems


def _diagonals(left: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Equal places of every diagonal, one row for each."""
    planes = lambda m: [_words(x) for x in ((m & 1) > 0, (m & 2) > 0, m < 4, m == 4)]
    return _equal_places(planes(left), planes(other), left.shape[1])


def _equal_places(a: list[np.ndarray], b: list[np.ndarray], width: int) -> np.ndarray:
    """Equal places of every diagonal of texts given as bits: both bits of a base's code, the places that hold one, and those of N,
    which meets itself."""
    (a0, a1, a, an), (b0, b1, b, bn) = a, b
    rare = an.any() and bn.any()
    equal = np.empty((2 * width - 1, len(a)), a.dtype)
    for rows, shift, by in ((slice(0, width - 1), np.left_shift, np.arange(width - 1, 0, -1)), (slice(width - 1, None), np.right_shift, np.arange(width))):
        part, by = equal[rows], by.astype(a.dtype)[:, None]
        shift(b0, by, out=part)
        part ^= a0
        second = shift(b1, by)
        second ^= a1
        part |= second
        np.invert(part, out=part)
        part &= a
        part &= shift(b, by, out=second)
        if rare:
            part |= an & shift(bn, by, out=second)
    return equal


def _longest_ones(equal: np.ndarray) -> np.ndarray:
    """Longest run of set bits in any row of a column; the numbers are used up."""
    best, rows, one = np.zeros(equal.shape[1], np.int32), np.arange(equal.shape[1]), equal.dtype.type(1)
    while len(rows):
        some = np.bitwise_or.reduce(equal, axis=0) != 0
        if 2 * some.sum() < len(rows):
            rows, equal, some = rows[some], equal[:, some], some[some]
        best[rows] += some
        equal &= equal >> one
    return best


def _longest_run_wide(left: np.ndarray, other: np.ndarray, apart: np.ndarray | None = None, loop: int = 3) -> np.ndarray:
    """As ``_longest_run`` for oligos of any length and letters."""
    best = np.zeros(len(left), np.int32)
    before = np.zeros((len(left), other.shape[1] + 1), np.int32)
    partner = None if apart is None else apart[:, None] - 1 - np.arange(other.shape[1])[None, :]
    for i in range(left.shape[1]):
        same = left[:, i:i + 1] == other
        if partner is not None:
            same &= np.abs(partner - i) > loop
        now = np.zeros_like(before)
        np.multiply(before[:, :-1] + 1, same, out=now[:, 1:])
        np.maximum(best, now.max(axis=1, initial=0), out=best)
        before = now
    return best


def _ending(matrix: np.ndarray, window: int) -> np.ndarray:
    return matrix[:, -window:]


def _low_complexity(o: Oligos) -> np.ndarray:
    b, n = o.bytes, o.n
    period = (b[:, 2:] == b[:, :-2]) & (np.arange(2, o.width)[None, :] < n[:, None])
    streak, longest = np.zeros(len(n), np.int32), np.zeros(len(n), np.int32)
    for k in range(period.shape[1]):
        streak = (streak + 1) * period[:, k]
        longest = np.maximum(longest, streak)
    repeats = longest >= 6
    kinds = sum((o.left == c).any(axis=1).astype(int) for c in range(6))
    head = b[:, 0].astype(int) * 256 + b[:, 1]
    starts = np.isin(head, [x[0] * 256 + x[1] for x in (b"AT", b"TA", b"GC", b"CG")])
    whole = starts & (n % 2 == 0) & (period.sum(axis=1) == n - 2)
    return repeats | whole | ((kinds <= 2) & (n >= 20)) | (n == 0)


def assess(o: Oligos) -> dict[str, np.ndarray]:
    """Composition, stability, dimers, hairpin and penalty of every oligo of the batch."""
    return _with_dimers(o, _single(o))


def _single(o: Oligos) -> dict[str, np.ndarray]:
    """The measures that need one look along an oligo, and the part of the penalty they give (``part``)."""
    gc_count, h, s10, h3, s3, clamp, run4, low = _bit_counts(o) if o.width <= 64 and not (o.left == 5).any() else _counts(o)
    gc, tm = _gc_percent(o.n, gc_count), _melting(o.n, gc_count, h, s10)
    dg3 = _half_up((h3 - 310.15 * (s3 / 10)) / 1000, 2)
    part = (np.abs(gc - 50) / 4 + np.abs(tm - 60) / 3 + 8.0 * run4 + 10.0 * low
            + np.where(dg3 > -1.0, 6.0, np.where(dg3 < -10.0, 4.0, 0.0)))
    return {"gc": gc, "tm": tm, "dg3": dg3, "clamp": clamp, "run4": run4, "low": low, "part": part}


def _gc_percent(n: np.ndarray, gc_count: np.ndarray) -> np.ndarray:
    return np.where(n == 0, 0.0, np.floor(gc_count / np.maximum(n, 1) * 1000 + 0.5) / 10)


def _melting(length: np.ndarray, gc_count: np.ndarray, h: np.ndarray, s10: np.ndarray) -> np.ndarray:
    """Melting temperature from the length, GC and stacking sums."""
    n = np.maximum(length, 1)
    dh = 200.0 + h
    ds = (-57.0 + s10) / 10
    mg, mono = 1.5e-3, 0.05
    ln_mg = math.log(mg)
    base = dh / (ds + 1.987 * math.log(250e-9 / 4)) - 273.15
    assert 0.22 <= math.sqrt(mg) / mono < 6.0  # the mixed-salt regime holds for these concentrations
    inverse = (1 / (base + 273.15) + 3.92e-5 - 9.11e-6 * ln_mg + gc_count / n * (6.26e-5 + 1.42e-5 * ln_mg)
               + (1 / (2 * np.maximum(1, length - 1))) * (-4.82e-4 + 5.25e-4 * ln_mg + 8.31e-5 * ln_mg**2))
    return np.where(length == 0, 0.0, _half_up(1 / inverse - 273.15, 1))


def _counts(o: Oligos) -> tuple[np.ndarray, ...]:
    """GC, stacking sums (all, last five bases), GC of the last three bases, a run of four, low complexity."""
    last, end = _ending(o.right, 5), _ending(o.right, 3)
    equal = (o.left[:, 1:] == o.left[:, :-1]) & (o.left[:, 1:] < 4)
    pairs = lambda table, m: table[m[:, :-1], m[:, 1:]].sum(axis=1)
    return (((o.left == 1) | (o.left == 2)).sum(axis=1), pairs(_H, o.left), pairs(_S10, o.left), pairs(_H, last), pairs(_S10, last),
            ((end == 1) | (end == 2)).sum(axis=1), (equal[:, 2:] & equal[:, 1:-1] & equal[:, :-2]).any(axis=1), _low_complexity(o))


def _bit_counts(o: Oligos) -> tuple[np.ndarray, ...]:
    """As ``_counts``, for at most 64 bases of A, C, G, T and N: a base's places are the bits of one number."""
    at = [_words(o.left == c) for c in range(5)]
    kind = at[0].dtype.type
    one, ones = kind(1), np.iinfo(kind).max
    # Bits at and after a place counted from the end.
    after = lambda back: kind(ones) << np.maximum(o.n - back, 0).clip(max=at[0].itemsize * 8 - 1).astype(kind)
    tail, gc = after(5), at[1] | at[2]
    sums = [np.zeros(len(o.n)) for _ in range(4)]
    for x in range(4):
        for y in range(4):
            both = at[x] & (at[y] >> one)
            whole, end = np.bitwise_count(both), np.bitwise_count(both & tail)
            for place, (table, count) in enumerate(((_H, whole), (_S10, whole), (_H, end), (_S10, end))):
                sums[place] += table[x, y] * count
    equal = (at[0] & at[0] >> one) | (at[1] & at[1] >> one) | (at[2] & at[2] >> one) | (at[3] & at[3] >> one)
    two = kind(2)
    period = sum(((x & x >> two) for x in at[1:]), at[0] & at[0] >> two)
    six = period & period >> one
    six = six & six >> two & six >> kind(4)
    kinds = sum((x != 0).astype(int) for x in at)
    head = lambda x, y: ((at[x] & one) & (at[y] >> one & one)).astype(bool)
    starts = head(0, 3) | head(3, 0) | head(2, 1) | head(1, 2)
    whole = starts & (o.n % 2 == 0) & (np.bitwise_count(period) == o.n - 2)
    low = (six != 0) | whole | ((kinds <= 2) & (o.n >= 20)) | (o.n == 0)
    return (np.bitwise_count(gc).astype(np.int64), *sums, np.bitwise_count(gc & after(3)).astype(np.int64), (equal & equal >> one & equal >> two) != 0, low)


def _with_dimers(o: Oligos, single: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    rc = o.reverse_complement()
    self_run, hairpin = _runs_and_stems(o.left, rc, o.n)
    tail = _ending(o.right, 8)
    self_three = _longest_run(tail, _tail_complement(tail))
    penalty = (single["part"] + np.maximum(0, self_run - 3) * 2.5 + np.maximum(0, self_three - 2) * 5 + np.maximum(0, hairpin - 3) * 3)
    return {**{n: v for n, v in single.items() if n != "part"}, "self_run": self_run, "self_three": self_three, "hairpin": hairpin,
            "penalty": np.where(o.n == 0, 100.0, _half_up(penalty, 1))}


def _tail_complement(tail: np.ndarray) -> np.ndarray:
    codes = _COMPLEMENT[tail[:, ::-1]]
    codes[tail[:, ::-1] == _LEFT_PAD] = _RIGHT_PAD
    return codes


_ARROW = {"double": pa.float64(), "integer": pa.int32(), "boolean": pa.bool_()}


def _struct(values: dict[str, np.ndarray], kinds: dict[str, str]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(values[n], type=_ARROW[t]) for n, t in kinds.items()], names=list(kinds))


_QUALITY_KINDS = {f.name: f.dataType.typeName() for f in QUALITY_TYPE.fields}
_RUNS_KINDS = {f.name: f.dataType.typeName() for f in RUNS_TYPE.fields}


# Ship this module's functions with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Marked nondeterministic only so that filters on the result are not moved below it and evaluated again.
@F.arrow_udf(QUALITY_TYPE)
def _quality(oligo: pa.Array) -> pa.Array:
    return _struct(assess(Oligos(oligo)), _QUALITY_KINDS)


@F.arrow_udf(T.DoubleType())
def _tm(oligo: pa.Array) -> pa.Array:
    """As ``functions.seq.melting_temperature``, from running sums over all letters of the batch."""
    oligo = oligo.cast(pa.string())
    known, length = pc.is_valid(oligo).to_numpy(zero_copy_only=False), pc.fill_null(pc.utf8_length(oligo), 0).to_numpy().astype(np.int64)
    oligo = pc.fill_null(oligo, "")
    offsets = np.frombuffer(oligo.buffers()[1], np.int32)[oligo.offset:oligo.offset + len(oligo) + 1].astype(np.int64)
    data = oligo.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    code, low, high = _CODE[_upper(raw)], offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    sums = lambda x: np.concatenate((np.zeros(1), np.cumsum(x, dtype=np.float64)))
    pairs = lambda table: (lambda x: x[np.maximum(low, high - 1)] - x[low])(np.append(sums(table[code[:-1], code[1:]]), 0.0))
    strong = sums((code == 1) | (code == 2))
    return pa.array(_melting(length, strong[high] - strong[low], pairs(_H), pairs(_S10)), mask=~known)


_FLIP = np.arange(256, dtype=np.uint8)
_FLIP[list(b"ACGT")] = list(b"TGCA")


#: Measures of a primer by its length and GC count: GC percent, whether that is allowed, and the terms of its melting temperature.
_SIZES, _GCS = np.arange(PRIMER_LEN_MAX + 1)[:, None], np.arange(PRIMER_LEN_MAX + 1)[None, :]
_GC_OF = _gc_percent(np.broadcast_to(_SIZES, (PRIMER_LEN_MAX + 1,) * 2), _GCS)
_GC_FITS = (_GC_OF >= PRIMER_GC_MIN) & (_GC_OF <= PRIMER_GC_MAX)
#: Places of a text in one word.
_PLACES = 32
#: On diagonal d, place i of an oligo of n bases meets its place n - 1 - d - i; the places that lie far enough apart for a hairpin.
_FAR = _words(np.abs(np.arange(-PRIMER_LEN_MAX, 2 * PRIMER_LEN_MAX)[:, None] - 2 * np.arange(PRIMER_LEN_MAX)[None, :]) > 3)
_FAR_ROW = (PRIMER_LEN_MAX - 1 - np.arange(1 - PRIMER_LEN_MAX, PRIMER_LEN_MAX))[:, None]


def _ahead(bits: np.ndarray) -> np.ndarray:
    """For each place the bits from it on, the first one lowest."""
    word, step = bits.astype(np.uint32), 1
    while step < _PLACES:
        later = np.zeros_like(word)
        later[:-step] = word[step:]
        word = word | later << np.uint32(step)
        step *= 2
    return word


class PrimerTexts:
    """Pieces of sequence end to end, with the bits of their bases from each place on and, complemented, back from it."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.upper = raw, _upper(raw)
        self.code = _CODE[self.upper]
        base = self.code < 4
        planes = lambda code, other: [((code & 1) > 0) & base, ((code & 2) > 0) & base, base, other]
        self.ahead = [_ahead(x) for x in planes(self.code, self.code == 4)]
        # The complement of any other letter counts as N.
        self.back = [_ahead(x[::-1])[::-1] for x in planes(3 - self.code, ~base)]

    def bits(self, at: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The bits of the stretches, and of their reverse complements."""
        only = (np.uint32(1) << n.astype(np.uint32)) - np.uint32(1)
        last = at + n - 1
        return [x[at] & only for x in self.ahead], [x[last] & only for x in self.back]


def end_bits(bits: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    """The last eight places of stretches."""
    by = (n - 8).astype(np.uint32)
    return [(x >> by).astype(np.uint8) for x in bits]


def bit_runs(a: list[np.ndarray], b: list[np.ndarray], width: int) -> np.ndarray:
    """Longest common stretch of each pair of texts given as bits."""
    runs = np.zeros(len(a[0]), np.int32)
    for at in range(0, len(runs), _ROWS):
        part = slice(at, at + _ROWS)
        runs[part] = _longest_ones(_equal_places([x[part] for x in a], [x[part] for x in b], width))
    return runs


def primer_singles(pieces: list[str], flipped: list[bool], first: np.ndarray, last: np.ndarray, end: np.ndarray) -> dict:
    """Primers of each piece that pass the limits that need one look along them: ``row`` (of the piece), ``start`` in the piece, ``n``,
    ``at`` (their place in ``texts``), ``gc``, ``tm``, ``clamp`` and ``part``, the penalty without dimers and hairpin.

    All lengths are tried from each start of ``first`` to ``last`` that end by ``end``; of a flipped piece the reverse complement is
    taken. Everything comes from running sums along the pieces, so no stretch is cut out."""
    raw = [np.frombuffer(p.encode("ascii", "replace"), np.uint8) for p in pieces]
    texts = PrimerTexts(np.concatenate([_FLIP[b][::-1] if f else b for b, f in zip(raw, flipped)]).astype(np.uint8) if raw else np.zeros(0, np.uint8))
    upper, code = texts.upper, texts.code
    size = np.array([len(b) for b in raw], np.int64)
    base = np.cumsum(size) - size
    sums = lambda x, kind: np.concatenate((np.zeros(1, kind), np.cumsum(x, dtype=kind)))
    strong, same = (code == 1) | (code == 2), (code[1:] == code[:-1]) & (code[1:] < 4)
    gc_sums, n_sums, runs = sums(strong, np.int32), sums(texts.raw == ord("N"), np.int32), sums(same[2:] & same[1:-1] & same[:-2], np.int32)
    h, s10 = _H[code[:-1], code[1:]], _S10[code[:-1], code[1:]]
    h_sums, s10_sums = sums(h, np.float64), sums(s10, np.float64)
    found = []
    for n in range(PRIMER_LEN_MIN, min(PRIMER_LEN_MAX, len(code)) + 1):
        places = len(code) - n + 1
        # The starts of a piece are one stretch of places, from the other end where it is flipped.
        fits = np.zeros(places, bool)
        for low, high, at, long, turned in zip(np.maximum(0, first), np.minimum(last, np.minimum(end, size) - n), base, size, flipped):
            if low <= high:
                fits[(at + long - n - high if turned else at + low):(at + long - n - low if turned else at + high) + 1] = True
        within = lambda table, shorter: table[n - shorter:][:places] - table[:places]
        gcs = within(gc_sums, 0)
        allowed = np.flatnonzero(_GC_FITS[n])
        fits &= (gcs >= allowed[0]) & (gcs <= allowed[-1])
        fits &= (within(n_sums, 0) == 0) & (within(runs, 3) == 0)
        at = np.flatnonzero(fits)
        gcs, sizes = gcs[at].astype(np.int64), np.full(len(at), n)
        tm = _melting(sizes, gcs, within(h_sums, 1)[at], within(s10_sums, 1)[at])
        keep = (tm >= PRIMER_TM_MIN) & (tm <= PRIMER_TM_MAX)
        found.append((at[keep], sizes[keep], gcs[keep], tm[keep]))
    at, n, gcs, tm = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    gc = _GC_OF[n, gcs]
    # By place: stability of the five bases from it on, GC of three, and eight that repeat two.
    four = lambda x: x[:-3] + x[1:-2] + x[2:-1] + x[3:] if len(x) > 3 else x[:0]
    dg3 = _half_up((four(h) - 310.15 * (four(s10) / 10)) / 1000, 2)
    loose = np.where(dg3 > -1.0, 6.0, np.where(dg3 < -10.0, 4.0, 0.0))[at + n - 5]
    strong = strong.astype(np.int64)
    clamp = (strong[:-2] + strong[1:-1] + strong[2:])[at + n - 3]
    again = upper[2:] == upper[:-2]
    for _ in range(5):
        again = again[1:] & again[:-1]
    two = sums(again, np.int32)
    # Letters are counted in fields of six bits of one sum.
    letters = sums((np.int64(1) << 6 * np.arange(6, dtype=np.int64))[code], np.int64)
    held = letters[at + n] - letters[at]
    kinds = sum((held & 63 << 6 * f != 0).astype(np.int8) for f in range(6))
    poor = (two[at + n - 7] > two[at]) | ((kinds <= 2) & (n >= 20))
    part = np.abs(gc - 50) / 4 + np.abs(tm - 60) / 3 + 10.0 * poor + loose
    # The least sum that rounds above the limit; the other parts of a penalty are never negative.
    may = np.flatnonzero(part < PRIMER_PENALTY_MAX + 0.06)
    row = np.searchsorted(base + size, at[may], side="right")
    by_row = np.argsort(row, kind="stable")
    may, row = may[by_row], row[by_row]
    at, n = at[may], n[may]
    start = at - base[row]
    start = np.where(np.array(flipped, bool)[row], size[row] - n - start, start)
    return {"texts": texts, "row": row, "start": start, "n": n, "at": at, **{k: v[may] for k, v in {"gc": gc, "tm": tm, "clamp": clamp, "part": part}.items()}}


def primer_penalties(singles: dict, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole penalty of the primers at places ``which`` of :func:`primer_singles`, and whether they pass the limits on dimers, hairpin and penalty."""
    n, penalty, good = singles["n"][which], np.empty(len(which)), np.empty(len(which), bool)
    for low in range(0, len(which), _ROWS):
        part = slice(low, low + _ROWS)
        a, b = singles["texts"].bits(singles["at"][which[part]], n[part])
        equal = _equal_places(a, b, PRIMER_LEN_MAX)
        hairpin = _longest_ones(equal & _FAR[n[part] + _FAR_ROW])
        self_run = _longest_ones(equal)
        three = _longest_ones(_equal_places(end_bits(a, n[part]), [x.astype(np.uint8) for x in b], 8))
        penalty[part] = _half_up(singles["part"][which[part]] + np.maximum(0, self_run - 3) * 2.5 + np.maximum(0, three - 2) * 5 + np.maximum(0, hairpin - 3) * 3, 1)
        good[part] = (three < 4) & (hairpin < 6) & (penalty[part] <= PRIMER_PENALTY_MAX)
    return penalty, good


def primer_bytes(singles: dict, which: np.ndarray) -> np.ndarray:
    """The letters of the primers at these places, end to end."""
    at, n = singles["at"][which], singles["n"][which]
    return singles["texts"].raw[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())]


def primer_windows(pieces: list[str], flipped: list[bool], first: np.ndarray, last: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Primers of each piece that pass every single limit: ``row`` (of the piece), ``start`` in the piece, ``n``, ``text`` (bytes of
    all) and measures."""
    w = primer_singles(pieces, flipped, first, last, end)
    penalty, good = primer_penalties(w, np.arange(len(w["n"])))
    return {**{k: w[k][good] for k in ("row", "start", "n", "gc", "tm", "clamp")}, "text": primer_bytes(w, np.flatnonzero(good)), "penalty": penalty[good]}


@F.arrow_udf(RUNS_TYPE)
def _runs(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = Oligos(left), Oligos(right)
    return _struct({"hetero": _longest_run(a.left, b.reverse_complement()),
                    "hetero_three": _longest_run(_ending(a.right, 8), _tail_complement(_ending(b.right, 8)))}, _RUNS_KINDS)


_TO_PAIR = str.maketrans("ACGT", "TGCA")


def _text_run(left: str, right: str | None, loop: int) -> int:
    """Longest stretch of ``left`` that can pair with one of ``right`` (of itself, more than ``loop`` letters on, without it); a letter
    other than a base pairs with itself. A run of k that ends at a place holds one of k - 1, so one search a place is enough."""
    other = left if right is None else right
    turned, best = other[::-1].translate(_TO_PAIR), 0
    for end in range(1, len(left) + 1):
        if end <= best:
            continue
        if right is None:
            found = end + loop + 1 <= len(left) and turned[len(left) - end:len(left) - end + best + 1] in left[end + loop:]
        else:
            found = left[end - best - 1:end] in turned
        best += found
    return best


def _or_text(runs: np.ndarray, odd: np.ndarray, columns: list[pa.Array], loop: int = 3, window: int | None = None) -> pa.Array:
    """The runs, of rows with letters that the bits do not know taken from their texts."""
    runs = np.array(runs, np.int32)
    for i in np.flatnonzero(odd):
        texts = [(c[i].as_py() or "").upper() for c in columns]
        texts = texts if window is None else [t[-window:] for t in texts]
        runs[i] = _text_run(texts[0], texts[1] if len(texts) > 1 else None, loop)
    return pa.array(runs, pa.int32())


def _odd(o: Oligos) -> np.ndarray:
    return (o.left == 5).any(axis=1)


@F.arrow_udf(T.IntegerType())
def _pairing(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = Oligos(left), Oligos(right)
    return _or_text(_longest_run(a.left, b.reverse_complement()), _odd(a) | _odd(b), [left, right])


@F.arrow_udf(T.IntegerType())
def _end_pairing(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = Oligos(left), Oligos(right)
    return _or_text(_longest_run(_ending(a.right, 8), _tail_complement(_ending(b.right, 8))), _odd(a) | _odd(b), [left, right], window=8)


def stem_run(min_loop: int):
    """The longest stem of an oligo whose arms are more than ``min_loop`` bases apart, as a column function."""
    def stem(oligo: pa.Array) -> pa.Array:
        o = Oligos(oligo)
        return _or_text(_runs_and_stems(o.left, o.reverse_complement(), o.n, min_loop)[1], _odd(o), [oligo], min_loop)
    return F.arrow_udf(stem, T.IntegerType()).asNondeterministic()


oligo_quality = _quality.asNondeterministic()
oligo_tm = _tm.asNondeterministic()
pairing_run = _pairing.asNondeterministic()
end_pairing_run = _end_pairing.asNondeterministic()
pair_runs = _runs.asNondeterministic()
