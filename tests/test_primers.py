"""Primer pair search against a plain loop over all windows, lengths and pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from editloom.functions.fixed import NN_PARAMS
from editloom.operators import primers as pr

NN = NN_PARAMS


def half_up(x, d):
    return math.floor(x * 10**d + 0.5) / 10**d


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def run(a, b):
    b = rc(b)
    best = 0
    table = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x == y:
                table[i, j] = table.get((i - 1, j - 1), 0) + 1
                best = max(best, table[i, j])
    return best


def hairpin(s):
    best, table = 0, {}
    for i in range(len(s)):
        for j in range(len(s) - 1, -1, -1):
            if abs(i - j) > 3 and s[i] == rc(s[j]):
                table[i, j] = table.get((i - 1, j + 1), 0) + 1
                best = max(best, table[i, j])
    return best


def quality(s):
    n, gc_n = len(s), sum(c in "GC" for c in s)
    gc = math.floor(gc_n / n * 1000 + 0.5) / 10
    dh = 200 + sum(NN[s[i:i + 2]][0] for i in range(n - 1))
    ds = -5.7 + sum(round(10 * NN[s[i:i + 2]][1]) for i in range(n - 1)) / 10
    mg = math.log(1.5e-3)
    inv = 1 / (dh / (ds + 1.987 * math.log(250e-9 / 4))) + 3.92e-5 - 9.11e-6 * mg + gc_n / n * (6.26e-5 + 1.42e-5 * mg)
    inv += 1 / (2 * (n - 1)) * (-4.82e-4 + 5.25e-4 * mg + 8.31e-5 * mg * mg)
    tm = half_up(1 / inv - 273.15, 1)
    t = s[-5:]
    dg = half_up((sum(NN[t[i:i + 2]][0] for i in range(4)) - 310.15 * sum(round(10 * NN[t[i:i + 2]][1]) for i in range(4)) / 10) / 1000, 2)
    low = any(a + b in s and (a + b) * 4 in s for a in "ACGT" for b in "ACGT") or len(set(s)) <= 2
    pen = abs(gc - 50) / 4 + abs(tm - 60) / 3 + 10 * low + (6 if dg > -1 else 4 if dg < -10 else 0)
    three, hair = run(s[-8:], s[-8:]), hairpin(s)
    pen += 2.5 * max(0, run(s, s) - 3) + 5 * max(0, three - 2) + 3 * max(0, hair - 3)
    return {"gc": gc, "tm": tm, "three": three, "hair": hair, "pen": half_up(pen, 1), "clamp": sum(c in "GC" for c in s[-3:]), "s": s}


def usable(s):
    if any(b * 4 in s for b in "ACGT"):
        return None
    q = quality(s)
    ok = 38 <= q["gc"] <= 67 and 55 <= q["tm"] <= 67 and q["three"] < 4 and q["hair"] < 6 and q["pen"] <= 22
    return q if ok else None


def pair(f, r, amp, wanted, extra):
    three = run(f["s"][-8:], r["s"][-8:])
    pen = half_up(f["pen"] + r["pen"] + 3 * max(0, run(f["s"], r["s"]) - 4) + 7 * max(0, three - 2) + abs(f["tm"] - r["tm"]) / 2, 1)
    if three >= 4 or pen > 30:
        return None
    return half_up(-(abs(f["tm"] - 60) + abs(r["tm"] - 60)) - (abs(f["gc"] - 50) + abs(r["gc"] - 50)) / 10 + (f["clamp"] + r["clamp"]) * 2
                   - abs(amp - wanted) / 100 - pen / 8 - extra, 2)


def spans(seq, starts, reverse):
    out = {}
    for a in starts:
        for n in range(18, 27):
            if 0 <= a and a + n <= len(seq):
                s = seq[a:a + n]
                q = None if "N" in s else usable(rc(s) if reverse else s)
                if q:
                    out[a, a + n] = q
    return out


def centred(seq, center, offset):
    n, found = len(seq), set()
    cap = lambda x, hi: max(0, min(hi, x))
    f = spans(seq, range(0, n), False)
    r = spans(seq, range(0, n), True)
    for amp in range(450, 501):
        ideal = center - offset if offset else math.floor(center - amp / 2 + 0.5)
        for start in {cap(ideal + o, max(0, n - amp)) for o in range(-35, 36)}:
            extra = abs(center - start - offset) / 5 if offset else abs(center - (start + amp / 2)) / 5
            for fl in range(18, 27):
                for rl in range(18, 27):
                    a, b = f.get((start, start + fl)), r.get((start + amp - rl, start + amp))
                    if a and b and start + amp - rl > start + fl and abs(a["tm"] - b["tm"]) <= 5 and rc(a["s"][-4:]) != b["s"][-4:]:
                        found.add((start, fl, start + amp, rl, amp, extra))
    return [(pair(f[s, s + fl], r[e - rl, e], amp, 475, x), amp, s, fl, rl, e) for s, fl, e, rl, amp, x in found]


def screen(seq, lc, rc_, flank=250):
    n = len(seq)
    cap = lambda x, hi: max(0, min(hi, x))
    wf, wr = cap(lc - flank, n - 18), cap(rc_ + flank - 18, n - 18)
    f, r = spans(seq, range(max(0, wf - 40), wf + 41), False), spans(seq, range(n), True)
    out = []
    for (a, b), x in f.items():
        for rl in range(18, 27):
            for st in {max(b + 50, min(max(0, n - rl), wr + o)) for o in range(-40, 41)}:
                y = r.get((st, st + rl))
                if y and abs(x["tm"] - y["tm"]) <= 5:
                    amp = max(36, lc - a + st + rl - rc_)
                    out.append((pair(x, y, amp, 500, (abs(lc - a - flank) + abs(st + rl - rc_ - flank)) / 20), a, b - a, st, rl, st + rl))
    return out


def light_score(f, r, amp, wanted, extra):
    """Score of a pair without its hetero-dimers: never below the full score."""
    pen = half_up(f["pen"] + r["pen"] + abs(f["tm"] - r["tm"]) / 2, 1)
    return half_up(-(abs(f["tm"] - 60) + abs(r["tm"] - 60)) - (abs(f["gc"] - 50) + abs(r["gc"] - 50)) / 10 + (f["clamp"] + r["clamp"]) * 2
                   - abs(amp - wanted) / 100 - pen / 8 - extra, 2)


def crossed(f, r, low, high, wanted, extra):
    """Best five scores of all pairs whose reach lies within bounds; dimers are run from the highest light score down."""
    rows = []
    for (a, b), x in f.items():
        for (c, d), y in r.items():
            if low <= d - a <= high and abs(x["tm"] - y["tm"]) <= 5 and rc(x["s"][-4:]) != y["s"][-4:]:
                rows.append((light_score(x, y, d - a, wanted, extra(a, d)), a, b, c, d))
    found = []
    for light, a, b, c, d in sorted(rows, reverse=True):
        if len(found) == 5 and light < found[-1]:
            break
        score = pair(f[a, b], r[c, d], d - a, wanted, extra(a, d))
        if score is not None:
            found = sorted([*found, score], reverse=True)[:5]
    return found


def flanking(seq, a, b):
    n = len(seq)
    f, r = spans(seq, range(max(0, a - 500), max(0, a - 80)), False), spans(seq, range(min(n, b + 80), min(n, b + 460)), True)
    return crossed(f, r, 450, 500, 475, lambda s, e: 0)


def outside(seq, a, b):
    n = len(seq)
    left, right = max(0, min(a, n)), max(max(0, min(a, n)), min(n, b))
    if left < 18 or n - right < 18:
        return []
    low = right - left + 48
    f = {k: q for k, q in spans(seq, range(max(0, left - 650), left - 17), False).items() if k[1] <= left}
    r = spans(seq, range(right, min(n - 18, right + 650) + 1), True)
    return crossed(f, r, low, right - left + 1300 + 52, right - left + 240, lambda s, e: (abs(left - s - 120) + abs(e - right - 120)) / 25)


def best(rows, order):
    rows = sorted((x for x in rows if x[0] is not None), key=order)[:5]
    return [x[0] for x in rows]


@pytest.fixture(scope="module")
def seqs(spark):
    rnd = random.Random(7)
    rows = [(i, "".join(rnd.choice("ACGT") for _ in range(n))) for i, n in ((1, 620), (2, 520))]
    return rows, spark.createDataFrame(rows, "target_id bigint, seq string")


@pytest.mark.parametrize("center,offset", [(300, 0), (60, 0), (260, 175)])
def test_centred_pairs(seqs, center, offset):
    rows, df = seqs
    got = pr.ranked_pairs(pr.centred_targets(df.withColumn("center", F.lit(center).cast("bigint")), offset=offset)).collect()
    for key, seq in rows:
        want = best(centred(seq, center, offset), lambda x: (-x[0], x[1], x[2], x[3], x[4]))
        assert [x.score for x in sorted((g for g in got if g.target_id == key), key=lambda g: g.rank)] == want


@pytest.fixture(scope="module")
def short_flanks(spark):
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    rows = [(1, text(560)), (2, text(150) + "N" * 30 + text(380)), (3, text(500))]
    return rows, spark.createDataFrame(rows, "target_id bigint, seq string")


@pytest.mark.parametrize("start,end", [(180, 230), (90, 400), (470, 490)])
def test_flanking_pairs(short_flanks, start, end):
    rows, df = short_flanks
    t = df.withColumns({"anchor_start": F.lit(start).cast("bigint"), "anchor_end": F.lit(end).cast("bigint")})
    got = pr.ranked_pairs(pr.flanking_targets(t)).collect()
    for key, seq in rows:
        want = flanking(seq, start, end)
        assert [x.score for x in sorted((g for g in got if g.target_id == key), key=lambda g: g.rank)] == want


@pytest.mark.parametrize("start,end", [(170, 380), (40, 520), (10, 300)])
def test_outside_pairs(short_flanks, start, end):
    rows, df = short_flanks
    t = df.withColumns({"arm_start": F.lit(start).cast("bigint"), "arm_end": F.lit(end).cast("bigint")})
    got = pr.ranked_pairs(pr.outside_targets(t)).collect()
    for key, seq in rows:
        want = outside(seq, start, end)
        assert [x.score for x in sorted((g for g in got if g.target_id == key), key=lambda g: g.rank)] == want


def test_screen_pairs(seqs):
    rows, df = seqs
    t = df.withColumns({"left_cut": F.lit(200).cast("bigint"), "right_cut": F.lit(330).cast("bigint")})
    got = pr.ranked_pairs(pr.screen_targets(t)).collect()
    for key, seq in rows:
        want = best(screen(seq, 200, 330), lambda x: (-x[0], x[1], x[2], x[3], x[4]))
        assert [x.score for x in sorted((g for g in got if g.target_id == key), key=lambda g: g.rank)] == want
