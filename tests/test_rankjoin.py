"""The rank join against all pairs, and how little of them it measures."""

import random

import numpy as np
import pyarrow as pa

from editloom.functions import oligo as ol
from editloom.operators import rankjoin as rj

LIMITS = {"screen_shift": 40, "centre_shift": 35, "outside_flank": 120, "least": 18, "tm_delta": 5, "pair_limit": 30}


def side(rng, n, first):
    texts = ["".join(rng.choices("ACGT", k=rng.randint(18, 26))) for _ in range(n)]
    q = ol.assess(ol.Oligos(pa.array(texts)))
    start = np.array([first + rng.randint(0, 60) for _ in texts])
    size = np.array([len(x) for x in texts])
    cost = np.abs(q["tm"] - 60) + np.abs(q["gc"] - 50) / 10 - q["clamp"] * 2 + q["penalty"] / 8
    columns = {"placing": np.zeros(n), "start": start, "len": size, "end": start + size, "cost": cost, "p": pa.array(texts), "gc": q["gc"], "tm": q["tm"],
               "clamp": q["clamp"], "pen": q["penalty"]}
    return pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def test_equals_all_pairs(monkeypatch):
    rng = random.Random(6)
    saved = 0
    for mode in ("flanking", "centred", "outside", "screen"):
        for trial in range(6):
            t = {"n": 600, "a": 90, "b": 470, "center": 300, "offset": rng.choice([0, 150]), "amp_lo": 380, "amp_hi": 560, "wanted": 475}
            t |= {"center": 480, "offset": 250} if mode == "screen" else {}
            f, r = rj.Side(side(rng, 150, 0), None), rj.Side(side(rng, 150, 440), None)
            monkeypatch.setattr(rj, "BLOCK", 1 << 20)
            monkeypatch.setattr(rj, "MEASURED", 1 << 30)
            every, all_of = rj.best_pairs(mode, t, f, r, 5, LIMITS)
            monkeypatch.setattr(rj, "BLOCK", rng.choice([1, 7, 32]))
            monkeypatch.setattr(rj, "MEASURED", rng.choice([1, 16]))
            some, few = rj.best_pairs(mode, t, f, r, 5, LIMITS)
            assert some == every
            saved += all_of - few
    assert saved > 0


def test_empty_sides():
    rng = random.Random(1)
    f, none = rj.Side(side(rng, 3, 0), None), rj.Side(side(rng, 3, 0), 0)
    assert rj.best_pairs("flanking", {}, f, none, 5, LIMITS) == ([], 0) and len(none) == 0
