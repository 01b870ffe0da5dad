"""Dimers of primer candidates are looked for only where they can matter, and the pairs are those of all candidates."""

import random

import numpy as np
import pyarrow as pa

from editloom.functions import oligo as ol
from editloom.operators import primers as pr
from editloom.operators import rankjoin as rj
from test_rankjoin import LIMITS

# Per mode: letters of the sequences, and limits of a target in a sequence of 900 bases.
TARGETS = {
    "flanking": {"n": 900, "a": 420, "b": 430, "center": 420, "offset": 0, "amp_lo": 450, "amp_hi": 500, "wanted": 475, "f_lo": 0, "f_hi": 339, "r_lo": 510, "r_hi": 880},
    "centred": {"n": 900, "a": 450, "b": 450, "center": 450, "offset": 0, "amp_lo": 450, "amp_hi": 500, "wanted": 475, "f_lo": 165, "f_hi": 260, "r_lo": 589, "r_hi": 742},
    "offset": {"n": 900, "a": 300, "b": 300, "center": 300, "offset": 150, "amp_lo": 450, "amp_hi": 500, "wanted": 475, "f_lo": 115, "f_hi": 185, "r_lo": 539, "r_hi": 667},
    "outside": {"n": 900, "a": 350, "b": 550, "center": 350, "offset": 0, "amp_lo": 248, "amp_hi": 1552, "wanted": 440, "f_lo": 0, "f_hi": 332, "r_lo": 550, "r_hi": 882},
    "screen": {"n": 900, "a": 300, "b": 600, "center": 832, "offset": 250, "amp_lo": 0, "amp_hi": 0, "wanted": 500, "f_lo": 10, "f_hi": 90, "r_lo": 792, "r_hi": 872},
}


def sides(t, seqs):
    rows = [{"target_id": i, "n": t["n"], "a": t["a"], "b": t["b"], "side": s, "lo": t[s + "_lo"], "hi": t[s + "_hi"], "piece_start": t[s + "_lo"],
             "piece": seq[t[s + "_lo"]:t[s + "_hi"] + 26]} for i, seq in enumerate(seqs) for s in "fr"]
    return pa.Table.from_pylist(rows)


def named(found):
    pairs, f, r = found
    return [(s, amp, reach, f.text(i), int(f.start[i]), r.text(j), int(r.start[j])) for s, amp, reach, i, j in pairs]


def test_equals_the_search_over_all_measured_candidates(monkeypatch):
    rng = random.Random(21)
    seqs = ["".join(rng.choice(x) for _ in range(900)) for x in ("ACGT", "ACGT", "AACGT", "ACGTN", "ACCGGT", "AT", "ACGTRn")] + ["ACGTTGCA" * 113]
    for name, t in TARGETS.items():
        mode = "centred" if name == "offset" else name
        table = sides(t, seqs)
        row, c = pr._measure(table, mode == "outside", 120)
        of = lambda k: rj.Side(c.filter(pa.array(row == k)), None)
        wanted = []
        for k in range(len(seqs)):
            f, r = of(2 * k), of(2 * k + 1)
            wanted.append(named((rj.best_pairs(mode, t, f, r, 5, LIMITS)[0], f, r)))
        w, columns = pr._singles(table, mode == "outside", 120)
        for first in (3, 64):
            monkeypatch.setattr(rj, "FIRST", first)
            got = rj.lazy_pairs(mode, [t] * len(seqs), w, columns, w["row"] // 2, w["row"] % 2 == 1, 5, LIMITS)
            assert [named(x) for x in got] == wanted
        assert any(wanted) and not all(wanted)


def test_few_candidates_are_measured_in_full(monkeypatch):
    rng = random.Random(22)
    seqs, looked, penalties = ["".join(rng.choice("ACGT") for _ in range(900)) for _ in range(8)], [], rj.primer_penalties
    monkeypatch.setattr(rj, "primer_penalties", lambda singles, which: looked.append(len(which)) or penalties(singles, which))
    for mode in ("flanking", "outside"):
        w, columns = pr._singles(sides(TARGETS[mode], seqs), mode == "outside", 120)
        looked.clear()
        rj.lazy_pairs(mode, [TARGETS[mode]] * len(seqs), w, columns, w["row"] // 2, w["row"] % 2 == 1, 5, LIMITS)
        assert 0 < sum(looked) < len(w["n"]) / 4


def test_bits_of_primers_give_the_measures_of_their_letters():
    rng = random.Random(4)
    pieces = ["".join(rng.choice(x) for _ in range(300)) for x in ("ACGT", "acgtACGT", "ACGTnR", "AACCGT")] + ["ACGTTACCGGATCAATATATATATGCCGATTGCA"]
    size = np.array([len(p) for p in pieces])
    w = ol.primer_singles(pieces, [True, False, True, False, False], np.zeros(5, np.int64), size, size)
    which = np.arange(len(w["n"]))
    text = ol.primer_bytes(w, which).tobytes().decode()
    ends = np.cumsum(w["n"])
    q = ol.assess(ol.Oligos(pa.array([text[e - n:e] for e, n in zip(ends, w["n"])])))
    penalty, good = ol.primer_penalties(w, which)
    assert len(which) > 500 and np.array_equal(penalty, q["penalty"])
    assert np.array_equal(good, (q["self_three"] < 4) & (q["hairpin"] < 6) & (q["penalty"] <= 22))
    assert all(np.array_equal(w[k], q[k]) for k in ("gc", "tm", "clamp"))
