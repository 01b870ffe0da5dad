"""The first candidates of a side in search order are those of all candidates, and few are measured for them."""

import random

import numpy as np
import pyarrow as pa

from editloom.operators import primers as pr
from test_lazy_pairs import TARGETS, sides


def test_first_of_all_candidates(monkeypatch):
    rng = random.Random(8)
    seqs = ["".join(rng.choice(x) for _ in range(900)) for x in ("ACGT", "ACGT", "AACGT", "ACGTN", "AT", "ACGTRn")] + ["ACGTTGCA" * 113]
    looked, penalties = [], pr.primer_penalties
    monkeypatch.setattr(pr, "primer_penalties", lambda singles, which: looked.append(len(which)) or penalties(singles, which))
    for mode in ("outside", "flanking"):
        table = sides(TARGETS[mode], seqs)
        row, c = pr._measure(table, mode == "outside", 120)
        every = looked.pop()
        rows = c.to_pylist()
        for per_side in (1, 10, 90, 100000):
            looked.clear()
            got_row, got = pr._first_measured(table, mode == "outside", 120, per_side)
            wanted = []
            for k in range(len(table)):
                own = sorted((x for x, r in zip(rows, row) if r == k), key=lambda x: (x["placing"], x["start"], x["len"]))
                wanted += [(k, x) for x in own[:per_side]]
            assert list(zip(got_row.tolist(), got.to_pylist())) == wanted and wanted
            assert per_side > 10 or mode == "flanking" or sum(looked) < every / 2


def test_no_sides():
    table = sides(TARGETS["outside"], ["ACGT"])
    for empty in (table, table.slice(0, 0)):
        row, c = pr._first_measured(empty, True, 120, 90)
        assert len(row) == 0 and isinstance(c, pa.StructArray) and np.array_equal(row, pr._measure(empty, True, 120)[0])
