"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from editloom.llm import periodic as pe
from editloom.llm.queries import QUERIES


def brute(words):
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            e = i + p
            if e - s >= max(6, 4 * p) and not any(all(words[k] == words[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.append((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sample(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 3, 6, 10, 30, 80, 200])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n else 0):
        a = rng.randrange(n)
        p, size = rng.randint(1, max(1, (n - a) // 3)), rng.randint(1, n - a)
        w[a:a + size] = [w[a + i % p] for i in range(size)]
    if rng.random() < .4 and n > 20:
        unit = [0] * rng.randint(3, 9) + [1]
        w = (unit * rng.randint(2, 6) + [2]) * rng.randint(3, 6)
    return [str(x).encode() for x in w]


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        texts = [sample(rng) for _ in range(rng.randint(0, 5))]
        for words, (runs, stay) in zip(texts, pe._runs_of(texts, 4, 6)):
            want = brute(words)
            assert [tuple(r) for r in runs.tolist()] == want
            assert stay.tolist() == [not any(s + p <= i < s + n for s, n, p in want) for i in range(len(words))]


def digest_of(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(kept)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, b" ".join(sample(rng)).decode(), "x") for i in range(150)]
    rows += [(900, None, None), (901, "", "x"), (902, " \t\n ", "x"), (None, "a b " * 30, "x"), (903, "w " * 4000, "x"), (903, "w " * 4000, "x"),
             (904, " ".join(f"{i % 700}" for i in range(3000)), "y"), (905, "a\x1cb a\x1cb\x0ba\x1cb\x0ca\x1cb a\x1cb a\x1cb", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((digest_of(i, t) for i, t, _ in rows), key=str)


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pe.digests(pe.periodic_runs(df, {"doc_id": F.col("doc_id")})).count() == 0
    words = [b"%d" % i for i in range(60_000)] * 4
    (runs, stay), = pe._runs_of([words], 4, 6)
    assert runs.tolist() == [[0, 240_000, 60_000]] and stay.sum() == 60_000
