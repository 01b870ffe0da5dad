"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of words with smallest period p and at least four periods long that no neighbouring word extends. Periods
up to SMALL are found by comparing each word with the one p before it. For greater ones, at each scale t = 4, 8, 16 ...:

* every position has a hash of its next t words; positions whose t words lie in a run of a period up to t/4 (highly periodic
  regions, all known from smaller scales) are left out;
* a position i is in the synchronising set when the least hash of positions i to i + t is that of i or of i + t, so whether
  it is depends on 2t words only, and outside highly periodic regions every t neighbours hold one such position;
* of set positions with equal 2t words (their context), neighbours at a distance p of t to 2t - 1 propose the period p. A run of
  such a period holds its set positions again one period later and no equal context between, so it is always proposed.
  The periods that the left-out regions would have shown are those already found;
* proposals that continue each other count once; each is extended word by word, so hashes only propose, never decide.

Words lie between characters of [\\x20\\x09-\\x0D]. Null and empty texts have no words. The work is done per Arrow batch, on
pieces of at most PIECE words (or one text), so a very long text needs memory in proportion to itself. Rows that repeat an id
are rows of their own; other columns are left behind unless named in ``keep``."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mix, prepare, text_of, tidied

#: Periods found by plain comparison; the first scale is the next number.
SMALL = 3
#: Words that are worked on at once.
PIECE = 400_000
#: Words compared at once when proposals are extended.
GATHER = 1 << 21
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _least_of_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, _TOP, np.uint64)
    padded[:len(x)] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def _reach(words: np.ndarray, at: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on (in direction ``step``) equal the one a period later, for each proposal."""
    n, width = len(words), 16
    got, live = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(live):
        width = min(width * 2, 1 << 16)
        rest = []
        for part in np.array_split(live, -(-len(live) * width // GATHER)):
            a = (at[part] + step * got[part])[:, None] + step * np.arange(width)
            b = a + period[part][:, None]
            inside = (a >= 0) & (b < n)
            same = inside & (words[np.where(inside, a, 0)] == words[np.where(inside, b, 0)])
            stop = np.where(same.all(axis=1), width, same.argmin(axis=1))
            got[part] += stop
            rest.append(part[stop == width])
        live = np.concatenate(rest)
    return got


def find(words: np.ndarray, text: np.ndarray, least: int = 4) -> np.ndarray:
    """Runs (start, end, period) of several texts laid end to end: ``words`` as numbers, each text closed by a number of its own,
    ``text`` the number of the text of each word."""
    n, found = len(words), []
    for p in range(1, min(SMALL, n - 1) + 1):
        edge = np.diff(np.concatenate(([0], (words[:-p] == words[p:]).view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + p
        runs = np.column_stack((start, end, np.full(len(start), p)))
        runs = runs[end - start >= least * p]
        for q in range(1, p):
            # A stretch of a smaller period that divides p shows again under p.
            if p % q == 0 and found:
                known = {(s, e) for s, e, _ in found[q - 1].tolist()}
                runs = runs[[(s, e) not in known for s, e, _ in runs.tolist()]]
        found.append(runs)
    longest = int(np.bincount(text).max(initial=0))
    scale, hashes = 1, mix(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    own = mix(text.astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        while least * scale <= longest:
            double = mix(hashes[:len(hashes) - scale] * np.uint64(0x9E3779B97F4A7C15) + hashes[scale:]) if len(hashes) > scale else hashes[:0]
            if scale > SMALL and len(double):
                hidden = np.zeros(n + 1, np.int32)
                for runs in found:
                    wide = runs[(runs[:, 1] - runs[:, 0] >= scale) & (runs[:, 2] * 4 <= scale)]
                    np.add.at(hidden, wide[:, 0], 1)
                    np.add.at(hidden, wide[:, 1] - scale + 1, -1)
                masked = np.where(np.cumsum(hidden)[:len(hashes)] > 0, _TOP, hashes)
                low = _least_of_windows(masked, scale + 1)
                at = np.flatnonzero((low != _TOP) & ((low == masked[:len(low)]) | (low == masked[scale:])))
                found.append(_proposed(words, at, double[at] ^ own[at], scale, least))
            hashes, scale = double, scale * 2
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _proposed(words: np.ndarray, at: np.ndarray, context: np.ndarray, scale: int, least: int) -> np.ndarray:
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    gap = at[1:] - at[:-1]
    use = (context[1:] == context[:-1]) & (gap >= scale) & (gap < 2 * scale)
    at, gap = at[:-1][use], gap[use]
    order = np.lexsort((at, gap))
    at, gap = at[order], gap[order]
    if len(at):
        new = np.concatenate(([True], (gap[1:] != gap[:-1]) | (at[1:] > at[:-1] + 2 * scale)))
        at, gap = at[new], gap[new]
    start = at - _reach(words, at - 1, gap, -1)
    end = at + _reach(words, at, gap, 1) + gap
    return np.unique(np.column_stack((start, end, gap))[end - start >= least * gap], axis=0)


def _pieces(texts: list[list[bytes]]):
    """Neighbouring texts of at most PIECE words together."""
    first, size = 0, 0
    for i, words in enumerate(texts):
        if i > first and size + len(words) > PIECE:
            yield first, i
            first, size = i, 0
        size += len(words) + 1
    if first < len(texts):
        yield first, len(texts)


def _runs_of(texts: list[list[bytes]], least: int, words_least: int):
    """Per text its runs as a sorted (start, length, period) table and a mask of the words that stay."""
    for first, last in _pieces(texts):
        number = count().__next__
        known: dict[bytes, int] = {}
        flat, text, starts = [], [], []
        for i in range(first, last):
            starts.append(len(flat))
            flat.extend([known[w] if w in known else known.setdefault(w, number()) for w in texts[i]])
            flat.append(-1 - i)
            text.append(len(texts[i]) + 1)
        ids = np.array(flat, np.int64)
        of = np.repeat(np.arange(last - first), text)
        runs = find(ids, of, least)
        runs = runs[runs[:, 1] - runs[:, 0] >= words_least]
        drop = np.zeros(len(ids) + 1, np.int32)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 1], -1)
        stay = np.cumsum(drop)[:-1] == 0
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        cut = np.searchsorted(runs[:, 0], np.array(starts + [len(ids)]))
        for k, start in enumerate(starts):
            own = runs[cut[k]:cut[k + 1]]
            yield (np.column_stack((own[:, 0] - start, own[:, 1] - own[:, 0], own[:, 2])), stay[start:start + len(texts[first + k])])


def periodic_runs(docs: DataFrame, keep: dict[str, Column], text: Column | None = None, least: int = 4, words_least: int = 6) -> DataFrame:
    """Per row the columns of ``keep`` and n_words, runs (start, length, period in words, in order) and collapsed: the words of
    which no run holds more than the first period, joined by one space. ``least``: periods of a run, 4 or more."""
    if least < 4:
        raise ValueError("runs of fewer than four periods are not always proposed")
    prepare(docs.sparkSession)
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], (text_of() if text is None else text).alias("__text"))
    names = list(keep)

    def step(batches):
        for batch in batches:
            texts = [t.encode().split() for t in batch.column(len(names)).to_pylist()]
            starts, runs, kept = [0], [], []
            for words, (own, stay) in zip(texts, _runs_of(texts, least, words_least)):
                runs.append(own)
                starts.append(starts[-1] + len(own))
                kept.append((b" ".join(words) if stay.all() else b" ".join([w for w, s in zip(words, stay.tolist()) if s])).decode())
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            listed = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(flat[:, i], pa.int64()) for i in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(w) for w in texts], pa.int64()), listed, pa.array(kept, pa.string())],
                                             [*names, "n_words", "runs", "collapsed"])

    added = StructType.fromDDL("n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    schema = StructType([f for f in rows.schema.fields if f.name != "__text"] + added.fields)
    return rows.mapInArrow(tidied(step), schema)


def digests(found: DataFrame) -> DataFrame:
    """Of rows with doc_id, runs and collapsed: number of runs, the one of most periods, and hashes of all runs and of the text."""
    # Exact comparison of length over period by cross products; runs come by start, then period, and the first of equals stays.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda acc, r: F.when(r["length"] * acc["period"] > acc["length"] * r["period"], r).otherwise(acc))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.withColumn("__best", best)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "__best.start", "__best.length", "__best.period",
                      F.expr("__best.length * 1000 div __best.period").alias("exponent_milli"),
                      F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The text with a stretch of repeated words in a tenth of the rows: let h be crc32 of the decimal doc_id and g = floor(h / 10);
    if h % 10 = 0, each word i from a = g % n on is word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g = F.floor(h / 10).cast("long")
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def planted(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return let(F.struct(words.alias("w"), a.alias("a"), p.alias("p")), lambda v: F.array_join(F.transform(
            v["w"], lambda w, i: F.when(i < v["a"], w).otherwise(F.get(v["w"], v["a"] + (i - v["a"]) % v["p"]))), " "))

    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(""))).otherwise(text)
