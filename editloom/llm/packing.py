"""Lexical retrieval packing: windows of documents that share words.

Whole windows are cut off long documents first. What is left of each document goes to a shard by its leading term (the
one of highest weight), so that like documents meet; a shard is a stretch of that order and holds a bounded number of
documents. In a shard, a BM25 inverted index over the leftovers returns for each seed the unused neighbours by score,
which fill the seed's window in turn. The last one is cut where the window is full and its rest stays unused. Inverse
document frequencies count all documents of the corpus. What is left at the end of a shard is carried to the next one
of the same task; the last rest is cut at powers of two, so no sequence needs padding."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, key_of, pass_rows, prepare, stage, text_of, tidied, tidy
from .tokens import END, default_path, encoder, in_parts, release

WINDOW = 2048
#: Documents whose leftovers one shard of the index holds.
SHARD = 512
#: Documents of one leading term that are kept together; a term with more is dealt out by key.
GROUP = 256
#: Terms of a seed that query the index, those of highest inverse document frequency.
QUERY_TERMS = 32
K1, B = 1.2, 0.75

_PIECES = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids: bit 61 marks windows filled by one document, then the task, then a counter.
_TASK_BITS = 36


def _encode(path: str, end: int):
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        encode = encoder(path).encode
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in in_parts(texts):
                blobs = [x + last for x in encode(texts[a:b])]
                yield pa.record_batch({"key": batch["key"].slice(a, b - a), "n": pa.array([len(x) // 4 for x in blobs], pa.int64()), "ids": pa.array(blobs, pa.binary())})
    return run


def encode_rows(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """(key, n, ids): little-endian unsigned 32-bit ids of each whole text and the end id."""
    prepare(docs.sparkSession)
    return pass_rows(docs, {"key": key_of(), "text": text_of()}).mapInArrow(tidied(_encode(vocabulary or default_path(), end)), "key long, n long, ids binary")


def _left(ids: bytes, window: int) -> np.ndarray:
    """The end of a document that fills no whole window."""
    held = np.frombuffer(ids, "<u4")
    return held[len(held) // window * window:]


def _count_terms(window: int):
    def run(batches):
        release()
        tidy()
        counts = np.zeros(0, np.int64)
        documents = length = 0
        for batch in batches:
            for ids in batch["ids"]:
                left = _left(ids.as_buffer(), window)
                if len(left):
                    terms = np.unique(left)
                    if terms[-1] >= len(counts):
                        counts = np.concatenate([counts, np.zeros(int(terms[-1]) + 1 - len(counts), np.int64)])
                    counts[terms] += 1
                    documents += 1
                    length += len(left)
        seen = np.flatnonzero(counts)
        yield pa.record_batch({"term": pa.array(np.concatenate([seen, [-1, -2]]), pa.int64()), "n": pa.array(np.concatenate([counts[seen], [documents, length]]), pa.int64())})
    return run


def term_statistics(coded: DataFrame, window: int = WINDOW) -> tuple[np.ndarray, float, np.ndarray]:
    """Inverse document frequency by term id over all leftovers, their mean length, and the document frequencies; as many
    numbers as the vocabulary has."""
    rows = coded.select("ids").mapInArrow(_count_terms(window), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}
    documents, length = counts.pop(-1, 0), counts.pop(-2, 0)
    held = np.zeros(max(counts, default=0) + 1, np.int64)
    held[list(counts)] = list(counts.values())
    return np.log(1 + (documents - held + 0.5) / (held + 0.5)), length / documents if documents else 1.0, held


def _split(window: int, idf_of):
    """Whole windows as finished pieces (kind 0, ahead of all terms and spread by key), leftovers with their leading term
    (kind 1)."""
    def run(batches):
        from pyspark import TaskContext
        (idf, _, held), next_id = idf_of.value, (1 << 61) | (TaskContext.get().partitionId() << _TASK_BITS)
        for batch in batches:
            out = []
            for key, n, ids in zip(batch["key"].to_pylist(), batch["n"].to_pylist(), batch["ids"]):
                raw = memoryview(ids.as_buffer())
                for k in range(n // window):
                    out.append((0, -1, (key + k) % (1 << 31), key, k * window, window, zlib.crc32(raw[4 * k * window:4 * (k + 1) * window]), n, next_id, None))
                    next_id += 1
                left = _left(raw, window)
                if len(left):
                    terms, tf = np.unique(left, return_counts=True)
                    lead = int(terms[np.argmax(idf[terms] * tf / (tf + K1))])
                    out.append((1, lead, key % (1 + int(held[lead]) // GROUP), key, n - len(left), len(left), 0, n, 0, left.astype("<u4").tobytes()))
            columns = list(zip(*out)) or [()] * 10
            names = ("kind", "lead", "salt", "key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "ids")
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch({m: pa.array(c, t) for m, c, t in zip(names, columns, kinds)})
    return run


_SPLIT = "kind int, lead long, salt long, key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, ids binary"


class Shard:
    """BM25 inverted index over the leftovers of a bounded number of documents."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        self.terms = [np.unique(t, return_counts=True) for t in texts]
        docs = np.repeat(np.arange(len(texts)), [len(t) for t, _ in self.terms])
        terms = np.concatenate([t for t, _ in self.terms]) if texts else np.zeros(0, np.int64)
        tf = np.concatenate([c for _, c in self.terms]) if texts else np.zeros(0, np.int64)
        size = np.array([len(t) for t in texts], float)
        weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[docs] / mean))
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights = docs[order], weight[order]
        self.names, self.first = np.unique(terms[order], return_index=True)
        self.last = np.append(self.first[1:], len(terms))
        self.idf, self.count = idf, len(texts)

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[seed][0]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-self.idf[terms], QUERY_TERMS)[:QUERY_TERMS]]
        at = np.searchsorted(self.names, terms)
        first, size = self.first[at], self.last[at] - self.first[at]
        take = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.docs[take], self.weights[take], self.count)


def pack_shard(rows: list[list], window: int, idf: np.ndarray, mean: float, last: bool):
    """Sequences (lists of (row, from, to)) of a shard's rows [key, start, ids, doc_tokens], and the rows that are left over."""
    index = Shard([r[2] for r in rows], idf, mean)
    used, done = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
    size = np.array([len(r[2]) for r in rows], np.int64)
    total = int(size.sum())
    for seed in range(len(rows)):
        if used[seed] or (total < window and not last):
            continue
        ranked, room, sequence = None, window, []
        scores = index.scores(seed)
        scores[used] = -1.0
        scores[seed] = np.inf
        ranked = np.argsort(-scores, kind="stable")
        for row in ranked[:int((~used).sum())].tolist():
            take = min(room, int(size[row] - done[row]))
            sequence.append((row, int(done[row]), int(done[row]) + take))
            done[row] += take
            used[row] = done[row] == size[row]
            room -= take
            if not room:
                break
        total -= window - room
        yield sequence
        if not used[seed]:
            raise AssertionError("a seed fits its window")
    left = [[r[0], r[1] + int(d), r[2][d:], r[3]] for r, d in zip(rows, done.tolist()) if d < len(r[2])]
    return left


def _pack(window: int, shard: int, idf_of):
    def run(batches):
        from pyspark import TaskContext
        idf, mean, _ = idf_of.value
        state = {"next": TaskContext.get().partitionId() << _TASK_BITS}
        out: list[tuple] = []

        def put(rows, sequences):
            for sequence in sequences:
                offset = 0
                for row, a, b in sequence:
                    key, start, ids, n = rows[row]
                    out.append((key, start + a, b - a, zlib.crc32(ids[a:b].tobytes()), n, state["next"], offset))
                    offset += b - a
                state["next"] += 1

        def fill(rows, last):
            work = pack_shard(rows, window, idf, mean, last)
            while True:
                try:
                    sequence = next(work)
                except StopIteration as end:
                    return end.value
                whole = sum(b - a for _, a, b in sequence)
                put(rows, [sequence] if whole == window else cut_at_powers(sequence))

        def batch_of():
            columns = list(zip(*out)) or [()] * 7
            names = ("key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            made = pa.record_batch({m: pa.array(c, pa.int64()) for m, c in zip(names, columns)})
            out.clear()
            return made

        rows: list[list] = []
        held = 0
        for batch in batches:
            done = int((batch["kind"].to_numpy() == 0).sum())  # whole windows come first in the order
            if done:
                first = batch.slice(0, done)
                columns = {m: first[m] for m in ("key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id")}
                yield pa.record_batch({**columns, "offset": pa.array(np.zeros(done, np.int64))})
                batch = batch.slice(done)
            for key, start, ids, n in zip(batch["key"].to_pylist(), batch["start"].to_pylist(), batch["ids"], batch["doc_tokens"].to_pylist()):
                rows.append([key, start, np.frombuffer(ids.as_buffer(), "<u4"), n])
                held += len(rows[-1][2])
                if len(rows) >= shard and held >= window:
                    rows = fill(rows, False)
                    held = sum(len(r[2]) for r in rows)
            if out:
                yield batch_of()
        while rows:
            rows = fill(rows, True)
        yield batch_of()
    return run


def cut_at_powers(sequence: list[tuple[int, int, int]]):
    """Cut a sequence into ones whose lengths are powers of two, the largest first."""
    whole = sum(b - a for _, a, b in sequence)
    parts, pieces = [], list(sequence)
    while whole:
        room = 1 << (whole.bit_length() - 1)
        whole -= room
        part = []
        while room:
            row, a, b = pieces[0]
            take = min(room, b - a)
            part.append((row, a, a + take))
            room -= take
            pieces[0:1] = [(row, a + take, b)] if a + take < b else []
        parts.append(part)
    return parts


def pack(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each document lies in one piece; a null or empty text is its end id alone. Rows that repeat a doc_id are
    packed as documents of their own. Only counts by term reach the driver, as many as the vocabulary has."""
    spark = docs.sparkSession
    coded = stage(encode_rows(docs, vocabulary, end), "packing-ids")
    statistics = spark.sparkContext.broadcast(term_statistics(coded, window))
    parts = coded.mapInArrow(tidied(_split(window, statistics)), _SPLIT)
    dealt = parts.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "key", "start")
    packed = dealt.mapInArrow(tidied(_pack(window, shard, statistics)), _PIECES)
    return packed.select(id_of(F.col("key")).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
