"""Benchmark decontamination: word n-grams join passages to test items, Smith-Waterman alignment scores the pairs.

All n-grams of an item are its seeds. A bit map over all seeds, of bounded size, picks the places of each document that
may hold one. These, not the texts, are joined with the seeds by hash; a seed proposes pairs however many documents hold
it. Around the seeds that a document shares with an item, the item's length and the gaps that the threshold allows decide
what is aligned with it, word by word, so edited and paraphrased copies score too, and no alignment that holds a seed and
reaches the threshold is cut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, gram_hashes, hash_of_text, hash_words, id_of, key_of, pass_rows, prepare, stage, text_of, tidied

#: Words of a seed.
SEED_WORDS = 4
#: Alignment: match, mismatch, gap; and the share of an item's full score from which a document counts as contaminated.
MATCH, MISMATCH, GAP_COST = 2.0, -1.0, 1.0
THRESHOLD = 0.5
#: Bits of the map: sixteen for each n-gram, within these bounds; beyond the upper one the map lets more places through.
LEAST_BITS, MAP_BITS = 1 << 22, 1 << 27
#: Seeds (16 bytes each) that may be broadcast; more are joined by shuffle.
BROADCAST_SEEDS = 1_000_000
#: Documents with a shared seed whose lists of places may be broadcast to find their texts, if these have at most so many
#: places; and words of all items that may be broadcast to their passages. More are joined by shuffle.
BROADCAST_DOCUMENTS, BROADCAST_PLACES = 100_000, 1_000_000
BROADCAST_WORDS = 2_000_000


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes & np.uint64(size - 1)).astype(np.int64)


def _item_rows(batches):
    known: dict[str, int] = {}
    for batch in batches:
        hashed = [hash_words(WORD.findall(t.lower()), known) for t in batch["text"].to_pylist()]
        found = [(i, w) for i, w in zip(batch["item_id"].to_pylist(), hashed) if len(w)]
        grams = [np.unique(gram_hashes(w, SEED_WORDS)).view(np.int64) for _, w in found]
        yield pa.record_batch({"item_id": pa.array([i for i, _ in found], pa.int64()), "n": pa.array([len(w) for _, w in found], pa.int32()),
                               "words": pa.array([w.tobytes() for _, w in found], pa.binary()), "grams": pa.array(grams, pa.list_(pa.int64()))})


def item_rows(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, words, grams), words as hashes, of the items that have words; ``item`` is a key of the distinct text
    (once staged). Equal texts count once, with the smallest id; an id may be null or have several texts."""
    rows = pass_rows(benchmark, {"item_id": F.col("item_id").cast("long"), "text": text_of()}).groupBy("text").agg(F.min("item_id").alias("item_id"))
    made = rows.select("item_id", "text").mapInArrow(_item_rows, "item_id long, n int, words binary, grams array<long>")
    return made.select(F.monotonically_increasing_id().alias("item"), "*")


def _map_words(size: int):
    def run(batches):
        for batch in batches:
            at = np.unique(_bits(batch["gram"].to_numpy(zero_copy_only=False).view(np.uint64), size))
            cell = at >> 5
            cells, first = np.unique(cell, return_index=True)
            held = np.bitwise_or.reduceat(np.int64(1) << (at & 31), first) if len(at) else at
            yield pa.record_batch({"cell": pa.array(cells), "held": pa.array(held)})
    return run


def bit_map(seeds: DataFrame) -> np.ndarray:
    """Bits over the hashes of all seeds; at most MAP_BITS of them reach the driver, whatever the number of items."""
    n, size = seeds.count(), LEAST_BITS
    while size < min(16 * n, MAP_BITS):
        size *= 2
    rows = seeds.select("gram").mapInArrow(_map_words(size), "cell long, held long").groupBy("cell").agg(F.bit_or("held").alias("held")).collect()
    cells = np.zeros(size // 32, np.uint32)
    if rows:
        cells[[r["cell"] for r in rows]] = [r["held"] for r in rows]
    return np.unpackbits(cells.view(np.uint8), bitorder="little").astype(bool)


def span_of(item: int, threshold: float = THRESHOLD) -> int:
    """Most words of a document that an alignment with an item of so many words can cover and reach the threshold: the
    item's own, and as many further ones as its score can pay for."""
    return item + int(MATCH * item * (1 - max(threshold, 0.0)) / GAP_COST)


def stretches(at: np.ndarray, words: int, item: int, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(from, to) in a document of so many words: all that alignments through one of the seeds at ``at`` (sorted) may
    cover, those that overlap as one."""
    span, seed = span_of(item, threshold), min(item, SEED_WORDS)
    cuts = np.flatnonzero(np.diff(at) >= 2 * span - seed) + 1
    lows, highs = at[np.concatenate([[0], cuts])] + seed - span, at[np.concatenate([cuts - 1, [len(at) - 1]])] + span
    return list(zip(np.maximum(lows, 0).tolist(), np.minimum(highs, words).tolist()))


def _hits(bits_of, lengths: list[int]):
    """The places of each document whose n-gram, of one of these lengths, may be a seed."""
    def run(batches):
        bits, known = bits_of.value, {}
        for batch in batches:
            out = []
            for key, mark, text in zip(batch["key"].to_pylist(), batch["text_hash"].to_pylist(), batch["text"].to_pylist()):
                words = hash_words(WORD.findall(text.lower()), known)
                made = [gram_hashes(words, n) for n in lengths if n <= len(words)]
                places = [np.flatnonzero(bits[_bits(grams, len(bits))]) for grams in made]
                if any(len(at) for at in places):
                    out.append((key, mark, np.concatenate([g[at] for g, at in zip(made, places)]).view(np.int64), np.concatenate(places).astype(np.int32)))
            yield pa.record_batch({"key": pa.array([o[0] for o in out], pa.int64()), "text_hash": pa.array([o[1] for o in out], pa.int64()),
                                   "gram": pa.array([o[2] for o in out], pa.list_(pa.int64())), "at": pa.array([o[3] for o in out], pa.list_(pa.int32()))})
    return run


def _cut(threshold: float):
    """The words, as hashes, of the stretches that a document shares with items."""
    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            out, wanted = [], batch["wanted"]
            items, sizes, places = (wanted.values.field(c).to_numpy() for c in ("item", "n", "at"))
            bounds = wanted.offsets.to_numpy().tolist()
            for key, mark, text, a, b in zip(batch["key"].to_pylist(), batch["text_hash"].to_pylist(), batch["text"].to_pylist(), bounds, bounds[1:]):
                words = hash_words(WORD.findall(text.lower()), known)
                order = a + np.lexsort((places[a:b], items[a:b]))
                for own in np.split(order, np.flatnonzero(np.diff(items[order])) + 1):
                    for low, high in stretches(places[own], len(words), int(sizes[own[0]]), threshold):
                        out.append((key, mark, items[own[0]], low, words[low:high].tobytes()))
            yield pa.record_batch({"key": pa.array([o[0] for o in out], pa.int64()), "text_hash": pa.array([o[1] for o in out], pa.int64()), "item": pa.array([o[2] for o in out], pa.int64()),
                                   "at": pa.array([o[3] for o in out], pa.int32()), "passage": pa.array([o[4] for o in out], pa.binary())})
    return run


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two word sequences (as numbers), and where it ends in the passage."""
    steps = np.arange(len(passage) + 1, dtype=float) * GAP_COST
    row, best, end = np.zeros(len(passage) + 1), 0.0, 0
    for word in item:
        new = np.maximum(row - GAP_COST, 0.0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


def most(same: np.ndarray) -> float:
    """No alignment scores more: the best run of a passage when each word that the item has (``same``) is a match, each
    other one a gap."""
    sums = np.cumsum(np.where(same, MATCH, -min(GAP_COST, -MISMATCH)))
    return float((sums - np.minimum(np.minimum.accumulate(sums), 0.0)).max(initial=0.0))


def _scores(threshold: float):
    """Alignment scores that reach the threshold; pairs that cannot reach it by :func:`most` are not aligned."""
    def run(batches):
        for batch in batches:
            kept, scores, ends = [], [], []
            for row, (item, passage) in enumerate(zip(batch["words"], batch["passage"])):
                item, passage = (np.frombuffer(x.as_buffer(), np.uint64) for x in (item, passage))
                names, numbers = np.unique(item, return_inverse=True)
                at = np.minimum(np.searchsorted(names, passage), len(names) - 1)
                same, full = names[at] == passage, MATCH * len(item)
                if most(same) / full < threshold:
                    continue
                best, end = align(numbers, np.where(same, at, -1))
                if best / full >= threshold:
                    kept.append(row)
                    scores.append(best / full)
                    ends.append(end)
            left = batch.select(["key", "text_hash", "item", "item_id", "at"]).take(pa.array(kept, pa.int64()))
            yield pa.record_batch({"key": left["key"], "text_hash": left["text_hash"], "item": left["item"], "item_id": left["item_id"], "score": pa.array(scores, pa.float64()), "end": pa.array(ends, pa.int32()), "at": left["at"]})
    return run


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, text_hash, item_id, score, end_word): contaminated documents with each item they hold, best score over their stretches.

    Null and empty texts hold nothing; items of fewer than SEED_WORDS words are searched by the run of
    all their words, items without words not at all. Equal items count once; distinct texts with one item_id, or with none,
    are items of their own."""
    spark = docs.sparkSession
    prepare(spark)
    items = stage(item_rows(benchmark), "benchmark-items")
    seeds = items.select("item", "n", F.explode("grams").alias("gram"))
    bits = spark.sparkContext.broadcast(bit_map(seeds))
    lengths = [r[0] for r in items.select(F.least("n", F.lit(SEED_WORDS))).distinct().collect()]
    texts = pass_rows(docs, {"key": key_of(), "text_hash": hash_of_text(), "text": text_of()})
    found = stage(texts.mapInArrow(tidied(_hits(bits, lengths)), "key long, text_hash long, gram array<long>, at array<int>"), "benchmark-hits")
    hits = found.select("key", "text_hash", F.inline(F.arrays_zip("gram", "at")))
    small = seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS  # a seed that very many documents hold is then no hot key
    pairs = hits.join(F.broadcast(seeds) if small else seeds, "gram")
    wanted = stage(pairs.groupBy("key", "text_hash").agg(F.collect_list(F.struct("item", "n", "at")).alias("wanted")), "benchmark-pairs")
    documents, places = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()
    small = documents <= BROADCAST_DOCUMENTS and places <= BROADCAST_PLACES
    passages = texts.join(F.broadcast(wanted) if small else wanted, ["key", "text_hash"]).mapInArrow(tidied(_cut(threshold)), "key long, text_hash long, item long, at int, passage binary")
    own = items.select("item", "item_id", "words")
    small = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= BROADCAST_WORDS
    both = passages.join(F.broadcast(own) if small else own, "item")
    scored = both.select("key", "text_hash", "at", "item", "item_id", "words", "passage").mapInArrow(_scores(threshold), "key long, text_hash long, item long, item_id long, score double, end int, at int")
    best = scored.groupBy("key", "text_hash", "item", "item_id").agg(F.max(F.struct("score", "at", "end")).alias("best"))
    return best.select("key", "text_hash", "item_id", F.col("best.score").alias("score"), (F.col("best.at") + F.col("best.end")).alias("end_word"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, end_word) of :func:`matches`; doc_id is null for rows without one."""
    return matches(docs, benchmark, threshold).select(id_of(F.col("key")).alias("doc_id"), "item_id", "score", "end_word")
