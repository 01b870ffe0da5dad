"""Hidden Markov language model over words.

Symbols are the end of a text, the most frequent words and, for all other words, a class by their last two bytes. Latent
states emit symbols; a word of a class then comes from the class by its smoothed training count, so every text has a
probability. Baum-Welch counts are taken per partition, summed across partitions and turned into the next model, over
whole texts in each round and until the likelihood settles. A text's likelihood is exact: one scaled forward recursion over all of its symbols.

Counts of words run over all training documents. Words beyond the frequent ones meet their counts by a join, so nothing
that grows with the vocabulary is held by one task or the driver."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, mix, pass_rows, prepare, stage, text_of, tidied

#: Words that are symbols of their own, classes of the other words, latent states.
FREQUENT = 50_000
CLASSES = 512
STATES = 8
#: Gain of the log likelihood in a round, as a share of it, from which training goes on; and a guard against endless rounds.
SETTLED = 1e-4
ROUNDS = 200
#: Words of unigram mass mixed into each state's emissions; added count of a word in the base model and in its class.
MIXED, ADDED = 200.0, 0.1
#: Symbols of one stretch in Baum-Welch; long texts are cut, a later stretch starts from the states' overall shares.
STRETCH = 1024
BATCH = 1_000_000
#: Distinct words that a task counts before it passes them on.
HELD = 300_000

_SUMS = ", ".join(f"k{i} double" for i in range(STATES))


def words_of(text: str | None) -> list[bytes]:
    """Words between white space (space, tab to carriage return), A-Z lower-cased."""
    return (text or "").encode().lower().split()


def class_of(word: bytes) -> int:
    return (word[-1] * 7 + (word[-2] if len(word) > 1 else 0) * 131 + len(word) // 8 * 17) % CLASSES


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of many texts in order, and the number of the text that each is from; see :func:`words_of`."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    words, owner = split.flatten(), pc.list_parent_indices(split)
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real).cast(pa.large_binary()).cast(pa.binary()), owner.filter(real).to_numpy()


def _count(batches):
    held: list[pa.Table] = []
    size = 0

    def summed() -> pa.Table:
        every = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
        return every.select(["word", "c_sum"]).rename_columns(["word", "c"])

    for batch in batches:
        found = words_in(batch["text"])[0].value_counts()
        held.append(pa.table({"word": pa.concat_arrays([found.field(0), pa.array([b""])]), "c": pa.concat_arrays([found.field(1), pa.array([batch.num_rows], pa.int64())])}))
        size += len(held[-1])
        if size > 2 * HELD:
            held = [summed()]
            size = len(held[0])
            if size > HELD:
                yield from held.pop().to_batches()
                size = 0
    if held:
        yield from summed().to_batches()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all training texts; the end of a text is the empty word."""
    return training.select("text").mapInArrow(tidied(_count), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _class_rows(batches):
    for batch in batches:
        words = batch["word"].to_pylist()
        yield pa.record_batch({"class": pa.array([class_of(w) for w in words], pa.int32()), "c": batch["c"]})


@dataclass
class Vocabulary:
    """Frequent words with their symbols and counts, and totals; symbol 0 is the end, classes follow the words."""
    symbols: dict[bytes, int]
    counts: np.ndarray
    class_counts: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int

    @property
    def size(self) -> int:
        return len(self.counts) + CLASSES

    def base(self) -> np.ndarray:
        """log10 of the base model's probability of the symbols that are words."""
        return np.log10((self.counts + ADDED) / (self.total + ADDED * (self.distinct + 1)))

    def unigram(self) -> np.ndarray:
        every = np.concatenate([self.counts, self.class_counts]) + ADDED
        return every / every.sum()


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """The bounded part of the counts: at most ``frequent`` words and the totals of the classes of all others."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = counts.where(F.length("word") == 0).first()
    words = counts.where(F.length("word") > 0)
    top = words.orderBy(F.desc("c"), "word").limit(frequent).collect()
    symbols = {bytes(r["word"]): i + 1 for i, r in enumerate(top)}
    least = (top[-1]["c"], bytes(top[-1]["word"])) if len(top) == frequent else None
    class_counts, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    if least:
        others = words.where((F.col("c") < least[0]) | ((F.col("c") == least[0]) & (F.col("word") > F.lit(bytearray(least[1])))))
        for r in others.mapInArrow(_class_rows, "class int, c long").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
            class_counts[r["class"]], class_words[r["class"]] = r["c"], r["n"]
    held = np.array([end["c"] if end else 0, *[r["c"] for r in top]], np.int64)
    return Vocabulary(symbols, held, class_counts, class_words, total, distinct)


def _symbol_rows(shared):
    def run(batches):
        own: Vocabulary = shared.value
        base, known, first = own.base(), own.counts > 0, len(own.counts)
        frequent_words = pa.array(list(own.symbols), pa.binary())
        for batch in batches:
            out = []
            words, owner = words_in(batch["text"])
            found = pc.index_in(words, value_set=frequent_words)
            other = found.is_null().to_numpy(zero_copy_only=False)
            every = np.zeros(len(words) + batch.num_rows, np.int32)  # an end follows the words of each text
            place = np.arange(len(words)) + owner
            every[place] = pc.fill_null(found, -1).to_numpy() + 1
            rare_words, rare_owner = words.filter(pa.array(other)).to_pylist(), owner[other]
            every[place[other]] = [first + class_of(w) for w in rare_words]
            ends = np.cumsum(np.bincount(owner, minlength=batch.num_rows) + 1).tolist()
            cuts = np.searchsorted(rare_owner, np.arange(batch.num_rows + 1)).tolist()
            for i, (a, b) in enumerate(zip([0, *ends], ends)):
                ids, rare = every[a:b], Counter(rare_words[cuts[i]:cuts[i + 1]])
                frequent = ids[ids < first]
                out.append((len(ids), float(base[frequent].sum()), int(known[frequent].sum()), ids.astype("<u2").tobytes(),
                            [{"word": w, "n": n, "class": class_of(w)} for w, n in rare.items()]))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32()), ("class", pa.int32())])))
            yield pa.record_batch({"doc_id": batch["doc_id"], "held_out": batch["held_out"],
                                   **{n: pa.array(c, k) for n, c, k in zip(("n_tokens", "base", "known", "symbols", "rare"), columns, kinds)}})
    return run


@dataclass
class Model:
    """Start and overall state shares, transitions, and emissions by symbol."""
    start: np.ndarray
    shares: np.ndarray
    moves: np.ndarray
    emissions: np.ndarray


def first_model(unigram: np.ndarray, states: int = STATES) -> Model:
    """A fixed, uneven start: each state leans to other symbols, and states tend to stay."""
    grid = mix(np.arange(len(unigram) * states, dtype=np.uint64) + np.uint64(1)).reshape(len(unigram), states)
    lean = 0.5 + (grid >> np.uint64(11)).astype(float) / (1 << 53)
    emissions = unigram[:, None] * lean
    moves = np.full((states, states), 0.2 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.8 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    return Model(even, even, moves, emissions / emissions.sum(axis=0))


def _by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(order, all symbols by time, the stretch of them that each time holds); the longest sequences come first at every time."""
    size = np.array([len(s) for s in sequences])
    order = np.argsort(-size, kind="stable")
    running = np.searchsorted(-size[order], -np.arange(1, size.max() + 1), side="right")
    ends = np.cumsum(running)
    starts = ends - running
    symbols = np.empty(ends[-1], np.intp)
    for column, i in enumerate(order.tolist()):
        symbols[starts[:size[i]] + column] = sequences[i]
    return order, symbols, list(zip(starts.tolist(), ends.tolist()))


def _over_states(rows: np.ndarray) -> np.ndarray:
    """Sum over the states, pair by pair, which is also the order in which numpy sums a short row."""
    while len(rows) > 1 and len(rows) % 2 == 0:
        rows = rows[0::2] + rows[1::2]
    return rows[0] if len(rows) == 1 else rows.sum(axis=0)


def log_likelihoods(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural log of the probability of each whole sequence: forward recursion, scaled at every symbol."""
    order, symbols, times = _by_time(sequences)
    total, alpha, onward = np.zeros(len(sequences)), None, np.ascontiguousarray(model.moves.T)
    for a, b in times:
        now = model.start[:, None] if alpha is None else onward @ alpha[:, :b - a]
        alpha = np.multiply(now, model.emissions.take(symbols[a:b], axis=0, mode="clip").T, order="C")
        scale = _over_states(alpha)
        alpha /= scale
        total[:b - a] += np.log(scale)
    out = np.empty(len(sequences))
    out[order] = total
    return out


class Sums:
    """Expected counts: emissions by symbol and state, transitions, first states; and the log likelihood of the stretches."""

    def __init__(self, symbols: int, states: int):
        self.emissions, self.moves, self.start = np.zeros((symbols, states)), np.zeros((states, states)), np.zeros(states)
        self.likelihood = 0.0

    def add(self, sequences: list[np.ndarray], opens: list[bool], model: Model) -> None:
        """Forward-backward over stretches; ``opens`` tells those that begin a text."""
        order, symbols, times = _by_time(sequences)
        first = np.array(opens)[order]
        # One row per state and one column per stretch, so that each step runs along the memory.
        moves = model.moves.astype(np.float32)
        onward = np.ascontiguousarray(moves.T)
        table = model.emissions.astype(np.float32)
        alpha = np.where(first, model.start[:, None], model.shares[:, None]).astype(np.float32)
        alphas, given, scales = [], [], np.empty(len(symbols), np.float32)
        for a, b in times:
            e = np.ascontiguousarray(table.take(symbols[a:b], axis=0, mode="clip").T)
            alpha = (onward @ alpha[:, :b - a] if a else alpha) * e
            scale = scales[a:b] = _over_states(alpha)
            alpha /= scale
            e /= scale
            alphas.append(alpha)
            given.append(e)
        self.likelihood += float(np.log(scales).sum(dtype=float))
        tallied = np.zeros_like(self.moves)
        weights = np.empty((len(moves), len(symbols)), np.float32)
        beta = np.ones((len(moves), 0), np.float32)
        for (a, b), alpha, e in zip(reversed(times), reversed(alphas), [None, *reversed(given)]):
            back = np.ones_like(alpha)
            if e is not None:
                ahead = np.multiply(e, beta, out=e)
                width = ahead.shape[1]
                # One row per stretch here: the order in which the products are summed shows in the last digits of the scores.
                tallied += np.ascontiguousarray(alpha[:, :width].T).T @ np.ascontiguousarray(ahead.T)
                np.matmul(moves, ahead, out=back[:, :width])
            beta = back
            np.multiply(alpha, beta, out=weights[:, a:b])
        self.moves += tallied * model.moves
        self.start += np.ascontiguousarray(weights[:, :len(first)].T)[first].sum(axis=0)
        for k, row in enumerate(weights):
            self.emissions[:, k] += np.bincount(symbols, row, len(self.emissions))

    def model(self, unigram: np.ndarray) -> Model:
        shares = self.emissions.sum(axis=0)
        emissions = (self.emissions + MIXED * unigram[:, None]) / (shares + MIXED)
        moves = self.moves + 1.0
        start = self.start + 1.0
        return Model(start / start.sum(), (shares + 1) / (shares + 1).sum(), moves / moves.sum(axis=1, keepdims=True), emissions)


def stretches(symbols: np.ndarray) -> list[np.ndarray]:
    return [symbols[k:k + STRETCH] for k in range(0, len(symbols), STRETCH)]


def _batched(rows, most: int):
    """Groups of (row number, symbols) pairs of about so many symbols."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _expect(shared):
    """Baum-Welch counts of one partition: per symbol seen one row, transitions as -1, -2, ..., first states as -1000,
    the likelihood as -2000 (in its first column)."""
    def run(batches):
        model: Model = shared.value
        sums = Sums(*model.emissions.shape)
        texts = (np.frombuffer(s, "<u2") for batch in batches for s in batch["symbols"].to_pylist())
        for group in _batched(texts, BATCH):
            cut = [stretches(s) for s in group]
            sums.add([p for parts in cut for p in parts], [k == 0 for parts in cut for k in range(len(parts))], model)
        seen = np.flatnonzero(sums.emissions.any(axis=1))
        states = len(sums.start)
        symbol = np.concatenate([seen, -1 - np.arange(states), [-1000, -2000]])
        values = np.concatenate([sums.emissions[seen], sums.moves, sums.start[None], sums.likelihood * (np.arange(states) == 0)[None]])
        yield pa.record_batch({"symbol": pa.array(symbol, pa.int64()), **{f"k{i}": pa.array(np.ascontiguousarray(values[:, i])) for i in range(states)}})
    return run


def baum_welch(symbols: DataFrame, model: Model, unigram: np.ndarray) -> tuple[Model, float]:
    """The next model after a round over all training texts, and the log likelihood under ``model``; the summed counts, of the size of the model, reach the driver."""
    shared = symbols.sparkSession.sparkContext.broadcast(model)
    rows = symbols.select("symbols").mapInArrow(tidied(_expect(shared)), f"symbol long, {_SUMS}")
    table = rows.groupBy("symbol").agg(*[F.sum(f"k{i}").alias(f"k{i}") for i in range(STATES)]).toArrow()
    at = table["symbol"].to_numpy()
    values = np.column_stack([table[f"k{i}"].to_numpy() for i in range(STATES)]) if len(at) else np.zeros((0, STATES))
    sums = Sums(*model.emissions.shape)
    sums.emissions[at[at >= 0]] = values[at >= 0]
    for k in range(STATES):
        if (at == -1 - k).any():
            sums.moves[k] = values[at == -1 - k][0]
    if (at == -1000).any():
        sums.start = values[at == -1000][0]
    if (at == -2000).any():
        sums.likelihood = float(values[at == -2000][0, 0])
    shared.unpersist()
    return sums.model(unigram), sums.likelihood


def train(symbols: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Rounds over all symbols of all training texts, until their likelihood settles; ``rounds`` at most."""
    model, last = first_model(unigram), -np.inf
    for _ in range(rounds):
        model, now = baum_welch(symbols, model, unigram)
        if now - last <= SETTLED * abs(now):
            break
        last = now
    return model


def _forward(shared):
    def run(batches):
        model: Model = shared.value
        for batch in batches:
            texts = [np.frombuffer(s, "<u2") for s in batch["symbols"].to_pylist()]
            made = [log_likelihoods(group, model) for group in _batched(texts, 4 * BATCH)]
            score = np.concatenate(made) / np.log(10) if made else np.zeros(0)
            yield pa.record_batch({"uid": batch["uid"], "doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_tokens": batch["n_tokens"],
                                   "base": batch["base"], "known": batch["known"], "forward": pa.array(score)})
    return run


def score(docs: DataFrame, held_out: Column | None = None, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Null and empty texts are the end alone. Rows that repeat a doc_id are documents of their own. Without any training
    document every probability of the base model is that of an unknown word."""
    spark = docs.sparkSession
    prepare(spark)
    rows = pass_rows(docs, {"doc_id": F.col("doc_id").cast("long"), "text": text_of(), "held_out": crc_of_id() % 10 == 0 if held_out is None else held_out})
    counts = stage(word_counts(rows.where("not held_out")), "model-counts")
    own = vocabulary(counts, frequent)
    shared = spark.sparkContext.broadcast(own)
    coded = rows.mapInArrow(tidied(_symbol_rows(shared)), "doc_id long, held_out boolean, n_tokens long, base double, known long, symbols binary, "
                                                 "rare array<struct<word: binary, n: int, class: int>>")
    coded = stage(coded.withColumn("uid", F.monotonically_increasing_id()), "model-symbols")
    model = train(coded.where("not held_out"), own.unigram(), rounds)

    inside = np.log10(own.class_counts + ADDED * (own.class_words + 1))
    whole = float(np.log10(own.total + ADDED * (own.distinct + 1)))
    words = coded.select("uid", F.inline("rare"))
    found = words.join(counts, "word", "left")
    log, n = F.log10(F.coalesce("c", F.lit(0)) + ADDED), F.col("n")
    rare = found.groupBy("uid").agg(F.sum(n * (log - whole)).alias("base_rare"), F.sum(F.when(F.col("c") > 0, n).otherwise(0)).alias("known_rare"),
                                    F.sum(n * (log - F.get(F.lit(inside.tolist()), F.col("class")))).alias("inside"))
    scored = coded.mapInArrow(tidied(_forward(spark.sparkContext.broadcast(model))), "uid long, doc_id long, held_out boolean, n_tokens long, base double, known long, forward double")
    none = F.lit(0.0)
    return scored.join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"), F.lit(own.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", none)).alias("base_score"), (F.col("forward") + F.coalesce("inside", none)).alias("score"))
