"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers (insult, threat, target, negation, reported speech) read the word classes of a clause; their
composition is one automaton whose path weight is the clause's score. Clauses that match no insult or threat score
nothing, so a lone target or negation is harmless. The insult words and their weights are learned from labelled
documents, the document score is a logistic function of its clause scores, fitted on other labelled documents."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, pass_rows, prepare, stage, text_of, tidied

#: Labelled rows that the lexicon and the weights are fitted on, at most: those first in the order of a hash of the id.
SAMPLE = 30_000
#: Words of the insult lexicon, at most: those of highest weight.
LEXICON = 20_000
THRESHOLD = 0.3

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)

# Seed words of the classes. Insults are only a start: their weights come from the labels when there are any.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum loser losers pathetic disgusting worthless imbecile scumbag",
    THREAT: "kill hurt punish destroy beat crush töten schlagen tuer frapper matar golpear",
    TARGET: "you your yours yourself ya u they them their he him his she her du dich dir euch ihr tu toi vous te vos usted ustedes",
    NEGATION: "not never no nobody isn aren wasn don doesn didn without nicht kein keine nie ne pas jamais nunca ni",
    REPORT: "said says say wrote writes called claims claimed quote quoted quotes reported sagte schrieb dit écrit dijo escribió",
}

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n\"]")
_WORD = re.compile(r"[^\W\d_]+")
_STOPS = frozenset(".!?;:\n\"")

# Transducers: (state, class) -> (next state, weight); a missing entry stays in its state at no weight.
INSULTS = {(0, INSULT): (0, 0.0)}
THREATS = {(0, THREAT): (1, 0.0), (1, TARGET): (0, 4.0)}
TARGETS = {(0, TARGET): (1, 0.0), (1, INSULT): (1, 1.0)}
NEGATIONS = {(0, NEGATION): (1, 0.0), (1, OTHER): (2, 0.0), (2, OTHER): (0, 0.0), (1, INSULT): (0, -1.0), (2, INSULT): (0, -1.0), (1, TARGET): (2, 0.0), (2, TARGET): (0, 0.0)}
REPORTS = {(0, REPORT): (1, 0.0), (1, INSULT): (1, -0.5)}
GRAMMAR = (INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS)


def compose(*transducers: dict) -> list[list[tuple[int, float]]]:
    """One automaton over the states that the transducers reach together: [state][class] -> (next state, summed weight)."""
    start = (0,) * len(transducers)
    number, table, todo = {start: 0}, [], [start]
    while todo:
        state = todo.pop(0)
        row = []
        for kind in range(OTHER + 1):
            steps = [t.get((s, kind), (s, 0.0)) for t, s in zip(transducers, state)]
            target = tuple(s for s, _ in steps)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append((number[target], sum(w for _, w in steps)))
        table.append(row)
    return table


AUTOMATON = compose(*GRAMMAR)


def classes(insults: dict[str, float]) -> dict[str, tuple[int, float]]:
    """Class and own weight of every word of the grammar; learned insults go before the other classes."""
    out = {w: (kind, 0.0) for kind in (REPORT, NEGATION, TARGET, THREAT) for w in SEEDS[kind].split()}
    out.update({w: (INSULT, weight) for w, weight in insults.items()})
    return out


def clause_scores(text: str, words: dict[str, tuple[int, float]]) -> list[float]:
    """Scores of the clauses that match an insult or a threat."""
    out, state, score, matched = [], 0, 0.0, False
    other = (OTHER, 0.0)
    for token in _TOKEN.findall(text):
        if token in _STOPS:
            if matched:
                out.append(max(score, 0.0))
            state, score, matched = 0, 0.0, False
            continue
        kind, own = words.get(token, other)
        state, weight = AUTOMATON[state][kind]
        score += own + weight
        matched = matched or kind == INSULT or weight >= 4.0
    if matched:
        out.append(max(score, 0.0))
    return out


def features(text: str, words: dict, triggers: frozenset) -> tuple[float, float, float]:
    """Best clause score, log of the summed scores, matched clauses in a hundred words."""
    lower = text.lower()
    found = _WORD.findall(lower)
    if triggers.isdisjoint(found):
        return 0.0, 0.0, 0.0
    scores = clause_scores(lower, words)
    return (max(scores), math.log1p(sum(scores)), min(100.0 * len(scores) / len(found), 100.0)) if scores else (0.0, 0.0, 0.0)


def _triggers(words: dict) -> frozenset:
    return frozenset(w for w, (kind, _) in words.items() if kind in (INSULT, THREAT))


def _feature_rows(model):
    def run(batches):
        words = classes(model.value)
        triggers = _triggers(words)
        for batch in batches:
            made = [features(t, words, triggers) for t in batch["text"].to_pylist()]
            yield pa.record_batch({"toxic": batch["toxic"], "f": pa.array(made, pa.list_(pa.float64()))})
    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most ``most`` labelled documents that are not held out, staged."""
    own = pass_rows(labels, {"doc_id": F.col("doc_id"), "toxic": F.col("toxic")}).where("doc_id is not null and toxic in (0, 1)").where(crc_of_id() % 4 != 2)
    picked = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = pass_rows(docs, {"doc_id": F.col("doc_id"), "text": text_of()})
    return stage(texts.join(F.broadcast(picked), "doc_id"), "toxicity-sample")  # at most ``most`` ids


def learn_insults(sample: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Words whose documents are mostly toxic, with their log odds.

    A word counts once per document. It joins the lexicon when the lower Wilson bound (95 %) of its toxic share is over
    one half, which takes at least four documents; the weight is the log odds of that bound, plus one."""
    words = sample.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).where("n >= 4 and 2 * k > n")
    z2, n, p = 3.84, F.col("n"), F.col("k") / F.col("n")
    low = (p + z2 / (2 * n) - F.sqrt(z2 * (p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    rows = counts.select("word", F.least(low, F.lit(0.999)).alias("low")).where("low > 0.5").orderBy(F.desc("low"), "word").limit(most).collect()
    return {r["word"]: 1.0 + math.log(r["low"] / (1 - r["low"])) for r in rows}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a ridge logistic regression, bias first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Weights when there are no labels of both kinds: any matched insult of ordinary weight is toxic.
DEFAULT_WEIGHTS = np.array([-3.0, 1.0, 1.0, 0.2])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """(insult words with weights, logistic weights), from labelled rows that are not held out.

    Three quarters of the sample give the words, the other quarter, which has not shaped them, the logistic weights."""
    rows = labelled_sample(docs, labels, sample)
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))
    insults = dict.fromkeys(SEEDS[INSULT].split(), 2.0)
    insults.update(learn_insults(rows.where(part > 0)))
    model = docs.sparkSession.sparkContext.broadcast(insults)
    made = rows.where(part == 0).select("toxic", "text").mapInArrow(_feature_rows(model), "toxic int, f array<double>").collect()  # a bounded sample
    y = np.array([r["toxic"] for r in made], float)
    if not 0 < y.sum() < len(y):
        return insults, DEFAULT_WEIGHTS
    weights = fit_logistic(np.array([r["f"] for r in made]), y)
    return insults, weights


def _score_rows(model):
    def run(batches):
        insults, weights = model.value
        words = classes(insults)
        triggers = _triggers(words)
        for batch in batches:
            x = np.array([features(t, words, triggers) for t in batch["text"].to_pylist()], float).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(score), "clauses": pa.array(x[:, 2])})
    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null and empty texts have no clause and get the score of a text without matches. Labels of unknown documents, null
    labels and null ids are no labels; without labels of both kinds the seed words and default weights are used."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    rows = pass_rows(docs, {"doc_id": F.col("doc_id").cast("long"), "text": text_of()})
    scored = rows.mapInArrow(tidied(_score_rows(model)), "doc_id long, score double, clauses double")
    return scored.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept; scored where they lie, without moving texts."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    at = docs.columns.index("text")

    def run(batches):
        insults, weights = model.value
        words = classes(insults)
        triggers = _triggers(words)
        for batch in batches:
            x = np.array([features(t or "", words, triggers) for t in batch.column(at).to_pylist()], float).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield batch.filter(pa.array(p < THRESHOLD))
    return docs.mapInArrow(tidied(run), docs.schema)
