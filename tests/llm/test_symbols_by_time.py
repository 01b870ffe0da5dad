"""The recursions of the hidden Markov model hold as much as there are symbols, whatever the lengths are."""

import tracemalloc

import numpy as np
import pyarrow as pa

from editloom.llm import hidden_markov


def test_one_long_text_beside_short_ones():
    rng = np.random.default_rng(3)
    model = hidden_markov.first_model(np.full(20, 0.05), 3)
    texts = [rng.integers(0, 20, 20_000)] + [rng.integers(0, 20, 1) for _ in range(2000)]
    tracemalloc.start()
    made = hidden_markov.log_likelihoods(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000, peak
    assert np.allclose(made[1:3], [np.log(model.start @ model.emissions[t[0]]) for t in texts[1:3]])


def test_words_as_split_one_by_one():
    texts = ["", " \t", "A\x0bB\x1cC  É Z q r\x85", "\x00x \x00", "ÀB İ K   a", "b\ta\na"]
    words, owner = hidden_markov.words_in(pa.array(texts))
    assert [(i, w) for i, t in enumerate(texts) for w in hidden_markov.words_of(t)] == list(zip(owner.tolist(), words.to_pylist()))
