"""The pipeline's stages, each on its own input, against brute-force versions."""

import re

import pytest

import corpus_pipeline
from conftest import DATA
from editloom.llm import toxicity
from editloom.llm.common import WORD, stage, table
from test_operators import LONG, brute_classes, check_pieces, frame


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [], table(spark, DATA, "documents")
    for name, step in corpus_pipeline.STAGES:
        made = stage(step(spark, docs, DATA), "test-stage")
        out.append((name, docs, made))
        docs = made
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_keep_the_columns(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes, name


def test_toxic_documents_go(spark, stages):
    _, before, after = stages[0]
    scored = toxicity.score(before, table(spark, DATA, "labels"))
    assert {r.doc_id for r in scored.where("predicted = 0").collect()} == {i for i, _ in rows(after)}


def test_copies_go(stages):
    _, before, after = stages[1]
    best = {}
    for i, t in rows(before):
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i)) if key in best else (-len(t or ""), i)
    assert [i for i, _ in rows(after)] == sorted(i for _, i in best.values())


def test_near_copies_go(stages):
    _, before, after = stages[2]
    assert [i for i, _ in rows(after)] == [i for i, c, _ in brute_classes(rows(before)) if i == c]


def test_benchmark_goes(spark, stages):
    _, before, after = stages[3]
    items = [WORD.findall(r.text.lower()) for r in table(spark, DATA, "benchmark").collect()]
    kept = {i for i, _ in rows(after)}
    for i, t in rows(before):
        words = WORD.findall((t or "").lower())
        text = " " + " ".join(words) + " "
        if any(" " + " ".join(item) + " " in text for item in items if len(item) >= 4):
            assert i not in kept
        grams = {tuple(words[k:k + 4]) for k in range(len(words) - 3)}
        shared = max(sum(tuple(item[k:k + 4]) in grams for k in range(len(item) - 3)) / max(1, len(item) - 3) for item in items)
        if shared < 0.1:
            assert i in kept


def test_all_tokens_are_packed(stages):
    tokenizers = pytest.importorskip("tokenizers")
    import numpy as np
    from editloom.llm.tokens import default_path
    tokenizer = tokenizers.Tokenizer.from_file(default_path())
    _, before, after = stages[4]
    assert check_pieces(after.collect(), rows(before), lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) == 0


def test_edges_pass_through(spark):
    plain = " ".join(f"plain{i}" for i in range(40))
    docs = frame(spark, [(1, None), (2, ""), (3, plain), (3, plain), (4, plain + " "), (5, plain + " more"), (None, "no id here"), (None, None), (7, LONG), (8, "a small text")])
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, DATA), "test-edges")
        assert docs.columns == frame(spark, []).columns
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect())
    assert kept == [(False, 1, ""), (False, 4, plain + " "), (False, 7, LONG), (False, 8, "a small text"), (True, 0, "no id here")]
    none = frame(spark, [])
    for _, step in corpus_pipeline.STAGES:
        none = stage(step(spark, none, DATA), "test-none")
    assert none.count() == 0
