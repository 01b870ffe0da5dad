"""Cases in which a cut of an operator would lose results."""

import numpy as np

import corpus_pipeline
from conftest import DATA
from editloom.llm import decontaminate, hidden_markov, near_join
from editloom.llm.common import stage, table
from test_operators import brute_classes, frame, slow_align

ITEMS = "item_id long, text string"


def found(spark, docs, items):
    got = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, ITEMS)).collect()
    return {(r.doc_id, r.item_id): r.score for r in got}


def filler(rng, n):
    return [f"f{i}" for i in rng.integers(0, 100_000, n)]


# decontamination

def test_verbatim_copy_does_not_hide_an_edited_one(spark):
    rng = np.random.default_rng(11)
    item = [f"v{i}" for i in range(40)]
    edited = ["other" if k % 5 == 4 else w for k, w in enumerate(item)]
    docs = [(1, " ".join(filler(rng, 30) + item)), (2, " ".join(filler(rng, 30) + edited + filler(rng, 30)))]
    other = " ".join(f"o{i}" for i in range(800))
    assert found(spark, docs, [(7, " ".join(item)), (8, other)]) == {(1, 7): 1.0, (2, 7): (32 * 2 - 7) / 80}


def test_copy_that_rewords_the_rare_words_is_found(spark):
    rng = np.random.default_rng(12)
    items = [rng.choice([f"c{i}" for i in range(20)], 40).tolist() for _ in range(30)]
    for k in (5, 15, 25):
        items[0][k] = f"rare{k}"
    copy = [f"reworded{w}" if w.startswith("rare") else w for w in items[0]]
    got = found(spark, [(1, " ".join(filler(rng, 30) + copy))], [(i, " ".join(w)) for i, w in enumerate(items)])
    assert got[1, 0] == (37 * 2 - 3) / 80


def test_parts_of_a_long_item_are_scored_together(spark):
    rng = np.random.default_rng(13)
    item = [f"v{i}" for i in range(100)]
    copy = ["other" if k in (25, 75) else w for k, w in enumerate(item)]
    text = filler(rng, 50) + copy[:50] + filler(rng, 60) + copy[50:] + filler(rng, 50)
    far = filler(rng, 50) + copy[:50] + filler(rng, 300) + copy[50:]
    got = found(spark, [(1, " ".join(text)), (2, " ".join(far))], [(7, " ".join(item))])
    assert got == {(1, 7): slow_align(item, text) / 200} == {(1, 7): (98 * 2 - 2 - 60) / 200}


def test_stretches_hold_all_that_an_alignment_can_cover():
    rng = np.random.default_rng(14)
    for _ in range(300):
        item = rng.integers(0, 9, rng.integers(4, 10))
        text = rng.integers(0, 9, 60)
        text[20:20 + len(item)] = item
        text = np.insert(text, rng.integers(18, 30, 4), 99)
        grams = {tuple(item[k:k + 4].tolist()) for k in range(len(item) - 3)}
        at = np.array([k for k in range(len(text) - 3) if tuple(text[k:k + 4].tolist()) in grams])
        if len(at):
            parts = [text[a:b] for a, b in decontaminate.stretches(at, len(text), len(item))]
            best, full = max(slow_align(item, p) for p in parts), slow_align(item, text)
            assert decontaminate.most(np.isin(text, item)) >= full
            through = [slow_align(item, text[max(0, k + 4 - decontaminate.span_of(len(item))):k + decontaminate.span_of(len(item))]) for k in at.tolist()]
            assert best >= max(through)


def test_each_item_text_is_searched(spark):
    rng = np.random.default_rng(15)
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abc"]
    items = [(None, texts[0]), (5, texts[1]), (5, texts[2] + " c20"), (6, "short run"), (7, "one"), (8, "..."), (None, None)]
    docs = [(1, " ".join([*filler(rng, 20), texts[0]])), (2, " ".join([*filler(rng, 20), texts[1]])), (3, texts[2] + " c20"),
            (4, "a Short, run of words"), (5, "short other run"), (6, "One"), (7, "")]
    assert found(spark, docs, items) == {(1, None): 1.0, (2, 5): 1.0, (3, 5): 1.0, (4, 6): 1.0, (6, 7): 1.0}


# rows that share a doc_id

def test_texts_of_one_id_are_documents_of_their_own(spark):
    rng = np.random.default_rng(16)
    a, b, c, d, e = (" ".join(filler(rng, 60)) for _ in range(5))
    bench = [r.text for r in table(spark, DATA, "benchmark").limit(1).collect()][0]
    docs = frame(spark, [(1, a), (2, a), (2, b), (3, c), (3, "longer than c " + d), (4, e), (4, e + " end"), (4, bench), (5, e + " end"), (6, d + " tail")])
    for _, step in corpus_pipeline.STAGES[1:-1]:
        docs = stage(step(spark, docs, DATA), "test-ids")
    got = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert len(got) == 5 and [g for g in got if g[0] < 4] == sorted([(1, a), (2, b), (3, c), (3, "longer than c " + d)]) and got[-1] in [(4, e), (4, e + " end")]


def test_links_of_texts_that_share_an_id(spark):
    rng = np.random.default_rng(17)
    a, b = " ".join(filler(rng, 60)), " ".join(filler(rng, 60))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end")]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in near_join.classes_of(frame(spark, rows)).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


# hidden Markov model

def test_all_symbols_of_all_texts_train_the_model(spark):
    rng = np.random.default_rng(18)
    texts = [(rng.integers(0, 6, 3000) + 6 * (np.arange(3000) > 2200)).astype("<u2") for _ in range(6)]
    rows = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "uid long, symbols binary").repartition(2)
    unigram = np.full(12, 1 / 12)
    cut = [hidden_markov.stretches(t) for t in texts]
    parts, opens = [p for c in cut for p in c], [k == 0 for c in cut for k in range(len(c))]
    model, last = hidden_markov.first_model(unigram), -np.inf
    while True:
        sums = hidden_markov.Sums(*model.emissions.shape)
        sums.add(parts, opens, model)
        model = sums.model(unigram)
        if sums.likelihood - last <= hidden_markov.SETTLED * abs(sums.likelihood):
            break
        last = sums.likelihood
    got = hidden_markov.train(rows, unigram)
    assert abs(hidden_markov.log_likelihoods(texts, got).sum() / hidden_markov.log_likelihoods(texts, model).sum() - 1) < 1e-6


def test_near_copies_beside_a_shared_passage(spark, monkeypatch):
    """A bucket of near copies and of unlike texts that share a passage: no link is lost, and the split rows stay in proportion to the sets."""
    rng = np.random.default_rng(9)
    words = [f"q{i}" for i in range(3000)]
    passage, base = rng.choice(words, 70).tolist(), rng.choice(words, 60).tolist()
    rows = []
    for i in range(160):
        text = passage + base
        for at in rng.integers(0, len(text), 1 + i % 3):
            text[at] = f"e{i}x{at}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(passage + rng.choice(words, 150).tolist())) for i in range(160)]
    made, write = {}, near_join.stage

    def counted(df, name):
        out = write(df, name)
        made.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(near_join, "stage", counted)
    monkeypatch.setattr(near_join, "LEAF", 16)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_join.classes_of(frame(spark, rows)).collect())
    assert got == brute_classes(rows)
    few, all_runs = near_join.runs_for()
    sets = made["join-paths"][0] // few
    assert len(made["join-paths"]) > 1 and sum(made["join-paths"]) <= near_join.DEPTH * all_runs * sets


def test_sets_of_small_buckets_are_joined_by_no_path(spark, monkeypatch):
    """Near copies in buckets under the limit: the paths are grouped, and only paths of large buckets meet their rows."""
    rng = np.random.default_rng(10)
    base = [f"w{i}" for i in rng.integers(0, 3000, 80)]
    rows = [(i, " ".join(base[:i] + [f"e{i}"] + base[i + 1:])) for i in range(60)]
    plans, write = [], near_join.stage

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)
    monkeypatch.setattr(near_join, "stage", seen)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_join.classes_of(frame(spark, rows)).collect())
    assert got == brute_classes(rows)
    assert plans and not [p for p in plans if "Join Inner, (path" in p]


def test_plain_text_equals_its_steps(spark):
    """The conversion is that of TEXT_STEPS, but only patterns that need one run a regular expression."""
    from pyspark.sql import functions as F

    from editloom.llm import warc
    parts = ["<!-- a -->", "<!--", "-->", "<HEAD x>", "</head >", "<script>", "</script\n>", "<style>", "</STYLE>", "<template>", "</template>", "<p>", "</P >", "<pre", "<br/>", "<", ">", "&nbsp;", "&amp;lt;",
             "&lt;", "&#39;", "&quot;", " ", "  ", "\t", "\r", "\f", "\n", "\n \n", " ", "word", "x<b y='>'>z", "<headline>"]
    rng = np.random.default_rng(12)
    texts = [None, "", *["".join(rng.choice(parts, 1 + i % 25)) for i in range(600)]]
    want = F.col("t")
    for pattern, put in warc.TEXT_STEPS:
        want = F.regexp_replace(want, pattern, put)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    bad = [r for r in rows.select("t", want.alias("want"), warc.plain_text(F.col("t")).alias("got")).collect() if r.want != r.got]
    assert not bad, bad[:3]
    plan = rows.select(warc.plain_text(F.col("t")).alias("got"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 7
