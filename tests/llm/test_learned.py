"""Toxicity and languages: held-out accuracy, brute-force likelihoods, odd rows."""

import math
import random

import numpy as np
import pytest

from tracewell.llm import langid, toxicity

R = random.Random(6)
CLEAN = [f"{a}{b}{c}" for a in ("lo", "mi", "ra", "te") for b in ("nu", "ka", "so") for c in ("x", "r", "l", "")]
BAD = ("vile", "grot", "mudling")


def text(toxic, sentences=8):
    out = [[R.choice(CLEAN) for _ in range(R.randrange(4, 12))] for _ in range(sentences)]
    if toxic:
        out[R.randrange(sentences)].insert(0, R.choice(BAD))
    return ". ".join(" ".join(s) for s in out) + "."


@pytest.fixture(scope="module")
def marked(spark):
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t, _ in rows], "doc_id long, text string, score string, h int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows[:400]] + [(0, 1, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, toxicity.fit(docs, labels)


def test_held_out_documents_and_sentences(marked):
    rows, docs, model = marked
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, t, y in rows[400:]:
        assert (got[i].score >= 0.7) == bool(y)
        if y:
            (span,) = got[i].sentences
            assert any(w in t[span.start : span.end].split() for w in BAD)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.7}


def test_noisy_or_of_sentences(marked):
    model = marked[2]
    t = "Vile thing. lonux mikar! GROT\nlonux"
    score, spans = toxicity.score_text(t, toxicity.Weights(model), model.bias)
    clean = 1.0
    for s in ("vile thing", " lonux mikar", " grot", "lonux"):
        z = model.bias + sum(model.weights.get(f, 0.0) for w in set(s.split()) for f in toxicity.features(w))
        clean *= 1 - 1 / (1 + math.exp(-z))
    assert score == pytest.approx(1 - clean, rel=1e-9) and len(spans) == 2


def test_gradient_matches_likelihood():
    texts, y = ["bad thing. fine", "fine day", "bad"] * 20, np.array([1, 0, 1] * 20)
    model = toxicity.fit_noisy_or(texts, y, np.ones(60), min_bags=2)
    w = toxicity.Weights(model)
    assert toxicity.score_text("bad", w, model.bias)[0] > 0.9 > 0.1 > toxicity.score_text("fine day", w, model.bias)[0]


def test_odd_rows_score(spark, marked):
    model = marked[2]
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "..!?"), (3, "İvile " * 3), (4, "lonux " * 50_000)], "doc_id long, text string")
    got = [(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()]
    assert [s for d, s in got if d in (1, None, 2)] == [0, 0, 0, 0] and all(0 <= s <= 1 for _, s in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score < 0.01 for r in toxicity.score(docs, none).collect()] == [True] * 6


def brute_bits(text, own, order=3):
    counts = {}
    for t in own:
        b = t.lower().encode()
        for i in range(len(b)):
            for k in range(min(order, i) + 1):
                counts.setdefault(b[i - k : i], {}).setdefault(b[i], 0)
                counts[b[i - k : i]][b[i]] += 1
    b, bits = text.lower().encode(), 0.0
    for i in range(len(b)):
        k = min(order, i)
        while True:
            if k < 0:
                bits += 8
                break
            c = counts.get(b[i - k : i])
            if c:
                n, distinct = sum(c.values()), len(c)
                if b[i] in c:
                    bits -= math.log2(c[b[i]] / (n + distinct))
                    break
                bits -= math.log2(distinct / (n + distinct))
            k -= 1
    return bits


SAMPLES = {"aa": ["the cat and the dog ran", "a dog sat on the mat"], "bb": ["der hund und die katze", "ein hund lief über die straße"], "cc": ["le chat noir et le chien"]}


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_code_lengths_equal_brute_force(monkeypatch, step):
    monkeypatch.setattr(langid, "STEP", step)
    trees = langid.learn(SAMPLES)
    texts = ["the dog", "die straße über", "日本 zz 12", "", "x", "le chat et the hund " * 5]
    bits, size = langid.code_lengths(texts, trees, *langid.automaton(trees))
    for i, t in enumerate(texts):
        assert size[i] == len(t.encode())
        for j, lang in enumerate(trees.languages):
            assert bits[i, j] == pytest.approx(brute_bits(t, SAMPLES[lang]), abs=1e-3)


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_lengths_from_the_counts_equal_the_automaton(monkeypatch, step):
    """Beyond the table's size nothing is cut: the counts themselves give the same lengths."""
    monkeypatch.setattr(langid, "STEP", step)
    trees = langid.learn(SAMPLES)
    assert langid.cells_of(trees) == langid.automaton(trees)[1].size
    texts = ["the dog", "die straße über", "日本 zz 12", "", "x", "le chat et the hund " * 5]
    want, _ = langid.code_lengths(texts, trees, *langid.automaton(trees))
    got, _ = langid.code_lengths(texts, trees, np.zeros(0), np.zeros((0, 0)), langid.sparse_tables(trees))
    assert np.allclose(got, want, atol=1e-3)


def test_predictions_without_the_automaton(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_CELLS", 1)
    trees = langid.learn(SAMPLES)
    docs = spark.createDataFrame([(1, "the dog sat"), (2, "die katze lief"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, trees).collect()} == {1: "aa", 2: "bb", 3: "und"}


def test_long_texts_teach_a_language(spark):
    """A language whose texts are all long is learnt; a draw ends where its characters do."""
    docs = spark.createDataFrame([(i, "wieder und wieder " * 2000 + str(i), "de") for i in range(6)] + [(9, "the cat", "en")], "doc_id long, text string, lang string")
    assert langid.fit(docs).languages == ("de", "en")
    assert langid.fit(docs, langid.SampleBound(total_chars=10)).languages == ("de", "en")


def test_shares_of_a_hot_language_draw_as_the_whole_would(spark):
    rows = [(f"satz {i} mit {i % 7}", "de") for i in range(300)] + [(f"phrase {i}", "fr") for i in range(3)]
    df = spark.createDataFrame(rows * 2, "text string, lang string").repartition(7)
    hashed = df.distinct().selectExpr("lang", "text", "xxhash64(text) AS h").collect()
    want = {c: [r.text for r in sorted((r for r in hashed if r.lang == c), key=lambda r: r.h)[:20]] for c in ("de", "fr")}
    assert langid.fit(df, langid.SampleBound(20)).key == langid.learn(want).key


def test_draw_of_the_smallest_hashes(spark):
    """A language with most rows, a small one, one whose hashes all lie high, so that more has to be asked for."""
    draw = random.Random(12)
    rows = [("a", draw.randrange(-(1 << 63), 1 << 63)) for _ in range(3000)] + [("b", 7)] + [("c", (1 << 63) - 1 - i) for i in range(100)]
    keyed = spark.createDataFrame([(lang, h, i) for i, (lang, h) in enumerate(rows)], "lang string, h long, size long")
    for most in (1, 20, 5000):
        want = {lang: sorted((h, i) for i, (own, h) in enumerate(rows) if own == lang)[:most] for lang in "abc"}
        assert langid.smallest_hashes(keyed, most) == want
    assert langid.smallest_hashes(keyed.limit(0), 5) == {}


def test_no_task_of_the_fit_meets_a_language(spark):
    """With 64 partitions for 6,000 texts, nearly all of one language, no task reads several times its share."""
    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    df = spark.createDataFrame([(f"text number {i}", "en" if i % 20 else "de") for i in range(6000)], "text string, lang string")
    sc, most = spark.sparkContext, 0
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        sc.setJobGroup("fit", "")
        langid.fit(df)
    finally:
        sc.setJobGroup("", "")
        for k, v in before.items():
            spark.conf.set(k, v)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    for job in sc.statusTracker().getJobIdsForGroup("fit"):
        for stage in sc.statusTracker().getJobInfo(job).stageIds:
            tasks = sc._jsc.sc().statusStore().taskList(stage, 0, 10_000)
            most = max([most, *(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()))])
    assert 6000 / 64 <= most < 250


def test_predictions_and_odd_rows(spark):
    rows = [(i, t + f" {i}", lang, "x") for lang, own in SAMPLES.items() for i, t in enumerate(own * 3)]
    docs = spark.createDataFrame([*rows, (50, "unlabelled", None, "x"), (51, None, "dd", "x")], "doc_id long, text string, lang string, lang_pred string")
    trees = langid.fit(docs)
    assert trees.languages == ("aa", "bb", "cc")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "²½"), (5, "the dog sat"), (5, "the dog sat"), (None, "die katze lief"), (6, "the cat " * 40_000)], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(odd, trees).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "aa"), (5, "aa"), (None, "bb"), (6, "aa")], key=str)
    assert all(0 <= r.score <= 1 for r in langid.predict(odd, trees).collect())
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(docs.limit(0))).collect()} == {"und"}
    assert langid.predict(odd.limit(0), trees).count() == 0
