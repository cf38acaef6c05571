"""The toxicity network and the quality rules."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import quality_rules as Q
from tidewatch.llm import toxicity as X

SYLLABLES = ["ta", "ro", "mi", "ken", "lu", "sor", "van", "eth"]


def invented(rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def toxic_corpus(seed, n):
    """Prose, of which every third text has some words of a stem that is never in the others."""
    rnd = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = invented(rnd, rnd.randint(1, 150)).split()
        bad = i % 3 == 0
        for _ in range(rnd.randint(1, 3) if bad else 0):
            words.insert(rnd.randint(0, len(words)), "grumz" + rnd.choice(SYLLABLES) + rnd.choice(SYLLABLES))
        texts.append(" ".join(words))
        labels.append(bad)
    return texts, np.array(labels)


def test_gradients():
    rng = np.random.default_rng(0)
    weights = {k: v.astype(np.float64) for k, v in X.first_weights(rng).items()}
    x, mask = rng.normal(size=(5, 3, 2 * X.EMBED)), np.ones((5, 3, 1))
    mask[3:, 1] = 0
    way = np.array([1, -2, 0.5])
    grads = X.backward(x, mask, weights, X.forward(x, mask, weights, keep=True)[1], way)

    def loss():
        return float(X.forward(x, mask, weights)[0] @ way)

    for name in ("u0", "u1", "w0", "w1", "b0", "a", "v", "o", "x"):
        value = x if name == "x" else weights[name]
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in value.shape)
            old = value[at]
            value[at] = old + 1e-2
            up = loss()
            value[at] = old - 1e-2
            slope = (up - loss()) / 2e-2
            value[at] = old
            assert slope == pytest.approx(float(grads[name][at]), abs=2e-4), name


def test_windows_cover_every_word():
    counts = np.array([0, 1, 32, 33, 48, 49, 500])
    text, first = X.windows(counts)
    for i, n in enumerate(counts):
        covered = set()
        for start in first[text == i]:
            assert start < n
            covered.update(range(start, min(n, start + X.WINDOW)))
        assert covered == set(range(n))


def test_toxicity_on_held_out_texts(spark, hard_docs):
    texts, toxic = toxic_corpus(1, 500)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic.tolist())], "doc_id long, toxic int")
    model = X.fit(docs, labels.union(labels))  # repeated labels change nothing
    assert model == X.fit(docs, labels)
    held, truth = toxic_corpus(2, 300)
    scores = X.score_texts(pa.array(held), X.unpacked(model))
    assert ((scores >= 0.5) == truth).mean() > 0.97
    long_ = "grumzloro " + "ta ro mi " * 20_000
    assert X.score_texts(pa.array([long_, "ta ro mi " * 20_000]), X.unpacked(model))[0] > 0.5
    stay = X.drop_toxic(hard_docs, model)
    assert stay.columns == hard_docs.columns
    scored = X.with_scores(hard_docs, model, keep=["doc_id"]).collect()
    assert len(scored) == hard_docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in scored if r.doc_id in (0, 1, 2)} == {X.EMPTY}


def test_toxicity_without_labels(spark, hard_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit(hard_docs, none)
    assert {r.score for r in X.with_scores(hard_docs, model).collect()} == {0.0}
    assert X.with_scores(no_docs, X.fit(no_docs, none)).count() == 0
    one = spark.createDataFrame([(4, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in X.with_scores(hard_docs, X.fit(hard_docs, one)).collect()} == {1.0}


def brute_statistics(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    chars = sum(len(w.decode()) for w in words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics_like_brute_force(hard_docs):
    texts = [r.text for r in hard_docs.collect()]
    for text, row in zip(texts, Q.statistics(pa.array(texts)).to_pylist()):
        assert tuple(row[c] for c in Q.COUNTS[:5]) == brute_statistics(text or ""), text
        assert row["n_bytes"] == len((text or "").encode())


def quality_corpus(seed, n):
    rnd = random.Random(seed)
    texts, good = [], []
    for i in range(n):
        text = invented(rnd, rnd.randint(60, 200))
        kind = i % 4
        if kind == 1:
            text = " ".join(w + "#%" for w in text.split())
        elif kind == 2 and i % 8 == 2:
            text = " ".join(w.upper() + "!!" for w in text.split())
        texts.append(text)
        good.append(kind in (0, 3) or i % 8 == 6)
    return texts, good


def test_rules_on_held_out_texts(spark, hard_docs):
    texts, good = quality_corpus(1, 400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    rules = Q.fit(docs, labels)
    assert 1 <= len(rules) <= Q.MAX_RULES and rules == Q.fit(docs, labels.union(labels))
    held, truth = quality_corpus(2, 300)
    judged = Q.judge(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), rules).collect()
    assert np.mean([r.kept == truth[r.doc_id] for r in judged]) > 0.97
    stay = Q.drop_low_quality(hard_docs, rules)
    assert stay.columns == hard_docs.columns
    kept = Q.judge(hard_docs, rules).filter(F.col("kept")).count()
    assert stay.count() == kept and Q.judge(hard_docs, rules).count() == hard_docs.count()


def test_base_rule_and_empty_list(spark, hard_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.fit(hard_docs, none) == [] == Q.fit(no_docs, none)
    for r in Q.judge(hard_docs, []).collect():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)
    assert Q.drop_low_quality(no_docs, []).count() == 0


def test_conditions_are_ordered_spark_expressions():
    rule = (Q.Condition("symbols", True, 0.1), Q.Condition("words", False, 80.0))
    text = str(Q.keeps([rule, rule[:1]], F.col("s")))
    assert text.count("WHEN") == 2 and "ELSE true" in text


def test_scoring_takes_bounded_memory_beside_its_rows():
    words = [f"w{i % 997}" for i in range(400_000)]
    texts = pa.array([" ".join(words[i : i + 400]) for i in range(0, len(words), 400)])  # 24,000 windows
    weights = X.first_weights(np.random.default_rng(0)) | {"curve": np.array([1, 0], np.float32)}
    tracemalloc.start()
    X.score_texts(texts, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # two workers of an executor each have this; 8,192 windows at a time took 250 MB


def test_scored_rows_go_in_small_pieces(spark, monkeypatch):
    given, add_column = [], X.add_column
    monkeypatch.setattr(X, "add_column", lambda *args: given.append(args) or add_column(*args))
    docs = spark.createDataFrame([(i, "some words of a text " * 500) for i in range(400)], "doc_id long, text string")
    model = X.packed(X.first_weights(np.random.default_rng(0)) | {"curve": np.array([1, 0], np.float32)})
    assert X.with_scores(docs, model).filter("score is not null").count() == 400
    assert given[0][-1] == X.PIECE <= 4 << 20
