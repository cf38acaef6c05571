import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tidewatch.llm import suffix_tree as S
from tidewatch.llm.words import LOWER, split_words


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(LOWER)))


def is_training(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 1


TEXTS = ["the cat sat on the mat", "the cat ran", "a cat sat on the hat and the cat sat on the mat", "Über the cat"] * 5


def tree_of(texts):
    found = S.stream(split_words(pa.array(texts), LOWER))
    codes, n = S.grams(found)
    pair = codes >> (8 * S.DEPTH) << 8 | codes & 255
    return S.subtree(codes, n, S.Roots.of(np.bincount(pair, n, 1 << 16), 1e-6)), found


def plain_tree(found):
    """Counts by context, and the contexts retained, by plain loops."""
    counts = {}
    for start, end in zip(found.starts, found.ends):
        for at in range(start, end):
            for depth in range(S.DEPTH + 1):
                counts.setdefault(bytes(found.symbols[at - depth : at]), Counter())[int(found.symbols[at])] += 1
    kept = set()
    for context in sorted(counts, key=len, reverse=True):
        own, up = counts[context], counts[context[1:]]
        total, up_total = sum(own.values()), sum(up.values())
        ratio = sum(n * math.log(n / total / (up[s] / up_total)) for s, n in own.items())
        longer = any(c[1:] == context for c in kept if len(c) == len(context) + 1)
        if len(context) <= 1 or longer or (total >= 2 and ratio >= S.DIVERGENCE * (len(own) + 1)):
            if total >= 2:
                kept.add(context)
    return counts, kept


def plain_p(counts, kept, context, symbol):
    while context not in kept:
        context = context[1:]
    own = counts[context]
    up = plain_p(counts, kept, context[1:], symbol) if context else 1 / 256
    return (own[symbol] + S.M * up) / (sum(own.values()) + S.M)


def test_probabilities_like_plain_loops():
    tree, found = tree_of(TEXTS)
    counts, kept = plain_tree(found)
    assert sum(len(level.contexts) for level in tree.levels) == sum(len(c) > 1 for c in kept) > 25
    words = S.stream(split_words(pa.array(["the cat sat by the mat", "", "zebra the", *TEXTS[:4]]), LOWER))
    got = S.read_symbols(words, tree)
    for start, end in zip(words.starts, words.ends):
        for at in range(start, end):
            p = plain_p(counts, kept, bytes(words.symbols[at - S.DEPTH : at]), int(words.symbols[at]))
            assert 10 ** float(got[at]) == pytest.approx(p, rel=1e-5)


def test_distributions_sum_to_one():
    tree, found = tree_of(TEXTS)
    contexts = np.unique(S.coded(found)[1] >> 8)
    codes = (contexts[:, None] << 8 | np.arange(256)).reshape(-1)
    assert np.allclose((10 ** tree.log_p(codes).astype(float)).reshape(-1, 256).sum(1), 1, atol=1e-4)


@pytest.mark.parametrize("frequent", [300_000, 3])
def test_counts_and_base_like_brute_force(hard_docs, frequent):
    rows = S.score_documents(hard_docs, frequent=frequent).collect()
    source = hard_docs.collect()
    assert len(rows) == len(source)
    counts = Counter()
    for r in source:
        if is_training(r.doc_id):
            counts.update([*tokens(r.text), b"\n"])
    n, whole = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = []
    for r in source:
        own = [*tokens(r.text), b"\n"]
        base = sum(math.log10((counts[t] + 0.5) / whole) for t in own)
        key = -1 if r.doc_id is None else r.doc_id
        want.append((key, not is_training(r.doc_id), len(own), sum(counts[t] > 0 for t in own), n, round(base, 4)))
    got = [
        (-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))
        for r in rows
    ]
    assert sorted(got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_table_of_frequent_words_does_not_change_scores(hard_docs):
    few, many = (S.score_documents(hard_docs, frequent=f).collect() for f in (3, 300_000))
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.score)
    for a, b in zip(sorted(few, key=key), sorted(many, key=key)):
        assert a.score == pytest.approx(b.score)


def test_empty_and_untrained(spark, no_docs):
    assert S.score_documents(no_docs).count() == 0
    held = next(i for i in range(100) if not is_training(i))
    docs = spark.createDataFrame([(held, "some words"), (held, None)], "doc_id long, text string")
    rows = S.score_documents(docs).collect()
    assert [r.n_known for r in rows] == [0, 0] and all(r.base_score == 0 for r in rows)
    assert all(math.isfinite(r.score) for r in rows)


def test_an_attested_context_stays_however_large_the_corpus(spark):
    rare = ["qaz"] * 60
    for others in (100, 4000):
        texts = rare + [" ".join(f"{i * 7919 % 9973:x} plain words" for i in range(j, j + 20)) for j in range(others)]
        docs = spark.createDataFrame([(2 * i, t) for i, t in enumerate(texts)], "id long, text string")
        after = S.count_words(docs, "text").filter("pair is not null").toArrow()
        n = np.bincount(after["pair"].to_numpy(), after["n"].to_numpy(), 1 << 16)
        roots = spark.sparkContext.broadcast(S.Roots.of(n, S.MIN_SHARE))
        rows = S.tree_rows(S.count_grams(docs), roots)
        context = int.from_bytes(b"aq", "big")  # newest first
        assert rows.filter(f"depth = 2 and not is_pair and code = {context}").count() == 1


@pytest.mark.parametrize("block, often", [(1 << 24, 500), (2000, 0)])
def test_a_tree_that_is_not_broadcast_gives_the_same_scores(hard_docs, monkeypatch, block, often):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "PER_TASK", 20_000)
    whole, joined = (S.score_documents(hard_docs, max_rows=m, frequent_grams=often).collect() for m in (10**9, -1))
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.score)
    assert len(whole) == len(joined) == hard_docs.count()
    for a, b in zip(sorted(whole, key=key), sorted(joined, key=key)):
        assert a[:5] == b[:5] and a.base_score == pytest.approx(b.base_score) and a.score == pytest.approx(b.score)


def test_pair_counts_from_the_different_words():
    texts = pa.array(["b a  b\tab", "", None, " \n", "Éa b", "a", "ab ab ab"])
    words = split_words(texts, LOWER)
    found = S.stream(words)
    at = S.places(found)
    wanted = np.bincount(found.symbols[at - 1].astype(np.int32) << 8 | found.symbols[at], minlength=1 << 16)
    times = np.bincount(words.ids, minlength=len(words.vocabulary))
    assert (S.pair_counts(words, times) == wanted).all()
    none = split_words(pa.array([None, ""], pa.string()), LOWER)
    assert S.pair_counts(none, np.zeros(len(none.vocabulary), np.int64)).nonzero()[0].tolist() == [S.END << 8 | S.END]


def test_grams_move_in_runs_of_one_ending(spark):
    texts = ["the cat sat on the mat while the dog ran " * 20, "Éa b", None, "z" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    rows = S.count_grams(docs, held_out=True).toArrow()
    found = S.grams(S.stream(split_words(pa.array(texts), LOWER)))[0]
    codes, sizes = rows["codes"].combine_chunks(), pc.list_value_length(rows["codes"]).to_numpy()
    assert sorted(codes.flatten().to_pylist()) == found.tolist()
    assert rows.num_rows < len(found) and sizes.max() <= S.RUN
    assert (np.repeat(rows["ending"].to_numpy(), sizes) == codes.flatten().to_numpy() >> 40).all()


def test_counts_of_known_words_are_looked_up_without_python_strings():
    known = S.Known(pa.array(["b", "", "é"], pa.large_string()), np.array([5, 7, 9, 0]))
    assert known.counts_of(pa.array(["é", "x", "b"], pa.large_string())).tolist() == [9, 0, 5]
    none = S.Known(pa.array([], pa.large_string()), np.array([0]))
    assert none.counts_of(pa.array(["a"], pa.large_string())).tolist() == [0]
