"""Toxicity of texts from a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a step are a word's embedding (by hash) and the sum of the embeddings of its character n-grams (by hash), so
that inflections never seen in training are still read. Two gated recurrent units read a window of words from either
side; attention weights pool their states into one vector for a logistic output. Windows overlap by half and cover the
whole text; a text's logit is the largest of its windows, and a logistic curve fitted on training documents makes it a
score.

Training has labels of documents, not of windows. First, the log-odds of words and n-grams over the training documents
name the likely windows of toxic documents; later rounds take the windows that the network itself scores highest, for
toxic documents as positive, for others as negative examples, besides random ones.

Training reads a bounded sample of labelled rows (MAX_DOCS of either label in order of a hash of the id, each of at most
MAX_BYTES), in one task; scoring reads all rows.

Null texts and texts without words score as EMPTY. Repeated rows score alike. Without training rows of both labels every
score is the share of toxic ones among them (0 without any). Empty tables give empty results. Columns other than id,
text and the label are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.words import (
    ALPHANUMERIC,
    Words,
    add_column,
    free_name,
    large_text,
    released,
    split_words,
    text_bytes,
)

MAX_DOCS = 2500  # training documents of either label
MAX_BYTES = 16_000  # of a training document's text
WINDOW, STRIDE = 32, 16  # words
HIDDEN = 8  # of each direction
EMBED = 6  # of words and of n-grams
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 16
GRAMS = (3, 4, 5)  # bytes
ROUNDS, EPOCHS, BATCH, RATE = 3, 3, 256, 0.01
LANES = 2048  # windows scored at a time
DOCS_AT_ONCE = 100  # training documents whose n-grams are counted at a time
PIECE = 3 << 20  # bytes of text scored at a time
EMPTY = 0.0
EVIDENCE = 8.0  # documents that a feature needs for half its log-odds to count

Weights = dict[str, np.ndarray]


def hashed(code: np.ndarray, buckets: int) -> np.ndarray:
    mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % buckets


def features(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its bucket; and buckets of n-grams of all words with the word that each belongs to."""
    raw, offsets = text_bytes(large_text(vocabulary))
    n = len(vocabulary)
    lengths = np.diff(offsets)
    # a marker before each word, so that n-grams know its beginning
    data = np.insert(raw, offsets[:-1], 1).astype(np.uint64) if n else np.zeros(0, np.uint64)
    starts = offsets[:-1] + np.arange(n)
    word = np.repeat(np.arange(n), lengths + 1)
    left = np.repeat(starts + lengths + 1, lengths + 1) - np.arange(len(data))  # bytes from here to the word's end
    code = np.zeros(len(data), np.uint64)
    buckets, owners = [], []
    for size in range(1, max(GRAMS) + 1):
        code = code * np.uint64(257)
        code[: len(code) - size + 1] += data[size - 1 :]
        if size in GRAMS:
            at = np.flatnonzero(left >= size)
            buckets.append(hashed(code[at] + np.uint64(size), GRAM_BUCKETS))
            owners.append(word[at])
    # the hash of a word is the sum of its bytes' powers
    powers = np.ones(len(data), np.uint64)
    place = np.arange(len(data)) - np.repeat(starts, lengths + 1)
    for bit in range(int(place.max(initial=0)).bit_length()):
        powers[(place >> bit) & 1 == 1] *= np.uint64(pow(1_000_003, 1 << bit, 1 << 64))
    total = np.add.reduceat(data * powers, starts) if n else data
    return hashed(total, WORD_BUCKETS), np.concatenate(buckets), np.concatenate(owners)


def word_vectors(vocabulary: pa.Array, weights: Weights) -> np.ndarray:
    """Inputs of the network for each word of a vocabulary."""
    words, grams, owners = features(vocabulary)
    chars = np.zeros((len(words), EMBED), np.float32)
    order = np.argsort(owners, kind="stable")
    if len(order):
        begins = np.flatnonzero(np.diff(owners[order], prepend=-1))
        chars[owners[order][begins]] = np.add.reduceat(weights["gram"][grams[order]], begins, axis=0)
    return np.concatenate([weights["word"][words], chars], axis=1)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window over texts with so many words the text and its first word."""
    n = np.where(counts == 0, 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)))
    text = np.repeat(np.arange(len(counts)), n)
    return text, (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-np.clip(x, -30, 30)))


def read(inputs: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (step, window, unit) of a gated recurrent unit over its projected inputs (step, window, 3 units)."""
    steps, n, _ = inputs.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states, kept = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        hu = h @ u
        gates = sigmoid(inputs[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(inputs[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        step = mask[t] * (1 - z) * (new - h)
        if keep:
            kept.append((h, z, r, new, hu[:, 2 * HIDDEN :]))
        h = h + step
        states[t] = h
    return states, kept


def read_back(grad: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``u`` from those of the states."""
    steps, n, _ = grad.shape
    out, du = np.empty((steps, n, 3 * HIDDEN), np.float32), np.zeros_like(u)
    dh = np.zeros((n, HIDDEN), np.float32)
    for t in reversed(range(steps)):
        h, z, r, new, hu = kept[t]
        dh = dh + grad[t]
        through = dh * mask[t]
        dnew = through * (1 - z) * (1 - new * new)
        dz = through * (h - new) * z * (1 - z)
        dr = dnew * hu * r * (1 - r)
        out[t] = np.concatenate([dz, dr, dnew], axis=1)
        dhu = np.concatenate([dz, dr, dnew * r], axis=1)
        du += h.T @ dhu
        dh = dh * (1 - mask[t]) + through * z + dhu @ u.T
    return out, du


def forward(x: np.ndarray, mask: np.ndarray, weights: Weights, projected: bool = False, keep: bool = False):
    """Logits of windows. ``x`` (step, window, ...) holds inputs, or the projections of both directions."""
    if not projected:
        x = np.concatenate([x @ weights["w0"] + weights["b0"], x @ weights["w1"] + weights["b1"]], axis=2)
    ahead, kept0 = read(x[:, :, : 3 * HIDDEN], mask, weights["u0"], keep)
    back, kept1 = read(x[::-1, :, 3 * HIDDEN :], mask[::-1], weights["u1"], keep)
    states = np.concatenate([ahead, back[::-1]], axis=2)
    inner = np.tanh(states @ weights["a"])
    energy = inner @ weights["v"] + (mask[:, :, 0] - 1) * np.float32(1e4)
    share = np.exp(energy - energy.max(axis=0))
    share /= share.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", share, states)
    logits = pooled @ weights["o"] + weights["c"]
    return logits, (kept0, kept1, states, inner, share, pooled)


def backward(x: np.ndarray, mask: np.ndarray, weights: Weights, kept: tuple, dlogit: np.ndarray) -> Weights:
    """Gradients of all weights, and of the inputs under ``x``."""
    kept0, kept1, states, inner, share, pooled = kept
    grads: Weights = {"o": pooled.T @ dlogit, "c": np.asarray([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * weights["o"][None, :]
    dshare = np.einsum("nh,tnh->tn", dpooled, states)
    denergy = share * (dshare - (share * dshare).sum(axis=0))
    grads["v"] = np.einsum("tnk,tn->k", inner, denergy)
    dinner = denergy[:, :, None] * weights["v"] * (1 - inner * inner)
    grads["a"] = np.einsum("tnh,tnk->hk", states, dinner)
    dstates = share[:, :, None] * dpooled[None] + dinner @ weights["a"].T
    d0, grads["u0"] = read_back(dstates[:, :, :HIDDEN], mask, weights["u0"], kept0)
    d1, grads["u1"] = read_back(dstates[::-1, :, HIDDEN:], mask[::-1], weights["u1"], kept1)
    d1 = d1[::-1]
    grads["x"] = np.zeros_like(x)
    for name, d in (("0", d0), ("1", d1)):
        grads["w" + name] = np.einsum("tnd,tng->dg", x, d)
        grads["b" + name] = d.sum(axis=(0, 1))
        grads["x"] += d @ weights["w" + name].T
    return grads


def first_weights(rng: np.random.Generator) -> Weights:
    def some(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    d, both = 2 * EMBED, 2 * HIDDEN
    weights = {"u0": some(HIDDEN, 3 * HIDDEN), "u1": some(HIDDEN, 3 * HIDDEN), "w0": some(d, 3 * HIDDEN)}
    weights |= {"w1": some(d, 3 * HIDDEN), "a": some(both, HIDDEN), "v": some(HIDDEN), "o": some(both)}
    weights |= {"b0": np.zeros(3 * HIDDEN, np.float32), "b1": np.zeros(3 * HIDDEN, np.float32)}
    weights["word"] = rng.normal(0, 0.05, (WORD_BUCKETS, EMBED)).astype(np.float32)
    weights["gram"] = rng.normal(0, 0.05, (GRAM_BUCKETS, EMBED)).astype(np.float32)
    return weights | {"c": np.zeros(1, np.float32)}


def document_counts(doc: np.ndarray, feature: np.ndarray, buckets: int, toxic: np.ndarray) -> np.ndarray:
    """In how many toxic documents, and in how many documents, each feature occurs."""
    pairs = np.unique(doc * buckets + feature)
    doc, feature = pairs // buckets, pairs % buckets
    return np.stack([np.bincount(feature[toxic[doc]], minlength=buckets), np.bincount(feature, minlength=buckets)])


def log_odds(counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-odds of a toxic document given that it has a feature, drawn to 0 where few documents have it."""
    yes, all_ = counts
    p, q = (yes + 0.5) / (toxic.sum() + 1), (all_ - yes + 0.5) / ((~toxic).sum() + 1)
    return np.clip(np.log(p / q) * all_ / (all_ + EVIDENCE), -4, 4).astype(np.float32)


class Corpus:
    """Training texts as word numbers, with their windows."""

    def __init__(self, texts: pa.Array, toxic: np.ndarray) -> None:
        self.words: Words = split_words(texts, ALPHANUMERIC)
        self.toxic = toxic
        self.bucket, grams, owners = features(self.words.vocabulary)
        order = np.argsort(owners, kind="stable")
        self.grams, counts = grams[order], np.bincount(owners, minlength=len(self.bucket))
        self.gram_ends = np.cumsum(counts)
        self.gram_counts = counts
        self.doc, first = windows(self.words.counts)
        self.place = self.words.starts[self.doc] + first
        self.size = np.minimum(WINDOW, self.words.ends[self.doc] - self.place)

    def word_numbers(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (step, window) of windows and the mask of steps within the text."""
        step = np.arange(WINDOW)[:, None]
        mask = step < self.size[rows][None, :]
        at = np.where(mask, self.place[rows][None, :] + step, 0)
        return self.words.ids[at], mask[:, :, None].astype(np.float32)

    def grams_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the n-grams of some words, and for each the position of its word in ``numbers``."""
        counts = self.gram_counts[numbers]
        inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.grams[np.repeat(self.gram_ends[numbers] - counts, counts) + inside], np.repeat(np.arange(len(numbers)), counts)

    def first_odds(self, weights: Weights) -> np.ndarray:
        """Put log-odds into the embeddings' first places; the largest evidence of a word in each window."""
        owner = np.repeat(np.arange(len(self.words.ends)), self.words.counts)
        counts = document_counts(owner, self.bucket[self.words.ids], WORD_BUCKETS, self.toxic)
        weights["word"][:, 0] = log_odds(counts, self.toxic)
        pairs = np.unique(owner * len(self.bucket) + self.words.ids)
        docs, numbers = pairs // len(self.bucket), pairs % len(self.bucket)
        counts = np.zeros((2, GRAM_BUCKETS), np.int64)
        for first in range(0, len(self.toxic), DOCS_AT_ONCE):  # each different word of a document has many n-grams
            a, b = np.searchsorted(docs, [first, first + DOCS_AT_ONCE])
            grams, at = self.grams_of(numbers[a:b])
            counts += document_counts(docs[a:b][at], grams, GRAM_BUCKETS, self.toxic)
        weights["gram"][:, 0] = log_odds(counts, self.toxic)
        per_word = word_vectors(self.words.vocabulary, weights)[:, [0, EMBED]].sum(axis=1)
        numbers, mask = self.word_numbers(np.arange(len(self.doc)))
        return np.where(mask[:, :, 0] > 0, per_word[numbers], -99).max(axis=0)

    def logits(self, weights: Weights) -> np.ndarray:
        return window_logits(self.words, self.place, self.size, weights)


def window_logits(words: Words, place: np.ndarray, size: np.ndarray, weights: Weights) -> np.ndarray:
    """Logits of windows of some texts. Words are projected once for each vocabulary."""
    vectors = word_vectors(words.vocabulary, weights)
    ready = np.concatenate([vectors @ weights[f"w{k}"] + weights[f"b{k}"] for k in "01"], axis=1)
    out = np.empty(len(place), np.float32)
    step = np.arange(WINDOW)[:, None]
    for at in range(0, len(place), LANES):
        own, n = place[at : at + LANES], size[at : at + LANES]
        steps = int(n.max())
        mask = step[:steps] < n[None, :]
        numbers = words.ids[np.where(mask, own[None, :] + step[:steps], own[None, :])]
        out[at : at + LANES], _ = forward(ready[numbers], mask[:, :, None].astype(np.float32), weights, True)
    return out


def highest(values: np.ndarray, doc: np.ndarray, per_doc: int) -> np.ndarray:
    """The rows with the highest values of each document."""
    order = np.lexsort((-values, doc))
    rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    return order[rank < per_doc]


def train(texts: pa.Array, toxic: np.ndarray, seed: int = 7) -> Weights:
    """Weights of the network and of the final logistic curve (``curve``)."""
    rng = np.random.default_rng(seed)
    corpus = Corpus(texts, toxic)
    weights = first_weights(rng)
    value = corpus.first_odds(weights)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items() if k not in ("word", "gram")}
    squares = {k: np.full(len(weights[k]), 1e-3, np.float32) for k in ("word", "gram")}
    is_toxic = toxic[corpus.doc]
    t = 0
    for _ in range(ROUNDS):
        top = highest(value, corpus.doc, 1)
        positive = top[is_toxic[top]]
        hard = top[~is_toxic[top]]
        random = rng.choice(np.flatnonzero(~is_toxic), min(2 * len(top), int((~is_toxic).sum())), replace=False)
        rows = np.concatenate([positive, hard, random])
        balance = np.where(is_toxic[rows], len(rows) / (2 * max(1, len(positive))), len(rows) / (2 * max(1, len(rows) - len(positive))))
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                pick = order[at : at + BATCH]
                t += 1
                learn(corpus, rows[pick], balance[pick].astype(np.float32), weights, moments, squares, t)
        value = corpus.logits(weights)
    best = np.full(len(toxic), np.nan)
    top = highest(value, corpus.doc, 1)
    best[corpus.doc[top]] = value[top]
    seen = ~np.isnan(best)
    weights["curve"] = logistic(best[seen], toxic[seen].astype(float))
    return weights


def learn(corpus, rows, balance, weights, moments, squares, t) -> None:
    """One step of Adam for the network, of Adagrad for the embeddings that occur."""
    numbers, mask = corpus.word_numbers(rows)
    distinct, at = np.unique(numbers, return_inverse=True)
    at = at.reshape(numbers.shape)
    grams, owner = corpus.grams_of(distinct)
    chars = np.zeros((len(distinct), EMBED), np.float32)
    np.add.at(chars, owner, weights["gram"][grams])
    x = np.concatenate([weights["word"][corpus.bucket[distinct]], chars], axis=1)[at]
    logits, kept = forward(x, mask, weights, keep=True)
    target = corpus.toxic[corpus.doc[rows]].astype(np.float32)
    grads = backward(x, mask, weights, kept, (sigmoid(logits) - target) * balance / np.float32(len(rows)))
    dx = np.zeros((len(distinct), 2 * EMBED), np.float32)
    np.add.at(dx, at.reshape(-1), (grads.pop("x") * mask).reshape(-1, 2 * EMBED))
    for name, g in grads.items():
        m, s = moments[name]
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        weights[name] -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    for name, bucket, g in (("word", corpus.bucket[distinct], dx[:, :EMBED]), ("gram", grams, dx[owner, EMBED:])):
        np.add.at(squares[name], bucket, (g * g).mean(axis=1))
        np.add.at(weights[name], bucket, -RATE * g / np.sqrt(squares[name][bucket])[:, None])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic curve through (x, y), by Newton steps with a weak prior."""
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        w = p * (1 - p)
        g = np.array([((y - p) * x).sum() - 1e-2 * (slope - 1), (y - p).sum() - 1e-2 * offset])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = slope + move[0], offset + move[1]
        if abs(move).max() < 1e-6:
            break
    return np.array([max(slope, 1e-3), offset], np.float32)


def score_texts(texts: pa.Array, weights: Weights) -> np.ndarray:
    words = split_words(texts, ALPHANUMERIC)
    if "share" in weights:
        return np.full(len(words.ends), float(weights["share"][0]))
    doc, first = windows(words.counts)
    place = words.starts[doc] + first
    logits = window_logits(words, place, np.minimum(WINDOW, words.ends[doc] - place), weights)
    best = np.full(len(words.ends), -np.inf)
    np.maximum.at(best, doc, logits)
    slope, offset = weights["curve"].astype(float)
    with np.errstate(over="ignore"):
        return np.where(words.counts == 0, EMPTY, 1 / (1 + np.exp(-(slope * best + offset))))


def packed(weights: Weights) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **weights)
    return out.getvalue()


def unpacked(data: bytes) -> Weights:
    with np.load(io.BytesIO(data)) as found:
        return dict(found)


def training_rows(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> DataFrame:
    """The bounded sample: ``text``, ``toxic``."""
    rows = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("toxic")).filter("id is not null")
    order = [F.xxhash64("id").asc(), F.col("id").asc()]
    sample = [rows.filter(F.col("toxic") == k).distinct().orderBy(*order).limit(MAX_DOCS) for k in (0, 1)]
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(F.octet_length("text") <= MAX_BYTES)
    # the sample has 2 * MAX_DOCS rows of two numbers at most
    found = texts.join(F.broadcast(sample[0].union(sample[1])), "id")
    return found.orderBy(*order, "text").limit(2 * MAX_DOCS).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> bytes:
    """The trained network. ``labels`` holds the rows that may be learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("toxic", pa.int32())]))
        toxic = found["toxic"].to_numpy() == 1
        both = toxic.any() and not toxic.all()
        weights = train(found["text"].combine_chunks(), toxic) if both else {"share": np.array([toxic.mean() if len(toxic) else 0.0])}
        yield pa.RecordBatch.from_pydict({"model": [packed(weights)]})

    rows = training_rows(docs, labels, id, text, label).coalesce(1)
    found = rows.mapInArrow(released(run), "model binary").first()  # nothing where Spark knows that there are no rows
    return found["model"] if found else packed({"share": np.zeros(1)})


def with_scores(docs: DataFrame, model: bytes, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds the score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        weights = unpacked(shared.value)

        return lambda piece: pa.array(score_texts(large_text(piece.column(text)), weights))

    return add_column(docs, text, name, T.DoubleType(), start, keep, PIECE)


def drop_toxic(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` without the texts that score 0.5 or more."""
    name = free_name(docs.columns, "score")
    return with_scores(docs, model, text, name).filter(F.col(name) < 0.5).drop(name)
