"""Quality rules: an ordered decision list, learned by sequential covering from labelled text statistics.

A rule is a conjunction of thresholds on shares such as repeated words or symbols. Rules for documents of low quality
are grown one after another on two thirds of the labelled rows: the condition with the highest information gain is added
until no good document is covered. A rule is then pruned on the other third, dropping its last conditions while that does
not lower (bad - good) / (bad + good), and taken if it still covers clearly more bad than good documents. Rows that a
rule covers leave both parts. The list becomes one conditional Spark expression, in order, with "keep" at the end.

Learning reads a bounded sample of labelled rows (MAX_ROWS in order of a hash of the id); statistics and verdicts cover
all rows and whole texts.

Null and empty texts have no words. Repeated rows get equal verdicts. Without labels of both kinds the list is empty and
keeps everything. Empty tables give empty results. Columns other than id, text and the label are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.words import add_column, encoded, free_name, large_text, split_words, struct_of, text_bytes, text_sums

MAX_ROWS = 20_000  # labelled rows that rules are learned from
SYMBOLS = b"#*$%&|<>"
THRESHOLDS = 64  # candidate thresholds of a feature
PIECE = 8 << 20  # bytes of text whose words are held at a time
MAX_RULES, MAX_CONDITIONS = 24, 5
LEAST = 0.6  # share of bad documents that a rule must cover on the pruning part

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks",
    "n_distinct", "n_bare", "n_bytes",
]
STATISTICS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def byte_counts(raw: np.ndarray, offsets: np.ndarray, wanted: bytes) -> np.ndarray:
    """How many bytes of each text are among ``wanted``."""
    table = np.zeros(256, np.uint8)
    table[list(wanted)] = 1
    return text_sums(table[raw], offsets[:-1], offsets[1:])


def repeats(ids: np.ndarray, owner: np.ndarray, size: int = 3) -> np.ndarray:
    """Which words lie in a window of ``size`` words that their text has twice or more."""
    out = np.zeros(len(ids), bool)
    if len(ids) < size:
        return out
    # number the windows of all texts one word at a time, so that equal numbers mean equal windows
    _, number = np.unique(ids, return_inverse=True)
    word = number.astype(np.int64)
    for step in range(1, size):
        _, number = np.unique(number[:-1].astype(np.int64) * (word.max() + 1) + word[step:], return_inverse=True)
    n = len(number)
    whole = owner[:n] == owner[size - 1 :]
    at = np.flatnonzero(whole)
    _, which, times = np.unique(owner[at] * np.int64(n + 1) + number[at], return_inverse=True, return_counts=True)
    found = at[times[which] > 1]
    for step in range(size):
        out[found + step] = True
    return out


def distinct_per_text(ids: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    pairs = np.unique(owner * np.int64(ids.max(initial=0) + 1) + ids)
    return np.bincount(pairs // (ids.max(initial=0) + 1), minlength=n_texts)


def statistics(texts: pa.Array) -> pa.StructArray:
    """The counts of each text."""
    texts = large_text(texts)
    raw, offsets = text_bytes(texts)
    n = len(texts)
    words = split_words(texts)
    owner = np.repeat(np.arange(n), words.counts)
    chars = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    bare = pc.invert(pc.match_substring_regex(words.vocabulary, r"[\pL\pN]")).to_numpy(zero_copy_only=False)
    lines = encoded(pc.split_pattern(texts, pattern="\n"))
    has_word = pc.match_substring_regex(lines.vocabulary, r"[^ \t-\r]").to_numpy(zero_copy_only=False)
    line_owner = np.repeat(np.arange(n), lines.counts)
    real = has_word[lines.ids] if len(lines.ids) else np.zeros(0, bool)
    n_lines = np.bincount(line_owner[real], minlength=n)
    n_different = distinct_per_text(lines.ids[real], line_owner[real], n)
    return struct_of(
        n_words=words.counts,
        word_chars=words.per_text(chars[words.ids]),
        n_symbols=byte_counts(raw, offsets, SYMBOLS),
        n_dup_lines=n_lines - n_different,
        n_repeat_words=words.per_text(repeats(words.ids, owner).astype(np.int64)),
        n_lines=n_lines,
        n_upper=byte_counts(raw, offsets, bytes(range(65, 91))),
        n_digits=byte_counts(raw, offsets, b"0123456789"),
        n_marks=byte_counts(raw, offsets, b"!?"),
        n_distinct=distinct_per_text(words.ids, owner, n),
        n_bare=words.per_text(bare.astype(np.int64)[words.ids]),
        n_bytes=np.diff(offsets),
    )


def with_statistics(docs: DataFrame, text: str, name: str, keep: list[str]) -> DataFrame:
    return add_column(docs, text, name, STATISTICS, lambda: lambda piece: statistics(piece.column(text)), keep, PIECE)


def share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def shares(s: Column) -> dict[str, Column]:
    """What rules may ask of a text, from its statistics."""
    return {
        "words": s["n_words"].cast("double"),
        "word_length": share(s["word_chars"], s["n_words"]),
        "symbols": share(s["n_symbols"], s["word_chars"]),
        "repeated_lines": share(s["n_dup_lines"], s["n_lines"]),
        "repeated_words": share(s["n_repeat_words"], s["n_words"]),
        "words_per_line": share(s["n_words"], s["n_lines"]),
        "capitals": share(s["n_upper"], s["word_chars"]),
        "digits": share(s["n_digits"], s["word_chars"]),
        "marks": share(s["n_marks"], s["n_words"]),
        "different_words": share(s["n_distinct"], s["n_words"]),
        "bare_words": share(s["n_bare"], s["n_words"]),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # else at or below
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, features: dict[str, Column]) -> Column:
        x = features[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covered(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(values)
    return out


def candidates(x: np.ndarray) -> np.ndarray:
    """Thresholds between different values, at quantiles when there are many."""
    values = np.unique(x)
    middles = (values[1:] + values[:-1]) / 2
    return middles if len(middles) <= THRESHOLDS else np.unique(np.quantile(x, np.linspace(0, 1, THRESHOLDS + 2)[1:-1]))


def grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition of highest gain until no good row is covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any() and (inside & bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        base = math.log2(p0 / (p0 + n0))
        best, gain = None, 0.0
        for name, x in values.items():
            own, own_bad = x[inside], bad[inside]
            for threshold in candidates(own):
                for above in (True, False):
                    hit = own > threshold if above else own <= threshold
                    p = (hit & own_bad).sum()
                    if p:
                        g = p * (math.log2(p / hit.sum()) - base)
                        if g > gain + 1e-12:
                            best, gain = Condition(name, above, float(threshold)), g
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(values)
    return rule


def worth(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = covered(rule, values, len(bad))
    p, n = (hit & bad).sum(), (hit & ~bad).sum()
    return float((p - n) / (p + n)) if p + n else -1.0


def learn(values: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray) -> list[Rule]:
    """The rules for bad rows, in order. ``prune`` marks the rows kept for pruning."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        g, q = left & ~prune, left & prune
        if not (g & bad).any() or not (g & ~bad).any():
            break
        rule = grow({k: v[g] for k, v in values.items()}, bad[g])
        part = {k: v[q] for k, v in values.items()}
        shorter = [rule[:i] for i in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda r: (worth(r, part, bad[q]), -len(r)), default=())
        if not rule or worth(rule, part, bad[q]) < 2 * LEAST - 1:
            break
        rules.append(rule)
        left &= ~covered(rule, values, len(bad))
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> DataFrame:
    """Shares of the bounded sample of labelled rows, with ``bad`` and ``prune``."""
    rows = labels.select(F.col(id).alias("id"), (F.col(label) == 0).alias("bad"))
    rows = rows.filter("id is not null and bad is not null").distinct()
    code = F.xxhash64("id")
    sample = rows.orderBy(code.asc(), "id", "bad").limit(MAX_ROWS)
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    # the sample has MAX_ROWS rows of two numbers at most
    found = with_statistics(texts.join(F.broadcast(sample), "id"), "text", "s", ["id", "bad"])
    columns = [c.alias(name) for name, c in shares(F.col("s")).items()]
    out = found.select(*columns, "bad", (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) == 0).alias("prune"))
    return out.orderBy(*out.columns).limit(2 * MAX_ROWS)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> list[Rule]:
    """The decision list. ``labels`` holds the rows that may be learned from (``label`` 0 is low quality)."""
    rows = training_rows(docs, labels, id, text, label).toArrow()
    values = {c: rows[c].to_numpy() for c in rows.column_names if c not in ("bad", "prune")}
    bad, prune = (rows[c].to_numpy().astype(bool) for c in ("bad", "prune"))
    return learn(values, bad, prune)


def keeps(rules: list[Rule], s: Column) -> Column:
    """The list as one conditional expression over statistics: false from the first rule that covers a text."""
    features = shares(s)
    out = None
    for rule in rules:
        test = rule[0].column(features)
        for condition in rule[1:]:
            test = test & condition.column(features)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_fails(s: Column) -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def judge(docs: DataFrame, rules: list[Rule], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, the statistics, ``base_failed`` and ``kept``."""
    s = F.col("s")
    found = with_statistics(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "s", ["id"])
    kept = ~base_fails(s) & keeps(rules, s)
    return found.select(F.col("id").alias(id), "s.*", base_fails(s).alias("base_failed"), kept.alias("kept"))


def drop_low_quality(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` without the documents that fail the base rule or the list."""
    name = free_name(docs.columns, "statistics")
    s = F.col(name)
    return with_statistics(docs, text, name, docs.columns).filter(~base_fails(s) & keeps(rules, s)).drop(name)
