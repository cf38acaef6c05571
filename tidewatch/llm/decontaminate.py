"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The automaton takes every substring of every item. Streaming a document's words through it gives at each word the length
of the longest match that ends there. Where that length reaches the window (13 words; a shorter item is a window as a
whole), the words of the window are hit. Matched spans are removed from a document, or the document is dropped, when
they exceed a length or a share of its words.

The benchmark is cut into blocks of bounded size; each block's automaton is broadcast and run over all documents, so a
larger benchmark takes more passes and not more memory. A word pair that no item has ends every match, so only runs of
known pairs, found for a whole piece of text at once, are streamed word by word.

Documents: null and empty texts have no words and are not contaminated; repeated rows are judged one by one; extra
columns are left alone. Items: null and empty texts have no window; rows that share an item id are one item with the
windows of all its rows; a null id counts as the id "null". An empty table on either side gives no hits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.store import written
from tidewatch.llm.words import ALPHANUMERIC, Words, add_column, free_name, split_words, struct_of

WINDOW = 13  # words
BLOCK_BYTES = 8 << 20  # of benchmark text in one automaton
PAIR_BITS = 22
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("longest_match", T.LongType()),
        T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class Automaton:
    """Generalised suffix automaton over the word numbers of a block of items."""

    def __init__(self, item_ids: list[str], texts: list[str | None], window: int) -> None:
        words = split_words(pa.array(texts, pa.string()), ALPHANUMERIC)
        self.window = window
        self.number = {w: i for i, w in enumerate(words.vocabulary.to_pylist(), 1)}  # 0 is any other word
        items = [words.ids[a:b] + 1 for a, b in zip(words.starts, words.ends)]
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for item in items:
            self._insert(item.tolist())
        self.owners: dict[int, set[str]] = {}  # state that holds a whole window: items with the window
        self.short: dict[int, list[tuple[int, str]]] = {}  # state: items that end there as a whole, and their lengths
        pairs = np.zeros(1 << PAIR_BITS, bool)
        self.least = 1 << 30  # words of the smallest window
        for name, item in zip(item_ids, items):
            if not len(item):
                continue
            pairs[self.pair_slot(item[:-1], item[1:])] = True
            self.least = min(self.least, len(item), window)
            state = 0
            for i, word in enumerate(item.tolist(), 1):
                state = self.step[state][word]
                if i >= window:
                    self.owners.setdefault(self.suffix_state(state, window), set()).add(name)
            if len(item) < window:
                self.short.setdefault(self.suffix_state(state, len(item)), []).append((len(item), name))
        self.pairs = pairs
        # the nearest state on the way of suffixes, itself included, where a short item ends
        self.short_at = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short_at[state] = state if state in self.short else self.short_at[self.link[state]]
        self.window_at = [
            self.suffix_state(s, window) if n >= window else -1 for s, n in enumerate(self.length)
        ]

    def _insert(self, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _extend(self, last: int, word: int) -> int:
        step, link, length = self.step, self.link, self.length
        known = step[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, known, word)
        state = len(link)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = state
            at = link[at]
        if at >= 0:
            target = step[at][word]
            link[state] = target if length[target] == length[at] + 1 else self._split(at, target, word)
        return state

    def _split(self, at: int, target: int, word: int) -> int:
        """A copy of ``target`` for the strings that end in the longest string of ``at`` and ``word``."""
        step, link, length = self.step, self.link, self.length
        copy = len(link)
        step.append(dict(step[target]))
        link.append(link[target])
        length.append(length[at] + 1)
        link[target] = copy
        while at >= 0 and step[at].get(word) == target:
            step[at][word] = copy
            at = link[at]
        return copy

    def suffix_state(self, state: int, length: int) -> int:
        """The state of the suffix of that length of the strings in ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    @staticmethod
    def pair_slot(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
        return (mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - PAIR_BITS)

    def matches(self, words: list[int]) -> tuple[list[int], list[int], list[tuple[int, int]], set[str]]:
        """For a run of words: longest match that ends at each, the spans of hit words, and the items."""
        step, link, length = self.step, self.link, self.length
        state, matched, longest, spans, items = 0, 0, [], [], set()
        for i, word in enumerate(words, 1):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            state = step[state].get(word, 0)
            matched = matched + 1 if state else 0
            longest.append(matched)
            if matched >= self.window:
                at = self.window_at[state]
                if at in self.owners:
                    items |= self.owners[at]
                    spans.append((i - self.window, i))
            at = self.short_at[state]
            while at > 0:
                for size, name in self.short[at]:
                    if size <= matched:
                        items.add(name)
                        spans.append((i - size, i))
                at = self.short_at[link[at]]
        return longest, spans, items

    def scan(self, words: Words) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Of each text the longest match, the spans of hit words (united, in order) and the items found."""
        known = [self.number.get(w, 0) for w in words.vocabulary.to_pylist()]
        ids = np.asarray(known, np.int64)[words.ids] if known else np.zeros(0, np.int64)
        starts = words.starts
        owner = np.repeat(np.arange(len(starts)), words.counts)
        # runs of words in which each neighbouring pair stands in some item
        joined = np.zeros(len(ids) + 1, bool)  # at i: word i goes on from word i - 1
        if len(ids) > 1:
            joined[1:-1] = (ids[:-1] > 0) & (ids[1:] > 0) & (owner[1:] == owner[:-1])
            at = np.flatnonzero(joined)
            joined[at] = self.pairs[self.pair_slot(ids[at - 1], ids[at])]
        begins = np.flatnonzero((ids > 0) & ~joined[:-1])
        ends = np.flatnonzero((ids > 0) & ~joined[1:]) + 1
        longest = np.zeros(len(starts), np.int64)
        enough = ends - begins >= min(self.least, self.window)
        spans: list[list[tuple[int, int]]] = [[] for _ in starts]
        items: list[set[str]] = [set() for _ in starts]
        for begin, end in zip(begins[enough].tolist(), ends[enough].tolist()):
            doc = owner[begin]
            lengths, hits, names = self.matches(ids[begin:end].tolist())
            longest[doc] = max(longest[doc], max(lengths))
            if hits:
                offset = begin - int(starts[doc])
                items[doc] |= names
                spans[doc] += [(a + offset, b + offset) for a, b in hits]
        return longest, [united(s) for s in spans], items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, id: str, text: str, block_bytes: int) -> Iterator[tuple[list[str], list[str | None]]]:
    """Ids and texts of the items, a block of about ``block_bytes`` of text at a time."""
    rows = items.select(F.coalesce(F.col(id).cast("string"), F.lit("null")).alias("id"), F.col(text).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for b in range(n):
        part = rows.filter(block == b).orderBy("id", "text").toArrow()
        yield part["id"].to_pylist(), part["text"].to_pylist()


def find_matches(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
    name: str = "found",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with a struct ``name``: ``n_words``, ``longest_match``
    (words of the longest substring of an item, 0 where that is shorter than every window), ``spans`` of hit words
    (from, to before) and ``items`` with windows in the text, sorted as strings."""
    keep = docs.columns if keep is None else keep
    context = docs.sparkSession.sparkContext
    out, before = docs.select(*dict.fromkeys([*keep, text])), None
    for ids, texts in blocks(items, item_id, item_text, block_bytes):
        model = context.broadcast(Automaton(ids, texts, window))
        if before:
            out = written(out)
        found = free_name(out.columns, name)
        columns = [c for c in out.columns if c != before]
        out, before = add_column(out, text, found, FOUND, scanner(model, text, before), columns), found
    out = out.select(*keep, before)
    return out if before == name else out.withColumnRenamed(before, free_name(keep, name))


def scanner(model: Broadcast, text: str, before: str | None):
    """Scans pieces with one block's automaton and adds to what earlier blocks found."""

    def start():
        automaton = model.value

        def scan(piece: pa.RecordBatch) -> pa.Array:
            words = split_words(piece.column(text), ALPHANUMERIC)
            longest, spans, items = automaton.scan(words)
            if before:
                for i, row in enumerate(piece.column(before).to_pylist()):
                    longest[i] = max(longest[i], row["longest_match"])
                    spans[i] = united(spans[i] + [(s["start"], s["end"]) for s in row["spans"]])
                    items[i] |= set(row["items"])
            rows = [[{"start": a, "end": b} for a, b in s] for s in spans]
            return struct_of(
                n_words=words.counts,
                longest_match=longest,
                spans=pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                items=pa.array([sorted(names) for names in items], pa.list_(pa.string())),
            )

        return scan

    return start


def hit_words(spans: Column) -> Column:
    """Number of words in the spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(found: Column, one_in: int = 20) -> Column:
    """Whether at least one in so many words is hit."""
    n_hit = hit_words(found["spans"])
    return (n_hit > 0) & (n_hit * one_in >= found["n_words"])


def cut_spans(docs: DataFrame, spans: str, text: str = "text", longest: int = 0) -> DataFrame:
    """``text`` without the spans (in words, as found in this text) of more than ``longest`` words.

    What stands between the words of a span goes with them; other texts stay as they are, null stays null.
    """

    def start():
        def cut(piece: pa.RecordBatch) -> pa.Array:
            out = piece.column(text).to_pylist()
            for i, some in enumerate(piece.column(spans).to_pylist()):
                some = [s for s in some or [] if s["end"] - s["start"] > longest]
                if some:
                    places = [m.span() for m in WORD.finditer(out[i])]
                    kept, at = [], 0
                    for s in some:
                        kept.append(out[i][at : places[s["start"]][0]])
                        at = places[s["end"] - 1][1]
                    out[i] = "".join([*kept, out[i][at:]])
            return pa.array(out, pa.string())

        return cut

    made = free_name(docs.columns, "cut")
    out = add_column(docs, text, made, T.StringType(), start)
    return out.select(*[F.col(made).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    one_in: int = 20,
    longest_span: int | None = None,
) -> DataFrame:
    """``docs`` without the documents in which one in so many words is hit; with ``longest_span``, spans of more words
    than that are cut from the documents that stay."""
    name = free_name(docs.columns, "found")
    found = find_matches(docs, items, text, item_id, item_text, window, name=name)
    clean = found.filter(~is_contaminated(F.col(name), one_in))
    if longest_span is not None:
        spans = free_name(clean.columns, "spans")
        clean = cut_spans(clean.withColumn(spans, F.col(name)["spans"]).drop(name), spans, text, longest_span)
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
