"""Language-model scores from a probabilistic suffix tree over the symbols of words.

Texts are read as symbols: the bytes of each word (ASCII letters in lower case) and a blank after it, then a line feed as
the end. The tree keeps contexts of up to DEPTH symbols. A context is a candidate from MIN_COUNT occurrences in training
on (from MIN_SHARE of the positions, if that is less), and is retained if its next-symbol distribution diverges from that
of its parent (the context without its oldest symbol) by a likelihood-ratio test, or if a longer context with it as parent
is retained; candidates of one symbol always are. Distributions are smoothed into the parent's:
P(s|c) = (n(c,s) + M P(s|parent)) / (n(c) + M), which for unseen symbols is M / (n(c) + M) of the parent's.
The tree's probability of spelling a token from the longest suffix state on is mixed with the token's training
frequency; both are distributions over tokens, so the mixture is one too.

All training positions are counted. The different grams of each task move once, by the two newest symbols of their
context; so a task has all contexts that end in these, adds their grams up, derives the shorter contexts' counts from
them, tests and smooths. Contexts of one symbol need a table of 65,536 counts, made along with the word counts. What is
written is the retained tree: a row for each context and for each symbol seen after it. The tree has no greatest size. Up
to MAX_ROWS rows it is broadcast as sorted arrays (12 bytes a row). A larger one is never gathered: the same tasks give the
probability of each different gram of the corpus; those of frequent grams are broadcast (a bounded table), and a block of
about BLOCK bytes of text is scored beside those of its other grams. Both ways give the same scores.

The base score needs the exact count of every word. Counts of frequent words are broadcast (a bounded table); the others
are joined by word with the few occurrences that the table lacks.

Null and empty texts are the end alone. Repeated rows count and score each. Without training rows all distributions are
uniform over the 256 byte values. Null ids are never held out. An empty table gives an empty table. Columns other than
id and text are not read.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.llm.store import least_count, written
from tidewatch.llm.words import LOWER, Words, large_text, pieces, released, split_words, text_bytes, text_sums

DEPTH = 6  # symbols of the longest context; `coded` puts four and two together
MIN_COUNT = 32  # occurrences from which on a context is a candidate on every corpus
MIN_SHARE = 2e-6  # of the training positions, where that is less than MIN_COUNT
MAX_ROWS = 6_000_000  # of a tree that is broadcast, 72 MB
PER_TASK = 8 << 20  # training positions whose grams one task puts together, about
M = 16.0  # weight of the parent's distribution
DIVERGENCE = 2.0  # of the log-likelihood ratio, for each stored symbol of a context
FREQUENCY = 0.2  # weight of a token's training frequency beside its spelling
END, BLANK = 10, 32
FREQUENT = 300_000  # words whose counts are broadcast
LONGEST = 64  # bytes of such a word
PIECE = 3 << 20  # bytes of text at a time
RUN = 128  # grams that move as one row at most, which bounds an Arrow batch of 10,000 rows to 20 MB
HELD = 3_000_000  # grams that a task holds, different within each piece, before it adds them up and reports
FREQUENT_GRAMS = 1_500_000  # whose probabilities are broadcast, about 18 MB
BLOCK = 8 << 20  # bytes of text that are scored beside the probabilities of their grams
BLOCK_PIECE = 2 << 20  # bytes of a block's text at a time
ROW = 64  # bytes that a row counts besides its text


@dataclass
class Stream:
    """The symbols of all texts, each text after DEPTH ends."""

    symbols: np.ndarray
    starts: np.ndarray  # of each text's own symbols
    ends: np.ndarray


def stream(words: Words) -> Stream:
    nothing, blank = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    row = pc.binary_join_element_wise(words.vocabulary.take(pa.array(words.ids)), nothing, blank)
    raw, offsets = text_bytes(large_text(row))
    sizes = offsets[words.ends] - offsets[words.starts] + 1  # the end is a symbol
    ends = np.cumsum(sizes + DEPTH)
    starts = ends - sizes
    symbols = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint8)
    own = np.zeros(len(symbols) + 1, np.int8)
    np.add.at(own, starts, 1)
    np.add.at(own, ends - 1, -1)
    symbols[np.cumsum(own[:-1], dtype=np.int8).astype(bool)] = raw
    return Stream(symbols, starts, ends)


def places(found: Stream) -> np.ndarray:
    """The places of the texts' own symbols."""
    inside = np.zeros(len(found.symbols) + 1, np.int8)
    np.add.at(inside, found.starts, 1)
    np.add.at(inside, found.ends, -1)
    return np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))


def coded(found: Stream) -> tuple[np.ndarray, np.ndarray]:
    """The places of the texts' own symbols, and the gram at each: its context from the newest symbol to the oldest, then
    the symbol, as a number of 8 * (DEPTH + 1) bits."""
    at = places(found)
    symbols = found.symbols
    two, four = (np.zeros(len(symbols), kind) for kind in (np.uint16, np.uint32))  # newest symbols up to each place
    two[1:] = symbols[1:].astype(np.uint16) << 8 | symbols[:-1]
    four[3:] = two[3:].astype(np.uint32) << 16 | two[1:-2]
    code = four[at - 1].astype(np.int64) << 16 | two[at - 5]
    return at, code << 8 | symbols[at]


def grams(found: Stream) -> tuple[np.ndarray, np.ndarray]:
    """The different grams and their counts."""
    return np.unique(coded(found)[1], return_counts=True)


def pair_counts(words: Words, times: np.ndarray) -> np.ndarray:
    """How often each symbol follows each other one (number of that << 8 | symbol) in the texts, from the different words
    and how often each occurs. A word stands between blanks, but for the ends before and after each text."""
    nothing, blank = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    raw, offsets = text_bytes(large_text(pc.binary_join_element_wise(words.vocabulary, nothing, blank)))
    before = np.concatenate([np.array([BLANK], np.uint8), raw])[:-1].astype(np.int32)
    n = np.bincount(before << 8 | raw, np.repeat(times, np.diff(offsets)), 1 << 16).astype(np.int64)
    some = words.counts > 0
    first = raw[offsets[:-1]][words.ids[words.starts[some]]].astype(np.int32)
    n += np.bincount(END << 8 | first, minlength=1 << 16) - np.bincount(BLANK << 8 | first, minlength=1 << 16)
    n[BLANK << 8 | END] += some.sum()
    n[END << 8 | END] += (~some).sum()
    return n


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """Counts of all words of the texts (``word``, ``n``), and of all symbols after the one before (``pair``, ``n``); each
    piece of a task is added up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                words = split_words(piece.column(text), LOWER)
                times = np.bincount(words.ids, minlength=len(words.vocabulary))
                some = np.flatnonzero(times)
                names = words.vocabulary.take(pa.array(some)).cast(pa.string())
                yield reported(names, pa.nulls(len(some), pa.int32()), times[some])
                times = pair_counts(words, times)
                some = np.flatnonzero(times)
                yield reported(pa.nulls(len(some), pa.string()), pa.array(some, pa.int32()), times[some])

    def reported(names: pa.Array, pairs: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names, pairs, pa.array(n.astype(np.int64))], names=["word", "pair", "n"])

    counted = docs.select(text).mapInArrow(released(count), "word string, pair int, n long")
    return counted.groupBy("word", "pair").agg(F.sum("n").alias("n"))


def in_blocks(docs: DataFrame) -> DataFrame:
    """``id`` and ``text`` of the rows and the ``block`` of each, about BLOCK bytes of text."""
    kind = f"block long, id {docs.schema['id'].dataType.simpleString()}, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 16, 0
        for batch in batches:
            for piece in pieces(batch, "text", BLOCK_PIECE):
                if held >= BLOCK:
                    block, held = block + 1, 0
                held += ROW * len(piece) + (pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0)
                numbers = pa.array(np.full(len(piece), block, np.int64))
                yield pa.RecordBatch.from_arrays([numbers, *piece.columns], names=["block", "id", "text"])

    return docs.select("id", "text").mapInArrow(released(cut), kind)


def count_grams(docs: DataFrame, held_out: bool = False) -> DataFrame:
    """The different grams of each task's texts (``codes``) and how often they occur in training (``n``), HELD at a time;
    with ``held_out`` also those that occur elsewhere only. A row is a run of grams whose contexts end in the same two
    symbols (``ending``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                text, training = piece.column("text"), piece.column("training")
                held.append(grams(stream(split_words(text.filter(training), LOWER))))
                if held_out:
                    other = grams(stream(split_words(text.filter(pc.invert(training)), LOWER)))[0]
                    held.append((other, np.zeros(len(other), np.int64)))
                if sum(len(codes) for codes, _ in held) > HELD:
                    yield reported(*added_up(*map(np.concatenate, zip(*held))))
                    held.clear()
        if held:
            yield reported(*added_up(*map(np.concatenate, zip(*held))))

    def reported(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ending = codes >> (8 * (DEPTH - 1))
        first = np.flatnonzero(np.diff(ending, prepend=-1))
        inside = np.arange(len(codes)) - np.repeat(first, np.diff(first, append=len(codes)))
        first = np.flatnonzero(inside % RUN == 0)
        bounds = pa.array(np.append(first, len(codes)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(values)) for values in (codes, n)]
        return pa.RecordBatch.from_arrays([pa.array(ending[first]), *lists], names=["ending", "codes", "n"])

    marked = docs.select("text", is_training(F.col("id")).alias("training"))
    marked = marked if held_out else marked.filter("training")
    return marked.mapInArrow(released(count), "ending long, codes array<long>, n array<long>")


def added_up(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in order, and the sums of their counts."""
    different, at = np.unique(codes, return_inverse=True)
    return different, np.bincount(at, n, len(different)).astype(np.int64)


def block_grams(blocks: DataFrame, hot: Broadcast) -> DataFrame:
    """The different grams of each block that the broadcast table lacks (``of_block``, ``code``)."""

    def list_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, codes = None, np.zeros(0, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text", BLOCK_PIECE):
                numbers = piece.column("block").to_numpy()
                for block in np.unique(numbers):
                    if block != last and len(codes):
                        yield reported(last, codes)
                        codes = codes[:0]
                    last = block
                    own = piece.column("text").filter(pa.array(numbers == block))
                    found = pa.array(grams(stream(split_words(own, LOWER)))[0])
                    rare = found.filter(pc.invert(pc.is_in(found, pa.array(hot.value[0]))))
                    codes = np.union1d(codes, rare.to_numpy())
        if len(codes):
            yield reported(last, codes)

    def reported(block: int, codes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block)), pa.array(codes)], names=["of_block", "code"])

    return blocks.select("block", "text").mapInArrow(released(list_grams), "of_block long, code long")


@dataclass
class Roots:
    """Counts and smoothed probabilities of each symbol after each one symbol (number of that << 8 | symbol)."""

    n: np.ndarray
    p: np.ndarray
    least: int  # occurrences from which on a context is a candidate

    @staticmethod
    def of(n: np.ndarray, min_share: float) -> Roots:
        n = n.reshape(256, 256).astype(np.float64)
        least = max(2, min(MIN_COUNT, int(min_share * n.sum())))
        p0 = (n.sum(0) + M / 256) / (n.sum() + M)
        all_ = n.sum(1, keepdims=True)
        p1 = np.where(all_ >= least, (n + M * p0) / (all_ + M), p0)
        return Roots(n.reshape(-1), p1.reshape(-1), least)


@dataclass
class Level:
    """Retained contexts of one depth (newest symbol first) and the symbols seen after them, in order."""

    contexts: np.ndarray
    unseen: np.ndarray  # log10 of the part of the parent's probability that symbols without a row get
    pairs: np.ndarray  # context << 8 | symbol
    log_p: np.ndarray


@dataclass
class Tree:
    roots: np.ndarray  # log10 probabilities, as in Roots
    levels: list[Level]  # from two symbols on

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each gram after its longest retained context. Fast in order.

        Each gram's retained contexts are found from the shortest on. The symbol is looked up from the longest one back, only
        until there is a row for it; the parts for unseen symbols of the longer contexts are added to what that row holds.
        """
        last = codes & 255
        out = self.roots[codes >> (8 * DEPTH) << 8 | last].astype(np.float32)
        open_ = np.arange(len(codes))
        retained = []
        for depth, level in enumerate(self.levels, 2):
            if not len(open_) or not len(level.contexts):
                break
            context = codes[open_] >> (8 * (DEPTH - depth + 1))
            at, has = position_of_runs(level.contexts, context)
            open_, at = open_[has], at[has]
            retained.append((level, open_, at, context[has]))
        found, unseen = np.zeros(len(codes), bool), []
        for level, rows, at, context in reversed(retained):
            some = ~found[rows]
            rows, at, context = rows[some], at[some], context[some]
            pair, seen = position(level.pairs, context << 8 | last[rows])
            out[rows[seen]] = level.log_p[pair[seen]]
            found[rows[seen]] = True
            unseen.append((rows[~seen], level.unseen[at[~seen]]))
        for rows, part in reversed(unseen):
            out[rows] += part
        return out


def position(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands among ``values`` (in order, at least one), and whether it does."""
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


def position_of_runs(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for at least one wanted value, where equal ones that follow each other are looked for once."""
    first = np.flatnonzero(np.diff(wanted, prepend=wanted[0] - 1))
    sizes = np.diff(first, append=len(wanted))
    at, has = position(values, wanted[first])
    return np.repeat(at, sizes), np.repeat(has, sizes)


def subtree(codes: np.ndarray, n: np.ndarray, roots: Roots, divergence: float = DIVERGENCE) -> Tree:
    """The tree below contexts of one symbol, from all grams (in order) whose contexts end in some two symbols."""
    keys, found = codes[n > 0], [n[n > 0]]
    shorter = lambda keys: keys >> 16 << 8 | keys & 255
    pairs = [keys]
    for _ in range(DEPTH, 2, -1):
        keys, times = added_up(shorter(pairs[0]), found[0])
        pairs, found = [keys, *pairs], [times, *found]
    made, ratios, up = [], [], None
    for keys, times in zip(pairs, found):
        context = keys >> 8
        first = np.flatnonzero(np.diff(context, prepend=-1))
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        total = np.bincount(row, times, len(first))
        if up is None:
            parent = shorter(keys)
            q = roots.n[parent] / roots.n.reshape(256, 256).sum(1)[parent >> 8]
        else:
            parent = np.searchsorted(up, shorter(keys))
            q = ratios[-1][parent]
        ratios.append(times / total[row])
        gain = np.bincount(row, times * np.log(ratios[-1] / q), len(first))
        kept = (total >= roots.least) & (gain >= divergence * (np.bincount(row, minlength=len(first)) + 1))
        made.append((context[first], row, total, kept, parent))
        up = keys
    for shorter_, longer in reversed(list(zip(made, made[1:]))):
        shorter_[3][np.searchsorted(shorter_[0], longer[0][longer[3]] >> 8)] = True
    levels, p = [], roots.p
    for keys, times, (contexts, row, total, kept, parent) in zip(pairs, found, made):
        up = p[parent]
        p = np.where(kept[row], (times + M * up) / (total[row] + M), up)
        own = kept[row]
        unseen = np.log10(M / (total[kept] + M)).astype(np.float32)
        levels.append(Level(contexts[kept], unseen, keys[own], np.log10(p[own]).astype(np.float32)))
    return Tree(np.log10(roots.p), levels)


def by_ending(grams: DataFrame, roots: Broadcast, make: Callable[..., Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """``make`` of the grams (of ``count_grams``) and the tree of each partition, all of whose contexts end in the same two
    symbols or in others that are whole as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(c).flatten().to_numpy() for c in ("codes", "n")] for b in batches if len(b)]
        if got:
            codes, n = added_up(*(np.concatenate(part) for part in zip(*got)))
            del got
            yield from make(codes, n, subtree(codes, n, roots.value))

    parts = max(1, -(-int(roots.value.n.sum()) // PER_TASK))
    return grams.repartition(parts, "ending").mapInArrow(released(run), kind)


def tree_rows(grams: DataFrame, roots: Broadcast) -> DataFrame:
    """The retained tree: ``depth``, ``pair`` (or null) or ``context`` (or null), ``value``."""

    def make(codes: np.ndarray, n: np.ndarray, tree: Tree) -> Iterator[pa.RecordBatch]:
        for depth, level in enumerate(tree.levels, 2):
            for is_pair, keys, values in ((True, level.pairs, level.log_p), (False, level.contexts, level.unseen)):
                columns = [np.full(len(keys), depth, np.int8), np.full(len(keys), is_pair), keys, values]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["depth", "is_pair", "code", "value"])

    return by_ending(grams, roots, make, "depth byte, is_pair boolean, code long, value float")


def gathered(rows: DataFrame, roots: Roots) -> Tree:
    """A tree of bounded size as arrays in order."""
    found = rows.toArrow()
    depth, is_pair, code, value = (found[c].to_numpy() for c in ("depth", "is_pair", "code", "value"))
    levels = []
    for d in range(2, DEPTH + 1):
        parts = []
        for some in ((depth == d) & ~is_pair, (depth == d) & is_pair):
            order = np.argsort(code[some])
            parts += [code[some][order], value[some][order]]
        levels.append(Level(*parts))
    return Tree(np.log10(roots.p), levels)


def gram_scores(grams: DataFrame, roots: Broadcast) -> DataFrame:
    """Of each different gram (``code``) the log10 probability (``log_p``) of its last symbol, and its count (``n``)."""

    def make(codes: np.ndarray, n: np.ndarray, tree: Tree) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (codes, n, tree.log_p(codes))], names=["code", "n", "log_p"])

    return by_ending(grams, roots, make, "code long, n long, log_p float")


def read_symbols(found: Stream, tree: Tree) -> np.ndarray:
    """log10 probability of each of the texts' own symbols."""
    at, code = coded(found)
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))
    own = np.empty(len(code), np.float32)
    own[order] = np.repeat(tree.log_p(code[first]), np.diff(first, append=len(code)))
    out = np.zeros(len(found.symbols), np.float32)
    out[at] = own
    return out


def look_up(found: Stream, *tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What ``read_symbols`` gives for the texts' own symbols, from tables of grams (in any order), the first first."""
    at, code = coded(found)
    out = np.zeros(len(found.symbols), np.float32)
    for codes, log_p in tables:
        row = pc.index_in(pa.array(code), pa.array(codes))
        has = row.is_valid().to_numpy(zero_copy_only=False)
        out[at[has]] = log_p[row.drop_null().to_numpy()]
        at, code = at[~has], code[~has]
    if len(at):
        raise ValueError("a gram of the texts has no probability")
    return out


def spelling(words: Words, read: Callable[[Stream], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each word, and of the end of each text, from those of the symbols."""
    found = stream(words)
    symbols = read(found).astype(np.float64)
    raw_sizes = pc.binary_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    sizes = raw_sizes[words.ids] if len(words.ids) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    before = np.concatenate([[0], ends])[words.starts]  # symbols of words in earlier texts
    starts = ends - sizes + np.repeat(found.starts - before, words.counts)
    spelled = np.where(found.symbols == END, 0.0, symbols)  # sums run on to the next word, over ends between texts
    return text_sums(spelled, starts, starts + sizes), symbols[found.ends - 1]


@dataclass
class Known:
    """The words whose counts are broadcast."""

    words: pa.LargeStringArray
    n: np.ndarray  # of each word, and 0 for any other

    def counts_of(self, vocabulary: pa.LargeStringArray) -> np.ndarray:
        at = pc.index_in(vocabulary, self.words).fill_null(len(self.words))
        return self.n[at.to_numpy(zero_copy_only=False)]


def mixed(frequency: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """log10 of the mixture of a training frequency and a spelling probability (given as log10)."""
    unseen = spelled + np.log10(1 - FREQUENCY)
    seen = np.log10(np.maximum(FREQUENCY * frequency, 1e-300) + (1 - FREQUENCY) * 10.0**spelled)
    return np.where(frequency > 0, seen, unseen)


def is_training(id: Column) -> Column:
    """Four of five documents, by crc32 of the id as text."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def score_documents(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    min_share: float = MIN_SHARE,
    frequent: int = FREQUENT,
    max_rows: int = MAX_ROWS,
    frequent_grams: int = FREQUENT_GRAMS,
) -> DataFrame:
    """Per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``. A tree
    of more than ``max_rows`` rows is not broadcast."""
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    context = docs.sparkSession.sparkContext
    training = docs.filter(is_training(F.col("id")))
    both = written(count_words(training, "text"))
    counts, after = both.filter("word is not null").select("word", "n"), both.filter("pair is not null").toArrow()
    n_after = np.bincount(after["pair"].to_numpy(), after["n"].to_numpy(), 1 << 16)
    roots = context.broadcast(Roots.of(n_after, min_share))
    rows_of_tree = written(tree_rows(count_grams(docs), roots))
    tree = gathered(rows_of_tree, roots.value) if rows_of_tree.count() <= max_rows else None
    texts = training.count()
    sums = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_tokens, n_different = sums["n"] + texts, sums["v"] + (texts > 0)
    whole, all_tokens = n_tokens + 0.5 * (n_different + 1), max(1, n_tokens)
    short = counts.filter(F.octet_length("word") <= LONGEST)
    hot = short.filter(F.col("n") >= least_count(short, frequent)).toArrow()
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, hot.schema) as out:
        out.write_table(hot)
    shared = context.broadcast((sink.getvalue(), tree))
    id_type = docs.schema["id"].dataType
    types = pa.schema(
        [("key", pa.int64()), ("id", to_arrow_type(id_type)), ("word", pa.string()), ("n_tokens", pa.int64()),
         ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
    )

    def rows(**columns) -> pa.RecordBatch:
        arrays = {k: c if isinstance(c, pa.Array) else pa.array(c) for k, c in columns.items()}
        n = len(arrays["key"])
        made = [arrays[f.name].cast(f.type) if f.name in arrays else pa.nulls(n, f.type) for f in types]
        return pa.RecordBatch.from_arrays(made, schema=types)

    def opened() -> tuple[Known, Tree | None]:
        table = pa.ipc.open_stream(shared.value[0]).read_all()
        return Known(large_text(table["word"]), np.append(table["n"].to_numpy(), 0)), shared.value[1]

    def scored(
        piece: pa.RecordBatch, key: int, known: Known, read: Callable[[Stream], np.ndarray]
    ) -> Iterator[pa.RecordBatch]:
        """A row for each document; and one for each word that the table lacks, with its spelling as ``score``."""
        words = split_words(piece.column("text"), LOWER)
        n = known.counts_of(words.vocabulary)[words.ids]
        spelled, end = spelling(words, read)
        keys = key + np.arange(len(piece), dtype=np.int64)
        has = n > 0
        base = words.per_text(np.where(has, np.log10((n + 0.5) / whole), 0.0))
        own = words.per_text(np.where(has, mixed(n / all_tokens, spelled), 0.0))
        yield rows(
            key=keys,
            id=piece.column("id"),
            n_tokens=words.counts + 1,
            n_known=words.per_text(has.astype(np.int64)) + int(texts > 0),
            base=base + np.log10((texts + 0.5) / whole),
            score=own + mixed(np.full(len(piece), texts / all_tokens), end),
        )
        lacking = np.flatnonzero(~has)
        many = words.vocabulary.take(pa.array(words.ids[lacking]))
        yield rows(key=np.repeat(keys, words.counts)[lacking], word=many, score=spelled[lacking])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, tree = opened()
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                yield from scored(piece, key, known, lambda found: read_symbols(found, tree))
                key += len(piece)

    def score_block(block: tuple[pa.Scalar, ...], texts: pa.Table, table: pa.Table) -> pa.Table:
        known, _ = opened()
        key, made = block[0].as_py() << 26, []
        own = tuple(table[c].combine_chunks().to_numpy() for c in ("code", "log_p"))
        for batch in texts.to_batches():
            for piece in pieces(batch, "text", BLOCK_PIECE):
                made += scored(piece, key, known, lambda found: look_up(found, hot_grams.value, own))
                key += len(piece)
        return pa.Table.from_batches(made, types)

    kind = f"key long, id {id_type.simpleString()}, word string, n_tokens long, n_known long, base double, score double"
    if tree is not None:
        scores = docs.mapInArrow(released(score), kind)
    else:
        # frequent grams are broadcast, of the others only the block's own stand beside its texts
        blocks = written(in_blocks(docs))
        table = written(gram_scores(count_grams(docs, held_out=True), roots))
        often = table.filter(F.col("n") >= least_count(table, frequent_grams)).select("code", "log_p").toArrow()
        hot_grams = context.broadcast(tuple(often[c].to_numpy() for c in ("code", "log_p")))
        rare = block_grams(blocks, hot_grams).join(table.drop("n"), "code")
        sides = blocks.groupBy("block").cogroup(rare.groupBy("of_block"))
        scores = sides.applyInArrow(score_block, kind)
    found = written(scores)
    lacking = found.filter("word is not null").select("key", "word", "score")
    joined = lacking.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n, spelled = F.col("n"), F.col("score")
    mix = F.log10(F.lit(FREQUENCY / all_tokens) * n + F.lit(1 - FREQUENCY) * F.pow(F.lit(10.0), spelled))
    own = F.when(n > 0, mix).otherwise(spelled + F.lit(float(np.log10(1 - FREQUENCY))))
    more = joined.groupBy("key").agg(
        F.sum(F.log10((n + 0.5) / F.lit(float(whole)))).alias("more_base"),
        F.sum(own).alias("more"),
        F.sum((n > 0).cast("long")).alias("known"),
    )
    out = found.filter("word is null").join(more, "key", "left")
    return out.select(
        F.col("id").alias(id),
        (~is_training(F.col("id"))).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(n_tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
