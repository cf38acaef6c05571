"""Byte-level BPE: ranked merges folded over words by Spark's higher-order functions, and decoding.

A word (one match of the split pattern, as bytes) starts as its single bytes. Each step of the fold takes the
neighbouring pair of lowest rank, the leftmost of equals, puts its join in the place of both, and looks up the ranks of
the two pairs that this makes; without a ranked pair the state stays. Words of more than SHORT bytes join all places of
the lowest rank in one step, where that comes to the same, so there are about as many steps over the word as different
ranks are joined. A word that is a token itself is not folded, which is how the published library treats it. Ranks lie in
one value, an array of small maps, found by crc32 of the piece. It is the scalar of a table of one row and not a literal,
which would stand in every plan that the driver describes and keeps.

Bytes are written as pairs of hexadecimal digits inside the fold, so that pieces are short ASCII strings.

Two tiers of words: the counts of all words of the corpus give the frequent ones, which are folded once and broadcast
in a table of bounded size; in a second pass over the texts, words beyond the table are folded once per piece of text.
So no word is shuffled but for the counts, and every step of the second pass is narrow.

Null and empty texts have no tokens. Repeated rows are encoded each. An empty table gives an empty table. Columns other
than id and text are not read.
"""

from __future__ import annotations

import base64
import io
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.store import least_count, written
from tidewatch.llm.words import Words, encoded, expanded, large_text, pieces, release_memory, released
from tidewatch.session import config_table

UNRANKED = 2**31 - 1
BUCKETS = 1 << 14
SHORT = 64  # bytes of a word up to which its pairs are joined one by one


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def with_ranks(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``ranks``, an array of maps from hexadecimal pieces to ranks; a map holds about three pieces. An expression
    that reads it once takes its place in the plan, so no row carries the ranks."""
    buckets: list[list[tuple[str, int]]] = [[] for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        piece = token.hex().upper()
        buckets[zlib.crc32(piece.encode()) % BUCKETS].append((piece, rank))
    table = config_table(rows.sparkSession, [(buckets,)], "ranks array<map<string,int>>")
    return rows.withColumn("ranks", table.scalar())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, as the end of a fold over nothing. (An element of a list of one would do,
    but to take it Spark works out the type of the whole body each time.)"""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def fold_words(words: Column, table: Column) -> Column:
    """Token ids of each word of an array; words are given as hexadecimal bytes."""
    return let(table, lambda ranks: F.transform(words, lambda w: fold_word(w, ranks)))  # one copy of the table


def fold_word(word: Column, table: Column) -> Column:
    """Token ids of one word, given as hexadecimal bytes."""
    n = (F.length(word) / 2).cast("int")
    several = let(
        F.regexp_extract_all(word, F.lit(".."), F.lit(0)),
        lambda parts: F.transform(fold_long(parts, table), lambda p: rank_of(table, p)),
    )
    whole = rank_of(table, word)
    one = fold_short(word, n, table)
    return F.when(whole != UNRANKED, F.array(whole)).when(n < 1, F.array().cast("array<int>")).when(n <= SHORT, one).otherwise(several)


def fold_short(word: Column, n: Column, table: Column) -> Column:
    """Token ids of a short word of ``n`` bytes, whose pairs are joined one by one.

    The state is one list, with an entry for each part and one for the word's end: the rank of the part's pair with the
    next (UNRANKED without one) before its first digit's place, in eight bits. So the least entry is the leftmost pair of
    the lowest rank, and pieces are cut from the word itself.
    """

    def pair(i: Column) -> Column:
        piece = F.substring(word, i * 2 + 1, F.lit(4))
        return entry(F.when(i + 1 < n, rank_of(table, piece)).otherwise(F.lit(UNRANKED)), i * 2)

    def ids(state: Column) -> Column:
        parts = F.slice(state, F.lit(1), F.size(state) - 1)
        return F.transform(parts, lambda e, i: rank_of(table, cut(word, begin(e), begin(state[i + 1]))))

    start = F.transform(F.sequence(F.lit(0), n), pair)
    joins = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(joins, start, lambda s, _: merge_first(s, word, table), ids)


def entry(rank: Column, place: Column) -> Column:
    return F.shiftleft(rank.cast("long"), 8) + place


def begin(found: Column) -> Column:
    """The place of an entry."""
    return found.bitwiseAND(255).cast("int")


def cut(word: Column, first: Column, end: Column) -> Column:
    return F.substring(word, first + 1, end - first)


def fold_long(parts: Column, table: Column) -> Column:
    """The parts that remain of a long word. Spark copies the state after each step, so the steps come in rounds, which
    end with its pairs."""

    def pair(part: Column, i: Column) -> Column:
        following = F.get(parts, i + 1)
        return F.when(following.isNotNull(), rank_of(table, F.concat(part, following))).otherwise(F.lit(UNRANKED))

    root = F.sequence(F.lit(1), F.ceil(F.sqrt(F.size(parts))))
    step = lambda s, _: F.when(s["best"] == UNRANKED, s).otherwise(merge_all(s, table))
    open_ = lambda s: F.when(s["best"] != UNRANKED, root).otherwise(F.array())
    rounds = lambda s, _: F.aggregate(open_(s), s, step)
    return F.aggregate(root, with_best(parts, F.transform(parts, pair)), rounds)["parts"]


def rank_of(table: Column, piece: Column) -> Column:
    bucket = F.crc32(piece).bitwiseAND(BUCKETS - 1)
    return F.coalesce(table[bucket][piece], F.lit(UNRANKED))


def with_best(parts: Column, ranks: Column) -> Column:
    """A state of the fold: parts of the word, the rank of each with the next, and the lowest of these."""
    return let(ranks, lambda r: F.struct(parts.alias("parts"), r.alias("ranks"), F.array_min(r).alias("best")))


def merge_first(state: Column, word: Column, table: Column) -> Column:
    """The leftmost pair of lowest rank is joined; without a ranked pair the state stays."""
    size = F.size(state)

    def join(best: Column, at: Column) -> Column:  # the pair's parts are at ``at`` and ``at + 1``, from 0
        first, before = begin(best), begin(state[at - 1])
        left = entry(rank_of(table, cut(word, before, begin(state[at + 2]))), before)
        ranked = F.when(at + 3 < size, rank_of(table, cut(word, first, begin(state[at + 3])))).otherwise(F.lit(UNRANKED))
        right = entry(ranked, first)
        around = F.when(at > 0, F.array(left, right)).otherwise(F.array(right))
        return F.flatten(F.array(F.slice(state, F.lit(1), F.greatest(at - 1, F.lit(0))), around, F.slice(state, at + 3, size)))

    place = lambda best: F.size(F.filter(state, lambda e: e.bitwiseAND(255) < best.bitwiseAND(255)))
    joined = lambda best: let(place(best), lambda at: join(best, at))
    return let(F.array_min(state), lambda best: F.when(best >= UNRANKED << 8, state).otherwise(joined(best)))


def merge_all(state: Column, table: Column) -> Column:
    """All pairs of lowest rank are joined, from the left, without overlaps, up to the first join that makes a pair of
    lower rank with a neighbour: what joining them one by one comes to."""
    parts, ranks, best = state["parts"], state["ranks"], state["best"]
    is_ = lambda chosen, i: F.get(chosen, i) == "1"
    hits = F.array_join(F.transform(ranks, lambda r: F.when(r == best, "1").otherwise("0")), "")
    apart = F.split(F.replace(hits, F.lit("11"), F.lit("10")), "")
    both = lambda i: F.concat(F.get(parts, i), F.get(parts, i + 1))

    def until_lower(chosen: Column) -> Column:
        def lower(mark: Column, i: Column) -> Column:
            before = F.when(is_(chosen, i - 2), both(i - 2)).otherwise(F.get(parts, i - 1))
            left, right = F.concat(before, both(i)), F.concat(both(i), F.get(parts, i + 2))
            makes = (rank_of(table, left) < best) | (rank_of(table, right) < best)
            return F.when(mark == "1", makes).otherwise(F.lit(False))

        cut = lambda n: F.transform(chosen, lambda m, i: F.when(i < n, m).otherwise("0"))
        last = F.array_position(F.transform(chosen, lower), True).cast("int")
        return let(last, lambda n: F.when(n == 0, chosen).otherwise(cut(n)))

    def joined(chosen: Column) -> Column:
        def starts(kept: Column) -> Column:
            def paired(new: Column) -> Column:
                def pair(i: Column, k: Column) -> Column:
                    following = F.get(kept, k + 1)
                    changed = rank_of(table, F.concat(F.get(new, k), F.get(new, k + 1)))
                    last = F.when(following.isNull(), F.lit(UNRANKED))
                    return last.when(is_(chosen, i) | is_(chosen, following), changed).otherwise(F.get(ranks, i))

                return with_best(new, F.transform(kept, pair))

            return let(F.transform(kept, lambda i: F.when(is_(chosen, i), both(i)).otherwise(F.get(parts, i))), paired)

        places = F.sequence(F.lit(0), F.size(parts) - 1)
        return let(F.filter(places, lambda i: (i == 0) | ~is_(chosen, i - 1)), starts)

    return let(let(apart, until_lower), joined)


# All white space of Unicode; the split pattern treats no other character as such.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
SPACE_BEFORE_BLANK = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "
PIECE = 3 << 20  # bytes of text encoded at a time
COUNTED = 16 << 20  # bytes of text whose words are counted at a time
FREQUENT = 1_000_000  # words in the broadcast table
LONGEST = 48  # bytes of a word in the table, which bounds it to about 125 MB; usual words make it 40 MB
HASHED = 1 << 16  # words that are Python strings at a time
MARKS = ".,;:!?"
# Fixed value: the split pattern for which letters with a mark after them are known to be two words.
USUAL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def units(texts: pa.LargeStringArray) -> Words:
    """The texts cut where a blank follows something other than white space; no match of the pattern reaches across.

    Texts in which a blank follows white space are cut one by one, before runs of white space.
    """
    lists = pc.split_pattern(texts, pattern=" ")
    flat = lists.flatten()
    first = np.zeros(len(flat), bool)
    first[np.asarray(lists.offsets)[:-1][np.asarray(pc.list_value_length(lists)) > 0]] = True
    blank = pa.array(["", " "], pa.large_string()).take(pa.array((~first).astype(np.int8)))
    joined = pc.binary_join_element_wise(blank, flat, pa.scalar("", pa.large_string()))
    lists = pa.ListArray.from_arrays(lists.offsets, joined)
    odd = pc.match_substring_regex(texts, SPACE_BEFORE_BLANK)
    if pc.any(odd).as_py():
        rows = pc.if_else(odd, texts, None).to_pylist()
        cut = [t if t is None else UNIT.findall(t) for t in rows]
        lists = pc.if_else(odd, pa.array(cut, lists.type), lists)
    return encoded(lists)


@dataclass
class Split:
    """Texts as units, and units as words (matches of the pattern)."""

    units: Words
    words: pa.StringArray  # different words
    of_unit: np.ndarray  # words of all units, one unit after the other
    unit_sizes: np.ndarray  # how many words each unit has


def split(texts: pa.Array, pattern: regex.Pattern) -> Split:
    """Most units are a blank and letters, with or without a mark at the end; the others go through the pattern."""
    found = units(large_text(texts))
    names = found.vocabulary.cast(pa.string())
    letters, marked = usual(names) if pattern.pattern == USUAL_PATTERN else (np.zeros(len(names), bool),) * 2
    others = ~(letters | marked)
    parts = [pattern.findall(unit) for unit in names.filter(pa.array(others)).to_pylist()]
    with_mark = names.filter(pa.array(marked))
    groups = [
        names.filter(pa.array(letters)),
        pc.utf8_slice_codeunits(with_mark, 0, -1),
        pc.utf8_slice_codeunits(with_mark, -1),
        pa.array([word for unit in parts for word in unit], pa.string()),
    ]
    coded = pa.concat_arrays(groups).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    sizes = np.where(marked, 2, 1)
    sizes[others] = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes) - sizes
    of_unit = np.empty(len(ids), np.int32)
    places = [starts[letters], starts[marked], starts[marked] + 1, expanded(starts[others], sizes[others])]
    of_unit[np.concatenate(places)] = ids
    return Split(found, coded.dictionary, of_unit, sizes.astype(np.int32))


def usual(names: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Which units are letters after one blank at most, and which have one mark after these."""
    size = lambda values: pc.binary_length(values).to_numpy(zero_copy_only=False)
    core = pc.utf8_ltrim(names, characters=" ")
    one_blank = size(names) - size(core) <= 1
    bare = pc.utf8_rtrim(core, characters=MARKS)
    marks = size(core) - size(bare)
    plain = one_blank & pc.utf8_is_alpha(bare).to_numpy(zero_copy_only=False)
    return plain & (marks == 0), plain & (marks == 1)


def word_counts(docs: DataFrame, text: str, pattern: str) -> DataFrame:
    """Counts of all words (``word``, ``n``) over the whole table; each piece of a task is added up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            for piece in pieces(batch, text, COUNTED):
                found = split(piece.column(text), compiled)
                times = np.bincount(found.units.ids, minlength=len(found.unit_sizes))
                per_word = np.repeat(times, found.unit_sizes)
                total = np.bincount(found.of_unit, per_word, minlength=len(found.words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([found.words, pa.array(total)], names=["word", "n"])

    return docs.select(text).mapInArrow(released(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, text: str, pattern: str, ranks: dict[bytes, int], most: int) -> Broadcast:
    """The ids of the most frequent words, at most ``most`` of at most LONGEST bytes each."""
    counts = written(word_counts(docs, text, pattern).filter(F.octet_length("word") <= LONGEST))
    hot = counts.filter(F.col("n") >= least_count(counts, most)).select("word")
    hexed = F.array(F.hex(F.encode("word", "utf-8")))
    found = with_ranks(hot, ranks).select("word", fold_words(hexed, F.col("ranks"))[0].alias("ids"))
    shared = docs.sparkSession.sparkContext.broadcast(word_table(found.toArrow()))
    release_memory()
    return shared


def word_hashes(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    slices = (words.slice(at, HASHED).to_pylist() for at in range(0, len(words), HASHED))
    return np.fromiter((digest(w) for some in slices for w in some), np.uint64, len(words))


def word_table(found: pa.Table) -> tuple[np.ndarray, bytes]:
    """Words and their ids in order of the words' hashes, as an Arrow stream. Words that share a hash are left out."""
    table = found.cast(pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])).combine_chunks()
    del found  # what it holds would stay in memory beside the copies
    hashes = word_hashes(table["word"])
    order = np.argsort(hashes)
    hashes = hashes[order]
    same = hashes[1:] == hashes[:-1]
    once = ~(np.concatenate([[False], same]) | np.concatenate([same, [False]]))[: len(hashes)]
    table = table.take(pa.array(order[once])).combine_chunks()
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return hashes[once], sink.getvalue()


class WordTable:
    """Looks words up by hash and compares them with what it finds."""

    def __init__(self, made: tuple[np.ndarray, bytes]) -> None:
        self.hashes, data = made
        table = pa.ipc.open_stream(data).read_all()  # one batch, in the memory of the broadcast
        self.words, self.ids = (flat_array(table[c]) for c in ("word", "ids"))

    def look_up(self, words: pa.StringArray) -> tuple[np.ndarray, pa.ListArray]:
        """Which words are known, and the ids of those."""
        if not len(self.hashes) or not len(words):
            return np.zeros(len(words), bool), self.ids.slice(0, 0)
        wanted = word_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        known = self.hashes[at] == wanted
        same = pc.equal(self.words.take(pa.array(at[known])), words.filter(pa.array(known)))
        known[np.flatnonzero(known)] = same.to_numpy(zero_copy_only=False)
        return known, self.ids.take(pa.array(at[known]))


def flat_array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays([pa.array([], column.type), *column.chunks])


def encode_documents(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    id: str = "doc_id",
    text: str = "text",
    decoded: bool = False,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Per document: id and ``ids``; with ``decoded`` also the bytes that the ids stand for."""
    docs = docs.select(id, text)
    hot = frequent_words(docs, text, pattern, ranks, frequent)
    id_type = docs.schema[id].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each piece: its texts as units, units as words, the ids of known words, and the other words."""
        compiled, known = regex.compile(pattern), WordTable(hot.value)
        for batch in batches:
            for piece in pieces(batch, text, PIECE):
                found = split(piece.column(text), compiled)
                is_known, ids = known.look_up(found.words)
                missing = found.words.filter(pa.array(~is_known))
                sizes = np.full(len(is_known), -1, np.int32)
                sizes[is_known] = np.asarray(pc.list_value_length(ids))
                state = io.BytesIO()
                np.savez(
                    state,
                    units=found.units.ids,
                    ends=found.units.ends,
                    of_unit=found.of_unit,
                    unit_sizes=found.unit_sizes,
                    sizes=sizes,
                    ids=ids.flatten().to_numpy(zero_copy_only=False),
                )
                own = pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), piece.column(id))
                lists = pa.ListArray.from_arrays(pa.array([0, len(missing)], pa.int32()), missing)
                columns = [own, pa.array([state.getvalue()], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["docs", "state", "missing"])

    pieces_ = docs.mapInArrow(released(look_up), f"docs array<{id_type}>, state binary, missing array<string>")
    hexed = F.transform("missing", lambda w: F.hex(F.encode(w, "utf-8")))
    folded = with_ranks(pieces_, ranks).select("docs", "state", fold_words(hexed, F.col("ranks")).alias("found"))
    shared = docs.sparkSession.sparkContext.broadcast(decode_table(ranks)) if decoded else None

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(shared.value, pa.large_binary()) if shared else None
        for batch in batches:
            for row in range(len(batch)):
                own = batch.column("docs").slice(row, 1).flatten()
                found = batch.column("found").slice(row, 1).flatten()
                made = finished(batch.column("state")[row].as_py(), found, tokens)
                whole = pa.RecordBatch.from_arrays([own, *made], names=names)
                for at in range(0, len(whole), 1000):
                    yield whole.slice(at, 1000)

    kind = f"`{id}` {id_type}, ids array<int>" + (", decoded binary" if decoded else "")
    names = [id, "ids", "decoded"][: 3 if decoded else 2]
    return folded.mapInArrow(released(finish), kind)


def finished(state: bytes, folded: pa.ListArray, tokens: pa.LargeBinaryArray | None) -> list[pa.Array]:
    """The ids of each text of a piece, once the ids of its missing words are known; with ``tokens`` also what they
    stand for, decoded once for each different unit."""
    with np.load(io.BytesIO(state)) as found:
        s = dict(found)
    sizes, missing = s["sizes"].astype(np.int64), s["sizes"] < 0
    sizes[missing] = np.asarray(pc.list_value_length(folded), np.int64)
    starts = np.cumsum(sizes) - sizes
    per_word = np.zeros(int(sizes.sum()), np.int32)
    per_word[expanded(starts[~missing], sizes[~missing])] = s["ids"]
    per_word[expanded(starts[missing], sizes[missing])] = folded.flatten().to_numpy(zero_copy_only=False)
    # words to units, units to texts
    of_unit, unit_words = s["of_unit"], s["unit_sizes"].astype(np.int64)
    per_unit = per_word[expanded(starts[of_unit], sizes[of_unit])]
    ends = np.concatenate([[0], np.cumsum(sizes[of_unit])])
    last = np.cumsum(unit_words)
    unit_ends = np.concatenate([[0], ends[last]]).astype(np.int32)
    places = np.concatenate([[0], s["ends"]])

    def texts(unit_lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Lists of units as lists of texts: where each text begins, and the values of all."""
        taken = unit_lists.take(pa.array(s["units"]))
        return np.asarray(taken.offsets if hasattr(taken, "offsets") else binary_offsets(taken))[places], taken

    offsets, taken = texts(pa.ListArray.from_arrays(pa.array(unit_ends), pa.array(per_unit)))
    out = [pa.ListArray.from_arrays(pa.array(offsets), taken.values)]
    if tokens is not None:
        pieces_ = tokens.take(pa.array(per_unit))  # one after the other in memory
        bounds = np.ascontiguousarray(binary_offsets(pieces_)[unit_ends])
        data = pieces_.buffers()[2] or pa.py_buffer(b"")
        units_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), data])
        offsets, taken = texts(units_)
        data = taken.buffers()[2] or pa.py_buffer(b"")
        out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), data]).cast(pa.binary()))
    return out


def binary_offsets(values: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]


def decode_documents(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the bytes that a column of id lists stands for; null lists stay null."""
    table = F.from_json(F.lit(json.dumps([token.hex() for token in decode_table(ranks)])), "array<string>")
    pieces_ = let(table, lambda t: F.array_join(F.transform(F.col(ids), lambda i: t[i]), ""))
    return rows.withColumn(name, F.unhex(pieces_))


def decode_table(ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens in order of their ids; empty for ids without one."""
    tokens = {rank: token for token, rank in ranks.items()}
    return [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
