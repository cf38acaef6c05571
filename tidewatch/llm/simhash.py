"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of the text's word shingles. Two
fingerprints link at ``DISTANCE`` (2) or fewer differing bits; documents of linked fingerprints form a component.

Pigeonring: a fingerprint is a ring of 8 segments of 8 bits. If two differ in at most 2 bits, then from some segment on
every chain of consecutive segments stays within its share of the budget: the first j segments differ in at most
floor(2 j / 8) bits, that is none in the first three, at most one in the first seven. So three segments are equal, and of
the next four at least three. Each start (8) and each segment that may differ (4) gives a key of 48 bits; fingerprints
that share a key are candidates, the chains of their differences are held against the budgets, and those that pass are
compared as a whole.

Fingerprints under one key differ in two segments only, so there are at most 65,536 of them however many documents there
are, and equal fingerprints count once. Crowded keys look up neighbours in a table of that size instead of comparing
all pairs. A key yields links to the smallest member of each connected set, not pairs.

Null and empty texts have no word and fingerprint zero, linked like any other. Repeated rows have equal fingerprints. A
component's id is the smallest document id in it, null if all are null. An empty table gives an empty table. Columns other
than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.components import connected_components
from tidewatch.llm.store import written
from tidewatch.llm.words import LOWER, Words, add_column, free_name, large_text, released, split_words, text_bytes

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENTS = 8
BITS = 8  # of a segment
CHAIN = 7  # segments with a budget of one difference; the first three have none
FREE = (3, 4, 5, 6)  # places in a chain that the one difference may fall in
CROWDED = 64  # members of a key from which on neighbours are looked up instead of compared
BLOCK = 1 << 16  # hashes whose bits are counted at a time
PIECE = 4 << 20  # bytes of text whose shingles are held at a time


def fingerprints(words: Words, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text as an unsigned number."""
    # all words in a row, each followed by a blank, so that a shingle is a slice
    nothing, blank = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    row = pc.binary_join_element_wise(words.vocabulary.take(pa.array(words.ids)), nothing, blank)
    raw, offsets = text_bytes(large_text(row))
    data = raw.tobytes()
    n_shingles = np.where(words.counts == 0, 0, np.maximum(words.counts - size + 1, 1))
    ends = np.cumsum(n_shingles)
    inside = np.arange(int(n_shingles.sum())) - np.repeat(ends - n_shingles, n_shingles)
    first = np.repeat(words.starts, n_shingles) + inside
    last = np.minimum(first + size, np.repeat(words.ends, n_shingles))
    digest = xxhash.xxh64_intdigest
    places = zip(offsets[first].tolist(), (offsets[last] - 1).tolist())
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in places), np.uint64, len(first))
    owner = np.repeat(np.arange(len(ends)), n_shingles)
    counts = np.zeros((len(ends), 64), np.int64)
    for at in range(0, len(hashes), BLOCK):
        block, own = hashes[at : at + BLOCK], owner[at : at + BLOCK]
        bits = np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.flatnonzero(np.diff(own, prepend=-1))
        counts[own[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    majority = counts * 2 > n_shingles[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view("<u8").reshape(-1)


def with_fingerprints(docs: DataFrame, text: str, name: str, keep: list[str], size: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint as a signed 64-bit number."""

    def start():
        return lambda piece: pa.array(fingerprints(split_words(piece.column(text), LOWER), size).view(np.int64))

    return add_column(docs, text, name, T.LongType(), start, keep, PIECE)


def ring_mask(start: int, free: int) -> int:
    """The bits of the key of a chain: all segments but the free one and the last of the ring."""
    left_out = {(start + free) % SEGMENTS, (start + SEGMENTS - 1) % SEGMENTS}
    bits = sum(((1 << BITS) - 1) << (BITS * s) for s in range(SEGMENTS) if s not in left_out)
    return bits - (1 << 64) if bits >> 63 else bits


CHAINS = [(start, free) for start in range(SEGMENTS) for free in FREE]


def chain_difference(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the differing bits ``x`` keep to the budget of every chain from ``start`` on."""
    total = np.zeros(len(x), np.int64)
    fits = np.ones(len(x), bool)
    for j in range(SEGMENTS):
        shift = ((start + j) % SEGMENTS * BITS).astype(np.uint64)
        total += np.bitwise_count((x >> shift) & np.uint64(0xFF))
        fits &= total <= DISTANCE * (j + 1) // SEGMENTS
    return fits


def links(chain: np.ndarray, key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by (chain, key, print) the links within keys, as pairs of a print and the smallest print that it
    is connected to under the same key."""
    n = len(prints)
    new = np.ones(n, bool)
    new[1:] = (chain[1:] != chain[:-1]) | (key[1:] != key[:-1])
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    start = np.asarray([c[0] for c in CHAINS])[chain]
    label = np.arange(n)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    small = sizes[group] < CROWDED
    for step in range(1, int(min(sizes.max(initial=1), CROWDED))):
        i = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
        if not len(i):
            break
        x = prints[i] ^ prints[i + step]
        i = i[chain_difference(x, start[i]) & (np.bitwise_count(x) <= DISTANCE)]
        pairs.append((i, i + step))
    for g in np.flatnonzero(sizes >= CROWDED):
        pairs += neighbours(np.flatnonzero(group == g), prints, CHAINS[int(chain[np.searchsorted(group, g)])])
    if not pairs:
        return prints[:0], prints[:0]
    a, b = (np.concatenate(side) for side in zip(*pairs))
    while True:
        lower = label.copy()
        np.minimum.at(lower, b, label[a])
        np.minimum.at(lower, a, label[b])
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    linked = np.flatnonzero(label != np.arange(n))
    return prints[linked], prints[label[linked]]


def neighbours(
    rows: np.ndarray, prints: np.ndarray, chain: tuple[int, int]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of a crowded key: each member looks up every print that the budgets allow in the two segments in
    which members differ."""
    start, free = chain
    places = [(start + free) % SEGMENTS * BITS, (start + SEGMENTS - 1) % SEGMENTS * BITS]
    value = sum(((prints[rows] >> np.uint64(p)) & np.uint64(0xFF)).astype(np.int64) << (8 * k) for k, p in enumerate(places))
    at = np.full(1 << 16, -1)
    at[value] = rows
    for change in range(1, 1 << 16):
        middle, end = (change & 0xFF).bit_count(), (change >> 8).bit_count()
        if middle <= 1 and middle + end <= DISTANCE:
            other = at[value ^ change]
            found = other > rows
            if found.any():
                yield rows[found], other[found]


def linked_prints(prints: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) between different fingerprints (column ``print``), enough to connect each component."""
    keys = F.array(
        *[
            F.struct(F.lit(i).cast("tinyint").alias("chain"), F.col("print").bitwiseAND(F.lit(ring_mask(*c))).alias("key"))
            for i, c in enumerate(CHAINS)
        ]
    )
    rows = prints.select("print", F.explode(keys).alias("k")).select("k.chain", "k.key", "print")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "chain", "key").sortWithinPartitions("chain", "key", "print")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns)]
            chain, key, own = columns
            # the last key may go on in the next batch
            last = np.flatnonzero((chain != chain[-1]) | (key != key[-1]))
            cut = last[-1] + 1 if len(last) else 0
            rest = [c[cut:] for c in columns]
            yield linked(chain[:cut], key[:cut], own[:cut])
        if rest is not None:
            yield linked(*rest)

    def linked(chain: np.ndarray, key: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        a, b = links(chain, key, own.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    return rows.mapInArrow(released(compare), "a long, b long")


def print_components(found: DataFrame, id: str) -> DataFrame:
    """For each different ``print`` of documents (``id``, ``print``) its component's smallest print, ``root``, and
    smallest id, ``component_id``."""
    prints = written(found.groupBy("print").agg(F.min(id).alias("least")))
    roots = connected_components(linked_prints(prints.select("print")))
    rooted = prints.join(roots.withColumnRenamed("node", "print"), "print", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("print", "root", "component_id")


def hex_print(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Per document: id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``."""
    found = written(with_fingerprints(docs.select(id, text), text, "print", [id], size))
    out = found.join(print_components(found, id), "print")
    return out.select(id, hex_print(F.col("print")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component: the smallest id, of rows with that id the one whose text hashes
    lowest, of rows equal in both any one."""
    code = F.xxhash64(F.col(text), F.col(text).isNull())
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), code.alias("code"))
    found = written(with_fingerprints(slim, "text", "print", ["id", "code"], size))
    grouped = found.join(print_components(found, "id"), "print").groupBy("root")
    stay = grouped.agg(F.min(F.struct("id", "code")).alias("stay")).select("stay.id", "stay.code")
    name = free_name(docs.columns, "code")
    coded = docs.withColumn(name, code)
    kept = coded.join(stay, coded[id].eqNullSafe(stay["id"]) & (coded[name] == stay["code"]), "left_semi")
    return kept.dropDuplicates([id, name]).drop(name)
