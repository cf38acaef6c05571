"""Whole columns of text cut into words with Arrow kernels, a bounded piece of a batch at a time.

A piece keeps each of its different words once (``vocabulary``) and the words of all texts as numbers into it, so that
work per word is done once per different word and the rest is numpy.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECE_BYTES = 32 << 20  # of text at a time in a Python worker; a longer text is a piece of its own

AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[ord("A") : ord("Z") + 1] += 32
# Digits, letters and everything beyond ASCII are words, all other bytes separate them.
ALPHANUMERIC = LOWER.copy()
ALPHANUMERIC[[b for b in range(128) if not (48 <= b <= 57 or 97 <= LOWER[b] <= 122)]] = 32


@dataclass
class Words:
    vocabulary: pa.LargeStringArray  # different words
    ids: np.ndarray  # of all words of all texts, numbers in the vocabulary
    ends: np.ndarray  # of each text the number of words up to its end

    @property
    def starts(self) -> np.ndarray:
        return self.ends - self.counts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per word over each text."""
        return text_sums(values, self.starts, self.ends)


def text_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over ``values[start:end]``; 0 where that is empty."""
    out = np.zeros(len(starts), values.dtype if values.dtype.kind == "f" else np.int64)
    full = ends > starts
    if full.any():
        out[full] = np.add.reduceat(values, starts[full], dtype=out.dtype)
    return out


def expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its size, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def large_text(texts: pa.Array) -> pa.LargeStringArray:
    """The texts with null as empty, in buffers that start at the first text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return texts if texts.offset == 0 else pa.concat_arrays([texts.slice(0, 0), texts])


def text_bytes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and the place of each text's start (and the end of the last)."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mapped(texts: pa.LargeStringArray, table: np.ndarray) -> pa.LargeStringArray:
    """The texts with each byte replaced through ``table``, which may only change ASCII to ASCII."""
    raw, offsets = text_bytes(texts)
    return pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(table[raw])
    )


def encoded(lists: pa.ListArray) -> Words:
    """Lists of strings as numbers into their different values; empty strings are left out."""
    flat = lists.flatten().dictionary_encode()
    ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
    ends = np.asarray(lists.offsets, dtype=np.int64)[1:] - lists.offsets[0].as_py() if len(lists) else np.zeros(0, np.int64)
    empty = pc.index(flat.dictionary, pa.scalar("", flat.dictionary.type)).as_py()
    if empty >= 0:
        keep = ids != empty
        before = np.concatenate([[0], np.cumsum(keep)])
        ids, ends = ids[keep], before[ends]
    return Words(flat.dictionary, ids, ends)


def split_words(texts: pa.Array, table: np.ndarray = AS_IS) -> Words:
    """Words between ASCII white space (space, tab to carriage return), after a replacement of bytes."""
    return encoded(pc.ascii_split_whitespace(mapped(large_text(texts), table)))


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with about ``limit`` bytes of text."""
    texts = large_text(batch.column(column))
    _, offsets = text_bytes(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, after which the memory that it used goes back to the system. Spark keeps Python
    workers for later tasks, and without this they keep the memory of their largest one."""

    def run_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return run_and_release


def release_memory() -> None:
    """Free memory that Arrow and the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, or with underscores before it until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def add_column(
    df: DataFrame,
    text: str,
    name: str,
    kind: T.DataType,
    start: Callable[[], Callable[[pa.RecordBatch], pa.Array]],
    keep: list[str] | None = None,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Add a column that a function makes of each piece of rows; the rows and their order stay.

    ``start`` is called once per task and returns the function. ``keep`` names the columns to return (all); an older
    column called ``name`` gives way. A piece has about ``piece_bytes`` of text.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != name.lower()]
    schema = T.StructType([*[f for f in df.schema.fields if f.name in keep], T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for piece in pieces(batch, text, piece_bytes):
                made = make(piece)
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in schema.names[:-1]], made], names=schema.names
                )

    return df.mapInArrow(released(run), schema)


def struct_of(**columns) -> pa.StructArray:
    """A struct column of arrays."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))
