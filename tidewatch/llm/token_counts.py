"""Token counts of whole texts through two tiers of pre-token lengths, without moving pre-tokens between tasks.

The tokenizer writes a blank as the mark U+2581 and puts one before the text. No piece of its vocabulary has a mark
after another character, so no merge reaches across the start of a run of marks: the count of a text is the sum over its
segments (marks, then other characters). First tier: lengths of frequent segments, broadcast as one compact table, which
is made from a bounded sample of the texts. Second tier: other segments are encoded by the library where they occur; each
worker keeps a bounded cache of them over all its tasks. Nothing is shuffled.

Null and empty texts have 0 tokens. Repeated rows are counted like any other. An empty table gives an empty table.
Columns other than id and text are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.words import Words, add_column, encoded, large_text, pieces, released, struct_of, text_bytes

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
SAMPLE_ROWS = 2_000  # texts in the sample that the table is made from
SAMPLE_BYTES = 16 << 10  # of a text in the sample, which bounds it to 32 MB
FREQUENT = 100_000  # segments in the broadcast table
LONGEST = 48  # bytes; longer segments stay out of the table, which bounds it to about 5 MB
CACHED = 600_000  # segments that a worker remembers beyond the table

_models: dict[str, object] = {}


def processor(model: str):
    """The library's processor for a model file, one per worker."""
    if model not in _models:
        import sentencepiece

        made = sentencepiece.SentencePieceProcessor(model_file=model)
        joined = any(MARK in made.id_to_piece(i).lstrip(MARK) for i in range(made.get_piece_size()))
        if joined or made.encode("a  b") != [*made.encode("a"), *made.encode(" b")] or made.encode(""):
            raise ValueError("the model joins or drops blanks, so that texts can't be counted by segment")
        _models[model] = made
    return _models[model]


def segments(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The segments of each text without their first mark, and whether a text ends in a segment of that mark alone.

    Where blanks stand alone, a segment is what stands between them. Texts with runs of blanks, blanks at an end or
    marks of their own are cut one by one.
    """
    texts = large_text(texts)
    lists = pc.split_pattern(texts, pattern=" ")
    odd = pc.match_substring_regex(texts, f"  |^ | $|{MARK}")
    lone = pc.match_substring_regex(texts, f"[^ {MARK}][ {MARK}]$").to_numpy(zero_copy_only=False)
    if pc.any(odd).as_py():
        rows = pc.if_else(odd, texts, None).to_pylist()
        cut = [t if t is None else [s[1:] for s in SEGMENT.findall(MARK + t.replace(" ", MARK))] for t in rows]
        lists = pc.if_else(odd, pa.array(cut, lists.type), lists)
    return encoded(lists), lone


def lengths(names: list[str], model: str) -> list[int]:
    """Token counts of segments that are given without their first mark."""
    return [len(ids) for ids in processor(model).encode(names, num_threads=1)] if names else []


def frequent_segments(docs: DataFrame, text: str) -> list[str]:
    """Segments that a bounded sample of texts repeats, the most frequent first, at most FREQUENT of at most LONGEST bytes.

    Which rows are taken decides where a segment's count is found, not what it is.
    """
    some = docs.select(text).filter(F.octet_length(text) <= SAMPLE_BYTES).head(SAMPLE_ROWS)
    words, _ = segments(pa.array([r[0] for r in some], pa.string()))
    counts = np.bincount(words.ids, minlength=len(words.vocabulary)).tolist()
    several = [(-n, s) for n, s in zip(counts, words.vocabulary.to_pylist()) if n > 1 and len(s.encode()) <= LONGEST]
    return [s for _, s in sorted(several)[:FREQUENT]]


def length_table(docs: DataFrame, text: str, model: str) -> Broadcast:
    """The frequent segments and their token counts as bytes, sizes and counts, under a name of their own."""
    names = frequent_segments(docs, text)
    raw, offsets = text_bytes(large_text(pa.array(names, pa.large_string())))
    counts = np.asarray(lengths(names, model), np.uint16)
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, raw.tobytes(), np.diff(offsets).astype(np.uint8), counts))


_tables: dict[str, tuple[str, dict[str, int], dict[str, int]]] = {}


def tiers(model: str, table: Broadcast) -> tuple[dict[str, int], dict[str, int]]:
    """A worker's table of frequent segments and its cache of others, kept from task to task."""
    name, raw, sizes, counts = table.value
    if model not in _tables or _tables[model][0] != name:
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        known = {raw[e - s : e].decode(): n for e, s, n in zip(ends, sizes.tolist(), counts.tolist())}
        _tables[model] = (name, known, {})
    return _tables[model][1:]


def count_tokens(
    docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", limit: int = 4096
) -> DataFrame:
    """Per document id, ``n_bytes``, ``n_tokens`` as the library gives them for the whole text, ``over_limit``."""
    docs = docs.select(id, text)
    table = length_table(docs, text, model)

    def start():
        known, cache = tiers(model, table)

        def measure(piece: pa.RecordBatch) -> pa.Array:
            texts = large_text(piece.column(text))
            words, lone = segments(texts)
            names = words.vocabulary.to_pylist()
            found = [known.get(s) or cache.get(s) for s in names]
            missing = [s for s, n in zip(names, found) if n is None]
            if len(cache) + len(missing) > CACHED:
                cache.clear()
            new = dict(zip(missing, lengths(missing, model)))
            cache.update(new if len(new) <= CACHED else {})
            sizes = np.fromiter((new[s] if n is None else n for s, n in zip(names, found)), np.int64, len(names))
            total = words.per_text(sizes[words.ids] if len(words.ids) else np.zeros(0, np.int64)) + lone
            return struct_of(n_bytes=np.diff(text_bytes(texts)[1]), n_tokens=total)

        return measure

    kind = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = add_column(docs, text, "counted", kind, start, keep=[id])
    return out.select(id, "counted.*", (F.col("counted.n_tokens") > limit).alias("over_limit"))
