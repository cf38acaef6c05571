"""Token ids of a corpus in binary shard files whose blocks are stored as compressed bit or byte planes.

A shard file, all numbers little-endian:

    magic       8 bytes  b"TWPLANE1"
    chunks      of BLOCK ids each (the last may be shorter): for each plane its zstandard frame
    index       for each chunk: ids u32, planes u32, and for each plane the size of its frame u32
    documents   for each document in order: doc_id i64, is null u8, ids u32
    footer      32 bytes: number of chunks u32, of documents u32, place of the index u64, of the documents u64,
                plane width in bits u32 (1 or 8), crc32 of index and documents u32

A plane holds the same bit (or byte) of all ids of a chunk, lowest first; planes above the highest that is not zero are
left out. Neighbouring ids share their high bits, so those planes shrink to almost nothing.

Documents are stored in ascending order of id over all shards, null ids first, rows of one id by the hash of their text.
Each document's ids end with ``end_id``. Null texts are empty: the end id alone. Repeated rows are stored each time. An
empty table gives no shard and no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.store import shared_folder, written
from tidewatch.llm.words import AS_IS, LOWER, large_text, pieces, released, split_words, text_sums

MAGIC = b"TWPLANE1"
MARKS = ".,;:!?"
FOOTER = struct.Struct("<IIQQII")
BLOCK = 1 << 16  # ids in a chunk
SHARD_BYTES = 24 << 20  # of text in a shard, about
PIECE = 8 << 20  # bytes of text encoded at a time
CACHED = 1_000_000  # words whose ids a worker remembers

_tokenizers: dict[str, object] = {}
_encoders: dict[str, WordEncoder] = {}


def tokenizer(path: str):
    """The library's tokenizer for a file, one per worker."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


class WordEncoder:
    """Ids of whole texts from a tokenizer that drops white space, so that it can encode word by word.

    Words are cut at ASCII white space. Each different word of a piece is encoded once by the library. A bounded number
    of words is remembered, those of the latest piece when there are too many: they include the frequent ones.
    """

    def __init__(self, path: str) -> None:
        self.library = tokenizer(path)
        self.cache: dict[str, bytes] = {}
        if self.ids_of(["a \t\n b's, éü D"])[0] != b"".join(self.ids_of(["a", "b's", ",", "éü", "d"])):
            raise ValueError("the tokenizer keeps blanks or case, so that texts can't be encoded word by word")

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of each word as 32-bit integers. A word of lower-case letters only is one piece for the merges, which
        the library's model takes without its normalizer and splitter."""
        merge, out, rest = self.library.model.tokenize, dict.fromkeys(words, b""), []
        for word in words:
            if is_plain(word):
                piece = word if word.isascii() else "".join([BYTE_CHARS[b] for b in word.encode()])
                out[word] = array("I", [t.id for t in merge(piece)]).tobytes()
            else:
                rest.append(word)
        for word, found in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False)):
            out[word] = array("I", found.ids).tobytes()
        return list(out.values())

    def look_up(self, names: list[str]) -> list[bytes]:
        """The ids of different words. A mark after a letter is a token apart, so such words are encoded without it."""
        parts = [self.cache.get(n) for n in names]
        missing = [n for n, ids in zip(names, parts) if ids is None and n]
        ends = [n[-1] if n[-1:] in MARKS and n[-2:-1].isalpha() else "" for n in missing]
        stems = [n[:-1] if end else n for n, end in zip(missing, ends)]
        unknown = [n for n in {*stems, *ends} if n and n not in self.cache]
        new = dict(zip(unknown, self.ids_of(unknown)))
        known = {**{n: self.cache[n] for n in {*stems, *ends} if n and n not in new}, "": b"", **new}
        new |= {n: known[stem] + known[end] for n, stem, end in zip(missing, stems, ends)}
        parts = [(new[n] if n else b"") if ids is None else ids for n, ids in zip(names, parts)]
        if len(self.cache) + len(new) <= CACHED:
            self.cache.update(new)
        else:
            self.cache = dict(zip(names[:CACHED], parts))
        return parts

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and the number of ids of each text."""
        texts = large_text(texts)
        # the tokenizer reads lower case, but its special strings, which begin so, as they are
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        words = split_words(texts, AS_IS if special else LOWER)
        parts = self.look_up(words.vocabulary.to_pylist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        table = np.frombuffer(b"".join(parts), np.uint32)
        firsts = np.cumsum(sizes) - sizes
        per_word = sizes[words.ids]
        per_text = text_sums(per_word, words.starts, words.ends) + 1
        # each word's ids are copied from the table to their place; an end id stands after each text
        owner = np.repeat(np.arange(len(words.ends)), words.counts)
        targets = np.cumsum(per_word) - per_word + owner
        out = np.full(int(per_text.sum()), end_id, np.uint32)
        inside = np.arange(int(per_word.sum())) - np.repeat(np.cumsum(per_word) - per_word, per_word)
        out[np.repeat(targets, per_word) + inside] = table[np.repeat(firsts[words.ids], per_word) + inside]
        return out, per_text


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable in Latin-1,
    the others in order from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


BYTE_CHARS = byte_chars()


def is_plain(word: str) -> bool:
    """Whether the word is letters that the normalizer leaves as they are."""
    return word.isalpha() and word == word.lower() and (word.isascii() or unicodedata.is_normalized("NFC", word))


def encoder(path: str) -> WordEncoder:
    """One per worker; later tasks find its words again."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def planes(ids: np.ndarray, width: int) -> list[bytes]:
    """The planes of a chunk, lowest first, without the zero planes above the highest that is not zero."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if width == 8:
        return [raw[:, b].tobytes() for b in range((top + 7) // 8)]
    bits = np.unpackbits(raw, axis=1, bitorder="little", count=top) if top else np.zeros((len(ids), 0), np.uint8)
    return [np.packbits(bits[:, b]).tobytes() for b in range(top)]


def from_planes(stored: list[bytes], n: int, width: int) -> np.ndarray:
    """The ids of a chunk from its planes."""
    raw = np.zeros((n, 4), np.uint8)
    if width == 8:
        for b, plane in enumerate(stored):
            raw[:, b] = np.frombuffer(plane, np.uint8)
    elif stored:
        bits = np.zeros((n, 32), np.uint8)
        for b, plane in enumerate(stored):
            bits[:, b] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class ShardWriter:
    """Writes one shard file, a chunk at a time."""

    def __init__(self, stream, width: int) -> None:
        import zstandard

        self.stream, self.width, self.place = stream, width, 0
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.rest = np.zeros(0, np.uint32)
        self.index, self.documents, self.n_chunks, self.n_documents = bytearray(), bytearray(), 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.place += len(data)

    def _chunk(self, ids: np.ndarray) -> None:
        frames = [self.compressor.compress(p) for p in planes(ids, self.width)]
        for frame in frames:
            self._put(frame)
        self.index += struct.pack(f"<II{len(frames)}I", len(ids), len(frames), *map(len, frames))
        self.n_chunks += 1

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        for doc_id, n in zip(doc_ids, counts.tolist()):
            self.documents += struct.pack("<qBI", doc_id or 0, doc_id is None, n)
        self.n_documents += len(doc_ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            self._chunk(ids[at : at + BLOCK])
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._chunk(self.rest)
        index_at, documents_at = self.place, self.place + len(self.index)
        tail = bytes(self.index) + bytes(self.documents)
        self._put(tail)
        footer = (self.n_chunks, self.n_documents, index_at, documents_at, self.width, zlib.crc32(tail))
        self._put(FOOTER.pack(*footer))
        self.stream.close()


def read_shard(stream) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """Document ids, their numbers of ids, and the ids chunk by chunk, from an open shard file."""
    import zstandard

    size = stream.size()
    stream.seek(size - FOOTER.size)
    n_chunks, n_documents, index_at, documents_at, width, crc = FOOTER.unpack(stream.read(FOOTER.size))
    stream.seek(index_at)
    tail = stream.read(size - FOOTER.size - index_at)
    stream.seek(0)
    if stream.read(len(MAGIC)) != MAGIC or zlib.crc32(tail) != crc:
        raise ValueError("not a shard file, or damaged")
    row = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])
    documents = np.frombuffer(tail, row, n_documents, documents_at - index_at)
    doc_ids = [None if null else i for i, null in zip(documents["id"].tolist(), documents["null"].tolist())]

    def chunks() -> Iterator[np.ndarray]:
        decompressor, place, at = zstandard.ZstdDecompressor(), len(MAGIC), 0
        for _ in range(n_chunks):
            n, k = struct.unpack_from("<II", tail, at)
            sizes = struct.unpack_from(f"<{k}I", tail, at + 8)
            at += 8 + 4 * k
            stream.seek(place)
            stored = []
            for frame in sizes:
                stored.append(decompressor.decompress(stream.read(frame)))
            place += sum(sizes)
            yield from_planes(stored, n, width)

    return doc_ids, documents["n"].astype(np.int64), chunks()


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder named by URI or path; it must be one that the executors' Python reaches."""
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else "/" + folder)


def uri(folder: str) -> str:
    """``file:/x`` as ``file:///x``, as Arrow wants it."""
    return "file:///" + folder[5:].lstrip("/") if folder.startswith("file:") else folder


def write_shards(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    id: str = "doc_id",
    text: str = "text",
    width: int = 1,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode all documents and write them to shard files in ``folder``. Returns one row per shard: ``shard`` (in the
    order of ids), ``path``, ``n_documents``, ``n_ids``.

    Rows are dealt to shards by ranges of id, so that shards follow each other. A file is written under a name of its
    own attempt and moved into place when complete: a repeated task replaces the file with the same bytes.
    """
    if width not in (1, 8):
        raise ValueError("width is 1 (bit planes) or 8 (byte planes)")
    folder = uri(folder)
    docs = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.lit(0)).alias("n")).first()
    shards = max(1, -(-total["n"] // shard_bytes))
    order: list[Column] = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.repartitionByRange(int(shards), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        words = encoder(tokenizer_path)
        files, top = opened(folder)
        files.create_dir(top, recursive=True)
        place = f"{top}/shard-{task.partitionId():07d}.twp"
        attempt = f"{place}.{task.taskAttemptId()}"
        writer, n_ids, n_documents = None, 0, 0
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                ids, counts = words.encode(piece.column("text"), end_id)
                writer = writer or ShardWriter(files.open_output_stream(attempt), width)
                writer.add(piece.column("id").to_pylist(), counts, ids)
                n_ids += len(ids)
                n_documents += len(counts)
        if writer:
            writer.close()
            files.move(attempt, place)
            yield pa.RecordBatch.from_pydict(
                {"shard": [task.partitionId()], "path": [place], "n_documents": [n_documents], "n_ids": [n_ids]}
            )

    # written at once: the files are made once, and later steps start from this table
    return written(dealt.mapInArrow(released(write), "shard long, path string, n_documents long, n_ids long"))


def with_starts(shards: DataFrame, per_group: int = 4096) -> DataFrame:
    """Adds ``start``, the ids in all shards before. Sums of groups of shards are added up first."""
    from pyspark.sql import Window

    group = F.floor(F.col("shard") / per_group)
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("group", group)
    groups = shards.groupBy("group").agg(F.sum("n_ids").alias("n"))
    groups = groups.select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = shards.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(groups, "group")
    return out.select("shard", "path", "n_documents", "n_ids", (F.col("base") + F.col("inside")).alias("start"))


def read_documents(shards: DataFrame, folder: str, id: str = "doc_id") -> DataFrame:
    """From the shard files, per document: id, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids_crc32`` (of its ids as little-endian unsigned 32-bit integers)."""
    folder = uri(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with files.open_input_file(path) as stream:
                    doc_ids, counts, chunks = read_shard(stream)
                    sums = checksums(counts, chunks)
                starts = start + np.cumsum(counts) - counts
                columns = [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, names=[id, "start", "n_tokens", "ids_crc32"])

    n = max(1, shards.sparkSession.sparkContext.defaultParallelism)
    placed = with_starts(shards).repartition(4 * n, "shard")
    return placed.select("path", "start").mapInArrow(released(read), f"`{id}` long, start long, n_tokens long, ids_crc32 long")


def checksums(counts: np.ndarray, chunks: Iterator[np.ndarray]) -> list[int]:
    """crc32 of each document's ids, from ids that arrive chunk by chunk."""
    out: list[int] = []
    rest = np.zeros(0, "<u4")
    crc = 0
    left = iter(counts.tolist())
    wanted = next(left, None)
    for chunk in chunks:
        rest = chunk
        while wanted is not None and wanted <= len(rest):
            out.append(zlib.crc32(rest[:wanted].tobytes(), crc))
            rest, crc, wanted = rest[wanted:], 0, next(left, None)
        if wanted is not None and len(rest):
            crc, wanted = zlib.crc32(rest.tobytes(), crc), wanted - len(rest)
    return out


def new_folder(docs: DataFrame) -> str:
    """A folder for shard files that all executors reach."""
    return uri(shared_folder(docs.sparkSession) + "-shards")
