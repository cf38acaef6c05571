"""Token counts, binary token files and byte-level BPE against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from tidewatch.llm import bitplanes, byte_bpe, token_counts


def test_counts_like_the_library(hard_docs, no_docs, vocabulary):
    model = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = token_counts.count_tokens(hard_docs, model, limit=100).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in hard_docs.collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert token_counts.count_tokens(no_docs, model).count() == 0


@pytest.mark.parametrize("width", [1, 8])
def test_planes_round_trip(width):
    rng = np.random.default_rng(1)
    for ids in ([0], [0, 0, 0], [2**32 - 1, 0, 7], rng.integers(0, 50_000, 1000), rng.integers(0, 2**32, 77)):
        ids = np.asarray(ids, np.uint32)
        assert (bitplanes.from_planes(bitplanes.planes(ids, width), len(ids), width) == ids).all()


@pytest.mark.parametrize("width,shard_bytes", [(1, 24 << 20), (8, 3000)])
def test_files_hold_what_the_library_gives(hard_docs, no_docs, vocabulary, width, shard_bytes):
    path = vocabulary("word_bpe_49k.json")
    folder = bitplanes.new_folder(hard_docs)
    shards = bitplanes.write_shards(hard_docs, folder, path, 2, width=width, shard_bytes=shard_bytes)
    rows = sorted(bitplanes.read_documents(shards, folder).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    library = bitplanes.tokenizer(path)
    want = []
    for r in hard_docs.collect():
        tokens = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((-1 if r.doc_id is None else r.doc_id, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == sorted(want)
    empty = bitplanes.new_folder(no_docs)
    assert bitplanes.read_documents(bitplanes.write_shards(no_docs, empty, path, 2), empty).count() == 0


@pytest.fixture(scope="module")
def ranks(vocabulary):
    return byte_bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))


@pytest.mark.parametrize("frequent", [300_000, 5])
def test_bpe_like_the_library_and_back(spark, hard_docs, no_docs, ranks, frequent):
    docs = hard_docs  # among them a word of 30,000 equal letters
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    found = byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, decoded=True, frequent=frequent)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, bytes(r.decoded).decode(), r.ids) for r in found.collect()), key=key)
    want = sorted(((r.doc_id, r.text or "", library.encode_ordinary(r.text or "")) for r in docs.collect()), key=key)
    assert got == want
    again = byte_bpe.decode_documents(found, ranks, name="again").filter("again <=> decoded").count()
    assert again == docs.count()
    assert byte_bpe.encode_documents(no_docs, ranks, public_tokenizers.PATTERN).count() == 0


def test_long_word(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    letters = random.Random(2)
    text = "ab" * 1500 + "é" * 200 + "".join(letters.choice("etaoinshr") for _ in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).first().ids == library.encode_ordinary(text)


def test_plans_do_not_spell_out_the_ranks(spark, ranks):
    """The driver describes and keeps the plan of each run, and the ranks as text are more than a megabyte."""
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    plans = byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)._jdf.queryExecution()
    assert len(plans.toString()) < 100_000
    carried = [c for node in plans.optimizedPlan().toString().splitlines() if "Project" in node for c in node.split(" AS ")[1:]]
    assert not any(c.startswith("ranks#") for c in carried)  # no row has them


def test_word_table_leaves_out_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(byte_bpe, "word_hashes", lambda words: np.array([len(w) for w in words.to_pylist()], np.uint64))
    words = pa.table({"word": ["dddd", "a", "ccc", "bb", "ee", "ff"], "ids": [[4], [1], [3, 3], [2], [5], [6]]})
    table = byte_bpe.WordTable(byte_bpe.word_table(words))
    assert table.hashes.tolist() == [1, 3, 4] and table.words.to_pylist() == ["a", "ccc", "dddd"]
    known, ids = table.look_up(pa.array(["ff", "ccc", "zz", "a", "b"]))
    assert known.tolist() == [False, True, False, True, False] and ids.to_pylist() == [[3, 3], [1]]
    assert len(byte_bpe.WordTable(byte_bpe.word_table(words.slice(0, 0))).hashes) == 0


def test_short_words_fold_like_joining_the_lowest_pair_each_time(spark):
    rng = random.Random(3)
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
    while len(ranks) < 60:  # not as a trained vocabulary has them: joins may make pairs of lower rank
        ranks.setdefault(bytes(rng.choices(b"abc", k=rng.randint(2, 5))), rng.randrange(1000, 100_000) * 100 + len(ranks))
    words = [bytes(rng.choices(b"abc", k=k)) for k in (1, 2, 3, 5, 9, 20, byte_bpe.SHORT) for _ in range(20)] + [b"d", b"ad"]

    def joined(word):
        parts = [word] if word in ranks else [bytes([c]) for c in word]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks.get(p, byte_bpe.UNRANKED) for p in parts]

    rows = byte_bpe.with_ranks(spark.createDataFrame([([w.hex().upper() for w in words],)], "words array<string>"), ranks)
    folded = byte_bpe.fold_words(F.col("words"), F.col("ranks"))
    assert rows.select(folded).first()[0] == [joined(w) for w in words]
    # a step puts one list together; the parts and their ranks were two, each with copies of its own
    plan = rows.select(F.transform("words", lambda w: byte_bpe.fold_word(w, F.col("ranks")).isNull()))
    assert "flatten(" in plan._jdf.queryExecution().analyzed().toString()
