import zlib

import pytest

from tidewatch.llm import histogram_sort as H


def placed(docs, shards, **options):
    rows = H.shard_documents(docs, shards, **options).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return rows, by


def test_sizes_are_near_equal_and_groups_whole(spark, monkeypatch):
    monkeypatch.setattr(H, "RUN_ROWS", 100)
    texts = [f"text {i % 1500} " * (1 + i % 7) for i in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows, by = placed(docs, 8, tolerance=0.05)
    assert len(rows) == 4000 and sorted(by) == list(range(8))
    total = sum(r.size for r in rows)
    for own in by.values():
        assert sum(r.size for r in own) == pytest.approx(total / 8, rel=0.11)
    shards = {}
    for r in rows:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_a_group_with_most_rows_is_cut(spark):
    texts = ["the same text"] * 3000 + [f"other {i}" for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, by = placed(docs, 16)
    total = sum(r.size for r in rows)
    assert all(sum(r.size for r in own) == pytest.approx(total / 16, rel=0.05) for own in by.values())


def test_equal_rows_stay_together(spark):
    docs = spark.createDataFrame([(7, "same")] * 50 + [(None, None)] * 3, "doc_id long, text string")
    rows, _ = placed(docs, 4)
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1 and len(rows) == 53


def test_odd_rows(hard_docs, no_docs):
    rows, _ = placed(hard_docs, 16)
    want = [(r.doc_id or -1, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in hard_docs.collect()]
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == sorted(want)
    assert H.shard_documents(no_docs).count() == 0


def test_runs_are_cut_by_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "RUN_ROWS", 200)
    texts = [None] * 3000 + [f"long text {i} " * 40 for i in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = H.measured(docs, "doc_id", "text").cache()
    runs = H.dealt(rows, H.find_splitters(rows, 4)).groupBy("run").count().collect()
    assert max(r["count"] for r in runs) <= 300 and sum(r["count"] for r in runs) == 4000
    placed(docs, 4)
