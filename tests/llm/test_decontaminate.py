import re

from pyspark.sql import functions as F

from tidewatch.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        size = min(window, len(w))
        wanted = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(own) - size + 1):
            if size and tuple(own[i : i + size]) in wanted:
                hit.update(range(i, i + size))
                found.add("null" if name is None else str(name))
    return len(own), len(hit), sorted(found)


ITEMS = [(1, "a b a b a c a b a d"), (2, "a b"), (2, "one two three one two"), (3, ""), (4, None), (10, "The the"), (None, "no id"), (11, "b a b a c q r s t u v")]


def check(spark, docs, window, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = D.find_matches(docs, items, window=window, keep=["doc_id", "text"], block_bytes=block_bytes)
    rows = found.select("doc_id", "text", "found", D.hit_words(F.col("found.spans")).alias("hits")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.found.n_words, r.hits, r.found["items"]) == brute(r.text, ITEMS, window), r.text[:80]
    return rows


def test_windows_and_short_items_like_brute_force(spark, hard_docs):
    check(spark, hard_docs, 4, 8 << 20)


def test_several_blocks_give_the_same(spark, hard_docs):
    check(spark, hard_docs, 4, 20)


def test_many_overlaps(spark):
    texts = ["a b a b a c a b a d a b", "c a b a c a b a d b a b a c q r s t u v w", "B A b, A c-q r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window in (2, 3, 5, 13):
        check(spark, docs, window, 8 << 20)


def test_spans_are_cut_and_documents_dropped(spark):
    rows = [(1, "One, two three one two and " + "much else " * 60), (2, "one two three one two"), (3, "x"), (4, None)]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, found string")
    items = spark.createDataFrame([(7, "one two three one two")], "item_id long, text string")
    out = {r.doc_id: r for r in D.decontaminate(docs, items).collect()}
    assert sorted(out) == [1, 3, 4] and out[1].text == rows[0][1] and out[1].found == "kept"
    cut = {r.doc_id: r.text for r in D.decontaminate(docs, items, longest_span=4).collect()}
    assert cut[1] == " and " + "much else " * 60 and cut[4] is None


def test_empty_tables(spark, hard_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.decontaminate(no_docs, items).count() == 0
    assert D.decontaminate(hard_docs, items.limit(0)).count() == hard_docs.count()
