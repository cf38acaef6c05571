"""The registered queries over the smallest tables, and the pipeline's stages."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from checks.compare import canonical, connect
from tidewatch.llm import byte_bpe
from tidewatch.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_each_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "simhash near-duplicates"


def test_queries_like_their_sql(spark):
    con = connect(SF)
    for name, sql in ORACLES.items():
        assert canonical(QUERIES[name](spark, SF).toPandas()) == canonical(con.sql(sql).df()), name


def test_shards_law(spark):
    rows = QUERIES["op9_histogram_sort"](spark, SF).collect()
    assert {r.law for r in rows} == {"bytes"} and {r.shard for r in rows} <= set(range(16))
    assert all(r.grown_shard is None for r in rows)


def test_pipeline_stages(spark, hard_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns
        stay = {(r.doc_id, r.text) for r in docs.collect()}
        assert stay <= {(r.doc_id, r.text) for r in before.collect()}
    assert 0 < len(stay) < len(rows)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in stay)
    for r in out:
        ids = library.encode_ordinary(rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_pipeline_stages_on_odd_rows(spark, hard_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, hard_docs, SF)
        assert out.columns == hard_docs.columns and out.count() <= hard_docs.count()
        assert stage(spark, no_docs, SF).count() == 0
