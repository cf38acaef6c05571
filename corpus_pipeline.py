"""A training-data pipeline over ``documents``: toxic and low-quality documents go, one document of each near-duplicate
group stays, contaminated documents go, the rest is tokenized.

Every stage but the last returns the columns of ``documents``. Toxicity and quality models learn only from labels of
documents whose crc32(doc_id as text) mod 5 is not 0, from a bounded sample that their modules document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, quality_rules, simhash, toxicity
from tidewatch.llm.queries import encoded_documents, labels_for_training, table
from tidewatch.llm.store import written
from tidewatch.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention network scores 0.5 or more go."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels_for_training(spark, sf_dir)))


def without_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the learned decision list go."""
    return quality_rules.drop_low_quality(docs, quality_rules.fit(docs, labels_for_training(spark, sf_dir)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the smallest id stays."""
    return simhash.keep_one(docs)


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which at least one word in 20 lies in a passage of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of each document and of their decoding."""
    return encoded_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("quality rules", without_low_quality),
    ("simhash near-duplicates", without_copies),
    ("decontamination", without_contaminated),
    ("byte-level BPE", tokenized),
]

# The stages run trained models and a tokenizer, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again as the next one's documents."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
