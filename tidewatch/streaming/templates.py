"""Drain inside a stream: log rows get the id of their cluster as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.operators.templates import DEPTH, SIMILARITY, _greedy, leaf_of, shape, template_id
from tidewatch.sources.store import write_batch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PARTS = 64  # shares of a source's leaves; one call of the processor takes a share
BLOCK = 256  # patterns of a leaf that one value of the state holds


class LeafState(StatefulProcessor):
    """What Drain knows of a share of a source's leaves: the cluster of each shape it has met (``members``) and, for
    each leaf, the clusters' patterns in the order in which they were opened (``patterns``, in blocks).

    A shape that is known costs one look-up. The others of a micro-batch are taken, leaf by leaf, in order of their
    first line, as :func:`tidewatch.operators.templates.learn_clusters` does, on top of the patterns so far. Most leaves
    of free text hold a single shape, and a call of the processor costs far more than a look-up, so a call takes many.
    """

    def __init__(self, columns: list[str], similarity: float, forget_after: int | None) -> None:
        self.columns = columns
        self.similarity = similarity
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.members = handle.getMapState("members", "shape_id string", "template_id string", self.forget_after)
        self.patterns = handle.getMapState(
            "patterns", "leaf string, block bigint", "template_ids array<string>, templates array<string>"
        )

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        chunks, firsts = [], []  # of one share in one micro-batch, whose size the source's rate limit bounds
        for chunk in rows:
            firsts.append(self._firsts(chunk))
            chunks.append(chunk[self.columns])
        shapes = self._firsts(pd.concat(firsts), seen="first_seen")
        ids: dict[str, str] = {}
        met = self.members.exists()
        for name in shapes["template_id"] if met else ():
            found = self.members.getValue((name,))
            if found is not None:
                ids[name] = found[0]
                if self.forget_after is not None:  # it was seen again
                    self.members.updateValue((name,), (ids[name],))
        new = shapes[~shapes["template_id"].isin(list(ids))]
        new = new.sort_values(["first_seen", "line_number", "template_id"], na_position="first")
        leaves: dict[str, list[tuple[str, str]]] = {}
        for leaf, name, template in zip(new["leaf"], new["template_id"], new["template"]):
            leaves.setdefault(leaf, []).append((name, template))
        met = self.patterns.exists()  # patterns stay when members are forgotten
        for leaf, fresh in leaves.items():
            ids |= self._learn(leaf, fresh, met)
        for chunk in chunks:
            yield chunk.assign(template_id=chunk["template_id"].map(ids))

    @staticmethod
    def _firsts(chunk: pd.DataFrame, seen: str = "timestamp") -> pd.DataFrame:
        """Per shape its first time, and the line that comes first, lines without a time before others."""
        lines = chunk.sort_values(["timestamp", "line_number"], na_position="first").drop_duplicates("template_id")
        times = chunk.groupby("template_id")[seen].min()
        return lines[["leaf", "template_id", "template", "timestamp", "line_number"]].assign(
            first_seen=lines["template_id"].map(times)
        )

    def _known(self, leaf: str) -> list[tuple[str, str]]:
        """Ids and patterns of a leaf's clusters in their order."""
        known: list[tuple[str, str]] = []
        while len(known) % BLOCK == 0:
            block = self.patterns.getValue((leaf, len(known) // BLOCK))
            if block is None:
                break
            known += zip(block[0], block[1])
        return known

    def _learn(self, leaf: str, fresh: list[tuple[str, str]], met: bool) -> dict[str, str]:
        known = self._known(leaf) if met else []
        names, texts = [name for name, _ in known], [text for _, text in known]
        if not known and len(fresh) == 1:  # a leaf's first shape opens its first cluster
            member, changed = [0], {0: fresh[0][1]}
        else:
            found = _greedy([s.split(" ") for _, s in fresh], self.similarity, [text.split(" ") for text in texts])
            member = found.member
            changed = {p: " ".join(tokens) for p, since, tokens in found.versions if since > 0}
        ids = {}
        for (name, _), m in zip(fresh, member):
            if m == len(names):
                names.append(name)
            ids[name] = names[m]
            self.members.updateValue((name,), (names[m],))
        texts += [""] * (len(names) - len(texts))
        for position, text in changed.items():
            texts[position] = text
        for block in {position // BLOCK for position in changed}:
            part = slice(block * BLOCK, (block + 1) * BLOCK)
            self.patterns.updateValue((leaf, block), (names[part], texts[part]))
        return ids

    def close(self) -> None:
        pass


def stream_templates(
    logs: DataFrame, similarity: float = SIMILARITY, depth: int = DEPTH, forget_after_days: int | None = None
) -> DataFrame:
    """A stream of log rows (source, timestamp, line_number, message, ...) with the ``template_id`` of their cluster;
    rows without a message keep a null one.

    State is kept by source and share of its leaves, so leaves of a busy source are spread over the tasks. The stream
    gives the clusters of a batch run over the same rows, as long as rows arrive in micro-batches in order. With
    ``forget_after_days`` the cluster of a shape that has not been seen for so long is dropped from the state; if it
    comes back it joins the cluster most like it then. Patterns stay.

    Start the query through :func:`write_templates` or with RocksDB as state store.
    """
    columns = [c for c in logs.columns if c != "template_id"]
    kinds = [f for f in logs.schema.fields if f.name != "template_id"]
    text = F.when(F.col("message") != "", shape(F.col("message")))
    rows = logs.select(*columns, text.alias("template"))
    rows = rows.withColumn("template_id", F.when(F.col("template").isNotNull(), template_id(F.col("source"), F.col("template"))))
    has_text = F.coalesce(F.col("message") != "", F.lit(False))  # a filter on the id would mask each message again
    plain = logs.filter(~has_text).select(*columns, F.lit(None).cast("string").alias("template_id"))
    keyed = rows.filter(has_text).withColumn("leaf", leaf_of(F.col("template"), depth))
    keyed = keyed.withColumn("__share", F.pmod(F.xxhash64("leaf"), F.lit(PARTS)))
    out = T.StructType([*kinds, T.StructField("template_id", T.StringType())])
    forget = None if forget_after_days is None else forget_after_days * 86_400_000
    found = keyed.groupBy("source", "__share").transformWithStateInPandas(
        statefulProcessor=LeafState(out.names, similarity, forget),
        outputStructType=out,
        outputMode="append",
        timeMode="None" if forget is None else "ProcessingTime",  # in the latter a query never runs out of batches
    )
    return found.unionByName(plain)


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which state with several variables needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def write_templates(logs: DataFrame, path: str, checkpoint: str, once: bool = False, **options: Any) -> StreamingQuery:
    """Log rows with cluster ids (see :func:`stream_templates`, with its options) into the log table at ``path``.

    A query that forgets shapes goes by the clock, so it cannot be run ``once``.
    """
    if once and options.get("forget_after_days") is not None:
        raise ValueError("a query that forgets by the clock does not end by itself")

    def append(batch: DataFrame, batch_id: int) -> None:
        days = [c for c in ("timestamp", "ingested_at") if c in batch.columns]
        write_batch(batch, path, batch_id, F.coalesce(*days))

    with state_in_rocksdb(logs.sparkSession):
        writer = stream_templates(logs, **options).writeStream.outputMode("append")
        writer = writer.foreachBatch(append).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
