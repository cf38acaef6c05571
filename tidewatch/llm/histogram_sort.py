"""Shards of near equal bytes by histogram sort.

Rows are ordered by a key. Candidate boundaries (probes) are spread over the key space; one pass counts the exact bytes
below each of them over all partitions. Each wanted splitter lies between two probes, which are the range for the next
round's probes, until a probe meets the wanted number of bytes within a tolerance or the range holds a single key. Then
rows are dealt out once. In the same rounds the order is cut into runs by counts of rows, so that many tasks number the
rows of a shard, however small these rows are.

The key is (hash of the text, hash of the id, id), so equal texts are neighbours. A splitter between groups of equal
texts that meets the tolerance is taken before one inside a group, so only a group too large for that is cut.

Size is the UTF-8 bytes of the text plus 1. Null texts have size 1 and hash apart from empty ones. Null ids are taken as
the smallest id. Rows that agree in id and text stay together, whatever their size and number. An empty table gives an empty
table. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.store import written

TOLERANCE = 0.002  # of a shard's bytes
LOOSE = 0.25  # of a run's rows
RUN_ROWS = 50_000  # rows that one task puts in order, about
PROBES = 4096  # in a round, shared out to the splitters; each gets MIN_PROBES at least
MIN_PROBES = 4
GROUP = 1 << 64  # keys of one text hash


def measured(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Narrow rows: id, size, crc and the two parts of the key."""
    text_, id_ = F.col(text), F.col(id).cast("bigint")
    return docs.select(
        id_.alias("id"),
        (F.coalesce(F.octet_length(text_), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text_, F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(text_, F.col(text).isNull()).alias("k1"),
        F.xxhash64(id_, F.lit(9)).alias("k2"),
    )


@dataclass
class Splitter:
    """The search for the first key of a part. Keys are whole numbers of 128 bits: hash of the text, hash of the id.

    Rows below ``low`` have ``under`` bytes, rows below ``high`` have ``over`` bytes; or so many rows, for runs.
    """

    target: float
    slack: float
    measure: str
    low: int = 0
    high: int = GROUP * GROUP
    under: int = 0
    over: int = 0
    found: bool = False

    def probes(self, n: int) -> list[int]:
        """Up to ``n`` keys inside the range: borders of groups, or keys inside a group when no border is left."""
        if self.found:
            return []
        step = GROUP if self.low // GROUP + 1 <= (self.high - 1) // GROUP else 1
        first, last = self.low // step + 1, (self.high - 1) // step
        count = last - first + 1
        picked = range(first, last + 1) if count <= n else (first + count * i // (n + 1) for i in range(1, n + 1))
        return [i * step for i in picked]

    def learn(self, below: dict[int, dict[str, int]], probes: list[int]) -> None:
        """Narrow the range to the neighbouring probes; done when one of them is near enough."""
        for key in probes:
            found = below[key][self.measure]
            if found <= self.target and key > self.low:
                self.low, self.under = key, found
            elif found > self.target and key < self.high:
                self.high, self.over = key, found
        self.found = min(self.target - self.under, self.over - self.target) <= self.slack or not self.probes(1)

    @property
    def key(self) -> int:
        """The end of the range that is nearer to the target."""
        return self.low if self.target - self.under <= self.over - self.target else self.high


def sortable(keys: list[int]) -> np.ndarray:
    """Keys as 16 bytes that compare like the keys."""
    return np.frombuffer(b"".join(min(k, GROUP * GROUP - 1).to_bytes(16, "big") for k in keys), "S16")


def row_keys(batch: pa.RecordBatch) -> np.ndarray:
    """The keys of rows in the same form; the sign bit is flipped, so that signed hashes compare like unsigned ones."""
    parts = np.stack([batch.column(c).to_numpy() for c in ("k1", "k2")], axis=1) ^ np.int64(-(2**63))
    return np.ascontiguousarray(parts.astype(">i8")).view("S16").reshape(-1)


def below_probes(rows: DataFrame, probes: list[int]) -> dict[int, dict[str, int]]:
    """Exact ``bytes`` and ``rows`` below each probe. A task adds up its rows between neighbouring probes; the driver
    gets one sum for each gap."""
    borders = rows.sparkSession.sparkContext.broadcast(sortable(probes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, times = np.zeros((2, len(borders.value) + 1), np.int64)
        for batch in batches:
            gaps = np.searchsorted(borders.value, row_keys(batch), side="right")
            np.add.at(sums, gaps, batch.column("size").to_numpy())
            times += np.bincount(gaps, minlength=len(times))
        some = np.flatnonzero(times)
        columns = [pa.array(x.astype(np.int64)) for x in (some, sums[some], times[some])]
        yield pa.RecordBatch.from_arrays(columns, names=["gap", "bytes", "rows"])

    found = rows.select("k1", "k2", "size").mapInArrow(count, "gap long, bytes long, rows long")
    gaps = np.zeros((2, len(probes) + 1), np.int64)
    for row in found.groupBy("gap").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect():
        gaps[:, row["gap"]] = row["bytes"], row["rows"]
    borders.unpersist()
    sums, times = np.cumsum(gaps, axis=1)[:, :-1].tolist()
    return {key: {"bytes": b, "rows": n} for key, b, n in zip(probes, sums, times)}


@dataclass
class Splitters:
    shards: list[int]  # the first key of each shard but the first
    runs: list[int]  # keys that cut the order into runs; those of shards are among them


def find_splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> Splitters:
    """Borders of shards are searched by bytes, to ``tolerance``; those of runs by rows, only loosely."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()

    def cut(parts: int, measure: str, slack: float) -> list[Splitter]:
        share = total[measure] / parts
        return [Splitter(share * i, slack * share, measure, over=total[measure]) for i in range(1, parts)]

    runs = max(1, math.ceil(total["rows"] / RUN_ROWS))
    search = cut(shards, "bytes", tolerance) + cut(runs, "rows", LOOSE)
    n = max(MIN_PROBES, PROBES // max(1, len(search)))
    while open_ := [(s, p) for s in search if (p := s.probes(n))]:
        below = below_probes(rows, sorted({key for _, p in open_ for key in p}))
        for s, p in open_:
            s.learn(below, p)
    firsts = sorted(s.key for s in search if s.measure == "bytes")
    return Splitters(firsts, sorted({*firsts, *(s.key for s in search)}))


def dealt(rows: DataFrame, splitters: Splitters) -> DataFrame:
    """Adds ``shard`` and ``run``, by the last splitter at or below a row's key."""
    shared = rows.sparkSession.sparkContext.broadcast((sortable(splitters.shards), sortable(splitters.runs)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = row_keys(batch)
            shard, run = (np.searchsorted(borders, keys, side="right") for borders in shared.value)
            columns = [*batch.columns, pa.array(shard, pa.int32()), pa.array(run, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "shard", "run"])

    kind = "id long, size long, crc long, k1 long, k2 long, shard int, run long"
    return rows.select("id", "size", "crc", "k1", "k2").mapInArrow(deal, kind)


def shard_documents(
    docs: DataFrame, shards: int = 16, id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE
) -> DataFrame:
    """Per document: id, ``size``, ``text_crc32``, ``shard`` and ``slot``, its place in the shard in order of keys."""
    rows = written(measured(docs, id, text))
    placed = dealt(rows, find_splitters(rows, shards, tolerance))
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order: list[Column] = [F.col(c).asc() for c in ("k1", "k2", "id")]
    inside = placed.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(*order)) - 1)
    out = inside.join(bases, "run")
    slot = (F.col("base") + F.col("place")).cast("bigint").alias("slot")
    return out.select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), "shard", slot)
