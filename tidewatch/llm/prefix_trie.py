"""Trie of conversations by their first turns, from vertical bitmaps.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Conversations are sorted
by the digests of their turns, so a node's members are neighbours, and cut into **shards** of at most ``SHARD`` conversations.
A shard holds for each (position, turn) the bitset of its conversations with that turn there, and for each length that of
those that end there. Going down depth first, a node's bitset cut with the postings of the next position gives its children;
a count of bits gives their members, the cut with the bitset of ends the conversations that end in it. Bits are numbered by
conversation id, so the lowest bit is the smallest member and ends come out in order.

Only nodes on the way to a shard's first or last conversation can have members elsewhere (**shared** nodes). All others
are done when their shard is. Shared ones, at most twice the depth per shard, are added up by a digest of their path; what
lies below them is summed along those two ways with windows. A conversation that many others repeat is cut by id into
several shards; the lists of its ends are hashed in order, chunk by chunk.

Order of turns: by ``turn``, null first, rows with the same turn by a digest of role and text. Null roles and texts are
empty. Rows without a conversation id belong to no conversation. An empty table has no node, not even a root.
A conversation is one row of digests (16 bytes a turn). Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.store import written

SHARD = 2048  # conversations at most
SHARD_TURNS = 100_000  # about, beyond the first conversation
WIDTH = 16  # bytes of a turn's digest


def turn_lists(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per conversation its turns in order: ``conv``, ``turns`` (array of digest and chars)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * WIDTH)))
    turns = rows.filter(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("bigint").alias("conv"),
        F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.char_length(text).alias("chars")).alias("t"),
    )
    listed = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"], t["chars"]))
    return turns.groupBy("conv").agg(listed.alias("turns"))


def with_shared_beginnings(lists: DataFrame, base: Column, turns: Column, longest: int) -> DataFrame:
    """Conversations that begin with the first ``turns`` (at most ``longest``) turns of the conversation ``base`` and go
    on with their own turns after as many."""
    heads = lists.select(F.col("conv").alias("base"), F.slice("turns", 1, longest).alias("head"))
    wanted = lists.withColumns({"base": base, "h": turns})
    heads = heads.join(wanted.select("base").distinct(), "base", "left_semi")
    joined = wanted.join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv", F.concat(head, own).alias("turns"))


NODE = (
    "shard long, path binary, up binary, way int, depth long, conv_id long, parent_conv_id long, n_convs long, chars long, "
    "n_children long, n_leaves long, saved_tokens long, ends string"
)


def bits_of(bits: int) -> list[int]:
    """The numbers of the bits that are set, lowest first."""
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shard_nodes(shard: int, conversations: list[tuple[int, bytes, np.ndarray]]) -> dict[str, list]:
    """All nodes of a shard's conversations (id, digests, chars), which come in order of digests and id.

    Rows with a ``path`` are shared: they lack what other shards hold, have the ends as a list and not its hash, and
    ``n_leaves`` and ``saved_tokens`` of the nodes below them that are not shared. ``way`` tells the way they are on:
    1 to the first conversation, 2 to the last, 0 to both.
    """
    first, last = conversations[0][0], conversations[-1][0]
    conversations = sorted(conversations, key=lambda c: c[0])
    ids = [c for c, _, _ in conversations]
    edges = (1 << ids.index(first), 1 << ids.index(last))
    turns = [[key[i : i + WIDTH] for i in range(0, len(key), WIDTH)] for _, key, _ in conversations]
    postings: dict[tuple[int, bytes], int] = {}
    ends: dict[int, int] = {}
    for i, own in enumerate(turns):
        bit = 1 << i
        ends[len(own)] = ends.get(len(own), 0) | bit
        for place in enumerate(own):
            postings[place] = postings.get(place, 0) | bit

    out: dict[str, list] = {name.split()[0]: [] for name in NODE.split(", ")}
    parents: list[int] = []
    stack: list[tuple[int, int, int, bytes, int]] = [(-1, 0, (1 << len(ids)) - 1, b"", 0)]
    while stack:
        parent, depth, members, up, chars = stack.pop()
        on_first, on_last = (bool(members & e) for e in edges)
        lowest = (members & -members).bit_length() - 1
        path = None
        if on_first or on_last:
            path = hashlib.sha256(up + (turns[lowest][depth - 1] if depth else b"")).digest()[:WIDTH]
        own_ends = members & ends.get(depth, 0)
        at = len(parents)
        children, rest = 0, members ^ own_ends
        while rest:
            i = (rest & -rest).bit_length() - 1
            child = members & postings[depth, turns[i][depth]]
            rest ^= child
            children += 1
            stack.append((at, depth + 1, child, path or b"", int(conversations[i][2][depth])))
        n = members.bit_count()
        ended = ",".join(str(ids[i]) for i in bits_of(own_ends)) if own_ends else ""
        done = path is None
        up_shared = parent >= 0 and out["path"][parent] is not None
        if not done and up_shared:  # a shared parent counts its shared children when shards are added up
            out["n_children"][parent] -= 1
        parents.append(parent)
        out["shard"].append(shard)
        out["path"].append(path)
        out["up"].append(up if up_shared else None)
        out["way"].append(0 if on_first and on_last else 1 if on_first else 2)
        out["depth"].append(depth)
        out["conv_id"].append(ids[lowest])
        out["parent_conv_id"].append(out["conv_id"][parent] if parent >= 0 and not up_shared else None)
        out["n_convs"].append(n)
        out["chars"].append(chars)
        out["n_children"].append(children)
        out["n_leaves"].append(int(done and not children))
        out["saved_tokens"].append((n - 1) * chars if done else 0)
        out["ends"].append(sha256(ended) if done else ended)
    for i in range(len(parents) - 1, 0, -1):
        if out["path"][i] is None:
            for total in ("n_leaves", "saved_tokens"):
                out[total][parents[i]] += out[total][i]
    return out


def sharded(lists: DataFrame, size: int) -> DataFrame:
    """The nodes of each shard of up to ``size`` conversations, see :func:`shard_nodes`."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    keyed = lists.select("conv", key.alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    keyed = written(keyed)
    placed = keyed.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = (context.partitionId() if context else 0) << 32
        held: list[tuple[int, bytes, np.ndarray]] = []
        turns = 0

        def nodes() -> pa.RecordBatch:
            rows = shard_nodes(shard, held)
            return pa.RecordBatch.from_pydict(rows, schema=NODE_ARROW)

        for batch in batches:
            chars = batch.column("chars")
            for i, (conv, key_) in enumerate(zip(batch.column("conv").to_pylist(), batch.column("key").to_pylist())):
                own = chars[i].values.to_numpy()
                if held and (len(held) == size or turns + len(own) > SHARD_TURNS):
                    yield nodes()
                    shard, held, turns = shard + 1, [], 0
                held.append((conv, key_, own))
                turns += len(own)
        if held:
            yield nodes()

    return written(placed.mapInArrow(work, NODE))


KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
NODE_ARROW = pa.schema([(name, KINDS[kind]) for name, kind in (c.split() for c in NODE.split(", "))])


def hashed_ends(chunks: DataFrame) -> DataFrame:
    """Per path the hash of its lists of ends, joined in order of their first id. A list of any length goes by."""
    placed = chunks.repartition(F.col("path")).sortWithinPartitions("path", "first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            paths, hashes = [], []
            for path, ends in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist()):
                if path != now:
                    if now is not None:
                        paths.append(now)
                        hashes.append(state.hexdigest())
                    now, state = path, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ends.encode())
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.binary()), "ends": pa.array(hashes, pa.string())})
        if now is not None:
            yield pa.RecordBatch.from_pydict({"path": [now], "ends": [state.hexdigest()]})

    return placed.select("path", "ends").mapInArrow(work, "path binary, ends string")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def build_trie(lists: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` of the subtree (code points that members beyond the first repeat),
    ``ends_sha256`` (of the ids of the conversations that end here)."""
    nodes = sharded(lists, shard_size)
    parts = nodes.filter("path is not null")
    joined = parts.groupBy("path").agg(
        F.min("shard").alias("home"),
        F.first("up").alias("up"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.first("chars").alias("chars"),
        F.sum("n_children").alias("own_children"),
        F.sum("n_leaves").alias("own_leaves"),
        F.sum("saved_tokens").alias("own_saved"),
    )
    joined = written(joined)
    below = joined.filter("up is not null").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("shared_children"))
    joined = joined.join(below, "path", "left").withColumn(
        "n_children", F.col("own_children") + F.coalesce("shared_children", F.lit(0))
    )
    joined = joined.withColumns(
        {
            "own_leaves": F.col("own_leaves") + (F.col("n_children") == 0).cast("bigint"),
            "own_saved": F.col("own_saved") + (F.col("n_convs") - 1) * F.col("chars"),
        }
    )
    # each shared node counts once, in its home shard, for all nodes above it on that shard's two ways
    at_home = parts.select("shard", "path", "way", "depth").join(joined.select("path", "home", "own_leaves", "own_saved"), "path")
    deeper = Window.partitionBy("shard").orderBy(F.desc("depth"))  # with rows of equal depth
    same_way = Window.partitionBy("shard", "way").orderBy(F.desc("depth"))

    def total(name: str) -> Column:
        value = F.when(F.col("home") == F.col("shard"), F.col(name)).otherwise(0)
        return F.when(F.col("way") == 0, F.sum(value).over(deeper)).otherwise(F.sum(value).over(same_way))

    summed = at_home.select("path", total("own_leaves").alias("n_leaves"), total("own_saved").alias("saved_tokens"))
    summed = summed.groupBy("path").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    first = F.split_part("ends", F.lit(","), F.lit(1)).cast("bigint")
    ends = hashed_ends(parts.filter("ends != ''").select("path", first.alias("first"), "ends"))
    ups = joined.select(F.col("path").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    shared = joined.join(summed, "path").join(ends, "path", "left").join(ups, "up", "left")
    shared = shared.withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit(""), 256))).select(COLUMNS)

    known = parts.select("shard", "path").join(joined.select("path", "conv_id"), "path")
    known = known.select("shard", F.col("path").alias("up"), F.col("conv_id").alias("__conv"))
    done = nodes.filter("path is null").withColumnRenamed("ends", "ends_sha256")
    under = done.filter("up is not null").join(known, ["shard", "up"]).withColumn("parent_conv_id", F.col("__conv"))
    return shared.unionByName(done.filter("up is null").select(COLUMNS)).unionByName(under.select(COLUMNS))
