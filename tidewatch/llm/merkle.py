"""Merkle manifest of a dataset, and the proof of every row by a recursive query.

Each row is a leaf. The leaves of a group (source) in order of id form a tree whose runs of three neighbours become their
hash until one is left, the group's subroot; the subroots in order of group form one more tree, whose top is the root.

Three levels of a tree are one **block**: up to 27 neighbours, the nodes above them and their top. Blocks are stored as rows
that name the block they go up to and their place in it, so the whole tree takes less than 50 bytes a leaf. Blocks are
built level by level, each from the tops of those below.

Proofs come from two recursive queries over these rows. The first descends from the root's block and gives each block that
stands for 729 leaves or for a whole group the steps from there to the root; every block is reached by its one parent. The second
ascends for each leaf: a step joins the leaf's state with its block, appends the siblings of up to three levels, folds its
hash with them and goes up to the parent. From the 729-leaf block on, the steps found by the first query are taken in one
go. So no join key has more than 729 rows, however large a group is.

A hash is lower-case hex SHA-256 of the inputs' hex texts, one after the other; tables keep the 32 bytes.

Null groups are a group of their own, the first. Null ids come first in their group. Rows with equal ids are ordered by
their leaf hash, so repeated rows are neighbours and each is a leaf. A single row is subroot and root, with an empty proof.
An empty table gives no rows. Further columns may be kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.store import written
from tidewatch.session import config_table

RUN = 3  # fixed: nodes that become one
BLOCK = RUN**3
DIGEST = 32  # bytes
TOP_TREE = -1  # the tree over subroots; those of groups are numbered from 0 in order of group


def field(value: Column) -> Column:
    """A value as its length in bytes and its text; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def leaf_rows(docs: DataFrame, columns: list[str], id: str, group: str, changed: dict[str, Column]) -> DataFrame:
    """Narrow rows: group, id, ``leaf`` of the columns as they are and ``start`` of them as ``changed``."""
    start = leaf_hash([changed.get(c, F.col(c)) for c in columns])
    untouched = F.lit(True)
    for name, value in changed.items():
        untouched &= F.col(name).eqNullSafe(value)
    leaf = F.unhex(leaf_hash([F.col(c) for c in columns]))
    return docs.select(
        F.col(group).alias("grp"), F.col(id).alias("id"), leaf.alias("leaf"), F.when(~untouched, F.unhex(start)).alias("start")
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``tree``, the number of the row's group, ``pos``, its place in the group, and ``total``, the group's size.

    Rows are sorted once over all tasks. A task's rows of one group form a stretch; places within stretches come from
    the sort, places of stretches from their sizes. The driver gets one number for each task.
    """
    order = ["grp", "id", "leaf"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    stretches = placed.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    own = Window.partitionBy("grp")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = written(
        stretches.select(
            "*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(own).alias("total")
        )
    )
    begins = stretches.filter("before = 0")
    counts = sorted((r["part"], r["n"]) for r in begins.groupBy("part").agg(F.count("*").alias("n")).collect())
    bases, base = [], 0
    for part, n in counts:
        bases.append((part, base))
        base += n
    trees = begins.select(
        "grp", "part", (F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1).alias("own")
    ).join(config_table(rows.sparkSession, bases, "part bigint, base bigint"), "part")
    trees = trees.select(F.col("grp").alias("g"), (F.col("base") + F.col("own")).alias("tree"))
    known = stretches.join(trees, F.col("grp").eqNullSafe(F.col("g"))).select(
        F.col("part").alias("p"), "g", "tree", (F.col("before") - F.col("first")).alias("shift"), "total"
    )
    joined = placed.join(known, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return written(joined.select(*rows.columns, "tree", (F.col("at") + F.col("shift")).alias("pos"), "total"))


def next_level(level: Column) -> Column:
    """The hashes of each run of three digests, one after the other."""
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / (RUN * DIGEST)).cast("int") - 1)
    hashed = F.transform(
        runs, lambda r: F.sha2(F.lower(F.hex(F.substring(level, r * (RUN * DIGEST) + 1, F.lit(RUN * DIGEST)))), 256)
    )
    return F.unhex(F.array_join(hashed, ""))


def one_level_of_blocks(nodes: DataFrame, level: int) -> DataFrame:
    """Blocks over the nodes (tree, pos, digest, total) of a level.

    ``levels`` are the digests of the levels that are folded on the way through the block, the lowest first; ``top``
    is what they come to. The last block of a tree stops at a single node; the others go through three levels.
    """
    digests = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: F.hex(x["digest"]))
    block = F.floor(F.col("pos") / BLOCK).cast("bigint")
    found = nodes.groupBy("tree", block.alias("block")).agg(
        F.unhex(F.array_join(digests, "")).alias("l0"), F.first("total").alias("total")
    )
    for i in range(3):
        found = found.withColumn(f"l{i + 1}", next_level(F.col(f"l{i}")))
    steps = F.lit(3)
    for n, size in ((2, RUN * RUN), (1, RUN), (0, 1)):
        steps = F.when(F.col("total") <= size, n).otherwise(steps)
    kept = F.array(*[F.col(f"l{i}") for i in range(4)])
    last = F.col("total") <= BLOCK
    in_group = last & (F.col("tree") != TOP_TREE)  # a group's last block is a leaf of the top tree
    up = F.when(in_group, F.col("tree")).when(~last, F.col("block"))
    return found.select(
        F.lit(level).alias("level"),
        "tree",
        "block",
        F.slice(kept, F.lit(1), steps).alias("levels"),
        F.get(kept, steps).alias("top"),
        F.when(in_group, 0).when(~last, level + 1).alias("up_level"),
        F.when(in_group, TOP_TREE).otherwise(F.col("tree")).cast("bigint").alias("up_tree"),
        F.floor(up / BLOCK).cast("bigint").alias("up_block"),
        (up % BLOCK).alias("slot"),
        F.ceil(F.col("total") / BLOCK).cast("bigint").alias("total"),
    )


def tree_blocks(nodes: DataFrame) -> list[DataFrame]:
    """All blocks of all trees, level by level. A level is a 27th of the one below."""
    out: list[DataFrame] = []
    while True:
        out.append(written(one_level_of_blocks(nodes, len(out))))
        nodes = out[-1].filter("total > 1").select("tree", F.col("block").alias("pos"), F.col("top").alias("digest"), "total")
        if nodes.isEmpty():
            return out


@dataclass
class Manifest:
    """``leaves``: grp, id, leaf, start, tree, pos; ``blocks``: parent-linked rows, see :func:`one_level_of_blocks`."""

    leaves: DataFrame
    blocks: DataFrame

    def write(self, path: str) -> None:
        """Write to a new folder."""
        self.leaves.write.parquet(f"{path}/leaves")
        self.blocks.write.parquet(f"{path}/blocks")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    return Manifest(spark.read.parquet(f"{path}/leaves"), spark.read.parquet(f"{path}/blocks"))


def build(
    docs: DataFrame, columns: list[str], id: str = "doc_id", group: str = "source", changed: dict[str, Column] | None = None
) -> Manifest:
    """The tree over the rows of ``docs``. ``changed`` are columns as they are found later; each leaf's ``start`` is
    their hash (null where nothing differs), from which :func:`prove` folds."""
    leaves = numbered(written(leaf_rows(docs, columns, id, group, changed or {})))
    own = tree_blocks(leaves.select("tree", "pos", F.col("leaf").alias("digest"), "total"))
    blocks = own[0]
    for more in own[1:]:
        blocks = blocks.unionByName(more)
    subroots = blocks.filter(f"up_tree = {TOP_TREE}").select(F.col("tree").alias("pos"), F.col("top").alias("digest"))
    count = subroots.count()
    for more in tree_blocks(subroots.select(F.lit(TOP_TREE).cast("bigint").alias("tree"), "*", F.lit(count).alias("total"))):
        blocks = blocks.unionByName(more)
    return Manifest(leaves.drop("total"), blocks.drop("total"))


@contextmanager
def unlimited_rows(spark: SparkSession) -> Iterator[None]:
    """Recursive queries of any number of rows; the session's own limit is put back afterwards."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def steps_sql(levels: str, slot: str) -> str:
    """The siblings before and after a node and its ancestors within a block, from the lowest level up."""
    at = f"({slot} div case i when 0 then 1 when 1 then {RUN} else {RUN * RUN} end)"
    before = f"substring(l, cast({at} div {RUN} * {RUN * DIGEST} + 1 as int), cast({at} % {RUN} * {DIGEST} as int))"
    after = f"substring(l, cast({at} * {DIGEST} + {DIGEST + 1} as int), cast(({RUN - 1} - {at} % {RUN}) * {DIGEST} as int))"
    return f"transform({levels}, (l, i) -> named_struct('before', {before}, 'after', {after}))"


def descend(blocks: DataFrame) -> DataFrame:
    """For each block that stands for 729 leaves or a whole group: its ``path``, the steps from its top to the root,
    with the ``subroot`` of its group and the ``root``."""
    found = blocks.sparkSession.sql(
        f"""
        with recursive down(level, tree, block, levels, path, subroot, root) as (
          select level, tree, block, levels,
                 cast(array() as array<struct<before: binary, after: binary>>), cast(null as binary), top
          from {{inner}} where up_level is null
          union all
          select b.level, b.tree, b.block, b.levels, concat({steps_sql("d.levels", "b.slot")}, d.path),
                 case when b.tree != {TOP_TREE} then coalesce(d.subroot, b.top) end, d.root
          from down d join {{inner}} b on b.up_level = d.level and b.up_tree = d.tree and b.up_block = d.block
        )
        select level, tree, block, levels, path, subroot, root from down
        """,
        inner=blocks.filter(f"level > 0 or tree = {TOP_TREE} or up_tree = {TOP_TREE}"),
    )
    with unlimited_rows(blocks.sparkSession):
        return written(found)


def prove(manifest: Manifest) -> DataFrame:
    """Per leaf: grp, id, leaf, ``subroot``, ``root``, ``proof`` (the siblings' digests up to the root, one after the
    other) and ``folded``, what ``start`` comes to with them. All are binary."""
    paths = descend(manifest.blocks)
    low = manifest.blocks.filter(f"level = 0 and tree != {TOP_TREE} and up_tree != {TOP_TREE}")
    # a group of up to 27 leaves has its path at its only block, larger ones at their blocks of the level above
    links = paths.filter(f"tree != {TOP_TREE} and level <= 1").unionByName(
        low.select("level", "tree", "block", "levels"), allowMissingColumns=True
    )
    fold = """named_struct('h', unhex(sha2(lower(hex(concat(x.before, a.h, x.after))), 256)),
                           'p', concat(a.p, x.before, x.after))"""
    found = manifest.leaves.sparkSession.sql(
        f"""
        with recursive climb(grp, id, leaf, level, tree, block, slot, state, subroot, root) as (
          select grp, id, leaf, 0, tree, pos div {BLOCK}, pos % {BLOCK},
                 named_struct('h', coalesce(start, leaf), 'p', cast('' as binary)), cast(null as binary), cast(null as binary)
          from {{leaves}}
          union all
          select c.grp, c.id, c.leaf, if(k.path is null, 1, -1), c.tree, c.block div {BLOCK}, c.block % {BLOCK},
                 aggregate(concat({steps_sql("k.levels", "c.slot")}, coalesce(k.path, array())), c.state, (a, x) -> {fold}),
                 k.subroot, k.root
          from climb c join {{links}} k on k.level = c.level and k.tree = c.tree and k.block = c.block
          where c.level >= 0
        )
        select grp, id, leaf, subroot, root, state.p as proof, state.h as folded from climb where level = -1
        """,
        leaves=manifest.leaves,
        links=links,
    )
    with unlimited_rows(manifest.leaves.sparkSession):
        return written(found)
