"""Message templates: masked shapes, and Drain clustering of shapes (He et al., ICWS 2017)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalars import let
from tidewatch.functions.skew import numbered, row_numbers
from tidewatch.session import cut_lineage, grouped, written

WILDCARD = "<*>"

# Clustering parameters, and the masked kinds of text in the order in which they are replaced, with what
# any text of the kind contains.
DEPTH = 4
SIMILARITY = 0.4
MAX_CLUSTERS = 1000
MASKS = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]+)?",
    r"0x[0-9a-fA-F]+",
    r"[0-9]+(\.[0-9]+)?",
)
CONTAINED = ("-", ".", "0x", "")
BLANKS = r"[\t\r\n][ \t\r\n]*| [ \t\r\n]+"  # runs of blanks other than a single space


def shape(message: Column) -> Column:
    """The message with ids, addresses and numbers masked and blanks folded."""


    def masked(mask: str, part: str) -> Callable[[Column], Column]:  # looking for a part is cheaper than for the kind
        return lambda text: F.when(text.contains(part), F.regexp_replace(text, mask, WILDCARD)).otherwise(text)

    out = message
    for mask, part in zip(MASKS, CONTAINED):
        out = let(out, masked(mask, part))
    return F.trim(F.regexp_replace(out, BLANKS, " "))


def template_id(source: Column, template: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", source, template), 256), F.lit(16))


def assign_shapes(logs: DataFrame) -> DataFrame:
    """Template ids from masked shapes: a column expression, no shuffle. No message, no template."""
    template = F.when(F.col("message") != "", shape(F.col("message")))
    logs = logs.withColumn("template", template)
    return logs.withColumn("template_id", F.when(F.col("template").isNotNull(), template_id(F.col("source"), F.col("template"))))


def inventory(assigned: DataFrame) -> DataFrame:
    """One row per template: lines, first and last time, and the first line as a sample.

    Grouped by the short id; the texts travel once per group, with the first line. Lines without a template are one
    more group, dropped by its missing text: a filter on the id would be pushed down and mask each message twice.
    """
    first = F.min_by(F.struct("template", "message", "line_number"), F.struct("timestamp", "line_number"))
    found = assigned.groupBy("source", "template_id").agg(
        F.count("*").alias("count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        first.alias("first"),
    )
    return found.filter(F.col("first.template").isNotNull()).select(
        "source",
        "template_id",
        F.col("first.template").alias("template"),
        "count",
        "first_seen",
        "last_seen",
        F.col("first.line_number").alias("first_line"),
        F.col("first.message").alias("sample_line"),
    )


def templates_by_count(templates: DataFrame) -> DataFrame:
    return templates.select("source", "template_id", "template", "count").orderBy(F.desc("count"), "source", "template_id")


def get_template(templates: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pattern and count of the wanted (source, template_id) pairs."""
    return templates.join(wanted, ["source", "template_id"], "left_semi").select(
        "source", "template_id", "template", "count"
    )


def template_count(templates: DataFrame) -> DataFrame:
    return templates.groupBy("source").agg(F.count_distinct("template_id").alias("templates"))


def sequence_ids(templates: DataFrame) -> DataFrame:
    """Templates numbered per source in the order of their first line; those without any time come first."""
    hour = F.coalesce(F.floor(F.unix_seconds("first_seen") / 3600), F.lit(-(2**62)))
    cells = cut_lineage(templates.withColumn("__hour", hour))  # read several times
    return row_numbers(cells, ["source"], "__hour", ["first_seen", "first_line", "template_id"], "seq_id").drop("__hour")


def max_ids(templates: DataFrame) -> DataFrame:
    """Highest sequence id per source: ids have no gaps, so it is the number of templates."""
    return templates.groupBy("source").agg(F.count("*").alias("max_id"))


def novel_templates(templates: DataFrame, baseline_max: DataFrame) -> DataFrame:
    """Templates whose sequence id is above the baseline's highest; all of a source without baseline."""
    joined = sequence_ids(templates).join(baseline_max.select("source", "max_id"), "source", "left")
    return joined.filter(F.col("seq_id") > F.coalesce("max_id", F.lit(0))).drop("max_id")


@dataclass
class Replay:
    """Shapes of one leaf taken in order. ``versions``: (position, since, pattern), where a pattern holds for shapes that
    come after number ``since``; those known before hold from 0 on."""

    member: np.ndarray
    versions: list[tuple[int, int, list[str]]]

    @property
    def patterns(self) -> list[list[str]]:
        """The patterns as they are at the end."""
        return list({position: pattern for position, _, pattern in self.versions}.values())


def _coded(vocabulary: dict[str, int], rows: list[list[str]], width: int) -> np.ndarray:
    coded = [[vocabulary.setdefault(t, len(vocabulary)) for t in row] for row in rows]
    return np.array(coded, dtype=np.int32).reshape(len(rows), width)


def _greedy(
    rows: list[list[str]], similarity: float, known: list[list[str]] | None = None, numbers: np.ndarray | None = None
) -> Replay:
    """Cluster equally long token rows in order: join the most similar cluster, or open a new one.

    ``known`` are the patterns of clusters that exist already, in their order. ``numbers`` are those of the rows in
    their leaf, if only some of its rows are given.
    """
    known = known or []
    numbers = np.arange(1, len(rows) + 1) if numbers is None else numbers
    width = len((known or rows)[0]) if known or rows else 0
    vocabulary: dict[str, int] = {WILDCARD: 0}
    coded = _coded(vocabulary, [*known, *rows], width)
    found = len(known)
    patterns = np.empty_like(coded)
    patterns[:found] = coded[:found]
    member = np.empty(len(rows), dtype=np.int64)
    changes = [(i, 0, patterns[i].copy()) for i in range(found)]
    for i, row in enumerate(coded[found:]):
        best = -1
        if found:
            alike = (patterns[:found] == row).mean(axis=1)
            best = int(alike.argmax())
            if alike[best] < similarity:
                best = -1
        if best < 0:
            best = found
            patterns[found] = row
            found += 1
        else:
            other = (patterns[best] != row) & (patterns[best] != 0)
            if not other.any():
                member[i] = best
                continue
            patterns[best][other] = 0
        member[i] = best
        changes.append((best, int(numbers[i]), patterns[best].copy()))
    words = np.array(list(vocabulary), dtype=object)
    return Replay(member, [(position, since, words[row].tolist()) for position, since, row in changes])


BLOCK_CELLS = 1 << 22  # comparisons held at a time


def _settle(
    rows: list[list[str]], numbers: np.ndarray, versions: list[tuple[int, int, list[str]]], similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """For each row the cluster that it joins, given all versions of the leaf's patterns, and whether it would change one
    or open one (then the versions are not yet all)."""
    versions = sorted(versions, key=lambda v: v[:2])
    position = np.array([v[0] for v in versions], np.int64)
    since = np.array([v[1] for v in versions], np.int64)
    until = np.where(np.append(position[1:] == position[:-1], False), np.append(since[1:], 0), np.iinfo(np.int64).max)
    width = len(rows[0])
    vocabulary: dict[str, int] = {WILDCARD: 0}
    patterns = _coded(vocabulary, [v[2] for v in versions], width)
    coded = _coded(vocabulary, rows, width)
    joined, changes = np.empty(len(rows), np.int64), np.empty(len(rows), bool)
    step = max(1, BLOCK_CELLS // max(1, len(versions)))
    for at in range(0, len(rows), step):
        part, when = coded[at : at + step], numbers[at : at + step, None]
        equal = np.zeros((len(part), len(versions)), np.int32)
        for i in range(width):
            equal += part[:, i, None] == patterns[None, :, i]
        equal[(since >= when) | (when > until)] = -1
        best = equal.argmax(axis=1)  # the first of the most similar
        near = equal[np.arange(len(part)), best]
        other = (patterns[best] != part) & (patterns[best] != 0)
        joined[at : at + step] = position[best]
        changes[at : at + step] = other.any(axis=1) | (near < 0) | (near / width < similarity)
    return joined, changes


@dataclass
class Clusters:
    """What Drain knows: the cluster of every shape it has met, and each cluster's pattern so far.

    ``members``: source, shape_id, template_id. ``patterns``: source, template_id, leaf, position, template, where
    clusters of a leaf are numbered by ``position`` in the order in which they were opened. A cluster's id is the id of
    the shape that opened it, so it never changes.
    """

    members: DataFrame
    patterns: DataFrame

    def write(self, path: str) -> None:
        """Write to a new folder; readers move on to it when it is complete."""
        self.members.write.parquet(f"{path}/members")
        self.patterns.write.parquet(f"{path}/patterns")


MEMBERS = "source string, shape_id string, template_id string"
PATTERNS = "source string, template_id string, leaf string, position bigint, template string"


def read_clusters(spark: SparkSession, path: str) -> Clusters:
    return Clusters(spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/patterns"))


def no_clusters(spark: SparkSession) -> Clusters:
    return Clusters(spark.createDataFrame([], MEMBERS), spark.createDataFrame([], PATTERNS))


def leaf_of(template: Column, depth: int = DEPTH) -> Column:
    """Where a shape is routed: its length and its first ``depth`` - 2 tokens, those with a mask counted as equal."""
    tokens = F.split(template, " ")
    first = F.transform(
        F.slice(tokens, 1, max(0, depth - 2)), lambda t: F.when(t.contains(WILDCARD), WILDCARD).otherwise(t)
    )
    return F.concat_ws(" ", F.size(tokens).cast("string"), first)


LEAF_SHAPES = 1000  # new shapes that one task takes in order, in leaves that have more about as many at first
ORDER = ["first_seen", "first_line", "shape_id"]
MADE = "source string, leaf string, shape_id string, template_id string, position bigint, since bigint, template string"


def learn_clusters(
    shapes: DataFrame,
    known: Clusters | None = None,
    similarity: float = SIMILARITY,
    depth: int = DEPTH,
    leaf_shapes: int = LEAF_SHAPES,
) -> Clusters:
    """Drain over distinct shapes (see :func:`inventory`, with ``shape_id`` and ``shape``) on top of what is known.

    Shapes that are known keep their cluster. The others are taken in order of their first line; each joins the most
    similar cluster of its leaf or opens one. Shapes of different leaves never share a cluster, so leaves are
    independent, and only those with new shapes are worked on. The outcome depends on nothing but the order of shapes:
    feeding the logs in several runs, one after the other, gives the clusters of a single run.

    A leaf of up to ``leaf_shapes`` new shapes is one task, a larger one is worked on by many
    (:func:`_learn_crowded`); ``leaf_shapes`` changes where the work is done and nothing else.
    """
    columns = ["source", "shape_id", "shape", "first_seen", "first_line"]
    new = shapes.select(*columns, leaf_of(F.col("shape"), depth).alias("leaf"))
    keys = ["source", "leaf"]
    if known is None:
        known = no_clusters(shapes.sparkSession)
        touched = rest = known.patterns
    else:
        new = new.join(known.members, ["source", "shape_id"], "left_anti")
        touched = known.patterns.join(new.select(*keys).distinct(), keys, "left_semi")
        rest = known.patterns.join(new.select(*keys).distinct(), keys, "left_anti")
    sizes = cut_lineage(new.groupBy(*keys).agg(F.count("*").alias("__n")))
    met = touched.select(*keys).distinct().withColumn("__met", F.lit(True))
    sizes = sizes.join(met, keys, "left")
    alone = (F.col("__n") == 1) & F.col("__met").isNull()
    crowded = F.col("__n") > leaf_shapes
    # a leaf's first shape opens its first cluster
    first = new.join(sizes.filter(alone).select(*keys), keys, "left_semi")
    first = first.withColumn("template_id", F.col("shape_id"))
    members = first.select("source", "shape_id", "template_id")
    patterns = first.select("source", "template_id", "leaf", F.lit(0).cast("bigint").alias("position"), F.col("shape").alias("template"))

    several = sizes.filter(~alone & ~crowded).select(*keys)
    made = [_learn_leaves(new.join(several, keys, "left_semi"), touched.join(several, keys, "left_semi"), similarity)]
    many = sizes.filter(crowded).select(*keys)
    if not many.isEmpty():
        made.append(_learn_crowded(new.join(many, keys, "left_semi"), touched.join(many, keys, "left_semi"), similarity, leaf_shapes))
    members, patterns = known.members.unionByName(members), rest.unionByName(patterns)
    for part in made:
        joined = part.filter(F.col("shape_id").isNotNull()).select("source", "shape_id", "template_id")
        members = members.unionByName(joined)
        patterns = patterns.unionByName(part.filter(F.col("shape_id").isNull()).select(*rest.columns))
    return Clusters(members, patterns)


def _replayed(key: tuple, shapes: pd.DataFrame, patterns: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Rows of members (with ``shape_id``) and of versions of patterns of a leaf, as :data:`MADE`."""
    shapes = shapes.sort_values("number" if "number" in shapes else ORDER, na_position="first")
    patterns = patterns.sort_values("position")
    numbers = shapes["number"].to_numpy() if "number" in shapes else None
    found = _greedy([s.split(" ") for s in shapes["shape"]], similarity, [t.split(" ") for t in patterns["template"]], numbers)
    ids = patterns["template_id"].tolist()
    for name, m in zip(shapes["shape_id"], found.member):
        if m == len(ids):
            ids.append(name)
    members = pd.DataFrame({"shape_id": shapes["shape_id"], "position": found.member})
    versions = pd.DataFrame(
        [(p, since, " ".join(tokens)) for p, since, tokens in found.versions], columns=["position", "since", "template"]
    )
    both = pd.concat([members, versions])
    both = both.assign(source=key[0], leaf=key[1], template_id=[ids[int(p)] for p in both["position"]])
    return both.reindex(columns=["source", "leaf", "shape_id", "template_id", "position", "since", "template"])


def _learn_leaves(new: DataFrame, touched: DataFrame, similarity: float) -> DataFrame:
    """Members and final patterns of leaves, each in one task."""

    def cluster(key: tuple, shapes: pd.DataFrame, patterns: pd.DataFrame) -> pd.DataFrame:
        both = _replayed(key, shapes, patterns, similarity)
        return both[both["shape_id"].notna() | ~both.duplicated(["position", "shape_id"], keep="last")]

    keys = ["source", "leaf"]
    made = grouped(new, *keys).cogroup(grouped(touched, *keys)).applyInPandas(cluster, MADE)
    return cut_lineage(made)  # read twice, for members and for patterns


def _learn_crowded(new: DataFrame, touched: DataFrame, similarity: float, leaf_shapes: int) -> DataFrame:
    """Members and final patterns of leaves with many new shapes.

    Most shapes fit a cluster as it is and leave no trace in any pattern, so only the others, the **marked** ones, need
    to be taken one after the other. Which these are is found in rounds. The marked shapes (at first the earliest) are
    replayed in order, which gives all versions of the leaf's patterns and from where on they hold. All other shapes
    are compared with the versions that hold for them, in chunks over many tasks. Those that would change a pattern or
    open one are marked for the next round, the earliest ones and at most as many as are marked. When there are none,
    the versions are those of the plain loop: by induction over the order, each shape that was not marked met the
    same patterns there and changed none.
    """
    keys = ["source", "leaf"]
    rows = numbered(new.select("shape_id", "shape", *keys, "first_seen", "first_line"), keys, ORDER, "number")
    rows = cut_lineage(rows.withColumn("chunk", F.floor((F.col("number") - 1) / leaf_shapes)).drop("first_seen", "first_line"))
    marked = rows.filter("chunk = 0").select(*keys, "number")

    def replay(key: tuple, shapes: pd.DataFrame, patterns: pd.DataFrame) -> pd.DataFrame:
        return _replayed(key, shapes, patterns, similarity)

    def settle(key: tuple, shapes: pd.DataFrame, versions: pd.DataFrame) -> pd.DataFrame:
        if shapes.empty:
            return pd.DataFrame(columns=["source", "leaf", "chunk", "number", "shape_id", "position", "changes"])
        known = [(int(p), int(s), t.split(" ")) for p, s, t in zip(versions["position"], versions["since"], versions["template"])]
        joined, changes = _settle([s.split(" ") for s in shapes["shape"]], shapes["number"].to_numpy(), known, similarity)
        out = shapes[["source", "leaf", "chunk", "number", "shape_id"]]
        return out.assign(position=joined, changes=changes)

    chunks = rows.select(*keys, "chunk").distinct()
    settled_schema = "source string, leaf string, chunk bigint, number bigint, shape_id string, position bigint, changes boolean"
    while True:
        chosen = rows.join(marked, [*keys, "number"], "left_semi")
        replayed = cut_lineage(grouped(chosen, *keys).cogroup(grouped(touched, *keys)).applyInPandas(replay, MADE))
        versions = replayed.filter("shape_id is null").drop("shape_id")
        others = rows.join(marked, [*keys, "number"], "left_anti")
        by = [*keys, "chunk"]
        spread = versions.join(chunks, keys)
        spread = spread.select(*[F.col(c).alias(c) for c in spread.columns])  # columns of its own beside the chunks'
        settled = grouped(others, *by).cogroup(grouped(spread, *by)).applyInPandas(settle, settled_schema)
        settled = cut_lineage(settled)
        open_ = settled.filter("changes").groupBy(*by).agg(F.count("*").alias("n"))
        if open_.isEmpty():
            break
        earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        open_ = open_.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        limits = marked.groupBy(*keys).agg(F.count("*").alias("most"))
        picked = open_.join(limits, keys).filter("earlier = 0 or earlier + n <= most").select(*by)
        more = settled.filter("changes").join(picked, by, "left_semi").select(*keys, "number")
        marked = cut_lineage(marked.unionByName(more))
    last = versions.groupBy(*keys, "position").agg(F.max_by(F.struct("template_id", "template", "since"), "since").alias("v"))
    patterns = last.select(*keys, F.lit(None).cast("string").alias("shape_id"), "v.template_id", "position", "v.since", "v.template")
    names = versions.select(*keys, "position", "template_id").distinct()
    joined = settled.select(*keys, "shape_id", "position").join(names, [*keys, "position"])
    return patterns.unionByName(replayed.filter("shape_id is not null")).unionByName(joined, allowMissingColumns=True)


def with_templates(assigned: DataFrame, known: Clusters) -> DataFrame:
    """Logs whose ``template_id`` is that of a shape (see :func:`assign_shapes`) with the ids of their clusters
    instead; shapes that Drain has not met keep their own id, under which a cluster opened by them would be found."""
    names = known.members.select("source", F.col("template_id").alias("__cluster"), F.col("shape_id").alias("template_id"))
    joined = assigned.join(names, ["source", "template_id"], "left")
    out = joined.withColumn("template_id", F.coalesce("__cluster", "template_id")).drop("__cluster")
    return out.select(*assigned.columns)


def drain_templates(
    assigned: DataFrame,
    similarity: float = SIMILARITY,
    max_clusters: int = MAX_CLUSTERS,
    known: Clusters | None = None,
    depth: int = DEPTH,
) -> DataFrame:
    """Drain over masked shapes: (source, shape_id, shape) -> cluster id and pattern.

    ``assigned`` comes from :func:`assign_shapes`. Only distinct shapes are clustered (see :func:`learn_clusters`).
    Clusters beyond ``max_clusters`` of a source are kept and marked ``overflow``.
    """
    shapes = cut_lineage(
        inventory(assigned).withColumnsRenamed({"template_id": "shape_id", "template": "shape"})
    )
    clusters = learn_clusters(shapes, known, similarity, depth)
    named = clusters.members.join(clusters.patterns.select("source", "template_id", "template"), ["source", "template_id"])
    ranked = cut_lineage(shapes.join(named, ["source", "shape_id"]))
    totals = ranked.groupBy("source", "template_id").agg(
        F.min("first_seen").alias("first_seen"),
        F.min_by("first_line", F.struct("first_seen", "first_line")).alias("first_line"),
    )
    late = sequence_ids(totals).select("source", "template_id", (F.col("seq_id") > max_clusters).alias("overflow"))
    return ranked.join(late, ["source", "template_id"])


def drain_inventory(clustered: DataFrame) -> DataFrame:
    """One row per Drain template, from the shapes that make it up."""
    first = F.min_by(F.struct("template", "sample_line", "first_line"), F.struct("first_seen", "first_line"))
    found = clustered.groupBy("source", "template_id", "overflow").agg(
        F.sum("count").alias("count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        first.alias("first"),
    )
    return found.select(
        "source",
        "template_id",
        F.col("first.template").alias("template"),
        "overflow",
        "count",
        "first_seen",
        "last_seen",
        F.col("first.first_line").alias("first_line"),
        F.col("first.sample_line").alias("sample_line"),
    )


def assign_drain(assigned: DataFrame, clustered: DataFrame) -> DataFrame:
    """Replace the shape ids and templates of lines by those of their Drain cluster."""
    mapping = clustered.select("source", F.col("shape_id").alias("template_id"), F.col("template_id").alias("__id"), F.col("template").alias("__template"))
    joined = assigned.join(mapping, ["source", "template_id"], "left")
    return joined.withColumns({"template_id": F.col("__id"), "template": F.col("__template")}).drop("__id", "__template")


def drain_lines(
    assigned: DataFrame,
    similarity: float = SIMILARITY,
    max_clusters: int = MAX_CLUSTERS,
    known: Clusters | None = None,
    depth: int = DEPTH,
) -> DataFrame:
    """Lines with the ids and templates of their Drain clusters: :func:`drain_templates`, then :func:`assign_drain`. The
    lines are written with their shapes in between, so each message is masked once."""
    lines = written(assigned)
    return assign_drain(lines, drain_templates(lines, similarity, max_clusters, known, depth))
