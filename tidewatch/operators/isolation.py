"""Isolation forest over bucket features (Liu, Ting, Zhou: Isolation Forest, ICDM 2008)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import grouped

FEATURES = ["error_rate", "line_count", "templates", "mean_latency"]

# Forest parameters.
TREES = 100
SAMPLE = 256
SEED = 42
MIN_BUCKETS = 10

TREE_SCHEMA = (
    "source string, tree_id int, node int, feature int, threshold double, left int, right int, size int, samples int"
)


def contamination(sensitivity: float) -> float:
    """Share of buckets taken for outliers, 0.001 to 0.05."""
    return 0.001 + sensitivity * 0.049


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of n keys."""
    n = np.asarray(n, dtype=float)
    inner = np.maximum(n, 3.0)
    big = 2.0 * (np.log(inner - 1.0) + np.euler_gamma) - 2.0 * (inner - 1.0) / inner
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _grow(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
    """One tree from at most SAMPLE rows, all nodes of a depth at a time.

    The random choices are fixed by source and tree number.
    """
    source, tree_id = key
    rows = sample.sort_values("__rank")[FEATURES].to_numpy(dtype=float)
    rng = np.random.default_rng([SEED, int(tree_id), *source.encode()])
    limit = math.ceil(math.log2(max(len(rows), 2)))
    levels = []
    at = np.zeros(len(rows), dtype=int)  # node of each row within its level, -1 once the row has come to rest
    width, offset = 1, 0
    for depth in range(limit + 1):
        live = at >= 0
        low, high = np.full((width, len(FEATURES)), np.inf), np.full((width, len(FEATURES)), -np.inf)
        np.minimum.at(low, at[live], rows[live])
        np.maximum.at(high, at[live], rows[live])
        size = np.bincount(at[live], minlength=width)
        usable = high > low
        splits = usable.any(axis=1) & (size > 1) & (depth < limit)
        chosen = np.where(usable, rng.random(usable.shape), -1.0).argmax(axis=1)
        node = np.arange(width)
        low, high = low[node, chosen], high[node, chosen]
        cut = np.where(splits, low + rng.random(width) * np.where(splits, high - low, 0.0), 0.0)
        child = np.cumsum(splits) * 2 - 2  # left child within the next level
        below = offset + width
        levels.append(
            pd.DataFrame(
                {
                    "node": offset + node,
                    "feature": np.where(splits, chosen, -1),
                    "threshold": cut,
                    "left": np.where(splits, below + child, -1),
                    "right": np.where(splits, below + child + 1, -1),
                    "size": size,
                }
            )
        )
        width, offset = 2 * int(splits.sum()), below
        if not width:
            break
        moving = live & splits[np.maximum(at, 0)]
        here = at[moving]
        goes_right = rows[moving, chosen[here]] > cut[here]
        at = np.full(len(rows), -1)
        at[moving] = child[here] + goes_right
    out = pd.concat(levels, ignore_index=True)
    return out.assign(source=source, tree_id=tree_id, samples=len(rows))[
        ["source", "tree_id", "node", "feature", "threshold", "left", "right", "size", "samples"]
    ]


def fit_forest(features: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Trees of all sources, one task group per (source, tree) with at most ``sample`` rows.

    A row enters a tree's draw with a chance a good deal above sample/n; of those that enter, the ones with the
    lowest hash are kept. Rows are repeated only for the trees whose draw they enter.
    """
    counts = features.groupBy("source").agg(F.count("*").alias("__n"))
    rows = features.join(counts.filter(F.col("__n") >= MIN_BUCKETS), "source")
    chance = F.lit(float(sample + 10 * math.sqrt(sample))) / F.col("__n")

    def rank(tree: Column) -> Column:
        return F.xxhash64(F.lit(SEED), "source", tree, "bucket")

    entered = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: rank(t) / F.lit(float(2**64)) + 0.5 <= chance
    )
    drawn = rows.withColumn("tree_id", F.explode(entered)).withColumn("__rank", rank(F.col("tree_id")))
    first = Window.partitionBy("source", "tree_id").orderBy("__rank", "bucket")
    drawn = drawn.withColumn("__k", F.row_number().over(first))
    drawn = drawn.filter(F.col("__k") <= sample).select("source", "tree_id", "__rank", *FEATURES)
    return grouped(drawn, "source", "tree_id").applyInPandas(_grow, TREE_SCHEMA)


def _depths(rows: np.ndarray, tree: pd.DataFrame) -> np.ndarray:
    tree = tree.sort_values("node")
    feature, left, right, size = (tree[c].to_numpy() for c in ("feature", "left", "right", "size"))
    threshold = tree["threshold"].to_numpy()
    at = np.zeros(len(rows), dtype=int)
    depth = np.zeros(len(rows))
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return depth + average_path(size[at])
        here = at[inner]
        goes_left = rows[inner, feature[here]] <= threshold[here]
        at[inner] = np.where(goes_left, left[here], right[here])
        depth[inner] += 1


def _score(features: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    if features.empty or trees.empty:
        return features[["source", "bucket"]].iloc[:0].assign(isolation_score=0.0)
    rows = features[FEATURES].to_numpy(dtype=float)
    depths = [_depths(rows, tree) for _, tree in trees.groupby("tree_id")]
    norm = float(average_path(np.array([trees["samples"].max()]))[0])
    score = np.exp2(-np.mean(depths, axis=0) / norm) if norm > 0 else np.full(len(rows), 0.5)
    return pd.DataFrame({"source": features["source"], "bucket": features["bucket"], "isolation_score": score})


SCORE_CHUNK = 4096


def isolation_scores(features: DataFrame, trees: DataFrame) -> DataFrame:
    """Outlier score of every bucket in (0, 1], higher is more isolated.

    Buckets of a source are scored in chunks of time, each next to the trees of its source.
    """
    chunked = features.withColumn("chunk", F.floor(F.col("bucket") / SCORE_CHUNK))
    chunks = chunked.select("source", "chunk").distinct()
    spread = trees.join(chunks, "source").withColumn("chunk", F.col("chunk") + 0)  # a column of its own
    schema = "source string, bucket bigint, isolation_score double"
    pairs = grouped(chunked, "source", "chunk").cogroup(grouped(spread, "source", "chunk"))
    return pairs.applyInPandas(_score, schema)


def isolation_outliers(scores: DataFrame, sensitivity: float = 0.5) -> DataFrame:
    """Scores with a flag for the most isolated share of each source's buckets."""
    share = 1.0 - contamination(sensitivity)
    cut = scores.groupBy("source").agg(F.percentile("isolation_score", F.lit(share)).alias("cut"))
    flagged = scores.join(cut, "source").withColumn("outlier", F.col("isolation_score") > F.col("cut"))
    return flagged.drop("cut")
