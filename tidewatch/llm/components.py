"""Connected components of an edge table in few rounds, each of equi-joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.store import written


def connected_components(edges: DataFrame) -> DataFrame:
    """For each node of the undirected edges (``a``, ``b``) the smallest node of its component: ``node``, ``root``.

    Alternates two steps until nothing changes: each node tells its larger neighbours of its smallest one, then each
    node points all its smaller neighbours and itself at the smallest. Both keep the components, and the number of
    rounds grows with the logarithm of the path lengths. Every round's edges are written to the shared folder. A node
    with very many neighbours is only ever a join key, which adaptive execution splits.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    pairs = written(pairs)
    state = summary(pairs)
    while state[0]:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a").select("b", "m").union(least.select(F.col("a").alias("b"), "m"))
        pairs = written(joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        before, state = state, summary(pairs)
        if state == before:
            break
    roots = pairs.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(roots.select("root", "root").distinct())


def summary(pairs: DataFrame) -> tuple:
    """Number of edges and a checksum of them."""
    row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
