"""What training needs of the logs, as counts that add up: new logs are read once, a retraining reads counts only.

A **cell** is a source and time bucket with either a template or a latency. Cells of different logs are merged by adding
them up, so they may be made hour by hour, from micro-batches, from late lines: training over merged cells gives the
baseline of training over all the logs. All counts are exact; latencies are kept as a multiset.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions import scalars as S
from tidewatch.operators import aggregates as A
from tidewatch.operators.isolation import fit_forest
from tidewatch.operators.templates import Clusters, with_templates
from tidewatch.plans.baseline import TRAINING_WINDOW_HOURS, Baseline
from tidewatch.session import cut_lineage
from tidewatch.sources.store import BATCH_JOBS, write_batch

BUCKET_MINUTES = 5
KEYS = ["source", "bucket", "template_id", "value"]
SUMS = ["lines", "errors", "latency_sum", "latency_lines", "n"]


def baseline_cells(logs: DataFrame, bucket_minutes: int = BUCKET_MINUTES, clusters: Clusters | None = None) -> DataFrame:
    """Cells of timed lines: ``source``, ``bucket``, ``template_id``, ``value`` and their sums.

    A line goes into a cell of its template (``lines``, ``errors``, ``latency_sum`` and ``latency_lines``) and, if it has
    a latency, into one of that ``value`` (``n``). Both are summed in one pass over the logs with one shuffle.
    """
    if clusters:
        logs = with_templates(logs, clusters)
    feature = S.feature_latency(F.col("fields"))
    lines = logs.filter(F.col("timestamp").isNotNull()).select(
        "source",
        A.epoch_bucket(bucket_minutes).alias("bucket"),
        F.when(F.col("template_id") != "", F.col("template_id")).alias("template"),
        S.is_error(F.col("level")).cast("bigint").alias("error"),
        feature.alias("feature"),
        S.latency(F.col("fields")).alias("latency"),
    )
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    of_template = F.struct(
        F.col("template").alias("template_id"), F.lit(None).cast("double").alias("value"), one.alias("lines"), F.col("error").alias("errors"),
        F.coalesce("feature", F.lit(0.0)).alias("latency_sum"), F.col("feature").isNotNull().cast("bigint").alias("latency_lines"), zero.alias("n"),
    )
    of_value = F.struct(
        F.lit(None).cast("string").alias("template_id"), F.col("latency").alias("value"), zero.alias("lines"), zero.alias("errors"),
        F.lit(0.0).alias("latency_sum"), zero.alias("latency_lines"), one.alias("n"),
    )
    both = F.filter(F.array(of_template, of_value), lambda c: (c["lines"] > 0) | c["value"].isNotNull())
    return merge_cells(lines.select("source", "bucket", F.explode(both).alias("c")).select("source", "bucket", "c.*"))


def merge_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def _day(bucket_minutes: int) -> Column:
    return F.timestamp_seconds(F.col("bucket") * (bucket_minutes * 60))


def append_cells(
    logs: DataFrame, path: str, run: str = BATCH_JOBS, bucket_minutes: int = BUCKET_MINUTES, clusters: Clusters | None = None
) -> None:
    """Add the cells of new logs to the table at ``path``. The same ``run`` on the same days replaces itself."""
    cells = baseline_cells(logs, bucket_minutes, clusters)
    write_batch(cells, path, 0, _day(bucket_minutes), run=run)


def write_cells(
    logs: DataFrame,
    path: str,
    checkpoint: str,
    once: bool = False,
    bucket_minutes: int = BUCKET_MINUTES,
    clusters: Clusters | None = None,
) -> StreamingQuery:
    """The cells of a stream of log rows into the table at ``path``. However late a line comes, it counts in its bucket;
    a repeated micro-batch replaces itself."""

    def append(batch: DataFrame, batch_id: int) -> None:
        write_batch(baseline_cells(batch, bucket_minutes, clusters), path, batch_id, _day(bucket_minutes))

    writer = logs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_cells(
    spark: SparkSession, path: str, as_of: datetime, hours: int = TRAINING_WINDOW_HOURS, bucket_minutes: int = BUCKET_MINUTES
) -> DataFrame:
    """Merged cells of [as_of - hours, as_of), whose ends must be ends of buckets. Only the days that it touches are read."""
    since, size = as_of - timedelta(hours=hours), bucket_minutes * 60
    epoch = datetime(1970, 1, 1)
    first, last = ((t - epoch).total_seconds() for t in (since, as_of))
    if first % size or last % size:
        raise ValueError(f"a window of cells starts and ends at a multiple of {bucket_minutes} minutes")
    stored = spark.read.parquet(path)
    inside = stored.filter(F.col("date").between(F.lit(since.date()), F.lit(as_of.date())))
    inside = inside.filter((F.col("bucket") >= int(first // size)) & (F.col("bucket") < int(last // size)))
    return merge_cells(inside)


def train_from_cells(cells: DataFrame, as_of: datetime, min_lines: int = A.MIN_TRAINING_LINES) -> Baseline:
    """The baseline of :func:`tidewatch.plans.baseline.train_baseline` from merged cells instead of logs."""
    cells = cut_lineage(cells)
    templated = cells.filter("lines > 0")
    buckets = templated.groupBy("source", "bucket").agg(
        F.sum("lines").alias("lines"),
        F.sum("errors").alias("errors"),
        F.count("template_id").alias("templates"),
        F.sum("latency_sum").alias("latency_sum"),
        F.sum("latency_lines").alias("latency_lines"),
    )
    stats = A.stats_of_buckets(buckets).filter(F.col("lines_trained") >= min_lines)
    stats = cut_lineage(stats.withColumn("trained_at", F.lit(as_of).cast("timestamp")))
    trained = stats.select("source")
    mean = F.when(F.col("latency_lines") > 0, F.col("latency_sum") / F.col("latency_lines")).otherwise(0.0)
    features = buckets.join(trained, "source", "left_semi").select(
        "source",
        "bucket",
        (F.col("errors") / F.col("lines")).alias("error_rate"),
        F.col("lines").cast("double").alias("line_count"),
        F.col("templates").cast("double").alias("templates"),
        mean.alias("mean_latency"),
    )
    counts = templated.groupBy("source", "template_id").agg(F.sum("lines").alias("count"))
    shares = A.shares_of_counts(counts).join(trained, "source", "left_semi")
    values = cells.filter("n > 0").groupBy("source", "value").agg(F.sum("n").alias("n"))
    return Baseline(stats, shares, values.join(trained, "source", "left_semi"), features, fit_forest(features))
