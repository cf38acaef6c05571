"""Training: one job over all sources gives the tables that detection compares against."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import aggregates as A
from tidewatch.operators.isolation import fit_forest
from tidewatch.operators.templates import Clusters, with_templates
from tidewatch.session import cut_lineage

TRAINING_WINDOW_HOURS = 168


@dataclass
class Baseline:
    stats: DataFrame  # source, error_rate_mean, error_rate_std, lines_trained, trained_at
    templates: DataFrame  # source, template_id, count, frequency
    latencies: DataFrame  # source, value, n
    features: DataFrame  # source, bucket, error_rate, line_count, templates, mean_latency
    trees: DataFrame  # source, tree_id, node, feature, threshold, left, right, size, samples

    def write(self, path: str) -> None:
        """Write the tables under ``path``; a later detection job reads them with :func:`read_baseline`."""
        for name in ("stats", "templates", "latencies", "features"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        # the forest is grown from the features just written, not from the logs again
        features = self.features.sparkSession.read.parquet(f"{path}/features")
        fit_forest(features).write.mode("overwrite").parquet(f"{path}/trees")


def read_baseline(spark: SparkSession, path: str) -> Baseline:
    return Baseline(**{part.name: spark.read.parquet(f"{path}/{part.name}") for part in fields(Baseline)})


def train_baseline(
    logs: DataFrame,
    as_of: datetime,
    hours: int = TRAINING_WINDOW_HOURS,
    bucket_minutes: int = 5,
    min_lines: int = A.MIN_TRAINING_LINES,
    clusters: Clusters | None = None,
    sources: DataFrame | None = None,
) -> Baseline:
    """Baselines of all sources from the logs of [as_of - hours, as_of).

    Sources with fewer than ``min_lines`` lines get none. ``sources`` (name, training_window_hours) shortens the window
    of single sources. With ``clusters`` (of Drain) messages are counted by cluster instead of by masked shape.
    """
    window = A.slice_logs(logs, as_of - timedelta(hours=hours), as_of)
    if sources is not None:
        own = sources.select(F.col("name").alias("source"), F.col("training_window_hours").alias("__hours"))
        age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("timestamp")) / 3_600_000_000
        window = window.join(own, "source", "left").filter(age <= F.coalesce("__hours", F.lit(hours))).drop("__hours")
    if clusters:
        window = with_templates(window, clusters)
    stats = A.rate_stats(window, bucket_minutes).filter(F.col("lines_trained") >= min_lines)
    # One row per source, written once: it gates the other tables.
    stats = cut_lineage(stats.withColumn("trained_at", F.lit(as_of).cast("timestamp")))
    trained = stats.select("source")

    def gated(df: DataFrame) -> DataFrame:
        return df.join(trained, "source", "left_semi")

    # The gate is applied to the small aggregates, not to the logs.
    features = gated(A.bucket_features(window, bucket_minutes))
    return Baseline(
        stats=stats,
        templates=gated(A.template_frequencies(window)),
        latencies=gated(A.latency_sample(window)),
        features=features,
        trees=fit_forest(features),
    )
