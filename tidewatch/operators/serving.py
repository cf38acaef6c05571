"""Reads behind a dashboard: recent rows, newest first, top n per source."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.store import between


def recent_logs(logs: DataFrame, source: str, since: datetime | str, limit: int = 10_000) -> DataFrame:
    """Oldest lines of a source since a time."""
    rows = between(logs.filter(F.col("source") == source), "timestamp", since)
    columns = ["timestamp", "source", "level", "message", "template_id", "fields", "line_number"]
    return rows.select(*columns).orderBy("timestamp", "line_number").limit(limit)


def recent_anomalies(anomalies: DataFrame, source: str | None = None, limit: int = 100) -> DataFrame:
    """Newest anomalies, of one source or of all."""
    rows = anomalies if source is None else anomalies.filter(F.col("source") == source)
    return rows.orderBy(F.desc("detected_at"), "id").limit(limit)


def recent_metrics(samples: DataFrame, name: str, since: datetime | str, limit: int = 10_000) -> DataFrame:
    """Oldest samples of a metric since a time."""
    rows = between(samples.filter(F.col("name") == name), "timestamp", since)
    return rows.orderBy("timestamp", "labels_hash", "value").limit(limit)


def recent_predictions(predictions: DataFrame, metric_name: str | None = None, limit: int = 50) -> DataFrame:
    rows = predictions if metric_name is None else predictions.filter(F.col("metric_name") == metric_name)
    return rows.orderBy(F.desc("predicted_at"), "id").limit(limit)


def recent_correlations(events: DataFrame, since: datetime | str | None = None, limit: int = 100) -> DataFrame:
    return between(events, "detected_at", since).orderBy(F.desc("detected_at"), "id").limit(limit)


def top_per_source(anomalies: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    """The ``n`` newest anomalies of every source. The rank limit runs before the shuffle as well."""
    order = order or [F.desc("detected_at"), F.asc("id")]
    ranked = anomalies.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)
