"""Correlation of log and metric anomalies in time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.functions.skew import PART, interval_join
from tidewatch.sources.store import between

WINDOW_SECONDS = 300
MIN_CONFIDENCE = 0.5


def _side(anomalies: DataFrame, side: str, as_of: Column) -> DataFrame:
    """Only the columns the pairing needs, with the side as prefix, those with few values first."""
    missing = F.lit(None).cast("timestamp")
    times = [F.col(c) if c in anomalies.columns else missing for c in ("detected_at", "timestamp")]
    return anomalies.select(
        F.unix_micros(S.event_time(*times, as_of)).alias(f"{side}_time"),
        F.coalesce("source", F.lit("")).alias(f"{side}_source"),
        S.correlation_order(F.col("severity")).alias(f"{side}_order"),
        F.col("id").alias(f"{side}_event_id"),
    )


def _reachable(order: Column, min_confidence: float) -> Column:
    """Whether an anomaly could reach the confidence with the best partner: same time, same source, top severity."""
    return F.lit(0.4 + 0.3) + order * 3 / 9.0 * 0.3 >= min_confidence - 1e-9


def find_correlations(
    log_anomalies: DataFrame,
    metric_anomalies: DataFrame,
    as_of: Column,
    window_seconds: float = WINDOW_SECONDS,
    min_confidence: float = MIN_CONFIDENCE,
    allow_self: bool = True,
    rows_per_split: int = PART,
) -> DataFrame:
    """All pairs of a log and a metric anomaly within the window that reach the confidence."""
    left = _side(log_anomalies, "log", as_of)
    right = _side(metric_anomalies, "metric", as_of)
    left = left.filter(_reachable(F.col("log_order"), min_confidence))
    right = right.filter(_reachable(F.col("metric_order"), min_confidence))
    pairs = interval_join(left, right, "log_time", "metric_time", int(window_seconds * 1_000_000), rows_per_split)
    delta = (F.col("metric_time") - F.col("log_time")) / F.lit(1_000_000.0)
    scored = pairs.withColumns(
        {
            "time_delta_sec": delta,
            "confidence": S.confidence(
                delta,
                window_seconds,
                F.col("log_source") == F.col("metric_source"),
                F.col("log_order"),
                F.col("metric_order"),
            ),
        }
    ).filter(F.col("confidence") >= min_confidence)
    if not allow_self:
        scored = scored.filter(F.col("log_event_id") != F.col("metric_event_id"))
    return scored.select(
        S.stable_id(F.col("log_event_id"), F.col("metric_event_id")).alias("id"),
        "log_event_id",
        "metric_event_id",
        "time_delta_sec",
        "confidence",
        as_of.alias("detected_at"),
    )


def _seen(anomalies: DataFrame, side: str, as_of: Column) -> DataFrame:
    """The side's columns with the times at which its id was seen (``<side>_at``), a row for each of them."""
    at = anomalies.select(F.col("id").alias(f"{side}_event_id"), F.col("detected_at").alias(f"{side}_at"))
    return _side(anomalies, side, as_of).join(at, f"{side}_event_id")


def newest_correlations(
    log_anomalies: DataFrame,
    metric_anomalies: DataFrame,
    as_of: Column,
    limit: int,
    window_seconds: float = WINDOW_SECONDS,
) -> DataFrame:
    """Pairs of any confidence within the window, with the later time of both, among them the ``limit`` newest.

    Not all pairs are made. A log anomaly with a metric anomaly in its own time bucket has a pair that is at least as
    new as itself, so the ``limit`` newest of these bound the time of what is asked for from below, and each pair as
    new as that has a side that is. Only those are joined to the others. Without so many, all pairs are made.
    """
    width = int(window_seconds * 1_000_000)
    left, right = _seen(log_anomalies, "log", as_of), _seen(metric_anomalies, "metric", as_of)
    buckets = right.select(F.floor(F.col("metric_time") / width).alias("__bucket")).distinct()
    paired = left.withColumn("__bucket", F.floor(F.col("log_time") / width)).join(buckets, "__bucket", "left_semi")
    newest = paired.filter("log_at is not null").select(F.unix_micros("log_at").alias("at")).orderBy(F.desc("at")).limit(limit)
    bound = newest.agg(F.count("*").alias("n"), F.min("at").alias("at")).first()

    def joined(logs: DataFrame, metrics: DataFrame) -> DataFrame:
        return interval_join(logs, metrics, "log_time", "metric_time", width)

    if bound["n"] < limit:
        pairs = joined(left, right)
    else:
        new_log, new_metric = (F.coalesce(F.unix_micros(c) >= bound["at"], F.lit(False)) for c in ("log_at", "metric_at"))
        pairs = joined(left.filter(new_log), right).unionByName(joined(left.filter(~new_log), right.filter(new_metric)))
    return pairs.select(
        S.stable_id(F.col("log_event_id"), F.col("metric_event_id")).alias("id"),
        "log_event_id",
        "metric_event_id",
        F.greatest("log_at", "metric_at").alias("detected_at"),
    )


def correlation_cycle(
    anomalies: DataFrame,
    as_of: datetime,
    window_seconds: float = WINDOW_SECONDS,
    min_confidence: float = MIN_CONFIDENCE,
    allow_self: bool = False,
) -> DataFrame:
    """Correlate the anomalies that are not older than two windows among themselves, all of them.

    ``allow_self`` also pairs each anomaly with itself.
    """
    recent = between(anomalies, "detected_at", as_of - timedelta(seconds=2 * window_seconds))
    now = F.lit(as_of).cast("timestamp")
    return find_correlations(recent, recent, now, window_seconds, min_confidence, allow_self)
