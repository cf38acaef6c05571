"""Continuous detection over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch import schemas
from tidewatch.operators import detectors as D
from tidewatch.plans.baseline import Baseline
from tidewatch.plans.detection import detect
from tidewatch.sources.store import conform, write_batch


def windowed_observations(logs: DataFrame, window_minutes: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """Equal lines of a window counted together: (source, window, is_error, template, latency) -> n.

    Lines later than the watermark are left out. In append mode a window appears once the watermark has passed its
    end, so the newest windows are still open.
    """
    observed = D.observations(logs.withWatermark("timestamp", lateness), "timestamp")
    window = F.window("timestamp", f"{window_minutes} minutes")
    counted = observed.groupBy("source", window.alias("w"), "is_error", "template_id", "latency").agg(
        F.count("*").alias("n")
    )
    return counted.select(
        "source",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "is_error",
        "template_id",
        "latency",
        "n",
    )


def write_detections(
    logs: DataFrame,
    baseline: Baseline,
    path: str,
    checkpoint: str,
    sources: DataFrame | None = None,
    window_minutes: int = 5,
    lateness: str = "10 minutes",
    once: bool = False,
) -> StreamingQuery:
    """The anomalies of every closed window into the anomaly table.

    Each micro-batch holds the counts of the windows that closed; the batch detectors run on them as they are.
    """
    by = ["source", "window_start"]

    def append(batch: DataFrame, batch_id: int) -> None:
        batch = batch.drop("window_end")
        end = F.col("window_start") + F.make_dt_interval(mins=F.lit(window_minutes))
        found = detect(batch, baseline, end, sources, by=by, window_minutes=window_minutes)
        write_batch(conform(found, schemas.ANOMALIES), path, batch_id, F.col("detected_at"))

    windows = windowed_observations(logs, window_minutes, lateness)
    writer = windows.writeStream.outputMode("append").foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_training(logs: DataFrame, path: str, as_of, **options) -> None:
    """One training run as a batch job; start it every few hours from the scheduler of the cluster."""
    from tidewatch.plans.baseline import train_baseline

    train_baseline(logs, as_of, **options).write(path)
