"""Tables at rest and streams: the given tables are written through them and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import detection, ingest, metrics, training  # noqa: F401  (SQL of all of them is used)
from checks import views as V
from checks.views import check, rounded
from tidewatch import schemas
from tidewatch.operators import templates as T
from tidewatch.operators.alerts import routable
from tidewatch.plans.forecasting import train_and_forecast
from tidewatch.plans.state import append_cells, read_cells, train_from_cells
from tidewatch.session import new_shared_folder
from tidewatch.sources import store
from tidewatch.sources.tailing import stream_growing_files
from tidewatch.sources.textlogs import read_log_files
from tidewatch.streaming.alerts import stream_cooldown
from tidewatch.streaming.correlation import stream_correlations
from tidewatch.streaming.detection import write_detections
from tidewatch.streaming.ingest import write_scrapes
from tidewatch.streaming.templates import write_templates


def same_sql(name: str, as_name: str) -> None:
    """The SQL of a query that gives the same rows by another way."""
    V.ORACLES[name] = V.ORACLES[as_name]


@check(
    "k1_append_logs",
    """
-- views: logs
select source, line_number, "timestamp", level, message, template_id, ingested_at from logs
""",
)
def append_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_folder(spark)
    store.append_logs(V.logs(spark, sf_dir), path)
    read = spark.read.parquet(path)
    return read.select("source", "line_number", "timestamp", "level", "message", "template_id", "ingested_at")


@check(
    "k2_append_anomalies",
    """
-- views: anomalies
select id, anomaly_type, severity, score, source, detected_at, 'anomaly ' || id as description, '{}' as context, false as alerted
from alert_anomalies
""",
)
def append_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_folder(spark)
    store.append_anomalies(V.alert_anomalies(spark, sf_dir), path)
    return spark.read.parquet(path).drop("sample_lines", "date", "run")


@check(
    "k3_append_metric_samples",
    """
-- views: metric_samples
select name, labels_hash, source, value, "timestamp" from metric_samples
""",
)
def append_metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_folder(spark)
    store.append_metric_samples(V.metric_samples(spark, sf_dir), path)
    return spark.read.parquet(path).select("name", "labels_hash", "source", "value", "timestamp")


@check(
    "k4_append_predictions",
    f"""
{metrics.VIEWS_LINE}
with {metrics.SERIES_SQL},
crossed as (
  select name, labels_hash, source, horizon_hours, threshold, min(ts) as exhaustion_time
  from forecast join thresholds on metric_name = name
  where (direction = 'above' and value >= threshold) or (direction = 'below' and value <= threshold)
  group by name, labels_hash, source, horizon_hours, threshold)
select f.name as metric_name, f.labels_hash, f.source, f.horizon_hours, f.ts, round(f.value, 6) as value, exhaustion_time,
       threshold, timestamp '2024-01-31' as predicted_at
from forecast f left join crossed c
  on c.name = f.name and c.labels_hash = f.labels_hash and c.source = f.source and c.horizon_hours = f.horizon_hours
""",
)
def append_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole forecasts of the series with a trend model, as stored: steps, threshold and time of crossing."""
    path = new_shared_folder(spark)
    run = train_and_forecast(V.metric_samples(spark, sf_dir), V.thresholds(spark), V.RETRAIN)
    store.append_predictions(run.predictions(V.RETRAIN), path)
    keys = ["metric_name", "labels_hash", "source"]
    trend = run.models.filter("model_type = 'arima'").select(*keys)
    read = spark.read.schema(schemas.PREDICTIONS).parquet(path).join(trend, keys, "left_semi")
    steps = read.select("*", F.inline("predictions")).drop("id", "predictions")
    return rounded(steps, "value")


@check("w10_seasonal_predictions")
def seasonal_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole forecasts of the series with a seasonal model."""
    run = train_and_forecast(V.metric_samples(spark, sf_dir), V.thresholds(spark), V.RETRAIN)
    return run.steps.filter("model_type = 'autoarima'")


@check("k7_append_correlated_events")
def append_correlated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_folder(spark)
    found = stream_correlations(V.log_anomalies(spark, sf_dir), V.metric_anomalies(spark, sf_dir))
    store.append_correlated_events(found, path)
    read = spark.read.parquet(path).drop("detected_at", "date", "run")
    return rounded(rounded(read, "confidence", digits=9), "time_delta_sec")


same_sql("k7_append_correlated_events", "x6_stream_correlation")


@check(
    "s1_log_files",
    """
-- views: logs
select source, message as line from logs
""",
)
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as text files of each source, read as lines."""
    path = new_shared_folder(spark)
    V.logs(spark, sf_dir).select("source", F.col("message").alias("value")).write.partitionBy("source").text(path)
    return read_log_files(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "line")


@check(
    "s1_growing_files",
    """
-- views: logs
select message as line from logs
""",
)
def growing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files to which lines are added between two runs of a stream."""
    path, out = new_shared_folder(spark), new_shared_folder(spark)
    for even in (0, 1):
        some = V.logs(spark, sf_dir).filter(F.col("line_number") % 2 == even)
        some.select(F.col("message").alias("value")).write.mode("append").text(f"{path}/in")
        lines = stream_growing_files(spark, f"{path}/in/*.txt").writeStream.format("parquet").option("path", f"{out}/lines")
        lines.option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/lines").select("line")


def _landed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A stream of rows that lie in the shared folder."""
    path = new_shared_folder(spark)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@check("t1_drain_line_templates")
def drain_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Drain template of every line."""
    lines = T.assign_shapes(V.message_logs(spark, sf_dir)).withColumn("message", F.lit(None).cast("string"))
    return T.drain_lines(lines).select("source", "line_number", "template_id", "template")


@check("x1_drain_stream")
def drain_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the id of their Drain cluster, as they come out of a stream."""
    out = new_shared_folder(spark)
    columns = ["source", "timestamp", "line_number", "message"]
    write_templates(_landed(spark, V.message_logs(spark, sf_dir).select(*columns)), f"{out}/logs", f"{out}/cp", once=True).awaitTermination()
    return spark.read.parquet(f"{out}/logs").select("source", "line_number", "template_id")


@check("x2_stream_detections")
def stream_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of the closed windows of a day, found by a stream."""
    out = new_shared_folder(spark)
    stream = _landed(spark, detection.current_logs(spark, sf_dir))
    known = detection.baseline(spark, sf_dir)
    write_detections(stream, known, f"{out}/found", f"{out}/cp", window_minutes=360, once=True).awaitTermination()
    read = spark.read.schema(schemas.ANOMALIES).parquet(f"{out}/found")
    return read.select("id", "anomaly_type", "severity", "score", "source", "detected_at", "description", "context")


@check("x3_incremental_baseline")
def incremental_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training from cells that three runs have added up, each with lines of all days."""
    path = new_shared_folder(spark)
    for part in range(3):
        some = V.logs(spark, sf_dir).filter(F.col("line_number") % 3 == part)
        append_cells(some, path, f"run{part}", V.DAY)
    cells = read_cells(spark, path, V.SPLIT, V.TRAIN_HOURS, V.DAY)
    return rounded(train_from_cells(cells, V.SPLIT).stats, "error_rate_mean", "error_rate_std")


same_sql("x3_incremental_baseline", "a11_baseline_stats")


@check("x5_stream_cooldown")
def cooldown_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_shared_folder(spark)
    stream = _landed(spark, routable(V.alert_anomalies(spark, sf_dir), V.channels(spark)))
    alerts = stream_cooldown(stream, detection.COOLDOWN).writeStream.format("parquet").option("path", f"{out}/alerts")
    alerts.option("checkpointLocation", f"{out}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/alerts").select("id", "source", "anomaly_type", "template_key")


same_sql("x5_stream_cooldown", "c1_cooldown")


@check("x7_scrapes")
def scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped bodies through a stream into the metric table."""
    out = new_shared_folder(spark)
    bodies = ingest.scrape_bodies(spark, sf_dir).withColumn("scraped_at", F.lit(datetime(2024, 2, 1)).cast("timestamp"))
    write_scrapes(_landed(spark, bodies), f"{out}/samples", f"{out}/cp", *ingest.SCRAPE_FILTERS, once=True).awaitTermination()
    return spark.read.parquet(f"{out}/samples").select("name", "labels", "labels_hash", "value", "timestamp", "metric_type", "source")


V.ORACLES["x7_scrapes"] = f"select * exclude (body_id) from ({V.ORACLES['s5_prometheus_text']})"
