"""Reads of recent rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as V
from checks.detection import PAIRS_SQL
from checks.metrics import SERIES_SQL, VIEWS_LINE
from checks.views import check
from tidewatch.operators import correlate as J
from tidewatch.operators import serving as L
from tidewatch.plans.forecasting import train_and_forecast


@check(
    "l1_recent_logs",
    """
-- views: logs
select "timestamp", source, level, message, template_id, line_number from logs
where source = 'svc-2' and "timestamp" >= timestamp '2024-01-10' order by "timestamp", line_number limit 10000
""",
)
def recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recent_logs(V.logs(spark, sf_dir), "svc-2", datetime(2024, 1, 10)).drop("fields")


@check(
    "l2_recent_anomalies",
    """
-- views: anomalies
select id, detected_at, source, severity from log_anomalies order by detected_at desc, id limit 100
""",
)
def recent_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recent_anomalies(V.log_anomalies(spark, sf_dir))


@check(
    "l2_recent_anomalies_of_source",
    """
-- views: anomalies
select id, detected_at, source, severity from log_anomalies where source = 'svc-4' order by detected_at desc, id limit 20
""",
)
def recent_anomalies_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recent_anomalies(V.log_anomalies(spark, sf_dir), "svc-4", 20)


@check(
    "l3_recent_metrics",
    """
-- views: metric_samples
select * from metric_samples where name = 'disk_2' and "timestamp" >= timestamp '2024-01-24'
order by "timestamp", labels_hash, value limit 10000
""",
)
def recent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recent_metrics(V.metric_samples(spark, sf_dir), "disk_2", datetime(2024, 1, 24))


@check(
    "l4_recent_predictions",
    f"""
{VIEWS_LINE}
with {SERIES_SQL},
runs as (
  select left(sha256(name || '|' || labels_hash || '|' || source || '|' || h || '|2024-01-31 00:00:00'), 32) as id,
         name as metric_name, h as horizon_hours, timestamp '2024-01-31' as predicted_at
  from models, (values (24), (48), (168)) as hs(h))
select * from runs order by predicted_at desc, id limit 5
""",
)
def recent_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = train_and_forecast(V.metric_samples(spark, sf_dir), V.thresholds(spark), V.RETRAIN)
    rows = L.recent_predictions(run.predictions(V.RETRAIN), limit=5)
    return rows.select("id", "metric_name", "horizon_hours", "predicted_at")


@check(
    "l5_recent_correlations",
    f"""
-- views: anomalies
with {PAIRS_SQL},
seen as (
  select left(sha256(log_event_id || '|' || metric_event_id), 32) as id, log_event_id, metric_event_id,
         greatest(l.detected_at, m.detected_at) as detected_at
  from pairs p join typed l on l.id = log_event_id join typed m on m.id = metric_event_id)
select * from seen where detected_at >= timestamp '2024-01-05' order by detected_at desc, id limit 100
""",
)
def recent_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = V.log_anomalies(spark, sf_dir), V.metric_anomalies(spark, sf_dir)
    now = F.lit("2024-02-01").cast("timestamp")
    seen = J.newest_correlations(left, right, now, limit=100)
    return L.recent_correlations(seen, datetime(2024, 1, 5), limit=100)


@check(
    "l6_top_per_source",
    """
-- views: anomalies
select * from (
  select id, detected_at, source, severity, row_number() over (partition by source order by detected_at desc, id) as rank
  from log_anomalies) as r where rank <= 20
""",
)
def top_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.top_per_source(V.log_anomalies(spark, sf_dir), 20)
