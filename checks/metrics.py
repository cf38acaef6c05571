"""Metric series: resampling, models, forecasts, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as V
from checks.views import check, rounded
from tidewatch.operators import autoregression as R
from tidewatch.operators import timeseries as W
from tidewatch.plans.forecasting import train_and_forecast

SERIES_SQL = """
resampled as (
  select name, labels_hash, source, cast(floor(epoch("timestamp")) as bigint) // 300 as slot,
         arg_max(value, row("timestamp", value)) as value
  from metric_samples group by all),
bounds as (select name, labels_hash, source, min(slot) as lo, max(slot) as hi from resampled group by all),
grid as (select name, labels_hash, source, unnest(generate_series(lo, hi)) as slot from bounds),
joined as (
  select g.*, r.value, last_value(r.value ignore nulls) over w as filled,
         g.slot - last_value(case when r.value is not null then g.slot end ignore nulls) over w as since
  from grid g left join resampled r using (name, labels_hash, source, slot)
  window w as (partition by g.name, g.labels_hash, g.source order by g.slot rows between unbounded preceding and current row)),
points as (
  select name, labels_hash, source, slot, filled as value,
         row_number() over (partition by name, labels_hash, source order by slot) as pos
  from joined where since <= 3),
diffs as (
  select *, value - lag(value) over s as diff, lag(value) over s - lag(value, 2) over s as prev_diff
  from points window s as (partition by name, labels_hash, source order by pos)),
choice as (
  select name, labels_hash, source, count(*) as points, cast(floor(count(*) * cast(0.9 as double)) as bigint) as train_points,
         avg(case when diff >= 0 then 1.0 when diff < 0 then 0.0 end) as rising_share
  from diffs group by all having count(*) >= 72),
models as (
  select *, case when regexp_matches(lower(name), 'disk|storage|capacity') or rising_share >= 0.95 then 'arima' else 'autoarima' end as model_type
  from choice),
fitted as (
  select m.name, m.labels_hash, m.source, m.train_points, m.points,
         sum(diff * prev_diff) filter (where pos <= train_points) / nullif(sum(prev_diff * prev_diff) filter (where pos <= train_points), 0) as phi,
         arg_max(value, pos) filter (where pos <= train_points) as last_value,
         arg_max(diff, pos) filter (where pos <= train_points) as last_diff,
         max(slot) filter (where pos <= train_points) as last_slot
  from models m join diffs d using (name, labels_hash, source) where model_type = 'arima' group by all),
arima as (
  select f.name, f.labels_hash, f.source, f.points, f.train_points, f.phi, f.last_value, f.last_diff, f.last_slot,
         sqrt(avg(power(last_value + last_diff * phi * (1 - power(phi, pos - train_points)) / (1 - phi) - value, 2))) as rmse
  from fitted f join diffs d using (name, labels_hash, source) where pos > train_points group by all),
forecast as (
  select name, labels_hash, source, h as horizon_hours, step,
         make_timestamp((last_slot + step) * 300000000) as ts,
         last_value + last_diff * phi * (1 - power(phi, step)) / (1 - phi) as value
  from arima, (values (24), (48), (168)) as hs(h), lateral (select unnest(generate_series(1, h * 12)) as step))
"""
VIEWS_LINE = "-- views: metric_samples, thresholds"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_differences(W.fill_gaps(W.resample(V.metric_samples(spark, sf_dir))))


@check(
    "w1_resample",
    f"""
{VIEWS_LINE}
with {SERIES_SQL}
select name, labels_hash, source, slot, value from resampled
""",
)
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.resample(V.metric_samples(spark, sf_dir))


@check(
    "w2_fill_gaps",
    f"""
{VIEWS_LINE}
with {SERIES_SQL}
select name, labels_hash, source, slot, make_timestamp(slot * 300000000) as ts, value, pos from points
""",
)
def fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.fill_gaps(W.resample(V.metric_samples(spark, sf_dir)))


@check(
    "w3_mostly_increasing",
    f"""
{VIEWS_LINE}
with {SERIES_SQL}
select name, source, round(rising_share, 6) as rising_share, rising_share >= 0.95 as mostly_increasing from choice
""",
)
def mostly_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = rounded(W.model_choice(_points(spark, sf_dir)), "rising_share")
    return choice.select("name", "source", "rising_share", (F.col("rising_share") >= W.MOSTLY).alias("mostly_increasing"))


@check(
    "w4_model_choice",
    f"""
{VIEWS_LINE}
with {SERIES_SQL}
select name, labels_hash, source, model_type from models
""",
)
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.model_choice(_points(spark, sf_dir)).select(*W.SERIES, "model_type")


@check(
    "w5_gate_and_split",
    f"""
{VIEWS_LINE}
with {SERIES_SQL}
select name, labels_hash, source, points, train_points from models
""",
)
def gate_and_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.model_choice(_points(spark, sf_dir)).select(*W.SERIES, "points", "train_points")


def _arima(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return W.fit_arima(points, W.model_choice(points))


@check(
    "w6_arima",
    f"""
{VIEWS_LINE}
with {SERIES_SQL}
select name, labels_hash, source, points, train_points, round(phi, 6) as phi, last_value, round(last_diff, 6) as last_diff, round(rmse, 6) as rmse
from arima
""",
)
def arima(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _arima(spark, sf_dir).drop("last_ts", "model_type")
    return rounded(fitted, "phi", "last_diff", "rmse")


@check("w7_autoregression")
def autoregression(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return R.fit_autoregressions(points, W.model_choice(points))


@check(
    "w8_arima_forecast",
    f"""
{VIEWS_LINE}
with {SERIES_SQL}
select name, labels_hash, source, 'arima' as model_type, horizon_hours, step, ts, round(value, 6) as value from forecast
""",
)
def arima_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.forecast_arima(_arima(spark, sf_dir)), "value")


@check("w8_autoregression_forecast")
def autoregression_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return R.forecast_autoregressions(R.fit_autoregressions(points, W.model_choice(points)))


@check(
    "w9_threshold_crossing",
    f"""
{VIEWS_LINE}
with {SERIES_SQL}
select name, labels_hash, source, horizon_hours, direction, threshold, min(ts) as exhaustion_time,
       round(arg_min(value, step), 6) as predicted_value
from forecast join thresholds on metric_name = name
where (direction = 'above' and value >= threshold) or (direction = 'below' and value <= threshold)
group by all
""",
)
def threshold_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    crossed = W.threshold_crossings(W.forecast_arima(_arima(spark, sf_dir)), V.thresholds(spark))
    return rounded(crossed, "predicted_value")


@check(
    "w10_train_models",
    f"""
{VIEWS_LINE}
with {SERIES_SQL}
select name as metric_name, labels_hash, source, model_type, timestamp '2024-01-31' as trained_at from models
""",
)
def train_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = train_and_forecast(V.metric_samples(spark, sf_dir), V.thresholds(spark), V.RETRAIN)
    return run.models.drop("rmse")


@check(
    "w10_predictions",
    f"""
{VIEWS_LINE}
with {SERIES_SQL}
select left(sha256(name || '|' || labels_hash || '|' || source || '|' || h || '|2024-01-31 00:00:00'), 32) as id,
       name as metric_name, labels_hash, source, h as horizon_hours, h * 12 as steps, timestamp '2024-01-31' as predicted_at
from models, (values (24), (48), (168)) as hs(h)
""",
)
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = train_and_forecast(V.metric_samples(spark, sf_dir), V.thresholds(spark), V.RETRAIN)
    rows = run.predictions(V.RETRAIN)
    return rows.withColumn("steps", F.size("predictions")).drop("predictions", "exhaustion_time", "threshold")
