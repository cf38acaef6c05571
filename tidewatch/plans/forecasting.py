"""Training and forecasting of all metric series in one job."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import seasonal as R
from tidewatch.operators import timeseries as W
from tidewatch.session import cut_lineage
from tidewatch.sources.store import nest_predictions


@dataclass
class Forecast:
    models: DataFrame  # metric_name, labels_hash, source, model_type, trained_at, rmse
    steps: DataFrame  # name, labels_hash, source, model_type, horizon_hours, step, ts, value
    crossings: DataFrame  # first threshold crossing per series and horizon

    def predictions(self, as_of: datetime) -> DataFrame:
        """One row per series and horizon with nested steps, exhaustion time and threshold."""
        nested = nest_predictions(self.steps, F.lit(as_of).cast("timestamp"))
        found = self.crossings.select(
            F.col("name").alias("metric_name"), "labels_hash", "source", "horizon_hours", "exhaustion_time", "threshold"
        )
        return nested.join(found, ["metric_name", "labels_hash", "source", "horizon_hours"], "left")


def train_and_forecast(
    samples: DataFrame,
    thresholds: DataFrame,
    as_of: datetime,
    horizons: tuple[int, ...] | list[int] = W.HORIZONS,
    anchor_now: bool = False,
) -> Forecast:
    """Models, forecasts and threshold crossings of every series with enough points.

    Forecasts start after the last training point, or at ``as_of`` with ``anchor_now``.
    """
    points = W.with_differences(W.fill_gaps(W.resample(samples)))
    choice = W.model_choice(points)
    anchor = F.lit(as_of).cast("timestamp") if anchor_now else None
    arima = W.fit_arima(points, choice)
    auto = cut_lineage(R.fit_seasonal(points, choice))  # read for models, steps and crossings
    common = [F.col("name").alias("metric_name"), "labels_hash", "source", "model_type"]
    trained = F.lit(as_of).cast("timestamp").alias("trained_at")
    models = arima.select(*common, trained, "rmse").unionByName(auto.select(*common, trained, "rmse"))
    steps = W.forecast_arima(arima, horizons, anchor).unionByName(R.forecast_seasonal(auto, horizons, anchor))
    return Forecast(models, steps, W.threshold_crossings(steps, thresholds))
