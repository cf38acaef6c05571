"""Per-series choice among small autoregressions, for metrics without a trend.

Candidates are least-squares autoregressions with an intercept: 0 or 1 difference, 0 to 3 lags, with or without a
lag of one season (12 slots, one hour). The one with the lowest corrected Akaike criterion is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import grouped
from tidewatch.operators.timeseries import HORIZONS, SERIES, STEPS_PER_HOUR, step_time

SEASON = 12
MAX_LAGS = 3

MODEL_SCHEMA = (
    "name string, labels_hash string, source string, model_type string, points bigint, train_points bigint, "
    "differences int, lags array<int>, coefficients array<double>, tail array<double>, last_ts timestamp, "
    "aicc double, rmse double"
)


def _design(series: np.ndarray, lags: list[int], skip: int) -> tuple[np.ndarray, np.ndarray]:
    target = series[skip:]
    columns = [np.ones(len(target))] + [series[skip - lag : len(series) - lag] for lag in lags]
    return np.column_stack(columns), target


def _fit(values: np.ndarray) -> tuple[float, int, list[int], np.ndarray]:
    best: tuple[float, int, list[int], np.ndarray] | None = None
    for differences in (0, 1):
        series = np.diff(values, differences)
        skip = SEASON + 1 - differences  # all candidates are judged on the same points
        for count in range(MAX_LAGS + 1):
            for seasonal in (False, True):
                lags = list(range(1, count + 1)) + ([SEASON] if seasonal else [])
                design, target = _design(series, lags, skip)
                coefficients, *_ = np.linalg.lstsq(design, target, rcond=None)
                residual = target - design @ coefficients
                n, k = len(target), len(coefficients) + 1
                variance = max(float(residual @ residual) / n, 1e-12)
                aicc = n * np.log(variance) + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)
                if best is None or aicc < best[0] - 1e-9:
                    best = (float(aicc), differences, lags, coefficients)
    assert best is not None
    return best


def _extend(tail: np.ndarray, differences: int, lags: list[int], coefficients: np.ndarray, steps: int) -> np.ndarray:
    level = tail[-1]
    history = list(np.diff(tail, differences))
    out = np.empty(steps)
    for i in range(steps):
        value = coefficients[0] + sum(c * history[-lag] for c, lag in zip(coefficients[1:], lags))
        history.append(value)
        level = level + value if differences else value
        out[i] = level
    return out


def _train(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
    points = points.sort_values("pos")
    values = points["value"].to_numpy(dtype=float)
    split = int(points["train_points"].iloc[0])
    train, test = values[:split], values[split:]
    aicc, differences, lags, coefficients = _fit(train)
    tail = train[-(SEASON + 1) :]
    error = _extend(tail, differences, lags, coefficients, len(test)) - test
    rmse = float(np.sqrt(np.mean(error**2))) if len(test) else 0.0
    row = [*key, "autoarima", len(values), split, differences, lags, coefficients.tolist(), tail.tolist()]
    row += [points["ts"].iloc[split - 1], aicc, rmse]
    names = [c.split(" ")[0] for c in MODEL_SCHEMA.split(", ")]
    return pd.DataFrame([row], columns=names)


def fit_autoregressions(points: DataFrame, choice: DataFrame) -> DataFrame:
    """One model per series that got no trend model; a task sees one resampled series."""
    chosen = choice.filter(F.col("model_type") == "autoarima").select(*SERIES, "train_points")
    chosen = points.select(*SERIES, "pos", "ts", "value").join(chosen, SERIES)
    return grouped(chosen, *SERIES).applyInPandas(_train, MODEL_SCHEMA)


def forecast_autoregressions(
    models: DataFrame, horizons: tuple[int, ...] | list[int] = HORIZONS, anchor: Column | None = None
) -> DataFrame:
    """Forecast steps per series and horizon; each model row is extended on its own."""
    longest = max(horizons) * STEPS_PER_HOUR
    start = F.col("last_ts") if anchor is None else anchor

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                path = _extend(
                    np.asarray(row.tail), row.differences, list(row.lags), np.asarray(row.coefficients), longest
                )
                yield pd.DataFrame(
                    {
                        "name": row.name,
                        "labels_hash": row.labels_hash,
                        "source": row.source,
                        "start": row.start,
                        "step": np.arange(1, longest + 1),
                        "value": path,
                    }
                )

    needed = models.select(*SERIES, "differences", "lags", "coefficients", "tail", start.alias("start"))
    schema = "name string, labels_hash string, source string, start timestamp, step int, value double"
    steps = needed.mapInPandas(extend, schema)
    hours = F.explode(
        F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: F.col("step") <= h * STEPS_PER_HOUR)
    )
    return steps.select(
        *SERIES,
        F.lit("autoarima").alias("model_type"),
        hours.alias("horizon_hours"),
        "step",
        step_time(F.col("start"), F.col("step")).alias("ts"),
        "value",
    )
