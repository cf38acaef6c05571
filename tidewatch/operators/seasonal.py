"""Seasonal ARIMA per series, for metrics without a trend: orders found stepwise, fitted by conditional likelihood.

The model is (p,d,q)(P,D,Q) with a season of 12 slots, one hour. A seasonal difference is taken if the seasonal part of
a moving-average decomposition is strong, an ordinary one if the level is not stationary by the KPSS test. Orders are
searched stepwise from four starting models to better neighbours by the corrected Akaike criterion, on the newest
``SEARCH_POINTS`` points; the model found is fitted to all training points. Coefficients are parametrised by partial
autocorrelations, so every model is stationary and invertible. Innovations before the first point are zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.timeseries import HORIZONS, SERIES, STEPS_PER_HOUR, step_time
from tidewatch.session import grouped

SEASON = 12
MOST = (3, 3, 1, 1)  # p, q, P, Q
STARTS = ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))
SEARCH_POINTS = 600
STRONG_SEASON = 0.64
KPSS_LIMIT = 0.463  # fixed: 5 % point of the level test
ITERATIONS = 25
NEGLIGIBLE = 1e-10

MODEL_SCHEMA = (
    "name string, labels_hash string, source string, model_type string, points bigint, train_points bigint, "
    "orders array<int>, constant double, ar array<double>, ma array<double>, tail array<double>, "
    "innovations array<double>, last_ts timestamp, aicc double, rmse double"
)

Orders = tuple[int, int, int, int]


def seasonal_strength(values: np.ndarray) -> float:
    """Share of the detrended variance that a fixed hourly pattern explains."""
    if len(values) < 3 * SEASON:
        return 0.0
    weights = np.r_[0.5, np.ones(SEASON - 1), 0.5] / SEASON
    rest = values[SEASON // 2 : -(SEASON // 2)] - np.convolve(values, weights, "valid")
    slot = np.arange(len(rest)) % SEASON
    pattern = np.bincount(slot, rest, SEASON) / np.bincount(slot, minlength=SEASON)
    total = rest.var()
    return 0.0 if total < NEGLIGIBLE else max(0.0, 1 - (rest - pattern[slot]).var() / total)


def kpss(values: np.ndarray) -> float:
    """Level stationarity statistic with a Bartlett window."""
    rest = values - values.mean()
    n, lags = len(rest), int(4 * (len(rest) / 100) ** 0.25)
    variance = rest @ rest / n
    for lag in range(1, lags + 1):
        variance += 2 * (1 - lag / (lags + 1)) * (rest[lag:] @ rest[:-lag]) / n
    return 0.0 if variance < NEGLIGIBLE else float((np.cumsum(rest) ** 2).sum() / (n * n * variance))


def differenced(values: np.ndarray, d: int, seasonal: int) -> np.ndarray:
    for _ in range(seasonal):
        values = values[SEASON:] - values[:-SEASON]
    return np.diff(values, d)


def coefficients(free: np.ndarray) -> np.ndarray:
    """Any numbers to the coefficients of a stationary autoregression, by way of partial autocorrelations."""
    out = np.zeros(0)
    for partial in np.tanh(free):
        out = np.append(out - partial * out[::-1], partial)
    return out


def polynomial(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """1 - sum of lags, times the same of whole seasons."""
    seasonal = np.zeros(len(long) * SEASON + 1)
    seasonal[0] = 1.0
    seasonal[SEASON::SEASON] = -long
    return np.convolve(np.r_[1.0, -short], seasonal)


def inverse(poly: np.ndarray, n: int) -> np.ndarray:
    """The first terms of 1 / poly, up to ``n`` or until they vanish."""
    lags = np.flatnonzero(poly[1:]) + 1
    if not len(lags):
        return np.ones(1)
    out, weights, longest = [1.0], poly[lags].tolist(), int(lags[-1])
    lag_list, quiet = lags.tolist(), 0
    for i in range(1, n):
        term = -sum(w * out[i - lag] for w, lag in zip(weights, lag_list) if lag <= i)
        out.append(term)
        quiet = quiet + 1 if abs(term) < NEGLIGIBLE else 0
        if quiet > longest:
            break
    return np.array(out)


def unpacked(free: np.ndarray, orders: Orders, with_mean: bool) -> tuple[np.ndarray, np.ndarray, float]:
    p, q, P, Q = orders
    parts = np.split(free[: p + q + P + Q], np.cumsum([p, q, P]))
    ar = polynomial(coefficients(parts[0]), coefficients(parts[2]))
    ma = polynomial(coefficients(parts[1]), coefficients(parts[3]))
    return ar, ma, float(free[-1]) if with_mean else 0.0


def innovations(series: np.ndarray, ar: np.ndarray, ma: np.ndarray, mean: float) -> np.ndarray:
    """What each point adds to its forecast from the points before."""
    centred = np.convolve(series - mean, ar)[: len(series)]
    centred[: len(ar) - 1] = 0.0
    return np.convolve(centred, inverse(ma, len(series)))[: len(series)]


def fitted(series: np.ndarray, orders: Orders, with_mean: bool, start: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Corrected Akaike criterion and free parameters, by damped least squares on the innovations."""
    size = sum(orders) + with_mean
    free = np.full(size, 0.1) if start is None else start
    if with_mean and start is None:
        free[-1] = series.mean()
    skip = orders[0] + SEASON * orders[2]
    longest = MOST[0] + SEASON * MOST[2]  # all models are judged on as many points

    def rest(x: np.ndarray) -> np.ndarray:
        return innovations(series, *unpacked(x, orders, with_mean))[skip:]

    e = rest(free)
    cost, damping = e @ e, 1e-2
    for _ in range(ITERATIONS if size else 0):
        steps = 1e-5 * np.maximum(1.0, np.abs(free))
        slope = np.column_stack([(rest(free + step * unit) - e) / step for step, unit in zip(steps, np.eye(size))])
        normal, gradient = slope.T @ slope, slope.T @ e
        better = False
        for _ in range(6):
            move = np.linalg.lstsq(normal + damping * (np.diag(np.diag(normal)) + NEGLIGIBLE * np.eye(size)), -gradient, rcond=None)[0]
            trial = np.clip(free + move, -8, 8) if not with_mean else np.r_[np.clip((free + move)[:-1], -8, 8), (free + move)[-1]]
            e_trial = rest(trial)
            if e_trial @ e_trial < cost:
                better = True
                break
            damping *= 5
        if not better:
            break
        gain = cost - e_trial @ e_trial
        free, e, cost, damping = trial, e_trial, e_trial @ e_trial, damping / 3
        if gain < 1e-7 * max(cost, NEGLIGIBLE):
            break
    judged = e[max(0, longest - skip) :]
    n, k = len(judged), size + 1
    variance = max(float(judged @ judged) / max(n, 1), 1e-12)
    return float(n * np.log(variance) + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)), free


def searched(series: np.ndarray, with_mean: bool) -> Orders:
    """The orders (p, q, P, Q) that no neighbour betters."""
    known: dict[Orders, float] = {}

    def criterion(orders: Orders) -> float:
        if orders not in known:
            known[orders] = fitted(series, orders, with_mean)[0]
        return known[orders]

    best = min(STARTS, key=criterion)
    while True:
        near = [(*best[:i], best[i] + step, *best[i + 1 :]) for i in range(4) for step in (-1, 1)]
        near = [o for o in near if all(0 <= x <= m for x, m in zip(o, MOST))]
        following = min(near, key=criterion)
        if criterion(following) >= criterion(best) - 1e-9:
            return best
        best = following


def train(values: np.ndarray) -> tuple[list[int], float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Orders (p, d, q, P, D, Q), constant, weights of past values and innovations, both tails, and the criterion."""
    seasonal = int(len(values) > 4 * SEASON and seasonal_strength(values) > STRONG_SEASON)
    d = int(kpss(differenced(values, 0, seasonal)) > KPSS_LIMIT)
    series = differenced(values, d, seasonal)
    with_mean = d + seasonal <= 1
    orders = searched(series[-SEARCH_POINTS:], with_mean)
    start = fitted(series[-SEARCH_POINTS:], orders, with_mean)[1] if len(series) > SEARCH_POINTS else None
    aicc, free = fitted(series, orders, with_mean, start)
    ar, ma, mean = unpacked(free, orders, with_mean)
    rest = innovations(series, ar, ma, mean)
    whole = ar
    for _ in range(d):
        whole = np.convolve(whole, [1.0, -1.0])
    for _ in range(seasonal):
        whole = np.convolve(whole, polynomial(np.zeros(0), np.ones(1)))
    p, q, P, Q = orders
    tail, last = values[len(values) - len(whole) + 1 :], rest[len(rest) - len(ma) + 1 :]
    return [p, d, q, P, seasonal, Q], float(mean * ar.sum()), -whole[1:], ma[1:], tail, last, aicc


def extended(constant: float, ar: np.ndarray, ma: np.ndarray, tail: np.ndarray, last: np.ndarray, steps: int) -> np.ndarray:
    """Forecasts: weighted past values and innovations, future innovations being zero."""
    past, shocks = list(tail), list(last)
    ar_lags, ma_lags = np.flatnonzero(ar), np.flatnonzero(ma)
    for i in range(steps):
        value = constant + sum(ar[j] * past[-1 - j] for j in ar_lags)
        value += sum(ma[j] * shocks[-1 - j + i] for j in ma_lags if j >= i)
        past.append(value)
    return np.array(past[len(tail) :])


def _train(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
    points = points.sort_values("pos")
    values = points["value"].to_numpy(dtype=float)
    split = int(points["train_points"].iloc[0])
    orders, constant, ar, ma, tail, last, aicc = train(values[:split])
    error = extended(constant, ar, ma, tail, last, len(values) - split) - values[split:]
    rmse = float(np.sqrt(np.mean(error**2))) if len(error) else 0.0
    row = [*key, "autoarima", len(values), split, orders, constant, ar.tolist(), ma.tolist(), tail.tolist(), last.tolist()]
    row += [points["ts"].iloc[split - 1], aicc, rmse]
    return pd.DataFrame([row], columns=[c.split(" ")[0] for c in MODEL_SCHEMA.split(", ")])


def fit_seasonal(points: DataFrame, choice: DataFrame) -> DataFrame:
    """One model per series that got no trend model; a task sees one resampled series."""
    chosen = choice.filter(F.col("model_type") == "autoarima").select(*SERIES, "train_points")
    chosen = points.select(*SERIES, "pos", "ts", "value").join(chosen, SERIES)
    return grouped(chosen, *SERIES).applyInPandas(_train, MODEL_SCHEMA)


def forecast_seasonal(
    models: DataFrame, horizons: tuple[int, ...] | list[int] = HORIZONS, anchor: Column | None = None
) -> DataFrame:
    """Forecast steps per series and horizon; each model row is extended on its own."""
    longest = max(horizons) * STEPS_PER_HOUR

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                weights = (np.asarray(x, dtype=float) for x in (row.ar, row.ma, row.tail, row.innovations))
                path = extended(row.constant, *weights, longest)
                own = {"name": row.name, "labels_hash": row.labels_hash, "source": row.source, "start": row.start}
                yield pd.DataFrame({**own, "step": np.arange(1, longest + 1), "value": path})

    start = (F.col("last_ts") if anchor is None else anchor).alias("start")
    needed = models.select(*SERIES, "constant", "ar", "ma", "tail", "innovations", start)
    steps = needed.mapInPandas(extend, "name string, labels_hash string, source string, start timestamp, step int, value double")
    wanted = F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: F.col("step") <= h * STEPS_PER_HOUR)
    return steps.select(
        *SERIES,
        F.lit("autoarima").alias("model_type"),
        F.explode(wanted).alias("horizon_hours"),
        "step",
        step_time(F.col("start"), F.col("step")).alias("ts"),
        "value",
    )
