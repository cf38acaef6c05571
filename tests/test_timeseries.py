from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import autoregression as R
from tidewatch.operators import seasonal as M
from tidewatch.operators import timeseries as W
from tidewatch.plans.forecasting import train_and_forecast
from tidewatch.sources import store

START = datetime(2025, 1, 1)
SCHEMA = "name string, labels_hash string, source string, timestamp timestamp, value double"
THRESHOLDS = "metric_name string, direction string, threshold double"


def samples(spark, values, name="cpu", minutes=None):
    minutes = minutes or [5 * i for i in range(len(values))]
    rows = [(name, "h", "s", START + timedelta(minutes=m), float(v)) for m, v in zip(minutes, values)]
    return spark.createDataFrame(rows, SCHEMA)


def points(spark, *args, **kwargs):
    return W.with_differences(W.fill_gaps(W.resample(samples(spark, *args, **kwargs))))


def test_resample_takes_the_last_value(spark):
    got = W.resample(samples(spark, [1, 2, 3, 4], minutes=[0, 4.9, 5, 3])).orderBy("slot").collect()
    assert [r.value for r in got] == [2.0, 3.0]


def fill_by_hand(slots):
    out, last, gap = [], None, 0
    for slot in range(min(slots), max(slots) + 1):
        if slot in slots:
            last, gap = slots[slot], 0
            out.append((slot, last))
        else:
            gap += 1
            if gap <= 3:
                out.append((slot, last))
    return out


def test_gaps_are_filled_up_to_three_steps(spark):
    rng = np.random.default_rng(0)
    slots = np.flatnonzero(rng.random(400) < 0.3)
    values = rng.random(len(slots))
    got = W.fill_gaps(W.resample(samples(spark, values, minutes=[int(5 * s) for s in slots]))).orderBy("pos").collect()
    wanted = fill_by_hand(dict(zip(slots.tolist(), values.tolist())))
    base = int((START - datetime(1970, 1, 1)).total_seconds()) // 300
    assert [(r.slot - base, r.value) for r in got] == wanted
    assert [r.pos for r in got] == list(range(1, len(wanted) + 1))


@pytest.mark.parametrize(
    ("values", "name", "model"),
    [
        ([0.75 * i + 4 for i in range(200)], "requests", "arima"),
        ([50 + 10 * np.sin(2 * np.pi * i / 24) for i in range(200)], "cpu", "autoarima"),
        ([50 + 10 * np.sin(2 * np.pi * i / 24) for i in range(200)], "Disk_Used", "arima"),
        ([1.0] * 71, "cpu", None),
        ([1.0] * 72, "cpu", "arima"),
    ],
)
def test_model_choice(spark, values, name, model):
    got = [r.model_type for r in W.model_choice(points(spark, values, name=name)).collect()]
    assert got == ([model] if model else [])


def test_arima_on_a_line(spark):
    line = points(spark, [0.75 * i + 4 for i in range(200)], name="disk")
    fitted = W.fit_arima(line, W.model_choice(line))
    model = fitted.first()
    assert model.train_points == 180 and model.phi == pytest.approx(1.0) and model.rmse == pytest.approx(0.0, abs=1e-9)
    steps = W.forecast_arima(fitted, [24]).orderBy("step").collect()
    assert len(steps) == 288
    assert steps[0].ts == START + timedelta(minutes=5 * 180) and steps[0].value == pytest.approx(139.0)
    assert steps[-1].value == pytest.approx(0.75 * (179 + 288) + 4)


def test_arima_equals_the_recursion(spark):
    rng = np.random.default_rng(8)
    values = np.cumsum(rng.normal(0, 1, 150))
    series = points(spark, values, name="disk")
    fitted = W.fit_arima(series, W.model_choice(series))
    train, test = values[:135], values[135:]
    d = np.diff(train)
    phi = (d[1:] @ d[:-1]) / (d[:-1] @ d[:-1])
    level, step, path = train[-1], d[-1], []
    for _ in range(288):
        step *= phi
        level += step
        path.append(level)
    model = fitted.first()
    assert model.phi == pytest.approx(phi)
    assert model.rmse == pytest.approx(np.sqrt(np.mean((np.array(path[:15]) - test) ** 2)))
    got = [r.value for r in W.forecast_arima(fitted, [24]).orderBy("step").collect()]
    assert got == pytest.approx(path)


def test_constant_series(spark):
    flat = points(spark, [7.0] * 100, name="disk")
    fitted = W.fit_arima(flat, W.model_choice(flat))
    assert fitted.first().phi == 0.0 and fitted.first().rmse == 0.0
    assert {r.value for r in W.forecast_arima(fitted, [24]).collect()} == {7.0}


def test_anchor(spark):
    line = points(spark, [float(i) for i in range(100)], name="disk")
    anchor = F.lit("2025-06-01 00:00:00").cast("timestamp")
    steps = W.forecast_arima(W.fit_arima(line, W.model_choice(line)), [24], anchor).orderBy("step")
    assert steps.first().ts == datetime(2025, 6, 1, 0, 5)


def test_autoregression_follows_a_season(spark):
    wave = [50 + 10 * np.sin(2 * np.pi * i / 12) for i in range(300)]
    series = points(spark, wave, name="cpu")
    models = R.fit_autoregressions(series, W.model_choice(series))
    model = models.first()
    assert model.model_type == "autoarima" and model.rmse < 0.5
    steps = R.forecast_autoregressions(models, [24, 48]).orderBy("horizon_hours", "step").collect()
    assert [sum(r.horizon_hours == h for r in steps) for h in (24, 48)] == [288, 576]
    wanted = [50 + 10 * np.sin(2 * np.pi * (270 + i) / 12) for i in range(288)]
    assert [r.value for r in steps[:288]] == pytest.approx(wanted, abs=1.0)
    assert steps[0].ts == START + timedelta(minutes=5 * 270)


def steps_of(spark, values):
    rows = [("m", "h", "s", 24, i + 1, START + timedelta(hours=i), float(v)) for i, v in enumerate(values)]
    schema = "name string, labels_hash string, source string, horizon_hours int, step int, ts timestamp, value double"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("values", "direction", "limit", "hour"),
    [([80, 90, 95, 100], "above", 95.0, 2), ([50, 20, 5], "below", 10.0, 2), ([1, 2], "above", 5.0, None)],
)
def test_first_crossing(spark, values, direction, limit, hour):
    thresholds = spark.createDataFrame([("m", direction, limit), ("other", "above", 0.0)], THRESHOLDS)
    got = W.threshold_crossings(steps_of(spark, values), thresholds).collect()
    assert [r.exhaustion_time for r in got] == ([] if hour is None else [START + timedelta(hours=hour)])


def test_crossing_description(spark):
    thresholds = spark.createDataFrame([("m", "above", 95.0)], THRESHOLDS)
    got = W.crossing_description(W.threshold_crossings(steps_of(spark, [96.5]), thresholds)).first()
    assert got.description == (
        "Metric 'm' predicted to cross above threshold 95.0 at 2025-01-01T00:00:00Z (predicted: 96.50)"
    )


def test_train_and_forecast_and_store(spark, tmp_path):
    data = samples(spark, [0.75 * i + 4 for i in range(200)], name="disk_used").unionByName(
        samples(spark, [50 + 10 * np.sin(i) for i in range(200)], name="cpu")
    )
    thresholds = spark.createDataFrame([("disk_used", "above", 146.5)], THRESHOLDS)
    run = train_and_forecast(data, thresholds, datetime(2025, 2, 1), [24, 48])
    assert {r.metric_name: r.model_type for r in run.models.collect()} == {"disk_used": "arima", "cpu": "autoarima"}
    store.append_predictions(run.predictions(datetime(2025, 2, 1)), str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p")).collect()
    assert sorted((r.metric_name, r.horizon_hours, len(r.predictions)) for r in rows) == [
        ("cpu", 24, 288), ("cpu", 48, 576), ("disk_used", 24, 288), ("disk_used", 48, 576)
    ]
    disk = [r for r in rows if r.metric_name == "disk_used"]
    assert {r.exhaustion_time for r in disk} == {START + timedelta(minutes=5 * 190)} and disk[0].threshold == 146.5
    assert {r.exhaustion_time for r in rows if r.metric_name == "cpu"} == {None}


def simulated(ar, ma, n=900, mean=50.0):
    rng = np.random.default_rng(1)
    shocks, values = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(30, n + 200):
        values[t] = -sum(ar[k] * values[t - k] for k in range(1, len(ar))) + sum(ma[k] * shocks[t - k] for k in range(len(ma)))
    return values[200:] + mean


NONE = np.zeros(0)


@pytest.mark.parametrize(
    ("ar", "ma", "orders"),
    [
        (M.polynomial(NONE, NONE), M.polynomial(np.array([-0.7]), NONE), [0, 0, 1, 0, 0, 0]),
        (M.polynomial(NONE, NONE), M.polynomial(np.array([-0.5]), np.array([-0.6])), [0, 0, 1, 0, 0, 1]),
        (M.polynomial(np.array([0.6]), np.array([0.5])), np.ones(1), [1, 0, 0, 1, 0, 0]),
    ],
)
def test_orders_of_simulated_series(ar, ma, orders):
    values = simulated(ar, ma)
    got, constant, weights, ma_weights, _, _, _ = M.train(values[:800])
    assert got == orders

    def step_error(predict):
        return np.mean([(predict(values[:t]) - values[t]) ** 2 for t in range(800, 900)])

    own = lambda seen: M.extended(
        constant, weights, ma_weights, seen[len(seen) - len(weights) :],
        M.innovations(seen, np.r_[1, -weights], np.r_[1, ma_weights], constant / (1 - weights.sum()))[len(seen) - len(ma_weights) :], 1,
    )[0]
    _, differences, lags, fitted = R._fit(values[:800])
    grid = lambda seen: R._extend(seen[-(R.SEASON + 1) :], differences, lags, fitted, 1)[0]
    assert step_error(own) < 1.02 * step_error(grid)
    if orders[2]:
        assert step_error(own) < step_error(grid)


def test_odd_series():
    wave = np.array([50 + 10 * np.sin(2 * np.pi * i / 12) for i in range(558)])
    _, *model, _ = M.train(wave[:270])
    assert np.abs(M.extended(*model, 288) - wave[270:]).max() < 1e-6
    for values in (np.full(100, 3.0), np.arange(100.0)):
        orders, *model, _ = M.train(values)
        assert np.isfinite(M.extended(*model, 50)).all()
        assert orders[1] == int(values[0] != values[-1])


def test_forecast_plan_keeps_whole_models(spark):
    rng = np.random.default_rng(2)
    run = train_and_forecast(samples(spark, rng.normal(50, 2, 300), name="load"), spark.createDataFrame([("load", "above", 49.0)], THRESHOLDS), START)
    steps = run.steps.filter("horizon_hours = 24").orderBy("step").collect()
    assert len(steps) == 288 and all(45 < r.value < 55 for r in steps)
    assert run.models.first().model_type == "autoarima" and 0 < run.models.first().rmse < 5
