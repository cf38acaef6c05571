import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import aggregates as A
from tidewatch.operators import detectors as D
from tidewatch.operators import isolation as I
from tidewatch.plans.baseline import read_baseline, train_baseline
from tidewatch.plans.state import append_cells, read_cells, train_from_cells, write_cells
from tidewatch.plans.detection import run_detection

LOG_SCHEMA = (
    "timestamp timestamp, source string, level string, message string, template_id string, fields string, line_number long"
)
OBSERVED = "source string, is_error boolean, template_id string, latency double, n long"
NOW = datetime(2024, 3, 1)


def stats(spark, mean=0.01, std=0.005):
    return spark.createDataFrame([("app", mean, std)], "source string, error_rate_mean double, error_rate_std double")


def errors(spark, rate, lines=10_000):
    bad = round(rate * lines)
    rows = [("app", True, None, None, bad), ("app", False, None, None, lines - bad)]
    return D.observed_rates(D.window_profile(spark.createDataFrame(rows, OBSERVED)))


@pytest.mark.parametrize(
    ("rate", "sensitivity", "fires"),
    [(0.01, 0.5, False), (0.1, 0.5, True), (0.03, 0.0, False), (0.04, 0.0, True), (0.03, 1.0, True), (0.0, 1.0, False)],
)
def test_error_rate_spike(spark, rate, sensitivity, fires):
    got = D.error_rate_spikes(errors(spark, rate), stats(spark), sensitivity).collect()
    assert bool(got) == fires
    if fires:
        z = (rate - 0.01) / 0.005
        assert got[0].z_score == pytest.approx(z)
        assert got[0].score == pytest.approx(min(1.0, z / 10 + 0.2))


@pytest.mark.parametrize(("rate", "score"), [(0.05, 1.0), (0.015, None), (0.02, None)])
def test_error_rate_spike_without_spread(spark, rate, score):
    got = D.error_rate_spikes(errors(spark, rate), stats(spark, 0.01, 0.0)).collect()
    assert [r.score for r in got] == ([] if score is None else [score])
    if got:
        assert got[0].z_score == 10.0 and got[0].severity == "critical"


def known(spark):
    rows = [("app", "a", 0.5), ("app", "b", 0.3), ("app", "c", 0.2), ("app", "rare", 1e-7)]
    return spark.createDataFrame(rows, "source string, template_id string, frequency double")


def shares(spark, **frequency):
    rows = [("app", t, int(f * 100), float(f)) for t, f in frequency.items()]
    return spark.createDataFrame(rows, "source string, template_id string, count long, frequency double")


def test_novel_patterns(spark):
    counts = shares(spark, a=0.5, new_few=0.02, new_some=0.03, new_many=0.15)
    got = {r.template_id: (r.score, r.severity) for r in D.novel_patterns(counts, known(spark)).collect()}
    assert got == {"new_some": (0.5, "medium"), "new_many": (0.7, "high")}


def test_frequency_deviations(spark):
    counts = shares(spark, a=0.5, b=0.9001, c=0.02, new=0.9, rare=0.5)
    got = {r.template_id: r for r in D.frequency_deviations(counts, known(spark)).collect()}
    assert set(got) == {"b", "c"}
    assert got["b"].direction == "increase" and got["b"].severity == "low"
    assert got["c"].direction == "decrease" and got["c"].score == pytest.approx(1.0) and got["c"].severity == "critical"


def test_frequency_deviations_vanished(spark):
    got = D.frequency_deviations(shares(spark, a=1.0), known(spark), include_vanished=True).collect()
    assert {r.template_id: (r.deviation_factor, r.score) for r in got} == {"b": (0.0, 1.0), "c": (0.0, 1.0)}


def latency_table(spark, values, source="app"):
    return spark.createDataFrame([(source, float(v), 1) for v in values], "source string, value double, n long")


def latency_observations(spark, values):
    return spark.createDataFrame([("app", False, None, float(v), 1) for v in values], OBSERVED)


def ks_by_hand(a, b):
    points = np.sort(np.concatenate([a, b]))
    f = np.searchsorted(np.sort(a), points, side="right") / len(a)
    g = np.searchsorted(np.sort(b), points, side="right") / len(b)
    return np.max(np.abs(f - g))


def test_latency_shift(spark):
    rng = np.random.default_rng(1)
    base, now = np.round(rng.normal(100, 10, 500), 1), np.round(rng.normal(300, 30, 200), 1)
    got = D.latency_shifts(latency_observations(spark, now), latency_table(spark, base)).collect()
    assert len(got) == 1 and (got[0].score, got[0].severity) == (0.85, "high")
    assert got[0].ks_statistic == pytest.approx(ks_by_hand(base, now))
    assert got[0].baseline_p99_ms == pytest.approx(np.percentile(base, 99))
    assert got[0].current_p99_ms == pytest.approx(np.percentile(now, 99))
    assert got[0].shift_percent == pytest.approx((now.mean() - base.mean()) / base.mean() * 100)


@pytest.mark.parametrize(
    ("mean", "count", "severity"), [(100, 200, None), (50, 200, None), (300, 9, None), (106, 200, "low"), (130, 200, "medium")]
)
def test_latency_shift_grades(spark, mean, count, severity):
    rng = np.random.default_rng(2)
    base = rng.normal(100, 10, 500)
    now = rng.normal(100, 10, count) - 0.5 + (mean - 100)
    got = D.latency_shifts(latency_observations(spark, now), latency_table(spark, base)).collect()
    assert [r.severity for r in got] == ([severity] if severity else [])


def test_ks_with_few_and_repeated_values(spark):
    rng = np.random.default_rng(3)
    for a, b in [
        (np.ones(50), np.ones(30) * 2),
        (rng.integers(0, 4, 300), rng.integers(0, 5, 200)),
        (rng.random(1000) * 1e-3 + 100, rng.random(700) * 1e-3 + 100.0002),
    ]:
        got = D.ks_distances(latency_table(spark, b), latency_table(spark, a)).first()
        assert got.ks_statistic == pytest.approx(ks_by_hand(np.asarray(a, float), np.asarray(b, float)))


def test_ks_pvalue_against_the_series(spark):
    d, n1, n2 = 0.2, 100, 80
    root = math.sqrt(n1 * n2 / (n1 + n2))
    lam = (root + 0.12 + 0.11 / root) * d
    wanted = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    df = spark.createDataFrame([(d, n1, n2), (0.001, n1, n2)], "d double, a long, b long")
    got = [r[0] for r in df.select(D.ks_pvalue(F.col("d"), F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(wanted), 1.0]


def training_rows(count=1500, source="app", seed=5):
    rng = np.random.default_rng(seed)
    start = NOW - timedelta(hours=167)
    rows = []
    for i in range(count):
        at = start + timedelta(seconds=i * 167 * 3600 / count)
        level = "error" if rng.random() < 0.02 else "info"
        fields = f'{{"latency": {rng.normal(100, 15):.3f}}}'
        rows.append((at, source, level, f"message {i}", f"tpl-{'abc'[i % 3]}", fields, i))
    return rows


def incident_rows(count=200, source="app"):
    return [
        (NOW + timedelta(seconds=i), source, "error", f"bad {i}", "tpl-novel", '{"latency": 500}', 5000 + i)
        for i in range(count)
    ]


def test_training(spark):
    rows = training_rows() + training_rows(100, "small")
    model = train_baseline(spark.createDataFrame(rows, LOG_SCHEMA), NOW)
    got = model.stats.collect()
    assert [r.source for r in got] == ["app"] and got[0].lines_trained == 1500
    rates = {}
    for at, source, level, *_ in rows:
        if source == "app":
            rates.setdefault(int(at.timestamp()) // 300, []).append(level == "error")
    rates = [np.mean(v) for v in rates.values()]
    assert got[0].error_rate_mean == pytest.approx(np.mean(rates))
    assert got[0].error_rate_std == pytest.approx(np.std(rates))
    assert {r.template_id: round(r.frequency, 6) for r in model.templates.collect()} == {
        f"tpl-{c}": round(1 / 3, 6) for c in "abc"
    }
    assert model.latencies.agg(F.sum("n")).first()[0] == 1500
    assert model.trees.select("tree_id").distinct().count() == 100


def test_detection_end_to_end(spark, tmp_path):
    train_baseline(spark.createDataFrame(training_rows(), LOG_SCHEMA), NOW).write(str(tmp_path / "model"))
    baseline = read_baseline(spark, str(tmp_path / "model"))
    window = spark.createDataFrame(incident_rows() + incident_rows(5, "untrained"), LOG_SCHEMA)
    found = {r.anomaly_type: r for r in run_detection(window, baseline, F.lit(NOW).cast("timestamp")).collect()}
    assert set(found) == {"error_rate_spike", "novel_pattern", "latency_shift"}
    assert all(r.source == "app" for r in found.values())
    assert found["error_rate_spike"].sample_lines == [f"bad {i}" for i in range(5)]
    assert found["novel_pattern"].template_id == "tpl-novel" and found["novel_pattern"].sample_lines == []
    assert "seen 200 times" in found["novel_pattern"].description
    assert found["latency_shift"].severity == "high"
    again = run_detection(window, baseline, F.lit(NOW).cast("timestamp")).collect()
    assert sorted(r.id for r in again) == sorted(r.id for r in found.values())


def test_detection_of_nothing(spark):
    baseline = train_baseline(spark.createDataFrame(training_rows(), LOG_SCHEMA), NOW)
    empty = spark.createDataFrame([], LOG_SCHEMA)
    assert run_detection(empty, baseline, F.lit(NOW).cast("timestamp")).collect() == []


def test_switched_off_detectors_and_sensitivity(spark):
    baseline = train_baseline(spark.createDataFrame(training_rows(), LOG_SCHEMA), NOW)
    sources = spark.createDataFrame(
        [("app", 0.5, ["novel_pattern"])], "name string, sensitivity double, anomaly_types array<string>"
    )
    window = spark.createDataFrame(incident_rows(), LOG_SCHEMA)
    found = run_detection(window, baseline, F.lit(NOW).cast("timestamp"), sources).collect()
    assert [r.anomaly_type for r in found] == ["novel_pattern"]


def test_ranked_by_age(spark):
    rows = training_rows(300) + training_rows(20, "b")
    got = A.ranked_by_age(spark.createDataFrame(rows, LOG_SCHEMA)).collect()
    assert len(got) == 320 and all(r["rank"] == r.line_number + 1 for r in got)


def test_isolation_forest_finds_the_odd_bucket(spark):
    rng = np.random.default_rng(7)
    rows = [("app", i, *map(float, rng.normal([0.02, 20, 3, 100], [0.005, 2, 0.3, 5]))) for i in range(600)]
    rows.append(("app", 600, 0.9, 200.0, 12.0, 900.0))
    rows += [("tiny", i, 0.0, 1.0, 1.0, 1.0) for i in range(9)]
    schema = "source string, bucket long, error_rate double, line_count double, templates double, mean_latency double"
    features = spark.createDataFrame(rows, schema)
    trees = I.fit_forest(features)
    assert trees.groupBy("source", "tree_id").agg(F.max("samples")).agg(F.min("max(samples)"), F.count("*")).first()[:2] == (256, 100)
    scored = I.isolation_outliers(I.isolation_scores(features, trees))
    top = scored.orderBy(F.desc("isolation_score")).first()
    assert top.bucket == 600 and top.outlier and top.isolation_score > 0.7
    assert scored.count() == 601
    again = I.isolation_scores(features, I.fit_forest(features)).orderBy(F.desc("isolation_score")).first()
    assert again.isolation_score == top.isolation_score


def test_error_rate_keeps_the_bucket_origin(spark):
    rows = [(datetime(2024, 1, 1, 0, m), "s", "error" if m % 2 else "info", "m", None, None, m) for m in range(20)]
    got = A.error_rate(spark.createDataFrame(rows, LOG_SCHEMA), 7).orderBy("bucket").collect()
    origin = datetime(2000, 1, 3)
    assert all((r.bucket - origin).total_seconds() % 420 == 0 for r in got)
    assert sum(r.total for r in got) == 20 and sum(r.errors for r in got) == 10


def test_vanished_templates_by_window(spark):
    rows = [("app", 1, "b", 0.5), ("app", 1, "c", 0.5), ("app", 2, "a", 0.5), ("app", 2, "c", 0.5)]
    now = spark.createDataFrame(rows, "source string, window_start int, template_id string, frequency double")
    base = [("app", t, 1 / 3) for t in "abc"]
    known_ = spark.createDataFrame(base, "source string, template_id string, frequency double")
    got = D.frequency_deviations(now, known_, by=["source", "window_start"], include_vanished=True).collect()
    assert sorted((r.window_start, r.template_id, r.deviation_factor) for r in got) == [(1, "a", 0.0), (2, "b", 0.0)]


def test_many_windows_look_at_the_baseline_once(spark):
    baseline = latency_table(spark, [float(v) for v in range(200)])
    rows = [("app", w, float(v + 3 * w), 1) for w in range(20) for v in range(0, 200, 7)]
    windows = spark.createDataFrame(rows, "source string, window_start int, value double, n long")
    by = ["source", "window_start"]
    got = {r.window_start: r.ks_statistic for r in D.ks_distances(windows, baseline, by).collect()}
    for w in (0, 7):
        one = latency_table(spark, [float(v + 3 * w) for v in range(0, 200, 7)])
        assert got[w] == pytest.approx(D.ks_distances(one, baseline).first().ks_statistic)
    own = [r.value for r in windows.filter("window_start = 19").collect()]
    spots = sorted({*own, *map(float, range(200))})
    gap = max(abs(sum(b <= x for b in range(200)) / 200 - sum(v <= x for v in own) / len(own)) for x in spots)
    assert got[19] == pytest.approx(gap)


def test_training_window_of_a_source(spark):
    rows = training_rows(1500) + training_rows(1500, "b")
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    short = spark.createDataFrame([("b", 100)], "name string, training_window_hours int")
    lines = {r.source: r.lines_trained for r in train_baseline(logs, NOW, min_lines=1, sources=short).stats.collect()}
    assert lines["app"] == 1500 and 0 < lines["b"] < 1500


def same_tables(got, want):
    for name in ("stats", "templates", "latencies", "features"):
        left, right = getattr(got, name), getattr(want, name)
        assert set(left.columns) == set(right.columns)
        order = [c for c in ("source", "bucket", "template_id", "value") if c in right.columns]
        rows = [df.select(*sorted(right.columns)).orderBy(*order).collect() for df in (left, right)]
        assert len(rows[0]) == len(rows[1]) > 0, name
        for a, b in zip(*rows):
            assert all(x == pytest.approx(y, rel=1e-9) if isinstance(y, float) else x == y for x, y in zip(a, b)), name


def test_training_from_cells_equals_training_from_logs(spark, tmp_path):
    rows = training_rows(1500) + training_rows(1200, "b") + training_rows(40, "few")
    rows += [(None, "app", "info", "no time", "t", "{}", 9999), (NOW - timedelta(hours=5), "app", "error", "", "", '{"latency": "x"}', 9998)]
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    path = str(tmp_path / "cells")
    for part in (0, 1, 2, 1):  # lines of all hours in each run; a repeated run replaces itself
        append_cells(logs.filter(F.col("line_number") % 3 == part), path, f"run{part}")
    cells = read_cells(spark, path, NOW)
    same_tables(train_from_cells(cells, NOW), train_baseline(logs, NOW))
    same_tables(train_from_cells(read_cells(spark, path, NOW, 100), NOW, 1), train_baseline(logs, NOW, 100, min_lines=1))
    with pytest.raises(ValueError):
        read_cells(spark, path, NOW + timedelta(minutes=1))


def test_cells_of_a_stream(spark, tmp_path):
    logs = spark.createDataFrame(training_rows(1500), LOG_SCHEMA)
    for part in range(3):
        logs.filter(F.col("line_number") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_cells(stream, str(tmp_path / "cells"), str(tmp_path / "cp"), once=True).awaitTermination()
    same_tables(train_from_cells(read_cells(spark, str(tmp_path / "cells"), NOW), NOW), train_baseline(logs, NOW))
