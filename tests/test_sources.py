import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import envelopes as E
from tidewatch.sources import store
from tidewatch.sources.prometheus import prometheus_samples
from tidewatch.sources.textlogs import read_log_files

NOW = datetime(2024, 5, 1, 12)


def bodies(spark, *payloads, **extra):
    rows = [(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "body_id long, body string")


def test_file_lines_are_numbered_across_blocks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        wanted = {}
        for name, count in (("a.log", 700), ("b.log", 3)):
            texts = [f"{name} line {i}" if i % 7 else "" for i in range(count)]
            (tmp_path / name).write_text("\n".join(texts) + "\n")
            wanted[name] = [t for t in texts if t]
        got = read_log_files(spark, str(tmp_path)).orderBy("path", "line_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, texts in wanted.items():
        mine = [r for r in got if r.path.endswith(name)]
        assert [r.line for r in mine] == texts
        assert [r.line_number for r in mine] == list(range(1, len(texts) + 1))


def test_http_envelope(spark):
    payloads = [
        {"message": "one"},
        [{"message": "a", "level": "x"}, {"message": ""}, "text", 5, {"other": 1}, {"message": "b"}],
        [{"message": 7}, {"message": 0}, {"message": "0"}, {"message": None}, {"message": False}, {"message": []}],
        5,
        "broken {",
    ]
    got = E.http_log_lines(bodies(spark, *payloads)).orderBy("body_id", "line_number").collect()
    assert [(r.body_id, r.source, r.line_number, r.line) for r in got] == [
        (0, "http", 0, "one"),
        (1, "http", 0, "a"),
        (1, "http", 1, "b"),
        (2, "http", 0, "7"),
        (2, "http", 1, "0"),
    ]


def test_http_envelope_source_header(spark):
    df = bodies(spark, {"message": "m"}, {"message": "n"}).withColumn("x_source", F.when(F.col("body_id") == 1, "app"))
    assert [r.source for r in E.http_log_lines(df).orderBy("body_id").collect()] == ["http", "app"]


def test_loki_envelope(spark):
    push = {
        "streams": [
            {"stream": {"job": "gate", "env": "live"}, "values": [["1", "a"], ["2", ""], ["3"], ["4", "b"]]},
            {"stream": {"job": "ledger"}, "values": [["1", "ignored"]]},
            {"stream": {"job": "gate"}, "values": [["1", "c"]]},
            {"values": [["1", "no labels"]]},
        ]
    }
    matchers = [("gate-live", {"job": "gate", "env": "live"}), ("web", {"job": "gate"})]
    got = E.loki_log_lines(bodies(spark, push, {"streams": []}, {}), matchers).orderBy("line_number").collect()
    assert [(r.source, r.line_number, r.line) for r in got] == [("gate-live", 0, "a"), ("gate-live", 1, "b"), ("web", 2, "c")]


def test_label_table_agrees_with_expression(spark):
    sets = [{"job": j, "env": e, "x": "1"} for j in "abc" for e in ("p", "d")] + [{}, {"job": "a"}]
    df = spark.createDataFrame([(s,) for s in sets], "labels map<string,string>")
    matchers = [("s1", {"job": "a", "env": "p"}), ("s2", {"env": "d"}), ("s3", {"job": "a"}), ("s4", {"job": "zz"})]
    rows = [(i, s, r) for i, (s, r) in enumerate(matchers)]
    table = spark.createDataFrame(rows, "ord int, source string, required map<string,string>")
    from tidewatch.functions.scalars import labels_json

    by_table = {r.label_key: r.source for r in E.match_sources(df, table).collect()}
    direct = df.select(labels_json(F.col("labels")).alias("k"), E.source_of_labels(F.col("labels"), matchers).alias("s"))
    assert by_table == {r.k: r.s for r in direct.collect() if r.s}


def otlp(*metrics, attributes=None):
    resource = {"attributes": attributes} if attributes is not None else {}
    return {"resourceMetrics": [{"resource": resource, "scopeMetrics": [{"metrics": list(metrics)}]}]}


def test_otlp_envelope(spark):
    point = {"asDouble": 41.25, "attributes": [{"key": "rack", "value": {"stringValue": "r7"}}]}
    service = [{"key": "service.name", "value": {"stringValue": "api"}}]
    payloads = [
        otlp({"name": "queue_fill", "gauge": {"dataPoints": [point]}}, attributes=service),
        otlp({"name": "requests", "sum": {"dataPoints": [{"asInt": "42"}, {"asDouble": 0, "asInt": 3}, {}]}}),
        otlp({"name": "h", "histogram": {"dataPoints": [point]}}, {"name": "", "gauge": {"dataPoints": [point]}}),
        {"resourceMetrics": []},
        {},
        "not json",
    ]
    got = E.otlp_metric_samples(bodies(spark, *payloads), F.lit(NOW).cast("timestamp"))
    rows = got.orderBy("body_id", F.desc("value")).collect()
    assert [(r.name, r.value, r.metric_type, r.source, r.labels) for r in rows] == [
        ("queue_fill", 41.25, "gauge", "api", '{"rack": "r7"}'),
        ("requests", 42.0, "counter", "otel", "{}"),
        ("requests", 3.0, "counter", "otel", "{}"),
        ("requests", 0.0, "counter", "otel", "{}"),
    ]


PROMETHEUS = """# HELP http_requests_total Requests
# TYPE http_requests_total counter
http_requests_total{method="GET",code="200"} 1027
http_requests_total{method="POST",code="400"} 3 1395066363000
# TYPE process_memory gauge
process_memory_bytes 1.5e7

bad line
nan_metric NaN
broken{a="b" 1
late 5
# TYPE late counter
late 6
"""


def scrape(spark, text, **options):
    df = spark.createDataFrame([(1, "node", text)], "body_id long, source string, body string")
    return prometheus_samples(df, F.lit(NOW).cast("timestamp"), **options).collect()


def test_prometheus_text(spark):
    got = sorted((r.name, r.labels, r.value, r.metric_type) for r in scrape(spark, PROMETHEUS) if r.value == r.value)
    assert got == [
        ("http_requests_total", '{"code": "200", "method": "GET"}', 1027.0, "counter"),
        ("http_requests_total", '{"code": "400", "method": "POST"}', 3.0, "counter"),
        ("late", "{}", 5.0, "gauge"),
        ("late", "{}", 6.0, "counter"),
        ("process_memory_bytes", "{}", 1.5e7, "gauge"),
    ]
    assert [r.name for r in scrape(spark, PROMETHEUS) if r.value != r.value] == ["nan_metric"]


def test_prometheus_type_of_base_name_wins(spark):
    text = "# TYPE a_b counter\n# TYPE a summary\na_b 1\n# TYPE a histogram\na_b 2\n"
    assert [r.metric_type for r in sorted(scrape(spark, text), key=lambda r: r.value)] == ["summary", "histogram"]


def test_prometheus_filters(spark):
    names = {r.name for r in scrape(spark, PROMETHEUS, include=["http", "mem"], exclude=["bytes$"])}
    assert names == {"http_requests_total"}


def test_store_round_trip(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 10), "s", "info", "m", None, None, None), (None, "s", "error", "n", "t", '{"a": 1}', 5)]
    schema = "timestamp timestamp, source string, level string, message string, template_id string, fields string, line_number long"
    df = spark.createDataFrame(rows, schema)
    store.append_logs(df, str(tmp_path / "logs"), F.lit(NOW).cast("timestamp"))
    store.append_logs(df, str(tmp_path / "logs"), F.lit(NOW).cast("timestamp"))
    back = spark.read.parquet(str(tmp_path / "logs"))
    assert back.count() == 4
    first = back.filter("level = 'info'").first()
    assert (first.fields, first.line_number, str(first.date)) == ("{}", 0, "2024-01-01")
    assert str(back.filter("level = 'error'").first().date) == "2024-05-01"


def test_reads_are_cut_to_days_and_columns(spark, tmp_path):
    from tidewatch.operators.aggregates import error_rate, slice_logs
    from tidewatch.operators.serving import recent_logs

    rows = [(datetime(2024, 1, d, 10), "s", "error", "m", "t", "{}", d) for d in range(1, 10)]
    schema = "timestamp timestamp, source string, level string, message string, template_id string, fields string, line_number long"
    store.append_logs(spark.createDataFrame(rows, schema), str(tmp_path / "logs"), F.lit(NOW).cast("timestamp"))
    stored = spark.read.parquet(str(tmp_path / "logs"))
    rates = error_rate(slice_logs(stored, datetime(2024, 1, 4), datetime(2024, 1, 6, 11)))
    plan = rates._jdf.queryExecution().executedPlan().toString()
    assert "date#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(timestamp" in plan
    assert "ReadSchema: struct<timestamp:timestamp,source:string,level:string>" in plan
    assert sorted(r.bucket.day for r in rates.collect()) == [4, 5, 6]
    assert [r.line_number for r in recent_logs(stored, "s", datetime(2024, 1, 8, 10)).collect()] == [8, 9]


def test_retention(spark, tmp_path):
    rows = [(datetime(2024, 4, d, h), "s", 100 * d + h) for d in (1, 2, 3, 20) for h in (1, 13)]
    rows.append((datetime(2024, 4, 20, 5), "s", 1))
    df = spark.createDataFrame(rows, "ingested_at timestamp, source string, line_number long")
    event = F.when(F.col("line_number") == 1, F.lit(datetime(2024, 4, 1))).otherwise(F.col("ingested_at"))
    path = str(tmp_path / "logs")
    store.append_logs(df.withColumn("timestamp", event.cast("timestamp")), path)
    store.write_batch(store.log_rows(df.withColumn("timestamp", F.col("ingested_at")), F.current_timestamp()), path, 3, F.col("timestamp"), "stream")
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "logs").rglob("*.parquet") if "2024-04-20" in str(p)}

    def lines():
        return sorted(r.line_number for r in spark.read.parquet(path).collect())

    as_of = datetime(2024, 5, 2, 6)  # 29 days before: 3 April, 6 o'clock
    assert store.enforce_retention(spark, path, as_of, 29) == 10
    # the batch and the stream's run wrote the same lines; a late line of 1 April stays
    assert lines() == [1, 1, 313, 313, 2001, 2001, 2013, 2013]
    assert all(p.stat().st_mtime_ns == at for p, at in untouched.items())
    assert not (tmp_path / "logs" / "date=2024-04-02").exists() or not list((tmp_path / "logs" / "date=2024-04-02").rglob("*.parquet"))
    assert store.enforce_retention(spark, path, as_of, 29) == 0
    # a run that died between writing and moving is finished by the next one
    kept = spark.read.parquet(path).filter("date = '2024-04-03' and line_number < 0")
    kept.write.partitionBy("date", "run").parquet(path + "/_retention")
    assert store.enforce_retention(spark, path, as_of, 29) == 0 and len(lines()) == 8
    assert not (tmp_path / "logs" / "_retention").exists()


def test_models_are_upserted_by_key(spark, tmp_path):
    schema = "metric_name string, labels_hash string, source string, model_type string, trained_at timestamp, rmse double"
    old = [("m", "h", "s", "arima", datetime(2024, 1, 1), 1.0), ("k", "h", "s", "arima", datetime(2024, 1, 1), 3.0)]
    new = [("m", "h", "s", "autoarima", datetime(2024, 1, 2), 2.0)]
    for part in (old, new):
        store.append_forecast_models(spark.createDataFrame(part, schema), str(tmp_path / "models"))
    models = spark.read.parquet(str(tmp_path / "models"))
    got = {r.metric_name: (r.model_type, r.rmse) for r in store.latest_models(models).collect()}
    assert got == {"m": ("autoarima", 2.0), "k": ("arima", 3.0)}
    keys = spark.createDataFrame([("m", "h"), ("x", "h")], "metric_name string, labels_hash string")
    assert [r.rmse for r in store.lookup_models(keys, models).collect()] == [2.0]


def test_model_versions(spark):
    rows = [("a", datetime(2024, 1, d), d * 10) for d in (1, 2, 3)] + [("b", datetime(2024, 1, 1), 5)]
    runs = spark.createDataFrame(rows, "source string, trained_at timestamp, lines_trained long")
    got = {r.source: (r.version, r.lines_trained) for r in store.model_metadata(runs).collect()}
    assert got == {"a": (3, 30), "b": (1, 5)}
    assert sorted(r.version for r in store.model_versions(runs).collect()) == [1, 1, 2, 3]


@pytest.mark.parametrize("writer", ["anomalies", "metric_samples", "correlated_events"])
def test_appends(spark, tmp_path, writer):
    data = {
        "anomalies": (store.append_anomalies, "id string, detected_at timestamp", [("x", NOW)]),
        "metric_samples": (store.append_metric_samples, "name string, timestamp timestamp", [("x", NOW)]),
        "correlated_events": (store.append_correlated_events, "id string, detected_at timestamp", [("x", NOW)]),
    }
    append, schema, rows = data[writer]
    for _ in range(2):
        append(spark.createDataFrame(rows, schema), str(tmp_path / writer))
    assert spark.read.parquet(str(tmp_path / writer)).count() == 2


def test_odd_bodies_lose_no_message(spark):
    odd = [
        '\n[{"message": "one"}, {"message": "two"}]\r\n',
        '[{"message": "one", "a": {"k": 1, "k": 2}}, {"message": "two"}, 3, "text"]',
        '{"message": "first", "message": "last"}',
    ]
    got = E.http_log_lines(bodies(spark, *odd)).orderBy("body_id", "line_number").collect()
    assert [(r.line_number, r.line) for r in got] == [(0, "one"), (1, "two"), (0, "one"), (1, "two"), (0, "last")]


def test_a_source_without_required_labels_takes_every_set(spark):
    sets = spark.createDataFrame([({"job": "a"},), ({"job": "b"},), ({},)], "labels map<string,string>")
    rows = [(0, "a", {"job": "a"}), (1, "rest", {}), (2, "late", {"job": "b"})]
    table = spark.createDataFrame(rows, "ord int, source string, required map<string,string>")
    by_table = {r.label_key: r.source for r in E.match_sources(sets, table).collect()}
    assert by_table == {'{"job": "a"}': "a", '{"job": "b"}': "rest", "{}": "rest"}


def test_pairs_of_many_days_are_appended_without_sorting_them(spark, tmp_path, monkeypatch):
    from datetime import datetime, timedelta

    from tidewatch.sources import store as S

    monkeypatch.setattr(S, "OPEN_FILES", 3)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    rows = [(str(i), "a", "b", 1.0, 0.5, datetime(2024, 1, 1) + timedelta(days=i % 7) if i % 9 else None) for i in range(200)]
    schema = "id string, log_event_id string, metric_event_id string, time_delta_sec double, confidence double, detected_at timestamp"
    pairs = spark.createDataFrame(rows, schema)
    S.append_correlated_events(pairs, str(tmp_path))
    S.append_correlated_events(pairs, str(tmp_path))
    read = spark.read.parquet(str(tmp_path))
    assert sorted(map(tuple, read.drop("date", "run").collect()), key=str) == sorted(rows * 2, key=str)
    assert read.filter("run <> 'batch' or not date <=> to_date(detected_at)").isEmpty()
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert all(f.name.endswith(".zstd.parquet") for f in tmp_path.rglob("part-*"))
