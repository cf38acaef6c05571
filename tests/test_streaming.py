import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import correlate as J
from tidewatch.operators.alerts import cooldown_kept
from tidewatch.operators.detectors import observations
from tidewatch.plans.baseline import train_baseline
from tidewatch.plans.detection import detect
from tidewatch.sources.textlogs import stream_log_files
from tidewatch.streaming.alerts import stream_cooldown, stream_cooldown_in_order
from tidewatch.streaming.correlation import stream_correlations
from tidewatch.streaming.templates import state_in_rocksdb, write_templates
from tidewatch.streaming.detection import windowed_observations, write_detections, write_training
from tidewatch.sources.store import append_logs, write_batch
from tidewatch.streaming.ingest import write_http_logs, write_logs, write_loki_logs, write_otlp_metrics, write_scrapes

START = datetime(2024, 1, 1)
LOG_SCHEMA = (
    "timestamp timestamp, source string, level string, message string, template_id string, fields string, line_number long"
)
EVENT_SCHEMA = "id string, detected_at timestamp, source string, severity string"


def land(spark, path, rows, schema, files):
    """Write rows as files that a stream reads one by one, in order."""
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size : (i + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema, per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def drain(df, path, mode="append"):
    writer = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp")
    writer.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/out")


def test_ingest_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "app.1.log").write_text('{"ts":"2024-01-01T00:00:00Z","level":"ERROR","msg":"boom 1"}\n\nlevel=info msg="ok" a=1\n')

    def run():
        lines = stream_log_files(spark, str(inbox))
        write_logs(lines, str(tmp_path / "logs"), str(tmp_path / "cp"), once=True).awaitTermination()
        return spark.read.parquet(str(tmp_path / "logs")).collect()

    rows = run()
    assert sorted((r.level, r.message) for r in rows) == [("error", "boom 1"), ("info", "ok")]
    assert all(r.template_id and r.ingested_at for r in rows)
    assert {(r.source, r.line_number, str(r.timestamp)) for r in rows if r.level == "error"} == {
        ("app", 1, "2024-01-01 00:00:00")
    }
    (inbox / "app.2.log").write_text("plain text 5\n")
    assert sorted(r.message for r in run()) == ["boom 1", "ok", "plain text 5"]
    assert len(run()) == 3


def test_scrape_stream(spark, tmp_path):
    rows = [(i, "node", f"# TYPE a counter\na{{x=\"{i}\"}} {i}\nb 2\n", START + timedelta(minutes=i)) for i in range(6)]
    schema = "body_id long, source string, body string, scraped_at timestamp"
    land(spark, str(tmp_path / "in"), rows, schema, 3)
    bodies = source(spark, str(tmp_path / "in"), schema)
    write_scrapes(bodies, str(tmp_path / "m"), str(tmp_path / "cp"), exclude=["^b$"], once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "m")).orderBy("timestamp").collect()
    assert [(r.value, r.metric_type, r.timestamp) for r in got] == [
        (float(i), "counter", START + timedelta(minutes=i)) for i in range(6)
    ]


def log_rows(minutes, bad_from):
    rows = []
    for i in range(minutes * 20):
        at = START + timedelta(seconds=3 * i)
        bad = i >= bad_from * 20
        level = "error" if bad or i % 50 == 0 else "info"
        rows.append((at, "app", level, f"m {i}", "tpl-new" if bad else f"tpl-{i % 3}", json.dumps({"latency": 400 + i % 7 if bad else 100 + i % 10}), i))
    return rows


def test_detection_stream_equals_batch(spark, tmp_path):
    baseline_rows = log_rows(600, 601)
    write_training(spark.createDataFrame(baseline_rows, LOG_SCHEMA), str(tmp_path / "model"), START + timedelta(hours=10))
    from tidewatch.plans.baseline import read_baseline

    baseline = read_baseline(spark, str(tmp_path / "model"))
    rows = log_rows(60, 42)
    land(spark, str(tmp_path / "in"), rows, LOG_SCHEMA, 4)
    stream = source(spark, str(tmp_path / "in"), LOG_SCHEMA)
    write_detections(stream, baseline, str(tmp_path / "a"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "a"))

    # the last windows stay open: the watermark is ten minutes behind the newest line
    closed = rows[-1][0] - timedelta(minutes=10)
    lines = spark.createDataFrame(rows, LOG_SCHEMA).withColumn("window_start", F.window("timestamp", "5 minutes")["start"])
    lines = lines.filter(F.col("window_start") + F.expr("interval 5 minutes") <= F.lit(closed))
    end = F.col("window_start") + F.expr("interval 5 minutes")
    batch = detect(observations(lines, "window_start"), baseline, end, by=["source", "window_start"])
    key = ["id", "anomaly_type", "severity", "detected_at"]
    wanted = sorted(map(tuple, batch.select(*key).collect()))
    assert sorted(map(tuple, got.select(*key).collect())) == wanted
    assert {"error_rate_spike", "novel_pattern", "latency_shift"} <= {w[1] for w in wanted}


def test_late_lines_are_left_out(spark, tmp_path):
    schema = LOG_SCHEMA
    rows = [(START + timedelta(minutes=m), "s", "info", "m", "t", None, m) for m in (0, 30, 60, 1, 90)]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    windows = windowed_observations(source(spark, str(tmp_path / "in"), schema))
    got = drain(windows, str(tmp_path)).orderBy("window_start").collect()
    assert [(r.window_start - START, r.n) for r in got] == [
        (timedelta(0), 1), (timedelta(minutes=30), 1), (timedelta(minutes=60), 1)
    ]


def test_cooldown_stream_equals_batch(spark, tmp_path):
    rows = []
    for i in range(300):
        rows.append((f"{i:03d}", "novel_pattern", "high", ["a", "b"][i % 2], START + timedelta(seconds=97 * i), '{"template_id": "t"}'))
    schema = "id string, anomaly_type string, severity string, source string, detected_at timestamp, context string"
    land(spark, str(tmp_path / "in"), rows, schema, 5)
    kept = stream_cooldown(source(spark, str(tmp_path / "in"), schema))
    got = drain(kept, str(tmp_path))
    wanted = sorted(r.id for r in cooldown_kept(spark.createDataFrame(rows, schema)).collect())
    assert sorted(r.id for r in got.collect()) == wanted and len(wanted) > 20


def test_cooldown_by_event_time_in_any_order(spark, tmp_path):
    import random

    random.seed(5)
    schema = "id string, anomaly_type string, severity string, source string, detected_at timestamp, context string"

    def row(i, seconds, key):
        return (f"{i:03d}", "novel_pattern", "high", key, START + timedelta(seconds=seconds), "{}")

    rows = [row(i, 97 * i + random.randint(0, 90), random.choice("ab")) for i in range(160)]
    rows += [row(200 + i, 97 * i, "a") for i in range(0, 160, 9)]
    mixed = []
    for at in range(0, len(rows), 30):  # rows come up to some 50 minutes late
        part = sorted(rows, key=lambda r: r[4])[at : at + 30]
        random.shuffle(part)
        mixed += part
    swapped = [mixed[i ^ 1] for i in range(len(mixed) - len(mixed) % 2)] + mixed[len(mixed) - len(mixed) % 2 :]
    last = [row(999, 10_000_000, "z")]
    land(spark, str(tmp_path / "in"), swapped, schema, 5)
    land(spark, str(tmp_path / "in"), last, schema, 1)
    with state_in_rocksdb(spark):
        kept = stream_cooldown_in_order(source(spark, str(tmp_path / "in"), schema), lateness="60 minutes")
        got = drain(kept, str(tmp_path))
    wanted = sorted(r.id for r in cooldown_kept(spark.createDataFrame(rows, schema)).collect())
    assert sorted(r.id for r in got.collect()) == wanted and len(wanted) > 10


def test_crowded_buckets_of_a_stream_are_split(spark, tmp_path):
    left = [(f"l{i}", START + timedelta(seconds=i % 7), "ab"[i % 2], "high") for i in range(60)]
    right = [(f"m{i}", START + timedelta(seconds=i % 5), "ab"[i % 2], "medium") for i in range(40)]
    land(spark, str(tmp_path / "l"), left, EVENT_SCHEMA, 2)
    land(spark, str(tmp_path / "m"), right, EVENT_SCHEMA, 2)
    streams = [source(spark, str(tmp_path / side), EVENT_SCHEMA) for side in "lm"]
    got = drain(stream_correlations(*streams, splits=3), str(tmp_path)).select("id", "confidence")
    batch = J.find_correlations(
        spark.createDataFrame(left, EVENT_SCHEMA), spark.createDataFrame(right, EVENT_SCHEMA), F.lit(START)
    )
    got, wanted = (sorted((r.id, round(r.confidence, 9)) for r in df.collect()) for df in (got, batch))
    assert got == wanted and len(wanted) > 500


def test_correlation_stream_equals_batch(spark, tmp_path):
    left = [(f"l{i}", START + timedelta(seconds=61 * i), "ab"[i % 2], "high") for i in range(80)]
    right = [(f"m{i}", START + timedelta(seconds=83 * i), "ab"[i % 2], "medium") for i in range(60)]
    land(spark, str(tmp_path / "l"), left, EVENT_SCHEMA, 3)
    land(spark, str(tmp_path / "m"), right, EVENT_SCHEMA, 3)
    joined = stream_correlations(
        source(spark, str(tmp_path / "l"), EVENT_SCHEMA), source(spark, str(tmp_path / "m"), EVENT_SCHEMA)
    )
    got = drain(joined, str(tmp_path)).select("id", "confidence")
    batch = J.find_correlations(
        spark.createDataFrame(left, EVENT_SCHEMA), spark.createDataFrame(right, EVENT_SCHEMA), F.lit(START)
    )
    got, wanted = (sorted((r.id, round(r.confidence, 9)) for r in df.collect()) for df in (got, batch))
    assert got == wanted and len(wanted) > 50


def test_stream_of_anomalies_needs_event_time(spark, tmp_path):
    land(spark, str(tmp_path / "l"), [("a", "x")], "id string, detected_at string", 1)
    stream = source(spark, str(tmp_path / "l"), "id string, detected_at string")
    with pytest.raises(Exception, match="(?i)event"):
        stream.withWatermark("detected_at", "1 minute").groupBy("id").count().writeStream.format("noop").start()


def test_streams_and_batch_jobs_share_a_table(spark, tmp_path):
    logs = str(tmp_path / "logs")
    for name in ("s", "t"):
        inbox = tmp_path / name
        inbox.mkdir()
        (inbox / f"{name}.log").write_text(f"line of {name}\n")
        lines = stream_log_files(spark, str(inbox))
        write_logs(lines, logs, str(tmp_path / f"cp-{name}"), once=True).awaitTermination()
    row = (START, "u", "info", "appended", "x", "{}", 0)
    append_logs(spark.createDataFrame([row], LOG_SCHEMA), logs)
    assert sorted(r.source for r in spark.read.parquet(logs).collect()) == ["s", "t", "u"]


def test_a_repeated_batch_replaces_itself_only(spark, tmp_path):
    rows = spark.createDataFrame([(START, 1), (START + timedelta(days=1), 2)], "timestamp timestamp, v long")
    for run, batch in (("one", 0), ("two", 0), ("one", 1), ("one", 0)):
        write_batch(rows, str(tmp_path / "t"), batch, F.col("timestamp"), run)
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.count() == 6 and got.select("run").distinct().count() == 3
    with pytest.raises(ValueError):
        write_batch(rows, str(tmp_path / "t"), 0, F.col("timestamp"))


def test_pushed_bodies(spark, tmp_path):
    at = START + timedelta(minutes=1)
    access = '10.0.0.1 - - [01/Jan/2024:00:00:05 +0000] \\"GET /x HTTP/1.1\\" 500 12'
    posts = [('[{"message": "level=error msg=bad a=1"}, {"message": "%s"}]' % access, "web")]
    land(spark, str(tmp_path / "http"), posts, "body string, x_source string", 1)
    bodies = source(spark, str(tmp_path / "http"), "body string, x_source string")
    write_http_logs(bodies, str(tmp_path / "l"), str(tmp_path / "c1"), once=True).awaitTermination()
    push = '{"streams": [{"stream": {"app": "x"}, "values": [["1", "first"], ["2", "second"]]}]}'
    land(spark, str(tmp_path / "loki"), [(push,)], "body string", 1)
    write_loki_logs(
        source(spark, str(tmp_path / "loki"), "body string"), [("any", {})], str(tmp_path / "l"), str(tmp_path / "c2"), once=True
    ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "l")).collect()
    assert sorted((r.source, r.level or "", r.message) for r in got) == [
        ("any", "", "first"), ("any", "", "second"), ("web", "error", "GET /x HTTP/1.1"), ("web", "error", "bad")
    ]
    metric = '{"name": "queue_depth", "gauge": {"dataPoints": [{"asDouble": 4.5}]}}'
    export = '{"resourceMetrics": [{"scopeMetrics": [{"metrics": [%s]}]}]}' % metric
    land(spark, str(tmp_path / "otlp"), [(export, at)], "body string, received_at timestamp", 1)
    bodies = source(spark, str(tmp_path / "otlp"), "body string, received_at timestamp")
    write_otlp_metrics(bodies, str(tmp_path / "m"), str(tmp_path / "c3"), once=True).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "m")).first()
    assert (row["name"], row.value, row.timestamp) == ("queue_depth", 4.5, at)


def test_drain_in_a_stream_equals_a_batch_run(spark, tmp_path):
    import random

    from tidewatch.operators import templates as T

    random.seed(9)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "7"]
    messages = [" ".join(["job", "step", *random.choices(words, k=random.randint(3, 5))]) for _ in range(294)] + ["", None, "x"]
    rows = [("s" if i % 3 else "t", START + timedelta(seconds=i) if i % 50 else None, i, m) for i, m in enumerate(messages)]
    schema = "source string, timestamp timestamp, line_number long, message string"
    land(spark, str(tmp_path / "in"), rows, schema, 3)
    logs = source(spark, str(tmp_path / "in"), schema).withColumn("ingested_at", F.lit(START).cast("timestamp"))
    write_templates(logs, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = {r.line_number: r.template_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    known = None
    for part in range(3):  # lines without a time come first in each run
        some = spark.createDataFrame(rows[part * 99 : (part + 1) * 99], schema)
        shapes = T.inventory(T.assign_shapes(some)).withColumnsRenamed({"template_id": "shape_id", "template": "shape"})
        known = T.learn_clusters(shapes, known)
    lines = T.assign_shapes(spark.createDataFrame(rows, schema))
    assert got == {r.line_number: r.template_id for r in T.with_templates(lines, known).collect()}
    assert len(got) == 297 and len(set(got.values())) < 250
    with pytest.raises(ValueError):
        write_templates(logs, "unused", "unused", once=True, forget_after_days=7)


class Held:
    """A state variable in memory, as the processor sees it."""

    def __init__(self):
        self.rows = {}

    def exists(self):
        return bool(self.rows)

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value


def test_one_call_takes_many_leaves(monkeypatch):
    """A leaf of one shape each, and one of many patterns, over three micro-batches."""
    import pandas as pd

    from tidewatch.operators.templates import _greedy
    from tidewatch.streaming import templates as S

    monkeypatch.setattr(S, "BLOCK", 2)
    state = S.LeafState(["line_number", "template_id"], 0.6, None)
    state.members, state.patterns = Held(), Held()
    crowded = [f"job {a} {b} {a}" for a in "abcdefg" for b in "xy"] * 2
    texts = [*(" ".join(["w"] * n) for n in range(1, 40)), *crowded]
    rows = pd.DataFrame({"template": texts, "line_number": range(len(texts))})
    rows = rows.assign(template_id="id " + rows["template"], timestamp=pd.Timestamp(START))
    rows["leaf"] = ["crowded" if t in crowded else t for t in texts]
    parts = [rows[:20], rows[20:50], rows[50:]]
    got = pd.concat([out for p in parts for out in state.handleInputRows(None, iter([p[:7], p[7:]]), None)])
    order = list(dict.fromkeys(crowded))
    member = _greedy([t.split(" ") for t in order], 0.6).member
    assert 2 < len(set(member)) < len(order)
    opened = {m: t for t, m in reversed(list(zip(order, member)))}
    cluster = {t: opened[m] for t, m in zip(order, member)}
    assert list(got["template_id"]) == ["id " + cluster.get(t, t) for t in texts]
    assert len({block for leaf, block in state.patterns.rows if leaf == "crowded"}) > 1
