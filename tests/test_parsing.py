import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import parsing as P
from tidewatch.functions import scalars as S


def lines(spark, rows):
    return spark.createDataFrame([("s", i, r) for i, r in enumerate(rows)], "source string, line_number long, line string")


def parse(spark, rows, fmt=None, **options):
    hint = F.lit(fmt) if fmt else None
    return {r.line_number: r for r in P.parse_each(lines(spark, rows), hint, **options).collect()}


def test_json_line(spark):
    got = parse(spark, ['{"level":"ERROR","message":"boom","timestamp":"2024-01-01T00:00:00Z","host":"a","n":1.5}'])[0]
    assert (got.level, got.message, got.timestamp, got.format) == ("error", "boom", "2024-01-01T00:00:00Z", "json")
    assert json.loads(got.fields) == {"host": "a", "n": 1.5}


def test_json_aliases_and_types(spark):
    rows = [
        '{"severity":"Warn","lvl":"x","msg":"m","log":"l","ts":1,"time":2}',
        '{"a":{"b":[1,"x"]},"t":true,"z":null}',
        '{"a":1,"a":2}',
        '{"message":null,"level":null}',
    ]
    got = parse(spark, rows)
    assert (got[0].level, got[0].message, got[0].timestamp) == ("warn", "m", "2")
    assert json.loads(got[0].fields) == {"lvl": "x", "log": "l", "ts": 1}
    assert json.loads(got[1].fields) == {"a": {"b": [1, "x"]}, "t": True, "z": None}
    assert json.loads(got[2].fields) == {"a": 2}
    assert got[3].message is None and got[3].level is None


@pytest.mark.parametrize("line", ['{"a":1} x', '{"a":1} {"b":2}', "{'a':1}", '{"a":1', "[1]", "5", "", "{bad}"])
def test_not_json(spark, line):
    assert parse(spark, [line], "json") == {}


def test_logfmt_line(spark):
    got = parse(spark, ['level=INFO msg="hello world" ts=2024-01-01 duration=250ms x=1 x=2 lvl=q message=m2'])[0]
    assert (got.level, got.message, got.timestamp, got.format) == ("INFO", "hello world", "2024-01-01", "logfmt")
    assert json.loads(got.fields) == {"duration": "250ms", "x": "2"}


def test_logfmt_quotes_and_unicode(spark):
    got = parse(spark, ['a="x y" b="open c=""', "ключ=значение b=1", "no pairs here"], "logfmt")
    assert json.loads(got[0].fields) == {"a": "x y", "b": "open c="}
    assert json.loads(got[1].fields) == {"ключ": "значение", "b": "1"}
    assert 2 not in got


def test_plain_line(spark):
    got = parse(spark, ["  Jan 1 host app: text \t", "   ", "one=pair"])
    assert got[0].message == "Jan 1 host app: text" and got[0].level is None and got[0].fields == "{}"
    assert 1 not in got
    assert got[2].format == "plain"


def test_access_log(spark):
    line = '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /a.gif HTTP/1.0" 500 2326 "http://x" "Agent 1"'
    got = parse(spark, [line, "not an access line"], "nginx")
    assert list(got) == [0]
    assert got[0].timestamp == "2000-10-10T20:55:36Z" and got[0].level == "error"
    assert json.loads(got[0].fields)["status"] == 500 and json.loads(got[0].fields)["path"] == "/a.gif"


def test_syslog(spark):
    got = parse(spark, ["<34>Oct  1 22:14:15 host su[12]: failed", "<34>Foo  1 22:14:15 h a: x"], "syslog3164", year=2024)
    assert list(got) == [0]
    assert got[0].timestamp == "2024-10-01T22:14:15" and got[0].message == "failed"
    assert json.loads(got[0].fields) == {"facility": 4, "severity": 2, "hostname": "host", "app": "su", "pid": "12"}


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        (['{"a":1}'] * 6 + ["x"] * 4, "json"),
        (['{"a":1}'] * 5 + ["x"] * 5, "plain"),
        (["a=1 b=2"] * 2 + [""], "logfmt"),
        (["a=1 b=2"] * 1 + [""] * 2, "plain"),
        (["x"] * 10 + ['{"a":1}'] * 90, "plain"),
    ],
)
def test_batch_format(spark, rows, expected):
    assert [r.format for r in P.detect_format(lines(spark, rows)).collect()] == [expected]


def test_parse_batches_uses_one_format(spark):
    got = P.parse_batches(lines(spark, ['{"msg":"a"}', '{"msg":"b"}', "plain"])).orderBy("line_number").collect()
    assert [(r.line_number, r.message) for r in got] == [(0, "a"), (1, "b")]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-01-01T10:00:00Z", datetime(2024, 1, 1, 10)),
        ("2024-01-01T10:00:00+02:00", datetime(2024, 1, 1, 8)),
        ("2024-01-01 10:00:00.5", datetime(2024, 1, 1, 10, 0, 0, 500000)),
        ("2024-01-01T10:00", datetime(2024, 1, 1, 10)),
        ("2024-01-01T10+01:00", datetime(2024, 1, 1, 9)),
        ("2024-01-01", datetime(2024, 1, 1)),
        ("2024", None),
        ("10:00", None),
        ("2024-13-01", None),
        ("soon", None),
    ],
)
def test_timestamps(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string").select(S.parse_timestamp(F.col("t")).cast("timestamp_ntz"))
    assert df.first()[0] == expected


@pytest.mark.parametrize(
    ("fields", "expected"),
    [
        ('{"latency": 5}', 5.0),
        ('"{\\"duration\\": \\"7.5\\"}"', 7.5),
        ('{"duration": "250ms", "elapsed": 3}', None),
        ('{"latency": null, "elapsed": 3}', None),
        ('{"elapsed": 3, "latency": 1}', 1.0),
        ('{"latency": -1}', None),
        ('{"latency": "nan"}', None),
        ('{"latency": "1_000"}', 1000.0),
        ('{"latency": "1.5d"}', None),
        ('{"latency": 1} x', None),
        ("[1]", None),
        (None, None),
    ],
)
def test_latency(spark, fields, expected):
    assert spark.createDataFrame([(fields,)], "f string").select(S.latency(F.col("f"))).first()[0] == expected


@pytest.mark.parametrize(
    "labels", [{}, {"b": 'x"y\\', "a": "é€😀\x7f"}, {"tab": "a\tb\nc\r\b\f\x01"}, {"z": "1", "a": "2", "m": ""}]
)
def test_labels_hash(spark, labels):
    df = spark.createDataFrame([(labels,)], "m map<string,string>")
    text, digest = df.select(S.labels_json(F.col("m")), S.labels_hash(F.col("m"))).first()
    assert text == json.dumps(labels, sort_keys=True)
    assert digest == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_decode_fields(spark):
    rows = ['{"a": 1}', '"{\\"a\\": 1}"', '"text"', "[1]", "nonsense", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, f string")
    got = [r[0] for r in df.orderBy("i").select(S.decode_fields(F.col("f"))).collect()]
    assert got == ['{"a": 1}', '{"a": 1}', None, None, None, None]


def test_each_line_is_parsed_once(spark):
    plan = P.parse_each(lines(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


ACCESS = '10.0.0.7 - - [02/Mar/2024:10:00:00 +0000] "GET /q=%s HTTP/1.1" 503 17 "-" "agent \\"x\\""'


def test_access_and_syslog_are_recognised(spark):
    lines = [ACCESS % i for i in range(10)] + ["<34>Oct 11 22:14:15 host su[7]: it failed"] * 10
    rows = [("web" if i < 10 else "sys", i, line) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "source string, line_number long, line string")
    assert {r.source: r.format for r in P.detect_format(df).collect()} == {"web": "nginx", "sys": "syslog3164"}
    each = P.parse_each(df, year=2024).collect()
    assert {(r.source, r.level, r.format) for r in each} == {("web", "error", "nginx"), ("sys", "fatal", "syslog3164")}
    assert {r.timestamp[:10] for r in each} == {"2024-03-02", "2024-10-11"}


def test_escaped_quote_in_a_request(spark):
    line = '1.2.3.4 - - [02/Mar/2024:10:00:00 +0000] "GET /a\\"b HTTP/1.1" 200 5'
    df = spark.createDataFrame([(line,)], "line string")
    row = df.select(P.parse_line(F.col("line")).alias("r")).first().r
    assert row.format == "nginx" and row.message == 'GET /a\\"b HTTP/1.1'


def test_nested_repeated_key_is_json(spark):
    df = spark.createDataFrame([('{"msg":"x","level":"WARN","a":{"k":1,"k":2}}',)], "line string")
    row = df.select(P.parse_line(F.col("line")).alias("r")).first().r
    assert (row.format, row.message, row.level) == ("json", "x", "warn") and "a" in row.fields


def test_last_of_repeated_latency_keys(spark):
    df = spark.createDataFrame([('{"latency": 1, "latency": 2}',)], "fields string")
    assert df.select(S.latency(F.col("fields")).alias("v")).first().v == 2.0
