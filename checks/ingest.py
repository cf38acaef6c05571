"""Sources and parsing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as V
from checks.views import check
from tidewatch.functions import parsing as P
from tidewatch.functions import scalars as S
from tidewatch.session import config_table
from tidewatch.sources import envelopes, prometheus, store
from tidewatch.streaming.ingest import ingest_logs

# --- envelopes: fifty events to a body, as a collector would post them


@check(
    "s2_http_log_envelope",
    """
-- views: logs
select line_number // 50 as body_id, case when (line_number // 50) % 2 = 0 then 'http' else 'batch' end as source,
       row_number() over (partition by line_number // 50 order by line_number) - 1 as line_number, message as line
from logs where level <> 'warn'
""",
)
def http_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    # warnings get an empty message, which must be dropped
    message = F.when(F.col("level") == "warn", "").otherwise(F.col("message"))
    entry = F.struct("line_number", message.alias("message"), F.lit("debug").alias("level"))
    bodies = V.logs(spark, sf_dir).groupBy(F.floor(F.col("line_number") / 50).alias("body_id"))
    bodies = bodies.agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("body"))
    bodies = bodies.withColumn("x_source", F.when(F.col("body_id") % 2 == 1, "batch"))
    return envelopes.http_log_lines(bodies)


MATCHERS = [
    ("edge", {"job": "svc-0", "env": "prod"}),
    ("prod", {"env": "prod"}),
    ("core", {"job": "svc-3"}),
]


def _loki_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = F.when(F.col("source").isin("svc-0", "svc-1"), "prod").otherwise("dev")
    labels = F.create_map(F.lit("job"), F.col("source"), F.lit("env"), env, F.lit("level"), F.col("level"))
    value = F.array(F.unix_micros("timestamp").cast("string"), F.col("message"))
    lines = V.logs(spark, sf_dir).select(
        F.floor(F.col("line_number") / 50).alias("body_id"),
        "source",
        "level",
        F.struct("line_number", labels.alias("labels"), value.alias("value")).alias("v"),
    )
    streams = lines.groupBy("body_id", "source", "level").agg(F.array_sort(F.collect_list(F.struct("v.line_number", "v.value"))).alias("vs"), F.any_value("v.labels").alias("labels"))
    stream = F.struct("source", "level", F.to_json("labels").alias("l"), F.transform("vs", lambda v: v["value"]).alias("values"))
    bodies = streams.groupBy("body_id").agg(F.array_sort(F.collect_list(stream)).alias("ss"))
    shape = F.transform(
        "ss",
        lambda s: F.struct(F.from_json(s["l"], "map<string,string>").alias("stream"), s["values"].alias("values")),
    )
    return bodies.select("body_id", F.to_json(F.struct(shape.alias("streams"))).alias("body"))


@check(
    "s3_loki_push_envelope",
    """
-- views: logs
with matched as (
  select line_number // 50 as body_id, line_number as event, source as job, level, message as line,
         case when source = 'svc-0' then 'edge' when source = 'svc-1' then 'prod' when source = 'svc-3' then 'core' end as source
  from logs)
select body_id, source, line,
       row_number() over (partition by body_id order by job, level, event) - 1 as line_number
from matched where source is not null
""",
)
def loki_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.loki_log_lines(_loki_bodies(spark, sf_dir), MATCHERS)


@check(
    "j6_label_matcher",
    """
-- views: logs
with sets as (
  select distinct source as job, level, case when source in ('svc-0', 'svc-1') then 'prod' else 'dev' end as env
  from logs)
select '{"env": "' || env || '", "job": "' || job || '", "level": "' || level || '"}' as label_key,
       case when job = 'svc-0' then 'edge' when job = 'svc-1' then 'prod' when job = 'svc-3' then 'core' end as source
from sets where job in ('svc-0', 'svc-1', 'svc-3')
""",
)
def label_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = F.when(F.col("source").isin("svc-0", "svc-1"), "prod").otherwise("dev")
    labels = F.create_map(F.lit("job"), F.col("source"), F.lit("env"), env, F.lit("level"), F.col("level"))
    rows = [(i, name, list(required.items())) for i, (name, required) in enumerate(MATCHERS)]
    matchers = config_table(spark, rows, "ord int, source string, required map<string,string>")
    return envelopes.match_sources(V.logs(spark, sf_dir).select(labels.alias("labels")), matchers)


@check(
    "s4_otlp_metrics_envelope",
    """
-- views: logs
select event_id // 50 as body_id, event_type as name, '{"event": "' || event_id || '", "user": "' || user_id || '"}' as labels,
       left(sha256('{"event": "' || event_id || '", "user": "' || user_id || '"}'), 16) as labels_hash,
       case when event_type = 'signup' then cast(user_id as double) else value end as value,
       timestamp '2024-02-01' as "timestamp", case when event_type = 'view' then 'counter' else 'gauge' end as metric_type,
       case when source = 'svc-4' then 'otel' else source end as source
from e where event_type <> 'error'
""",
)
def otlp_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are sums, signups integer gauges, errors a histogram that gives no points; one source has no name."""
    kind = F.col("event_type")
    attributes = F.array(
        F.struct(F.lit("user").alias("key"), F.struct(F.col("user_id").alias("intValue")).alias("value")),
        F.struct(F.lit("event").alias("key"), F.struct(F.col("event_id").alias("intValue")).alias("value")),
    )
    point = F.struct(
        attributes.alias("attributes"),
        F.when(kind == "signup", 0.0).otherwise(F.col("value")).alias("asDouble"),
        F.when(kind == "signup", F.col("user_id").cast("string")).alias("asInt"),
    )
    points = F.struct(F.array(point).alias("dataPoints"))
    metric = F.struct(
        kind.alias("name"),
        F.when(kind == "view", points).alias("sum"),
        F.when(kind == "error", points).alias("histogram"),
        F.when(~kind.isin("view", "error"), points).alias("gauge"),
    )
    service = F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))
    e = V.events(spark, sf_dir).select(
        F.floor(F.col("event_id") / 50).alias("body_id"), service.alias("service"), metric.alias("metric")
    )
    scopes = e.groupBy("body_id", "service").agg(F.collect_list("metric").alias("metrics"))
    name = F.array(
        F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value"))
    )
    resource = F.struct(F.when(F.col("service") != "svc-4", name).alias("attributes"))
    entry = F.struct(resource.alias("resource"), F.array(F.struct("metrics")).alias("scopeMetrics"))
    bodies = scopes.groupBy("body_id").agg(
        F.to_json(F.struct(F.collect_list(entry).alias("resourceMetrics"))).alias("body")
    )
    return envelopes.otlp_metric_samples(bodies, F.lit("2024-02-01").cast("timestamp"))


SCRAPE_FILTERS = (["^(click|view|purchase|signup)", "err"], ["sign", "^error"])


def scrape_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    name = F.concat("event_type", F.lit("_total"))
    service = F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))
    line = F.concat(
        name, F.lit('{user="'), F.col("user_id").cast("string"), F.lit('",svc="'), service, F.lit('"} '),
        F.col("value").cast("string"), F.lit(" 1706745600000"),
    )
    bodies = e.groupBy(F.floor(F.col("event_id") / 50).alias("body_id")).agg(
        F.array_join(F.collect_list(line), "\n").alias("samples")
    )
    head = "# HELP click clicks\n# TYPE click counter\n\n# TYPE view_total summary\n"
    body = F.concat(F.lit(head), "samples", F.lit("\nbroken_total{a=\"b\"} not-a-number\n# TYPE purchase_total histogram\n"))
    return bodies.select("body_id", F.lit("target").alias("source"), body.alias("body"))


@check(
    "s5_prometheus_text",
    """
-- views: logs
select event_id // 50 as body_id, event_type || '_total' as name,
       '{"svc": "' || source || '", "user": "' || user_id || '"}' as labels,
       left(sha256('{"svc": "' || source || '", "user": "' || user_id || '"}'), 16) as labels_hash,
       value, timestamp '2024-02-01' as "timestamp",
       case event_type when 'click' then 'counter' when 'view' then 'summary' else 'gauge' end as metric_type,
       'target' as source
from e where event_type in ('click', 'view', 'purchase')
""",
)
def prometheus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TYPE lines by base name and by full name, one after its samples; two names are filtered out."""
    stamp = F.lit("2024-02-01").cast("timestamp")
    return prometheus.prometheus_samples(scrape_bodies(spark, sf_dir), stamp, *SCRAPE_FILTERS)


@check(
    "s6_labels_hash",
    """
-- views: logs
with labelled as (
  select user_id, source, max(event_type) as top, '{"svc": "' || source || '", "user \\"id\\"": "' || user_id || '"}' as labels
  from e group by user_id, source)
select user_id, labels, left(sha256(labels), 16) as labels_hash from labelled
""",
)
def labels_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))
    labels = F.create_map(F.lit('user "id"'), F.col("user_id").cast("string"), F.lit("svc"), service)
    users = V.events(spark, sf_dir).select("user_id").distinct()
    return users.select(
        "user_id", S.labels_json(labels).alias("labels"), S.labels_hash(labels).alias("labels_hash")
    )


@check(
    "s7_metric_name_filter",
    """
-- views: metric_samples
select name, count(*) as samples from metric_samples
where (regexp_matches(name, '^disk') or regexp_matches(name, '_[13]$')) and not regexp_matches(name, '2')
group by name
""",
)
def metric_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = S.name_selected(F.col("name"), ["^disk", "_[13]$"], ["2"])
    return V.metric_samples(spark, sf_dir).filter(keep).groupBy("name").agg(F.count("*").alias("samples"))


# --- parsing

PARSED_SQL = """
with parsed as (
  select source, line_number, line,
         case when line like '{%}' and json_valid(line) then 'json'
              when regexp_matches(line, '^\\w+=\\S+(\\s+\\w+=\\S+)+') then 'logfmt' else 'plain' end as format
  from raw_lines)
"""


@check(
    "p1_detect_format",
    f"""
-- views: logs, raw_lines
{PARSED_SQL},
ranked as (select *, row_number() over (partition by source order by line_number) as n from parsed)
select source,
       case when avg(case when format = 'json' then 1.0 else 0 end) > 0.5 then 'json'
            when avg(case when format = 'logfmt' then 1.0 else 0 end) > 0.5 then 'logfmt' else 'plain' end as format
from ranked where n <= 10 group by source
""",
)
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.detect_format(V.raw_lines(spark, sf_dir))


@check(
    "p2_parse_json",
    """
-- views: logs, raw_lines
select source, line_number, line ->> '$.ts' as "timestamp", lower(line ->> '$.level') as level, line ->> '$.msg' as message,
       cast(line ->> '$.latency' as double) as latency, 1 as other_fields
from raw_lines where json_valid(line) and line like '{%'
""",
)
def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = P.parse_each(V.raw_lines(spark, sf_dir), F.lit("json"))
    return parsed.select(
        "source",
        "line_number",
        "timestamp",
        "level",
        "message",
        S.latency(F.col("fields")).alias("latency"),
        F.size(F.json_object_keys("fields")).alias("other_fields"),
    )


@check(
    "p3_parse_logfmt",
    """
-- views: logs, raw_lines
select source, line_number, regexp_extract(line, 'time=(\\S+)', 1) as "timestamp",
       regexp_extract(line, 'level=(\\S+)', 1) as level, regexp_extract(line, 'msg="([^"]*)"', 1) as message,
       cast(regexp_extract(line, 'latency=(\\S+)', 1) as double) as latency, 1 as other_fields
from raw_lines where regexp_matches(line, '\\w+=("[^"]*"|\\S+)')
""",
)
def parse_logfmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = P.parse_each(V.raw_lines(spark, sf_dir), F.lit("logfmt"))
    return parsed.select(
        "source",
        "line_number",
        "timestamp",
        "level",
        "message",
        S.latency(F.col("fields")).alias("latency"),
        F.size(F.json_object_keys("fields")).alias("other_fields"),
    )


@check(
    "p4_parse_plain",
    """
select doc_id as line_number, regexp_replace(text, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') as message
from documents where regexp_replace(text, '[ \\t\\r\\n]+', '', 'g') <> ''
""",
)
def parse_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_number"), F.col("text").alias("line"))
    return P.parse_each(lines, F.lit("plain")).select("line_number", "message")


@check(
    "p5_parse_line",
    f"""
-- views: logs, raw_lines
{PARSED_SQL}
select source, line_number, format,
       case format when 'json' then line ->> '$.ts' when 'logfmt' then regexp_extract(line, 'time=(\\S+)', 1) end as "timestamp",
       case format when 'json' then lower(line ->> '$.level') when 'logfmt' then regexp_extract(line, 'level=(\\S+)', 1) end as level,
       case format when 'json' then line ->> '$.msg' when 'logfmt' then regexp_extract(line, 'msg="([^"]*)"', 1) else trim(line) end as message
from parsed
""",
)
def parse_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = P.parse_each(V.raw_lines(spark, sf_dir))
    return parsed.select("source", "line_number", "format", "timestamp", "level", "message")


@check(
    "p6_parse_lines",
    f"""
-- views: logs, raw_lines
{PARSED_SQL},
ranked as (select *, row_number() over (partition by source order by line_number) as n from parsed),
formats as (
  select source,
         case when avg(case when format = 'json' then 1.0 else 0 end) > 0.5 then 'json'
              when avg(case when format = 'logfmt' then 1.0 else 0 end) > 0.5 then 'logfmt' else 'plain' end as batch
  from ranked where n <= 10 group by source)
select p.source, line_number, batch as format,
       case batch when 'json' then line ->> '$.msg' when 'logfmt' then regexp_extract(line, 'msg="([^"]*)"', 1) else trim(line) end as message
from parsed p join formats f on p.source = f.source
where batch = 'plain' or (batch = 'json' and format = 'json') or (batch = 'logfmt' and regexp_matches(line, '\\w+=\\S'))
""",
)
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_batches(V.raw_lines(spark, sf_dir)).select("source", "line_number", "format", "message")


@check(
    "p7_parse_timestamp",
    """
-- views: logs
select line_number,
       case when line_number % 5 = 0 then "timestamp" when line_number % 5 = 1 then date_trunc('second', "timestamp") - interval 1 hour
            when line_number % 5 = 2 then date_trunc('day', "timestamp") else timestamp '2024-02-01' end as "timestamp"
from logs
""",
)
def parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("line_number") % 5
    text = (
        F.when(kind == 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == 1, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss'+01:00'"))
        .when(kind == 2, F.date_format("timestamp", "yyyy-MM-dd"))
        .when(kind == 3, F.date_format("timestamp", "HH:mm:ss"))
    )
    rows = V.logs(spark, sf_dir).select("line_number", text.alias("text"))
    stamped = S.with_ingest_default(S.parse_timestamp(F.col("text")), F.lit("2024-02-01").cast("timestamp"))
    return rows.select("line_number", stamped.alias("timestamp"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log fields in seven shapes, by line number."""
    latency = F.get_json_object("fields", "$.latency")
    kind = F.col("line_number") % 7
    fields = (
        F.when(kind == 0, F.col("fields"))
        .when(kind == 1, F.concat(F.lit('"{\\"duration\\": '), latency, F.lit('}"')))
        .when(kind == 2, F.concat(F.lit('{"elapsed": "'), latency, F.lit('ms", "request_time": 1}')))
        .when(kind == 3, F.concat(F.lit('{"response_time": "'), latency, F.lit('"}')))
        .when(kind == 4, F.concat(F.lit('{"elapsed": -'), latency, F.lit("}")))
        .when(kind == 5, F.concat(F.lit('{"request_time": '), latency, F.lit("}")))
        .otherwise(F.lit("[1, 2]"))
    )
    return V.logs(spark, sf_dir).select("line_number", fields.alias("fields"))


@check(
    "p8_decode_fields",
    """
-- views: logs
select line_number, cast(coalesce(case line_number % 7 when 0 then latency when 1 then latency when 3 then latency end, -1) as double) as latency,
       line_number % 7 < 6 as is_object
from logs
""",
)
def decode_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _fields(spark, sf_dir).withColumn("decoded", S.decode_fields(F.col("fields")))
    values = [F.get_json_object("decoded", f"$.{k}").cast("double") for k in ("latency", "duration", "response_time")]
    return fields.select(
        "line_number",
        F.coalesce(*values, F.lit(-1.0)).alias("latency"),
        F.col("decoded").isNotNull().alias("is_object"),
    )


@check(
    "p9_extract_latency",
    """
-- views: logs
select line_number,
       case when line_number % 7 in (0, 1, 3, 5) then latency when line_number % 7 = 4 and -latency >= 0 then -latency end as latency,
       case when line_number % 7 in (0, 1, 3) then latency when line_number % 7 = 4 then -latency end as feature_latency
from logs
""",
)
def extract_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select(
        "line_number",
        S.latency(F.col("fields")).alias("latency"),
        S.feature_latency(F.col("fields")).alias("feature_latency"),
    )


@check(
    "p10_is_error",
    """
-- views: logs
select source, count(*) filter (where level in ('error', 'fatal')) as errors, count(*) as lines from logs group by source
""",
)
def is_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.logs(spark, sf_dir).groupBy("source").agg(
        F.count_if(S.is_error(F.col("level"))).alias("errors"), F.count("*").alias("lines")
    )


@check(
    "p11_severity",
    """
-- views: anomalies
select id, case when score >= 0.9 then 'critical' when score >= 0.7 then 'high' when score >= 0.4 then 'medium' else 'low' end as severity
from alert_anomalies
""",
)
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.alert_anomalies(spark, sf_dir).select("id", S.severity_of(F.col("score")).alias("severity"))


@check(
    "p12_severity_orders",
    """
-- views: anomalies
select id, case severity when 'low' then 0 when 'medium' then 1 when 'high' then 2 else 3 end as routing_order,
       case severity when 'low' then 1 when 'medium' then 2 else 3 end as correlation_order
from log_anomalies
""",
)
def severity_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.log_anomalies(spark, sf_dir).select(
        "id",
        S.routing_order(F.col("severity")).alias("routing_order"),
        S.correlation_order(F.upper("severity")).alias("correlation_order"),
    )


@check(
    "p14_event_time",
    """
-- views: anomalies
select id, case when event_id % 3 = 0 then detected_at when event_id % 3 = 1 then detected_at - interval 1 minute else timestamp '2024-02-01' end as event_time
from log_anomalies
""",
)
def event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("id").cast("bigint") % 3
    first = F.when(kind == 0, F.col("detected_at"))
    second = F.when(kind == 1, F.col("detected_at") - F.expr("interval 1 minute"))
    now = F.lit("2024-02-01").cast("timestamp")
    return V.log_anomalies(spark, sf_dir).select("id", S.event_time(first, second, now).alias("event_time"))


@check(
    "p16_anomaly_id",
    """
-- views: anomalies
select id as event, left(sha256(anomaly_type || '|' || source || '|' || coalesce(template_id, '') || '|' || id), 32) as id
from alert_anomalies
""",
)
def anomaly_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.alert_anomalies(spark, sf_dir)
    name = S.stable_id(F.col("anomaly_type"), F.col("source"), F.col("template_id"), F.col("id"))
    return found.select(F.col("id").alias("event"), name.alias("id"))


@check(
    "p17_parse_access_log",
    """
-- views: logs
select line_number, '10.0.0.' || (user_id % 250) as remote_addr, event_type as path, 200 + (event_id % 4) * 100 as status,
       event_id as bytes, date_trunc('second', ts) as "timestamp",
       case when event_id % 4 = 3 then 'error' when event_id % 4 = 2 then 'warn' else 'info' end as level
from (select *, event_id as line_number from e) as x
""",
)
def parse_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(
        F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" - - ["),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), "event_type", F.lit(' HTTP/1.1" '),
        (200 + (F.col("event_id") % 4) * 100).cast("string"), F.lit(" "), F.col("event_id").cast("string"),
        F.lit(' "-" "agent/1.0"'),
    )
    lines = V.events(spark, sf_dir).select(F.col("event_id").alias("line_number"), line.alias("line"))
    parsed = P.parse_each(lines, F.lit("nginx"))
    fields = F.from_json("fields", "remote_addr string, path string, status int, bytes bigint")
    return parsed.select(
        "line_number", fields.alias("f"), S.parse_timestamp(F.col("timestamp")).alias("timestamp"), "level"
    ).select("line_number", "f.remote_addr", "f.path", "f.status", "f.bytes", "timestamp", "level")


@check(
    "p18_parse_syslog",
    """
-- views: logs
select event_id as line_number, date_trunc('second', ts) as "timestamp", event_type || ' event ' || event_id as message,
       'host-' || (user_id % 5) as hostname, cast(user_id as varchar) as pid, event_id % 8 as severity,
       case when event_id % 8 < 3 then 'fatal' when event_id % 8 = 3 then 'error' when event_id % 8 = 4 then 'warn'
            when event_id % 8 = 7 then 'debug' else 'info' end as level
from e
""",
)
def parse_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(
        F.lit("<"), (16 * 8 + F.col("event_id") % 8).cast("string"), F.lit(">"), F.date_format("ts", "MMM "),
        F.lpad(F.date_format("ts", "d"), 2, " "), F.date_format("ts", " HH:mm:ss "), F.lit("host-"),
        (F.col("user_id") % 5).cast("string"), F.lit(" app["), F.col("user_id").cast("string"), F.lit("]: "),
        "event_type", F.lit(" event "), F.col("event_id").cast("string"),
    )
    lines = V.events(spark, sf_dir).select(F.col("event_id").alias("line_number"), line.alias("line"))
    parsed = P.parse_each(lines, F.lit("syslog3164"), year=2024)
    fields = F.from_json("fields", "hostname string, pid string, severity int")
    return parsed.select(
        "line_number", fields.alias("f"), S.parse_timestamp(F.col("timestamp")).alias("timestamp"), "level", "message"
    ).select("line_number", "f.hostname", "f.pid", "f.severity", "timestamp", "level", "message")


@check(
    "x1_ingest_rows",
    """
-- views: logs, raw_lines, templates
with parsed as (
  select source, line_number, case line_number % 3 when 2 then timestamp '2024-02-01' else "timestamp" end as "timestamp",
         case line_number % 3 when 2 then null else level end as level, message,
         case line_number % 3 when 2 then null else latency end as latency
  from logs),
routed as (select case when source = 'svc-0' then 'mixed' else source || '-' || (line_number % 3) end as source, * exclude (source) from parsed)
select source, line_number, "timestamp", level, message, latency,
       left(sha256(source || '|' || event || ' user <*> event <*>'), 16) as template_id
from (select *, split_part(message, ' ', 1) as event from routed) as r
""",
)
def ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest_logs(V.raw_lines(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"))
    return rows.select(
        "source", "line_number", "timestamp", "level", "message", S.latency(F.col("fields")).alias("latency"), "template_id"
    )


# --- state tables


@check(
    "k5_latest_forecast_models",
    """
-- views: metric_samples
select name as metric_name, labels_hash, max("timestamp") as trained_at, arg_max(value, row("timestamp", value)) as rmse
from metric_samples group by name, labels_hash
""",
)
def latest_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = V.metric_samples(spark, sf_dir).select(
        F.col("name").alias("metric_name"), "labels_hash", F.col("timestamp").alias("trained_at"), F.col("value").alias("rmse")
    )
    return store.latest_by_key(runs, ["metric_name", "labels_hash"], ["trained_at", "rmse"])


@check(
    "k6_lookup_forecast_model",
    """
-- views: metric_samples
select name as metric_name, labels_hash, 'arima' as model_type, max("timestamp") as trained_at
from metric_samples where name in ('disk_0', 'cpu_3') group by name, labels_hash
""",
)
def lookup_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = V.metric_samples(spark, sf_dir).select(
        F.col("name").alias("metric_name"), "labels_hash", F.lit("arima").alias("model_type"), F.col("timestamp").alias("trained_at")
    )
    wanted = [(n, "{\"svc\": \"svc-%s\"}" % n[-1]) for n in ("disk_0", "cpu_3")] + [("disk_0", "{}")]
    keys = config_table(spark, wanted, "metric_name string, labels string")
    keys = keys.select("metric_name", F.left(F.sha2("labels", 256), F.lit(16)).alias("labels_hash"))
    return store.lookup_models(keys, runs)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", F.col("timestamp"))
    return V.logs(spark, sf_dir).groupBy("source", day.alias("trained_at")).agg(F.count("*").alias("lines_trained"))


@check(
    "k8_model_versions",
    """
-- views: logs
select source, date_trunc('day', "timestamp") as trained_at, count(*) as lines_trained,
       row_number() over (partition by source order by date_trunc('day', "timestamp")) as version
from logs group by source, date_trunc('day', "timestamp")
""",
)
def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.model_versions(_runs(spark, sf_dir))


@check(
    "k8_model_metadata",
    """
-- views: logs
with runs as (
  select source, date_trunc('day', "timestamp") as trained_at, count(*) as lines_trained
  from logs group by source, date_trunc('day', "timestamp"))
select source, max(trained_at) as trained_at, arg_max(lines_trained, trained_at) as lines_trained, count(*) as version
from runs group by source
""",
)
def model_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.model_metadata(_runs(spark, sf_dir))


@check(
    "k9_retention",
    """
-- views: logs
select source, count(*) as kept, min(ingested_at) as oldest from logs
where ingested_at >= timestamp '2024-01-31' - interval 14 day group by source
""",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store.retained(V.logs(spark, sf_dir), datetime(2024, 1, 31), 14)
    return kept.groupBy("source").agg(F.count("*").alias("kept"), F.min("ingested_at").alias("oldest"))


@check(
    "k9_retention_count",
    """
-- views: logs
select count(*) as deleted from logs where ingested_at < timestamp '2024-01-31' - interval 14 day
""",
)
def retention_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.expired_count(V.logs(spark, sf_dir), datetime(2024, 1, 31), 14)
