"""Logs, metrics and anomalies derived from the ``events`` table, in Spark and as SQL for the comparison.

The log view adds an incident to one source on one day, so that the detectors have something to find.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import scalars as S
from tidewatch.session import config_table, ship_package

Query = Callable[[SparkSession, str], DataFrame]

BASE_START = datetime(2024, 1, 1)
SPLIT = datetime(2024, 1, 29)
END = datetime(2024, 1, 30)
RETRAIN = datetime(2024, 1, 31)
TRAIN_HOURS = 28 * 24
DAY = 1440

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its SQL."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return plain_types(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def plain_types(df: DataFrame) -> DataFrame:
    """Timestamps without zone and long integers, as the SQL side has them."""
    casts = {T.TimestampType: "timestamp_ntz", T.IntegerType: "bigint", T.ShortType: "bigint"}
    return df.select(
        *[
            F.col(f"`{f.name}`").cast(casts[type(f.dataType)]).alias(f.name)
            if type(f.dataType) in casts
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = (F.col("ts") >= F.lit(SPLIT)) & (F.col("ts") < F.lit(END))
    incident = (F.col("user_id") % 5 == 1) & day
    purchase = F.col("event_type") == "purchase"
    e = events(spark, sf_dir)
    value = F.when(incident, F.col("value") * 3).otherwise(F.col("value"))
    return e.select(
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.when((F.col("event_type") == "error") | (incident & purchase), "error")
        .when(F.col("event_type") == "signup", "warn")
        .otherwise("info")
        .alias("level"),
        F.concat_ws(
            " ", "event_type", F.lit("user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_id").cast("string")
        ).alias("message"),
        F.when(incident & purchase, "tpl-incident")
        .when(incident & F.col("event_type").isin("view", "click", "signup"), "view-1")
        .otherwise(F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string")))
        .alias("template_id"),
        F.concat(F.lit('{"latency": '), value.cast("string"), F.lit("}")).alias("fields"),
        F.col("event_id").alias("line_number"),
        F.col("ts").alias("ingested_at"),
    )


LOGS_SQL = """
e as (
  select *, 'svc-' || cast(user_id % 5 as varchar) as source,
         (user_id % 5 = 1 and ts >= timestamp '2024-01-29' and ts < timestamp '2024-01-30') as inc
  from events),
logs as (
  select ts as "timestamp", source,
         case when event_type = 'error' or (inc and event_type = 'purchase') then 'error'
              when event_type = 'signup' then 'warn' else 'info' end as level,
         event_type || ' user ' || cast(user_id as varchar) || ' event ' || cast(event_id as varchar) as message,
         case when inc and event_type = 'purchase' then 'tpl-incident'
              when inc and event_type in ('view','click','signup') then 'view-1'
              else event_type || '-' || cast(user_id % 10 as varchar) end as template_id,
         case when inc then value * 3 else value end as latency,
         event_id as line_number, ts as ingested_at
  from e),
base as (select * from logs where "timestamp" < timestamp '2024-01-29'),
cur as (select * from logs where "timestamp" >= timestamp '2024-01-29' and "timestamp" < timestamp '2024-01-30')
"""


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines as text: JSON, logfmt and plain. One source mixes them, the others have one format each."""
    kind = F.col("line_number") % 3
    ts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    latency = F.get_json_object("fields", "$.latency")
    as_json = F.concat(
        F.lit('{"ts":"'), ts, F.lit('","level":"'), F.upper("level"), F.lit('","msg":"'), F.col("message"),
        F.lit('","latency":'), latency, F.lit("}"),
    )
    as_logfmt = F.concat(
        F.lit("time="), ts, F.lit(" level="), F.col("level"), F.lit(' msg="'), F.col("message"),
        F.lit('" latency='), latency,
    )
    line = F.when(kind == 0, as_json).when(kind == 1, as_logfmt).otherwise(F.col("message"))
    source = F.when(F.col("source") == "svc-0", "mixed").otherwise(F.concat("source", F.lit("-"), kind.cast("string")))
    return logs(spark, sf_dir).select(source.alias("source"), "line_number", line.alias("line"))


RAW_LINES_SQL = """
raw_lines as (
  select case when source = 'svc-0' then 'mixed' else source || '-' || cast(line_number % 3 as varchar) end as source,
         line_number,
         case line_number % 3
           when 0 then '{"ts":"' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') || '","level":"' || upper(level)
                       || '","msg":"' || message || '","latency":' || cast(latency as varchar) || '}'
           when 1 then 'time=' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') || ' level=' || level
                       || ' msg="' || message || '" latency=' || cast(latency as varchar)
           else message end as line
  from logs)
"""


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = F.col("user_id") % 5
    source = F.concat(F.lit("svc-"), service.cast("string"))
    labels = F.create_map(F.lit("svc"), source)
    name = F.concat(F.when(service % 2 == 0, "disk_").otherwise("cpu_"), service.cast("string"))
    return events(spark, sf_dir).select(
        name.alias("name"),
        S.labels_hash(labels).alias("labels_hash"),
        S.labels_json(labels).alias("labels"),
        "value",
        F.col("ts").alias("timestamp"),
        F.lit("gauge").alias("metric_type"),
        source.alias("source"),
    )


METRICS_SQL = """
metric_samples as (
  select (case when (user_id % 5) % 2 = 0 then 'disk_' else 'cpu_' end) || cast(user_id % 5 as varchar) as name,
         left(sha256('{"svc": "svc-' || cast(user_id % 5 as varchar) || '"}'), 16) as labels_hash,
         '{"svc": "svc-' || cast(user_id % 5 as varchar) || '"}' as labels,
         value, ts as "timestamp", 'gauge' as metric_type, 'svc-' || cast(user_id % 5 as varchar) as source
  from events)
"""


def anomalies(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """Events of one type as anomalies, with severities in turn."""
    order = F.array(*[F.lit(s) for s in ("low", "medium", "high", "critical")])
    e = events(spark, sf_dir).filter(F.col("event_type") == event_type)
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").alias("detected_at"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.get(order, (F.col("event_id") % 4).cast("int")).alias("severity"),
    )


def log_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies(spark, sf_dir, "error")


def metric_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies(spark, sf_dir, "purchase")


def alert_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log anomalies with all columns of the anomaly table."""
    kinds = ("error_rate_spike", "novel_pattern", "latency_shift", "frequency_deviation")
    kind = F.array(*[F.lit(k) for k in kinds])
    number = F.col("id").cast("bigint")
    return log_anomalies(spark, sf_dir).select(
        "id",
        F.get(kind, (number % 8 / 4).cast("int") + (number % 2).cast("int") * 2).alias("anomaly_type"),
        "severity",
        F.round(number % 100 / 100.0, 2).alias("score"),
        "source",
        "detected_at",
        F.concat(F.lit("anomaly "), F.col("id")).alias("description"),
        F.lit("{}").alias("context"),
        F.array(F.concat(F.lit("line "), F.col("id"))).alias("sample_lines"),
        F.when(number % 2 == 1, F.concat(F.lit("tpl-"), (number % 3).cast("string"))).alias("template_id"),
        F.lit(False).alias("alerted"),
    )


ANOMALIES_SQL = """
typed as (
  select cast(event_id as varchar) as id, event_id, ts as detected_at, 'svc-' || cast(user_id % 5 as varchar) as source,
         case event_id % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'critical' end as severity,
         event_type
  from events),
log_anomalies as (select * from typed where event_type = 'error'),
metric_anomalies as (select * from typed where event_type = 'purchase'),
alert_anomalies as (
  select id, event_id, severity, source, detected_at,
         case when event_id % 2 = 0 then (case when event_id % 8 < 4 then 'error_rate_spike' else 'novel_pattern' end)
              else (case when event_id % 8 < 4 then 'latency_shift' else 'frequency_deviation' end) end as anomaly_type,
         round(event_id % 100 / 100.0, 2) as score,
         case when event_id % 2 = 1 then 'tpl-' || cast(event_id % 3 as varchar) end as template_id
  from log_anomalies),
channels(channel_type, min_severity) as (
  values ('telegram', 'medium'), ('email', 'high'), ('slack', 'critical'), ('alertmanager', 'high')),
sources(name, sensitivity) as (
  values ('svc-0', 0.5), ('svc-1', 0.5), ('svc-2', 0.5), ('svc-3', 0.5), ('svc-4', 0.5), ('svc-9', 0.5))
"""


def channels(spark: SparkSession) -> DataFrame:
    rows = [("telegram", "medium"), ("email", "high"), ("slack", "critical"), ("alertmanager", "high")]
    return config_table(spark, rows, "channel_type string, min_severity string")


def sources(spark: SparkSession) -> DataFrame:
    """Five sources with logs and one without. One has a detector switched off."""
    every = ["error_rate_spike", "novel_pattern", "latency_shift", "frequency_deviation"]
    rows = [(f"svc-{i}", 0.5, [k for k in every if i != 3 or k != "frequency_deviation"]) for i in (0, 1, 2, 3, 4, 9)]
    return config_table(spark, rows, "name string, sensitivity double, anomaly_types array<string>")


THRESHOLDS = [
    ("disk_0", "above", 40.0),
    ("disk_2", "above", 1.0),
    ("disk_4", "below", 20.0),
    ("cpu_1", "above", 5.0),
    ("cpu_3", "below", 10.0),
]


def thresholds(spark: SparkSession) -> DataFrame:
    return config_table(spark, THRESHOLDS, "metric_name string, direction string, threshold double")


THRESHOLDS_SQL = "thresholds(metric_name, direction, threshold) as (values {})".format(
    ", ".join(f"('{n}', '{d}', cast({v} as double))" for n, d, v in THRESHOLDS)
)

# Masked shapes of log messages, with whole documents as a second kind of log.
SHAPE_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({m}, "
    "'[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}', '<*>', 'g'), "
    "'[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}(:[0-9]+)?', '<*>', 'g'), "
    "'0x[0-9a-fA-F]+', '<*>', 'g'), '[0-9]+(\\.[0-9]+)?', '<*>', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"
)
TEMPLATES_SQL = f"""
shaped as (
  select source, "timestamp", line_number, message, {SHAPE_SQL.format(m="message")} as template
  from (select source, "timestamp", line_number, message from logs
        union all
        select 'doc-' || source, timestamp '2024-01-01', doc_id, text from documents) as m
  where message <> ''),
templated as (select *, left(sha256(source || '|' || template), 16) as template_id from shaped),
inventory as (
  select source, template_id, template, count(*) as "count", min("timestamp") as first_seen,
         max("timestamp") as last_seen,
         arg_min(line_number, row("timestamp", line_number)) as first_line,
         arg_min(message, row("timestamp", line_number)) as sample_line
  from templated group by source, template_id, template),
numbered as (
  select *, row_number() over (partition by source order by first_seen, first_line, template_id) as seq_id
  from inventory)
"""


def message_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["source", "timestamp", "line_number", "message"]
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("source")).alias("source"),
        F.lit(BASE_START).cast("timestamp").alias("timestamp"),
        F.col("doc_id").alias("line_number"),
        F.col("text").alias("message"),
    )
    return logs(spark, sf_dir).select(*columns).unionByName(documents)


VIEWS = {
    "logs": LOGS_SQL,
    "raw_lines": RAW_LINES_SQL,
    "metric_samples": METRICS_SQL,
    "anomalies": ANOMALIES_SQL,
    "thresholds": THRESHOLDS_SQL,
    "templates": TEMPLATES_SQL,
}


def with_views(sql: str) -> str:
    """Expand a first line ``-- views: a, b`` into common table expressions."""
    head, _, body = sql.strip().partition("\n")
    if not head.startswith("-- views:"):
        return sql.strip()
    names = [n.strip() for n in head.removeprefix("-- views:").split(",")]
    recursive = "recursive " if "-- recursive" in body else ""
    body = body.replace("-- recursive\n", "")
    ctes = ",".join(VIEWS[n].strip() + "\n" for n in names)
    body = body.strip()
    if body.startswith("with "):
        return f"with {recursive}{ctes}, {body.removeprefix('with ')}"
    return f"with {recursive}{ctes}{body}"
