"""Aggregates, templates and baseline training."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as V
from checks.views import check, rounded
from tidewatch.operators import aggregates as A
from tidewatch.operators import isolation as I
from tidewatch.operators import templates as T
from tidewatch.plans.baseline import Baseline, train_baseline


def base_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.slice_logs(V.logs(spark, sf_dir), V.BASE_START, V.SPLIT)


def current_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.slice_logs(V.logs(spark, sf_dir), V.SPLIT, V.END)


def baseline(spark: SparkSession, sf_dir: str) -> Baseline:
    return train_baseline(V.logs(spark, sf_dir), V.SPLIT, hours=V.TRAIN_HOURS, bucket_minutes=V.DAY)


def _error_rate_sql(minutes: int) -> str:
    return f"""
-- views: logs
select source, time_bucket(interval '{minutes} minutes', "timestamp") as bucket, count(*) as total,
       count(*) filter (where level in ('error', 'fatal')) as errors,
       round(count(*) filter (where level in ('error', 'fatal')) / count(*), 6) as error_rate
from logs where "timestamp" >= timestamp '2024-01-03 05:00:00' group by all
"""


def _error_rate(minutes: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        since = A.slice_logs(V.logs(spark, sf_dir), datetime(2024, 1, 3, 5))
        return rounded(A.error_rate(since, minutes), "error_rate")

    return query


for _minutes in (5, 7, 60):
    check(f"a01_error_rate_{_minutes}min", _error_rate_sql(_minutes))(_error_rate(_minutes))


@check(
    "a02_bucket_error_rates",
    """
-- views: logs
select source, cast(floor(epoch("timestamp")) as bigint) // 300 as bucket,
       round(avg(case when level in ('error', 'fatal') then 1.0 else 0 end), 6) as error_rate
from logs group by all
""",
)
def bucket_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.bucket_error_rates(V.logs(spark, sf_dir)), "error_rate")


STATS_SQL = """
with rates as (
  select source, cast(floor(epoch("timestamp")) as bigint) // 86400 as bucket, count(*) as n,
         avg(case when level in ('error', 'fatal') then 1.0 else 0 end) as r
  from base group by all),
stats as (
  select source, avg(r) as error_rate_mean, stddev_pop(r) as error_rate_std, cast(sum(n) as bigint) as lines_trained
  from rates group by source)
"""


@check(
    "a03_rate_stats",
    f"""
-- views: logs
{STATS_SQL}
select source, round(error_rate_mean, 6) as error_rate_mean, round(error_rate_std, 6) as error_rate_std, lines_trained
from stats
""",
)
def rate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.rate_stats(base_logs(spark, sf_dir), V.DAY), "error_rate_mean", "error_rate_std")


@check(
    "a04_template_inventory",
    """
-- views: logs
select distinct source, template_id from base where template_id <> ''
""",
)
def template_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.template_inventory(base_logs(spark, sf_dir))


@check(
    "a05_template_counts",
    """
-- views: logs
select source, template_id, count(*) as "count" from cur group by source, template_id
""",
)
def template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.template_counts(current_logs(spark, sf_dir))


@check(
    "a06_template_frequencies",
    """
-- views: logs
with counts as (
  select source, case when level <> 'warn' then template_id end as template_id, count(*) as n from base group by all),
shares as (select *, n / sum(n) over (partition by source) as f from counts)
select source, template_id, n as "count", round(f, 6) as frequency from shares where template_id is not null
""",
)
def template_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings lose their template here, to see that they still count as lines."""
    template = F.when(F.col("level") != "warn", F.col("template_id")).otherwise("")
    lines = base_logs(spark, sf_dir).withColumn("template_id", template)
    return rounded(A.template_frequencies(lines), "frequency")


@check(
    "a07_bucket_features",
    """
-- views: logs
select source, cast(floor(epoch("timestamp")) as bigint) // 3600 as bucket,
       round(avg(case when level in ('error', 'fatal') then 1.0 else 0 end), 6) as error_rate,
       cast(count(*) as double) as line_count, cast(count(distinct template_id) as double) as templates,
       round(avg(latency), 9) as mean_latency
from base group by all
""",
)
def bucket_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = rounded(A.bucket_features(base_logs(spark, sf_dir), 60), "error_rate")
    return rounded(features, "mean_latency", digits=9)


@check(
    "a08_latency_sample",
    """
-- views: logs
select source, latency as value, count(*) as n from base group by source, latency
""",
)
def latency_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latency_sample(base_logs(spark, sf_dir))


@check(
    "a09_training_gate",
    """
-- views: logs
select source, count(*) as lines from base group by source having count(*) >= 1900
""",
)
def training_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trainable_sources(base_logs(spark, sf_dir), 1900)


@check(
    "a10_training_slice",
    """
-- views: logs
select source, line_number, "timestamp" from logs
where "timestamp" >= timestamp '2024-01-22' and "timestamp" < timestamp '2024-01-29'
""",
)
def training_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = A.slice_logs(V.logs(spark, sf_dir), datetime(2024, 1, 22), V.SPLIT)
    return window.select("source", "line_number", "timestamp")


@check(
    "a10_training_slice_oldest",
    """
-- views: logs
select source, line_number, row_number() over (partition by source order by "timestamp", line_number) as rank from base
""",
)
def training_slice_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training lines of each source ranked from the oldest on."""
    return A.ranked_by_age(base_logs(spark, sf_dir)).select("source", "line_number", "rank")


@check(
    "a11_baseline_stats",
    f"""
-- views: logs
{STATS_SQL}
select source, round(error_rate_mean, 6) as error_rate_mean, round(error_rate_std, 6) as error_rate_std, lines_trained,
       timestamp '2024-01-29' as trained_at
from stats where lines_trained >= 1000
""",
)
def baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline(spark, sf_dir).stats, "error_rate_mean", "error_rate_std")


@check(
    "a11_baseline_templates",
    """
-- views: logs
with counts as (select source, template_id, count(*) as n from base group by all)
select source, template_id, n as "count", round(n / sum(n) over (partition by source), 6) as frequency from counts
qualify sum(n) over (partition by source) >= 1000
""",
)
def baseline_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline(spark, sf_dir).templates, "frequency")


@check(
    "a11_baseline_latencies",
    """
-- views: logs
select source, latency as value, count(*) as n from base
where source in (select source from base group by source having count(*) >= 1000) group by source, latency
""",
)
def baseline_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline(spark, sf_dir).latencies


@check(
    "a12_metric_names",
    """
-- views: metric_samples
select distinct name from metric_samples
""",
)
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.metric_names(V.metric_samples(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bucket_features(base_logs(spark, sf_dir), 60)


@check("a13_isolation_forest")
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fit_forest(_features(spark, sf_dir))


@check("a14_isolation_scores")
def isolation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _features(spark, sf_dir)
    return I.isolation_outliers(I.isolation_scores(features, I.fit_forest(features)))


@check(
    "a15_current_error_rate",
    """
-- views: logs
select source, count(*) as total, round(avg(case when level in ('error', 'fatal') then 1.0 else 0 end), 6) as error_rate
from cur group by source
""",
)
def current_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.current_error_rate(current_logs(spark, sf_dir)), "error_rate")


@check(
    "a16_error_samples",
    """
-- views: logs
with ranked as (
  select source, message, row_number() over (partition by source order by "timestamp", line_number) as n
  from cur where level in ('error', 'fatal'))
select source, string_agg(message, ' / ' order by n) as sample_lines from ranked where n <= 5 group by source
""",
)
def error_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = A.error_samples(current_logs(spark, sf_dir))
    return samples.withColumn("sample_lines", F.array_join("sample_lines", " / "))


@check(
    "a17_service_summary",
    f"""
-- views: logs, anomalies
{STATS_SQL}
select s.name as source, t.source is not null as trained, coalesce(t.lines_trained, 0) as lines_trained
from sources s left join (select * from stats where lines_trained >= 1000) t on t.source = s.name
""",
)
def service_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.service_summary(V.sources(spark), baseline(spark, sf_dir).stats).fillna(0, ["lines_trained"])


@check(
    "a17_service_health",
    f"""
-- views: logs, anomalies
{STATS_SQL}
select count(*) as sources, count(t.source) as baselines_loaded
from sources s left join (select * from stats where lines_trained >= 1000) t on t.source = s.name
""",
)
def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.service_health(V.sources(spark), baseline(spark, sf_dir).stats)


# --- templates


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.inventory(T.assign_shapes(V.message_logs(spark, sf_dir)))


@check(
    "t1b_masked_templates",
    """
-- views: logs, templates
select source, line_number, template_id from templated
""",
)
def masked_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.assign_shapes(V.message_logs(spark, sf_dir)).select("source", "line_number", "template_id")


@check(
    "t2_templates_by_count",
    """
-- views: logs, templates
select source, template_id, template, "count" from inventory
""",
)
def templates_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.templates_by_count(_inventory(spark, sf_dir))


@check(
    "t3_get_template",
    """
-- views: logs, templates
select source, template_id, template, "count" from inventory where template in ('view user <*> event <*>', 'error user <*> event <*>')
""",
)
def get_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _inventory(spark, sf_dir)
    texts = V.logs(spark, sf_dir).select("source").distinct()
    texts = texts.withColumn("template", F.explode(F.array(F.lit("view user <*> event <*>"), F.lit("error user <*> event <*>"))))
    wanted = texts.select("source", T.template_id(F.col("source"), F.col("template")).alias("template_id"))
    return T.get_template(found, wanted)


@check(
    "t4_template_count",
    """
-- views: logs, templates
select source, count(distinct template_id) as templates from inventory group by source
""",
)
def template_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.template_count(_inventory(spark, sf_dir))


@check(
    "t5_sequence_ids",
    """
-- views: logs, templates
select source, template_id, seq_id from numbered
""",
)
def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sequence_ids(_inventory(spark, sf_dir)).select("source", "template_id", "seq_id")


@check(
    "t5_max_ids",
    """
-- views: logs, templates
select source, max(seq_id) as max_id from numbered group by source
""",
)
def max_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.max_ids(_inventory(spark, sf_dir))


@check(
    "t6_novel_templates",
    """
-- views: logs, templates
with b as (select source, count(*) as max_id from inventory where first_seen < timestamp '2024-01-01 00:10:00' group by source)
select n.source, n.template_id, n.seq_id from numbered n left join b on b.source = n.source where n.seq_id > coalesce(b.max_id, 0)
""",
)
def novel_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.assign_shapes(V.message_logs(spark, sf_dir))
    early = T.inventory(A.slice_logs(lines, until=datetime(2024, 1, 1, 0, 10)))
    found = T.inventory(lines).select("source", "template_id", "first_seen", "first_line")
    novel = T.novel_templates(found, T.max_ids(early))
    return novel.select("source", "template_id", "seq_id")


@check(
    "t7_template_inventory",
    """
-- views: logs, templates
select source, template_id, template, "count", first_seen, last_seen, first_line, sample_line from inventory
""",
)
def inventory_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir)


@check("t1_drain_templates")
def drain_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drain over the log messages and whole documents."""
    return T.drain_inventory(T.drain_templates(T.assign_shapes(V.message_logs(spark, sf_dir))))


@check(
    "t1_drain_assigned_lines",
    """
-- views: logs, templates
select source, count(*) as lines from templated group by source
""",
)
def drain_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a message gets a template."""
    lines = T.assign_shapes(V.message_logs(spark, sf_dir)).withColumn("message", F.lit(None).cast("string"))
    assigned = T.drain_lines(lines).filter(F.col("template_id").isNotNull())
    return assigned.groupBy("source").agg(F.count("*").alias("lines"))
