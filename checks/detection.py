"""Detectors, correlation and alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as V
from checks.training import STATS_SQL, base_logs, baseline, current_logs
from checks.views import check, rounded
from tidewatch.operators import aggregates as A
from tidewatch.operators import alerts as C
from tidewatch.operators import correlate as J
from tidewatch.operators import detectors as D
from tidewatch.plans.detection import run_detection
from tidewatch.streaming.correlation import stream_correlations
from tidewatch.streaming.detection import windowed_observations

SPIKE_SQL = f"""
{STATS_SQL},
rate as (select source, avg(case when level in ('error', 'fatal') then 1.0 else 0 end) as observed_rate from cur group by source),
z as (
  select r.source, observed_rate, error_rate_mean,
         case when error_rate_std < 1e-10 then case when observed_rate > error_rate_mean + 0.01 then 10.0 end
              else (observed_rate - error_rate_mean) / error_rate_std end as z_score
  from rate r join (select * from stats where lines_trained >= 1000) s on s.source = r.source),
spikes as (
  select *, least(1.0, z_score / 10.0 + 0.2) as score from z where z_score > 5.0 - 0.5 * 3.0)
"""
GRADE = "case when score >= 0.9 then 'critical' when score >= 0.7 then 'high' when score >= 0.4 then 'medium' else 'low' end"

FREQ_SQL = """
known_counts as (select source, template_id, count(*) as n from base group by all),
known as (
  select source, template_id, n / sum(n) over (partition by source) as baseline_frequency from known_counts
  qualify sum(n) over (partition by source) >= 1000),
now_counts as (select source, template_id, count(*) as n from cur group by all),
now_shares as (
  select source, template_id, n, n / sum(n) over (partition by source) as current_frequency from now_counts),
novel as (
  select source, template_id, n as "count", case when n >= 10 then 0.7 else 0.5 end as score,
         case when n >= 10 then 'high' else 'medium' end as severity
  from now_shares s
  where n >= 3 and not exists (select 1 from known k where k.source = s.source and k.template_id = s.template_id)
    and source in (select source from known)),
moved as (
  select s.source, s.template_id, baseline_frequency, current_frequency, current_frequency / baseline_frequency as deviation_factor
  from now_shares s join known k on k.source = s.source and k.template_id = s.template_id
  where baseline_frequency >= 1e-6),
deviations as (
  select *, case when deviation_factor > 3.0 then 'increase' else 'decrease' end as direction,
         case when deviation_factor > 3.0 then least(1.0, (deviation_factor - 3.0) / 7.0)
              else least(1.0, (1.0 / deviation_factor - 3.0) / 7.0) end as score
  from moved where deviation_factor < 0.33 or deviation_factor > 3.0)
"""

KS_SQL = """
lat as (
  select source, latency as v, 1 as b, 0 as c from base where source in (select source from base group by source having count(*) >= 1000)
  union all select source, latency, 0, 1 from cur),
mass as (select source, v, sum(b) as b, sum(c) as c from lat group by source, v),
cdf as (
  select source, v, sum(b) over w / sum(b) over (partition by source) as fb, sum(c) over w / sum(c) over (partition by source) as fc
  from mass window w as (partition by source order by v)),
ks as (select source, max(abs(fb - fc)) as d from cdf group by source),
moments as (
  select source, cast(sum(b) as double) as n1, cast(sum(c) as double) as n2,
         avg(v) filter (where b = 1) as mb, avg(v) filter (where c = 1) as mc,
         quantile_cont(v, 0.99) filter (where b = 1) as baseline_p99_ms, quantile_cont(v, 0.99) filter (where c = 1) as current_p99_ms
  from lat group by source),
lam as (
  select m.*, d, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d as lam,
         (mc - mb) / mb * 100 as shift_percent
  from moments m join ks on ks.source = m.source where n1 >= 10 and n2 >= 10 and mc > mb),
tested as (
  select *, case when lam < 0.2 then 1.0 else least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101),
         lambda k: (case when k % 2 = 1 then 2.0 else -2.0 end) * exp(-2.0 * k * k * lam * lam))))) end as p
  from lam),
shifts as (
  select *, case when p < 0.001 and shift_percent > 50 then 0.85 when shift_percent > 20 then 0.6 else 0.4 end as score,
         case when p < 0.001 and shift_percent > 50 then 'high' when shift_percent > 20 then 'medium' else 'low' end as severity
  from tested where p < 0.01)
"""


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.observations(current_logs(spark, sf_dir))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.window_profile(current(spark, sf_dir))


@check(
    "d1_error_rate_spike",
    f"""
-- views: logs
{SPIKE_SQL}
select source, round(observed_rate, 6) as observed_rate, round(error_rate_mean, 6) as baseline_rate,
       round(z_score, 6) as z_score, round(score, 6) as score, {GRADE} as severity
from spikes
""",
)
def error_rate_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.error_rate_spikes(D.observed_rates(profile(spark, sf_dir)), baseline(spark, sf_dir).stats)
    return rounded(found, "observed_rate", "baseline_rate", "z_score", "score")


@check(
    "d1_error_rate_spike_by_hour",
    f"""
-- views: logs
{STATS_SQL},
rate as (
  select source, date_trunc('hour', "timestamp") as window_start,
         avg(case when level in ('error', 'fatal') then 1.0 else 0 end) as observed_rate
  from cur group by all),
z as (select r.*, error_rate_mean, (observed_rate - error_rate_mean) / error_rate_std as z_score
      from rate r join stats s on s.source = r.source where lines_trained >= 1000)
select source, window_start, round(observed_rate, 6) as observed_rate, round(error_rate_mean, 6) as baseline_rate,
       round(z_score, 6) as z_score, round(score, 6) as score, {GRADE} as severity
from (select *, least(1.0, z_score / 10.0 + 0.2) as score from z where z_score > 3.5) as s
""",
)
def error_rate_spike_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many windows at once."""
    by = ["source", "window_start"]
    lines = current_logs(spark, sf_dir).withColumn("window_start", F.date_trunc("hour", F.col("timestamp")))
    rates = D.observed_rates(D.window_profile(D.observations(lines, "window_start"), by), by)
    found = D.error_rate_spikes(rates, baseline(spark, sf_dir).stats, by=by)
    return rounded(found, "observed_rate", "baseline_rate", "z_score", "score")


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.template_shares(profile(spark, sf_dir))


@check(
    "d2_novel_patterns",
    f"""
-- views: logs
with {FREQ_SQL}
select source, template_id, cast("count" as bigint) as "count", cast(score as double) as score, severity from novel
""",
)
def novel_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.novel_patterns(_shares(spark, sf_dir), baseline(spark, sf_dir).templates)


@check(
    "j4_inventory_anti_join",
    """
-- views: logs
select distinct source, template_id from cur c
where not exists (select 1 from base b where b.source = c.source and b.template_id = c.template_id)
""",
)
def inventory_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = A.template_inventory(base_logs(spark, sf_dir))
    return D.novel_patterns(_shares(spark, sf_dir), known, min_occurrences=1).select("source", "template_id")


@check(
    "d3_latency_shift",
    f"""
-- views: logs
with {KS_SQL}
select source, round(baseline_p99_ms, 6) as baseline_p99_ms, round(current_p99_ms, 6) as current_p99_ms, round(d, 6) as ks_statistic,
       round(p, 6) as ks_pvalue, round(shift_percent, 6) as shift_percent, cast(score as double) as score, severity
from shifts
""",
)
def latency_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.latency_shifts(current(spark, sf_dir), baseline(spark, sf_dir).latencies)
    return rounded(found, "baseline_p99_ms", "current_p99_ms", "ks_statistic", "ks_pvalue", "shift_percent")


@check(
    "d3_ks_statistics",
    """
-- views: logs
with halves as (
  select source, latency as v, case when line_number % 2 = 0 then 1 else 0 end as b, line_number % 2 as c from logs),
mass as (select source, v, sum(b) as b, sum(c) as c from halves group by source, v),
cdf as (
  select source, v, sum(b) over w / sum(b) over (partition by source) as fb, sum(c) over w / sum(c) over (partition by source) as fc
  from mass window w as (partition by source order by v))
select source, round(max(abs(fb - fc)), 6) as ks_statistic from cdf group by source
""",
)
def ks_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistic for every source, odd lines against even lines."""
    lines = V.logs(spark, sf_dir)
    even = A.latency_sample(lines.filter(F.col("line_number") % 2 == 0))
    odd = A.latency_sample(lines.filter(F.col("line_number") % 2 == 1))
    return rounded(D.ks_distances(odd, even), "ks_statistic").select("source", "ks_statistic")


@check(
    "d4_frequency_deviation",
    f"""
-- views: logs
with {FREQ_SQL}
select source, template_id, round(baseline_frequency, 6) as baseline_frequency, round(current_frequency, 6) as current_frequency,
       round(deviation_factor, 6) as deviation_factor, direction, round(score, 6) as score, {GRADE} as severity
from deviations
""",
)
def frequency_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.frequency_deviations(_shares(spark, sf_dir), baseline(spark, sf_dir).templates)
    return rounded(found, "baseline_frequency", "current_frequency", "deviation_factor", "score")


@check(
    "d4_frequency_deviation_vanished",
    f"""
-- views: logs
with {FREQ_SQL},
pairs as (
  select k.source, k.template_id, baseline_frequency, coalesce(current_frequency, 0.0) as current_frequency,
         coalesce(current_frequency, 0.0) / baseline_frequency as f
  from known k left join now_shares s on k.source = s.source and k.template_id = s.template_id
  where baseline_frequency >= 1e-6 and k.source in (select source from now_shares))
select source, template_id, round(f, 6) as deviation_factor, case when f > 3.0 then 'increase' else 'decrease' end as direction
from pairs where f < 0.33 or f > 3.0
""",
)
def frequency_deviation_vanished(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.frequency_deviations(_shares(spark, sf_dir), baseline(spark, sf_dir).templates, include_vanished=True)
    return rounded(found, "deviation_factor").select("source", "template_id", "deviation_factor", "direction")


@check(
    "d5_run_detection",
    f"""
-- views: logs
{SPIKE_SQL}, {FREQ_SQL}, {KS_SQL},
found as (
  select source, 'error_rate_spike' as anomaly_type, null as template_id, {GRADE} as severity, score from spikes
  union all select source, 'novel_pattern', template_id, severity, score from novel
  union all select source, 'latency_shift', null, severity, score from shifts
  union all select source, 'frequency_deviation', template_id, {GRADE}, score from deviations),
samples as (
  select source, string_agg(message, ' / ' order by n) as sample_lines
  from (select source, message, row_number() over (partition by source order by "timestamp", line_number) as n
        from cur where level in ('error', 'fatal')) as x
  where n <= 5 group by source)
select left(sha256(anomaly_type || '|' || f.source || '|' || coalesce(template_id, '') || '|2024-01-30 00:00:00'), 32) as id,
       f.source, anomaly_type, template_id, severity, round(cast(score as double), 6) as score, timestamp '2024-01-30' as detected_at,
       case when anomaly_type = 'error_rate_spike' then coalesce(sample_lines, '') else '' end as sample_lines, false as alerted
from found f left join samples s on s.source = f.source
where not (f.source = 'svc-3' and anomaly_type = 'frequency_deviation')
""",
)
def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(V.END).cast("timestamp")
    found = run_detection(current_logs(spark, sf_dir), baseline(spark, sf_dir), now, V.sources(spark), V.DAY)
    found = found.withColumn("sample_lines", F.array_join("sample_lines", " / ")).drop("description", "context")
    return rounded(found, "score")


@check(
    "p15_descriptions",
    f"""
-- views: logs
{SPIKE_SQL}, {FREQ_SQL}, {KS_SQL}
select source, 'error_rate_spike' as anomaly_type, null as template_id,
       printf('Error rate spike detected (z-score=%.1f, rate=%.3f, baseline=%.3f)', z_score, observed_rate, error_rate_mean) as description
from spikes
union all select source, 'novel_pattern', template_id,
       printf('Novel log pattern detected (template_id=%s, seen %d times, not in baseline)', template_id, "count") from novel
union all select source, 'latency_shift', null,
       printf('Latency shift detected (p99: %.1fms -> %.1fms, shift=%.0f%%, KS p=%.4f)', baseline_p99_ms, current_p99_ms, shift_percent, p)
from shifts
union all select source, 'frequency_deviation', template_id,
       printf('Template frequency %s (%.1fx baseline, template_id=%s)', direction, deviation_factor, template_id)
from deviations where source <> 'svc-3'
""",
)
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(V.END).cast("timestamp")
    found = run_detection(current_logs(spark, sf_dir), baseline(spark, sf_dir), now, V.sources(spark), V.DAY)
    return found.select("source", "anomaly_type", "template_id", "description")


@check(
    "d5_anomaly_context",
    f"""
-- views: logs
{SPIKE_SQL}, {FREQ_SQL}, {KS_SQL}
select source, 'error_rate_spike' as anomaly_type, '' as template_id, round(z_score, 6) as measure, round(observed_rate, 6) as observed from spikes
union all select source, 'novel_pattern', template_id, cast("count" as double), -1.0 from novel
union all select source, 'latency_shift', '', round(shift_percent, 6), round(current_p99_ms, 6) from shifts
union all select source, 'frequency_deviation', template_id, round(deviation_factor, 6), round(current_frequency, 6)
from deviations where source <> 'svc-3'
""",
)
def anomaly_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(V.END).cast("timestamp")
    found = run_detection(current_logs(spark, sf_dir), baseline(spark, sf_dir), now, V.sources(spark), V.DAY)

    def first(*names: str):
        return F.coalesce(*[F.get_json_object("context", f"$.{n}").cast("double") for n in names], F.lit(-1.0))

    found = found.select(
        "source",
        "anomaly_type",
        F.coalesce(F.get_json_object("context", "$.template_id"), F.lit("")).alias("template_id"),
        first("z_score", "count", "shift_percent", "deviation_factor").alias("measure"),
        first("observed_rate", "current_p99_ms", "template_frequency_current").alias("observed"),
    )
    return rounded(found, "measure", "observed")


# --- correlation

CONFIDENCE_SQL = """
0.4 * greatest(0.0, 1.0 - abs(dt) / 300.0) + 0.3 * (case when l_source = m_source then 1.0 else 0.0 end) + 0.3 * (l_order * m_order / 9.0)
"""
PAIRS_SQL = """
pairs as (
  select l.id as log_event_id, m.id as metric_event_id, l.source as l_source, m.source as m_source,
         case l.severity when 'low' then 1 when 'medium' then 2 else 3 end as l_order,
         case m.severity when 'low' then 1 when 'medium' then 2 else 3 end as m_order,
         (epoch_us(m.detected_at) - epoch_us(l.detected_at)) / 1000000.0 as dt
  from log_anomalies l join metric_anomalies m
    on m.detected_at between l.detected_at - interval 300 second and l.detected_at + interval 300 second)
"""


@check(
    "j1_interval_correlation",
    f"""
-- views: anomalies
with {PAIRS_SQL}
select left(sha256(log_event_id || '|' || metric_event_id), 32) as id, log_event_id, metric_event_id,
       round(dt, 6) as time_delta_sec, round({CONFIDENCE_SQL}, 9) as confidence, timestamp '2024-02-01' as detected_at
from pairs where {CONFIDENCE_SQL} >= 0.5
""",
)
def interval_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-02-01").cast("timestamp")
    found = J.find_correlations(V.log_anomalies(spark, sf_dir), V.metric_anomalies(spark, sf_dir), now)
    return rounded(found, "confidence", digits=9)  # time deltas are whole microseconds


@check(
    "j1_interval_correlation_split_buckets",
    f"""
-- views: anomalies
with {PAIRS_SQL}
select log_event_id, metric_event_id, round({CONFIDENCE_SQL}, 9) as confidence from pairs
""",
)
def interval_correlation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs, all confidences, with buckets cut as if they were crowded."""
    now = F.lit("2024-02-01").cast("timestamp")
    found = J.find_correlations(
        V.log_anomalies(spark, sf_dir), V.metric_anomalies(spark, sf_dir), now, min_confidence=0.0, rows_per_split=2
    )
    return rounded(found, "confidence", digits=9).select("log_event_id", "metric_event_id", "confidence")


@check(
    "p13_confidence",
    f"""
-- views: anomalies
with {PAIRS_SQL}
select log_event_id, count(*) as partners, round(max({CONFIDENCE_SQL}), 9) as best, round(min({CONFIDENCE_SQL}), 9) as worst
from pairs group by log_event_id
""",
)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-02-01").cast("timestamp")
    found = J.find_correlations(V.log_anomalies(spark, sf_dir), V.metric_anomalies(spark, sf_dir), now, min_confidence=0.0)
    best = found.groupBy("log_event_id").agg(
        F.count("*").alias("partners"), F.max("confidence").alias("best"), F.min("confidence").alias("worst")
    )
    return rounded(best, "best", "worst", digits=9)


def _cycle_sql(self_pairs: bool) -> str:
    return f"""
-- views: anomalies
with recent as (select * from log_anomalies where detected_at >= timestamp '2024-01-31' - interval 36 hour),
pairs as (
  select l.id as log_event_id, m.id as metric_event_id, l.source as l_source, m.source as m_source,
         case l.severity when 'low' then 1 when 'medium' then 2 else 3 end as l_order,
         case m.severity when 'low' then 1 when 'medium' then 2 else 3 end as m_order,
         (epoch_us(m.detected_at) - epoch_us(l.detected_at)) / 1000000.0 as dt
  from recent l, recent m)
select log_event_id, metric_event_id, round(dt, 6) as time_delta_sec, round({CONFIDENCE_SQL.replace('300.0', '64800.0')}, 6) as confidence
from pairs where abs(dt) <= 64800 and {CONFIDENCE_SQL.replace('300.0', '64800.0')} >= 0.5
{'' if self_pairs else 'and log_event_id <> metric_event_id'}
"""


def _cycle(self_pairs: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = J.correlation_cycle(
            V.log_anomalies(spark, sf_dir), datetime(2024, 1, 31), window_seconds=18 * 3600, allow_self=self_pairs
        )
        found = rounded(found, "confidence")  # time deltas are whole microseconds
        return found.select("log_event_id", "metric_event_id", "time_delta_sec", "confidence")

    return query


check("j2_correlation_cycle", _cycle_sql(False))(_cycle(False))
check("j2_correlation_cycle_self", _cycle_sql(True))(_cycle(True))


@check(
    "j3_baseline_lookup",
    f"""
-- views: logs
{STATS_SQL}
select source, line_number, round(error_rate_mean, 6) as error_rate_mean from cur join stats using (source)
""",
)
def baseline_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.rate_stats(base_logs(spark, sf_dir), V.DAY).select("source", "error_rate_mean")
    joined = current_logs(spark, sf_dir).join(stats, "source").select("source", "line_number", "error_rate_mean")
    return rounded(joined, "error_rate_mean")


@check(
    "j5_frequency_inner_join",
    f"""
-- views: logs
with {FREQ_SQL}
select source, template_id, round(deviation_factor, 6) as ratio from moved
""",
)
def frequency_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = baseline(spark, sf_dir).templates.select("source", "template_id", F.col("frequency").alias("known"))
    joined = _shares(spark, sf_dir).join(known, ["source", "template_id"])
    joined = joined.withColumn("ratio", F.col("frequency") / F.col("known"))
    return rounded(joined, "ratio").select("source", "template_id", "ratio")


# --- the transformations of the streams, run here over the whole tables as a batch


@check(
    "x2_windowed_observations",
    """
-- views: logs
with w as (
  select source, time_bucket(interval '5 minutes', "timestamp", timestamp '1970-01-01') as window_start,
         level in ('error', 'fatal') as is_error, template_id, latency
  from logs)
select source, window_start, window_start + interval 5 minute as window_end, is_error, template_id, latency, count(*) as n
from w group by all
""",
)
def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_observations(V.logs(spark, sf_dir))


@check(
    "x6_stream_correlation",
    f"""
-- views: anomalies
with {PAIRS_SQL}
select left(sha256(log_event_id || '|' || metric_event_id), 32) as id, log_event_id, metric_event_id,
       round(dt, 6) as time_delta_sec, round({CONFIDENCE_SQL}, 9) as confidence
from pairs where {CONFIDENCE_SQL} >= 0.5
""",
)
def stream_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream_correlations(V.log_anomalies(spark, sf_dir), V.metric_anomalies(spark, sf_dir))
    return rounded(found.drop("detected_at"), "confidence", digits=9)  # time deltas are whole microseconds


# --- alerts

ORDER = "case {c} when 'low' then 0 when 'medium' then 1 when 'high' then 2 else 3 end"
KEPT_SQL = """
keyed as (
  select source, anomaly_type, coalesce(template_id, '') as template_key, epoch_us(detected_at) as t, min(id) as id
  from alert_anomalies where severity <> 'low' group by all),
chain as (
  select source, anomaly_type, template_key, min(t) as t from keyed group by all
  union all
  select c.source, c.anomaly_type, c.template_key,
         (select min(k.t) from keyed k where k.source = c.source and k.anomaly_type = c.anomaly_type
            and k.template_key = c.template_key and k.t >= c.t + 21600000000) as t
  from chain c where c.t is not null),
kept as (
  select k.* from keyed k join chain c
    on k.source = c.source and k.anomaly_type = c.anomaly_type and k.template_key = c.template_key and k.t = c.t)
"""
COOLDOWN = 6 * 60


@check(
    "j7_severity_routing",
    f"""
-- views: anomalies
select id, channel_type from alert_anomalies a join channels c
  on {ORDER.format(c='a.severity')} >= {ORDER.format(c='c.min_severity')}
""",
)
def severity_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.route(V.alert_anomalies(spark, sf_dir), V.channels(spark)).select("id", "channel_type")


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.alert_anomalies(spark, sf_dir)
    return C.cooldown_kept(C.routable(found, V.channels(spark)), COOLDOWN)


@check(
    "c1_cooldown",
    f"""
-- views: anomalies
-- recursive
with {KEPT_SQL}
select id, source, anomaly_type, template_key from kept
""",
)
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("id", "source", "anomaly_type", "template_key")


@check(
    "c2_outbox",
    f"""
-- views: anomalies
-- recursive
with {KEPT_SQL}
select k.id as anomaly_id, channel_type from kept k join alert_anomalies a on a.id = k.id join channels c
  on {ORDER.format(c='a.severity')} >= {ORDER.format(c='c.min_severity')}
""",
)
def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = C.outbox(V.alert_anomalies(spark, sf_dir), V.channels(spark), COOLDOWN)
    return sent.filter(F.col("payload").isNotNull()).select("anomaly_id", "channel_type")


def _payload(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sent = C.outbox(V.alert_anomalies(spark, sf_dir), V.channels(spark), COOLDOWN)
        return sent.filter(F.col("channel_type") == name)

    return query


def _payload_sql(channel: str, payload: str) -> str:
    return f"""
-- views: anomalies
-- recursive
with {KEPT_SQL},
sent as (
  select a.*, replace(a.anomaly_type, '_', ' ') as title, printf('%.2f', score) as shown, 'anomaly ' || a.id as description,
         strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%fZ') as stamp
  from kept k join alert_anomalies a on a.id = k.id join channels c on {ORDER.format(c='a.severity')} >= {ORDER.format(c='c.min_severity')}
  where channel_type = '{channel}')
select id as anomaly_id, '{channel}' as channel_type, {payload} as payload from sent
"""


TELEGRAM_SQL = """
json_object('text', case severity when 'low' then '\U0001f535' when 'medium' then '\U0001f7e1' when 'high' then '\U0001f7e0' else '\U0001f534' end
  || ' *tidewatch alert*' || chr(10) || chr(10) || '*Type:* ' || title || chr(10) || '*Severity:* ' || severity || chr(10)
  || '*Source:* ' || source || chr(10) || '*Score:* ' || shown || chr(10) || chr(10) || description || chr(10)
  || chr(10) || '*Sample lines:*' || chr(10) || '```' || chr(10) || '  line ' || id || chr(10) || '```', 'parse_mode', 'Markdown')
"""
SLACK_SQL = """
json_object('attachments', json_array(json_object(
  'color', case severity when 'low' then '#3498db' when 'medium' then '#f39c12' when 'high' then '#e67e22' else '#e74c3c' end,
  'blocks', json_array(
    json_object('type', 'header', 'text', json_object('type', 'plain_text', 'text', 'tidewatch: ' || title)),
    json_object('type', 'section', 'fields', json_array(
      json_object('type', 'mrkdwn', 'text', '*Severity:* ' || severity), json_object('type', 'mrkdwn', 'text', '*Source:* ' || source),
      json_object('type', 'mrkdwn', 'text', '*Score:* ' || shown), json_object('type', 'mrkdwn', 'text', '*Time:* ' || stamp))),
    json_object('type', 'section', 'text', json_object('type', 'mrkdwn', 'text', description))))))
"""
EMAIL_SQL = """
json_object('subject', '[tidewatch] ' || upper(severity) || ': ' || title || ' on ' || source,
  'body', 'Anomaly detected by tidewatch' || chr(10) || chr(10) || 'Type: ' || anomaly_type || chr(10) || 'Severity: ' || severity || chr(10)
  || 'Source: ' || source || chr(10) || 'Score: ' || shown || chr(10) || 'Time: ' || stamp || chr(10) || chr(10) || description || chr(10)
  || chr(10) || 'Sample lines:' || chr(10) || '  line ' || id || chr(10))
"""
ALERTMANAGER_SQL = """
json_array(json_object('labels', json_object('alertname', 'tidewatch_' || anomaly_type, 'severity', severity, 'source', source),
  'annotations', json_object('summary', description, 'score', cast(score as varchar)), 'startsAt', stamp))
"""

for _name, _channel, _sql in (
    ("c3_telegram_payload", "telegram", TELEGRAM_SQL),
    ("c4_slack_payload", "slack", SLACK_SQL),
    ("c5_email_payload", "email", EMAIL_SQL),
    ("c6_alertmanager_payload", "alertmanager", ALERTMANAGER_SQL),
):
    check(_name, _payload_sql(_channel, _sql))(_payload(_channel))


@check(
    "c7_active_cooldowns",
    f"""
-- views: anomalies
-- recursive
with {KEPT_SQL}
select source, anomaly_type, template_key, make_timestamp(max(t)) + interval 6 hour as expires_at from kept group by all
having make_timestamp(max(t)) + interval 6 hour > timestamp '2024-01-30 23:00:00'
""",
)
def active_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = C.cooldowns(_kept(spark, sf_dir), COOLDOWN)
    return C.active_cooldowns(running, F.lit("2024-01-30 23:00:00").cast("timestamp"))


@check(
    "c8_mark_alerted",
    f"""
-- views: anomalies
-- recursive
with {KEPT_SQL}
select a.id, k.id is not null as alerted from alert_anomalies a left join kept k on k.id = a.id
""",
)
def mark_alerted(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = C.mark_alerted(V.alert_anomalies(spark, sf_dir), _kept(spark, sf_dir))
    return marked.select("id", "alerted")
