"""Grouped statistics over logs. Every function works on all sources at once.

``logs`` has the columns of :data:`tidewatch.schemas.LOGS`; only those a function needs are read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.functions.skew import row_numbers
from tidewatch.sources.store import between

# Time buckets of stored error rates count from 2000-01-03, and a source needs this many lines.
BUCKET_ORIGIN = 946_857_600
MIN_TRAINING_LINES = 1000
DEFAULT_RATE_STD = 0.01


def slice_logs(logs: DataFrame, since: datetime | str | None = None, until: datetime | str | None = None) -> DataFrame:
    """Rows with since <= timestamp < until."""
    return between(logs, "timestamp", since, until)


def ranked_by_age(logs: DataFrame) -> DataFrame:
    """All lines with a time and their rank by age within the source (``rank``, oldest first).

    Ranks are added up from counts per minute, so a busy source is not sorted in one task, nor are the lines of one
    crowded minute.
    """
    minute = F.floor(F.unix_seconds("timestamp") / 60)
    timed = logs.filter(F.col("timestamp").isNotNull()).withColumn("__minute", minute)
    ranked = row_numbers(timed, ["source"], "__minute", ["timestamp", "line_number"], "rank")
    return ranked.select(*logs.columns, "rank")


def epoch_bucket(minutes: int) -> Column:
    """Number of a line's time bucket since 1970."""
    return F.floor(F.unix_seconds("timestamp") / (minutes * 60))


def error_rate(logs: DataFrame, bucket_minutes: int = 5) -> DataFrame:
    """Lines, errors and error rate per source and time bucket."""
    shift = BUCKET_ORIGIN % (bucket_minutes * 60)
    bucket = F.window("timestamp", f"{bucket_minutes} minutes", startTime=f"{shift} seconds")
    counted = logs.groupBy("source", bucket.alias("w")).agg(
        F.count("*").alias("total"), F.count_if(S.is_error(F.col("level"))).alias("errors")
    )
    return counted.select(
        "source", F.col("w.start").alias("bucket"), "total", "errors", (F.col("errors") / F.col("total")).alias("error_rate")
    )


def bucket_error_rates(logs: DataFrame, bucket_minutes: int = 5) -> DataFrame:
    """Error rate per source and epoch bucket; lines without a timestamp do not count."""
    rate = F.avg(S.is_error(F.col("level")).cast("int"))
    timed = logs.filter(F.col("timestamp").isNotNull())
    return timed.groupBy("source", epoch_bucket(bucket_minutes).alias("bucket")).agg(rate.alias("error_rate"))


def rate_stats(logs: DataFrame, bucket_minutes: int = 5) -> DataFrame:
    """Mean and population deviation of the bucket error rates of each source, with its number of lines.

    Lines are counted within the buckets, lines without a timestamp included, so the logs are read once.
    """
    timed = F.col("timestamp").isNotNull()
    buckets = logs.groupBy("source", epoch_bucket(bucket_minutes).alias("bucket")).agg(
        F.count("*").alias("lines"), F.count_if(S.is_error(F.col("level")) & timed).alias("errors")
    )
    return stats_of_buckets(buckets)


def stats_of_buckets(buckets: DataFrame) -> DataFrame:
    """:func:`rate_stats` from counts (source, bucket, lines, errors). Lines without a time have a null bucket."""
    rate = F.when(F.col("bucket").isNotNull(), F.col("errors") / F.col("lines"))
    return buckets.groupBy("source").agg(
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("error_rate_mean"),
        F.coalesce(F.stddev_pop(rate), F.lit(DEFAULT_RATE_STD)).alias("error_rate_std"),
        F.sum("lines").alias("lines_trained"),
    )


def _templated(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("template_id").isNotNull() & (F.col("template_id") != ""))


def template_inventory(logs: DataFrame) -> DataFrame:
    return _templated(logs).select("source", "template_id").distinct()


def template_counts(logs: DataFrame) -> DataFrame:
    return _templated(logs).groupBy("source", "template_id").agg(F.count("*").alias("count"))


def template_frequencies(logs: DataFrame) -> DataFrame:
    """Count and share of each template among all lines, those without a template included.

    Totals come from the counts, not from the lines again. Lines without a template are dropped by an aggregate and
    not by their key, which would be pushed below the shuffle that both branches share.
    """
    template = F.when(F.col("template_id") != "", F.col("template_id"))
    counts = logs.groupBy("source", template.alias("template_id")).agg(
        F.count("*").alias("count"), F.max(template.isNotNull()).alias("__templated")
    )
    lines = F.when(F.col("__templated").isNotNull(), F.col("count"))
    totals = counts.groupBy("source").agg(F.sum(lines).alias("__total"))
    shares = counts.filter("__templated").join(totals, "source")
    return shares.withColumn("frequency", F.col("count") / F.col("__total")).drop("__total", "__templated")


def shares_of_counts(counts: DataFrame) -> DataFrame:
    """:func:`template_frequencies` from counts (source, template_id, count) with a null template for lines without."""
    totals = counts.groupBy("source").agg(F.sum("count").alias("__total"))
    shares = counts.filter(F.col("template_id").isNotNull()).join(totals, "source")
    return shares.withColumn("frequency", F.col("count") / F.col("__total")).drop("__total")


def bucket_features(logs: DataFrame, bucket_minutes: int = 5) -> DataFrame:
    """Per source and bucket: error rate, lines, distinct templates, mean latency (0 if there is none)."""
    timed = logs.filter(F.col("timestamp").isNotNull()).select(
        "source",
        epoch_bucket(bucket_minutes).alias("bucket"),
        S.is_error(F.col("level")).cast("int").alias("error"),
        F.when(F.col("template_id") != "", F.col("template_id")).alias("template_id"),
        S.feature_latency(F.col("fields")).alias("latency"),
    )
    return timed.groupBy("source", "bucket").agg(
        F.avg("error").alias("error_rate"),
        F.count("*").cast("double").alias("line_count"),
        F.count_distinct("template_id").cast("double").alias("templates"),
        F.coalesce(F.avg("latency"), F.lit(0.0)).alias("mean_latency"),
    )


def latency_sample(logs: DataFrame) -> DataFrame:
    """All latencies of each source as (value, n): the same numbers, equal ones stored once."""
    values = logs.select("source", S.latency(F.col("fields")).alias("value")).filter(F.col("value").isNotNull())
    return values.groupBy("source", "value").agg(F.count("*").alias("n"))


def trainable_sources(logs: DataFrame, min_lines: int = MIN_TRAINING_LINES) -> DataFrame:
    lines = logs.groupBy("source").agg(F.count("*").alias("lines"))
    return lines.filter(F.col("lines") >= min_lines)


def current_error_rate(logs: DataFrame) -> DataFrame:
    rate = F.avg(S.is_error(F.col("level")).cast("int"))
    return logs.groupBy("source").agg(F.count("*").alias("total"), rate.alias("error_rate"))


def error_samples(logs: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` error messages of each source in time order."""
    first = Window.partitionBy("source").orderBy("timestamp", "line_number")
    errors = logs.filter(S.is_error(F.col("level")))
    errors = errors.select("source", "timestamp", "line_number", F.coalesce("message", F.lit("")).alias("message"))
    top = errors.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("__n", "message")))
    return top.groupBy("source").agg(F.transform(ordered, lambda s: s["message"]).alias("sample_lines"))


def metric_names(samples: DataFrame) -> DataFrame:
    return samples.select("name").distinct().orderBy("name")


def service_summary(sources: DataFrame, baseline_stats: DataFrame) -> DataFrame:
    """Configured sources with their baseline, if they have one."""
    trained = baseline_stats.select("source", "lines_trained", F.lit(True).alias("trained"))
    joined = sources.select(F.col("name").alias("source")).join(trained, "source", "left")
    return joined.select("source", F.coalesce("trained", F.lit(False)).alias("trained"), "lines_trained")


def service_health(sources: DataFrame, baseline_stats: DataFrame) -> DataFrame:
    return service_summary(sources, baseline_stats).agg(
        F.count("*").alias("sources"), F.count_if("trained").alias("baselines_loaded")
    )
