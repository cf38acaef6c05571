"""Tables at rest: plain Parquet, appended by batch jobs and streams."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch import schemas

RETENTION_DAYS = 30


OPEN_AT_A_TIME = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_FILES = 64
ROW_GROUP = 8 << 20  # bytes of a row group where many files are open

BATCH_JOBS = "batch"  # the run of everything that batch jobs append


def _append(df: DataFrame, path: str, partition: Column | None = None) -> None:
    if partition is None:
        df.write.mode("append").parquet(path)
        return
    df = df.withColumns({"date": partition, "run": F.lit(BATCH_JOBS)})
    # Sorted inside each task: few files per day and narrow row-group statistics for source and time.
    keys = [c for c in ("date", "source", "timestamp") if c in df.columns]
    df.sortWithinPartitions(*keys).write.mode("append").partitionBy("date", "run").parquet(path)


def stream_id(df: DataFrame) -> str:
    """The id of the stream whose micro-batch this is; it stays with the stream's checkpoint."""
    found = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not found:
        raise ValueError("not a micro-batch: name the run")
    return found


def write_batch(df: DataFrame, path: str, batch_id: int, day: Column, run: str | None = None) -> None:
    """Add a micro-batch to a table that batch jobs and other streams write as well.

    All of them share one layout, day and run. The run of a micro-batch is the stream's id (``run`` by default) and the
    number of the batch, and a write replaces only its own days and run: a batch that is repeated after a failure
    replaces itself, and nobody else's rows.
    """
    own = f"{run or stream_id(df)}-{batch_id}"
    dated = df.withColumns({"date": F.to_date(day), "run": F.lit(own)})
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date", "run").parquet(path)


def between(
    df: DataFrame, column: str, since: datetime | str | None = None, until: datetime | str | None = None
) -> DataFrame:
    """Rows with since <= column < until.

    The comparison is on the bare column, so it reaches the scan. Stored tables are also cut to the days they need.
    """
    for bound, inside, day_inside in (
        (since, lambda c, v: c >= v, lambda c, v: c >= v),
        (until, lambda c, v: c < v, lambda c, v: c <= v),
    ):
        if bound is None:
            continue
        value = F.lit(bound).cast("timestamp")
        df = df.filter(inside(F.col(column), value))
        if "date" in df.columns:
            df = df.filter(day_inside(F.col("date"), F.to_date(value)))
    return df


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema`` in order, missing ones null."""
    from pyspark.sql.types import _parse_datatype_string

    wanted = _parse_datatype_string(schema)
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted.fields
        ]
    )


def log_rows(logs: DataFrame, ingested_at: Column) -> DataFrame:
    """Logs in the stored layout: fields default to {}, line_number to 0, ingested_at to the given time."""
    if "ingested_at" not in logs.columns:
        logs = logs.withColumn("ingested_at", ingested_at)
    rows = conform(logs, schemas.LOGS)
    return rows.withColumns(
        {
            "fields": F.coalesce("fields", F.lit("{}")),
            "line_number": F.coalesce("line_number", F.lit(0)),
            "ingested_at": F.coalesce("ingested_at", ingested_at),
        }
    )


def append_logs(logs: DataFrame, path: str, ingested_at: Column | None = None) -> None:
    """Append logs, partitioned by event day (arrival day for lines without a time)."""
    rows = log_rows(logs, F.current_timestamp() if ingested_at is None else ingested_at)
    _append(rows, path, F.to_date(F.coalesce("timestamp", "ingested_at")))


def append_anomalies(anomalies: DataFrame, path: str) -> None:
    _append(conform(anomalies, schemas.ANOMALIES), path, F.to_date("detected_at"))


def append_metric_samples(samples: DataFrame, path: str) -> None:
    _append(conform(samples, schemas.METRIC_SAMPLES), path, F.to_date("timestamp"))


def append_predictions(forecasts: DataFrame, path: str) -> None:
    """Append predictions, steps nested per series and horizon (see :func:`nest_predictions`)."""
    _append(conform(forecasts, schemas.PREDICTIONS), path)


def nest_predictions(steps: DataFrame, predicted_at: Column) -> DataFrame:
    """(series, horizon_hours, step, ts, value) rows to one row per series and horizon.

    A group has 12 steps per hour of its horizon, so the nested array is bounded.
    """
    from tidewatch.functions.scalars import stable_id

    keys = ["name", "labels_hash", "source", "horizon_hours"]
    path = F.array_sort(F.collect_list(F.struct("ts", "value")))
    nested = steps.groupBy(*keys).agg(path.alias("predictions"))
    return nested.select(
        stable_id(*[F.col(k) for k in keys], predicted_at).alias("id"),
        F.col("name").alias("metric_name"),
        "labels_hash",
        "source",
        F.col("horizon_hours").cast("int").alias("horizon_hours"),
        "predictions",
        predicted_at.alias("predicted_at"),
    )


def append_correlated_events(events: DataFrame, path: str) -> None:
    """Append pairs, which may be far more than the anomalies: each task writes its days side by side instead of putting
    its pairs in order by day first. A file's row groups are small, as many are open at a time; a task with more than
    ``OPEN_FILES`` days does put the rest in order."""
    rows = conform(events, schemas.CORRELATED_EVENTS)
    rows = rows.withColumns({"date": F.to_date("detected_at"), "run": F.lit(BATCH_JOBS)})
    conf = events.sparkSession.conf
    before = conf.get(OPEN_AT_A_TIME)
    conf.set(OPEN_AT_A_TIME, str(OPEN_FILES))
    try:
        writer = rows.write.mode("append").option("parquet.block.size", ROW_GROUP).option("compression", "zstd")
        writer.partitionBy("date", "run").parquet(path)
    finally:
        conf.set(OPEN_AT_A_TIME, before)


def append_forecast_models(models: DataFrame, path: str) -> None:
    """Models are only ever appended; :func:`latest_models` is the current state."""
    _append(models, path)


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key: an aggregate with map-side combine instead of a sort per key."""
    others = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return newest.select(*keys, "__row.*").select(*rows.columns)


def latest_models(models: DataFrame) -> DataFrame:
    """Current forecast model per (metric_name, labels_hash)."""
    return latest_by_key(models, ["metric_name", "labels_hash"], ["trained_at", "model_type"])


def lookup_models(keys: DataFrame, models: DataFrame) -> DataFrame:
    """Current models for the wanted (metric_name, labels_hash) pairs; unknown pairs give nothing."""
    return keys.join(latest_models(models), ["metric_name", "labels_hash"])


def model_versions(runs: DataFrame) -> DataFrame:
    """Training runs with a version that counts up per source."""
    order = Window.partitionBy("source").orderBy("trained_at")  # a source trains a few times a day
    return runs.withColumn("version", F.row_number().over(order))


def model_metadata(runs: DataFrame) -> DataFrame:
    """Newest run of every source with its version."""
    newest = latest_by_key(runs, ["source"], ["trained_at"])
    versions = runs.groupBy("source").agg(F.count("*").alias("version"))
    return newest.join(versions, "source")


def retained(logs: DataFrame, as_of: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Logs that stay: ingested within the last ``days`` days."""
    return logs.filter(F.col("ingested_at") >= F.lit(as_of - timedelta(days=days)).cast("timestamp"))


def expired_count(logs: DataFrame, as_of: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    return logs.filter(F.col("ingested_at") < _cutoff(as_of, days)).agg(F.count("*").alias("deleted"))


def enforce_retention(spark: SparkSession, path: str, as_of: datetime, days: int = RETENTION_DAYS) -> int:
    """Remove the logs at ``path`` that were ingested more than ``days`` days ago, and return how many.

    One scan of the arrival times tells which day and run folders hold expired rows. Folders in which all are expired
    are dropped; only those that also hold others, the days around the limit, are written anew, so the work does not
    grow with the table. New folders are complete before old ones go: a run that died is finished by the next one.
    """
    files = _files(spark, path)
    staged = f"{path}/_retention"
    _finish_retention(spark, path)
    logs = spark.read.parquet(path)
    expired = F.col("ingested_at") < _cutoff(as_of, days)
    found = logs.groupBy("date", "run").agg(F.count_if(expired).alias("expired"), F.count("*").alias("rows"))
    touched = found.filter("expired > 0").collect()  # folders around or before the limit, none of the kept days
    if not touched:
        return 0
    folders = {(r["date"], r["run"]): _folder(r["date"], r["run"]) for r in touched}
    mixed = [f"{path}/{folders[r['date'], r['run']]}" for r in touched if r["expired"] < r["rows"]]
    if mixed:
        kept = spark.read.option("basePath", path).parquet(*mixed).filter(~F.coalesce(expired, F.lit(False)))
        kept.write.mode("overwrite").partitionBy("date", "run").parquet(staged)
        _finish_retention(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # type: ignore[union-attr]
    for r in touched:
        if r["expired"] == r["rows"]:
            folder = hadoop(f"{path}/{folders[r['date'], r['run']]}")
            files.delete(folder, True)
    return sum(r["expired"] for r in touched)


def _cutoff(as_of: datetime, days: int) -> Column:
    return F.lit(as_of - timedelta(days=days)).cast("timestamp")


def _folder(date: Any, run: str) -> str:
    day = "__HIVE_DEFAULT_PARTITION__" if date is None else date.isoformat()
    return f"date={day}/run={run}"


def _files(spark: SparkSession, path: str) -> Any:
    """The file system that holds ``path``."""
    java = spark.sparkContext._jvm
    return java.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # type: ignore[union-attr]


def _finish_retention(spark: SparkSession, path: str) -> None:
    """Put folders that are completely written in place of those that they replace. Readers skip ``_retention``."""
    files, hadoop = _files(spark, path), spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # type: ignore[union-attr]
    staged = hadoop(f"{path}/_retention")
    if not files.exists(staged):
        return
    if files.exists(hadoop(staged, "_SUCCESS")):
        for run in files.globStatus(hadoop(staged, "date=*/run=*")):
            own = run.getPath()
            target = hadoop(f"{path}/{own.getParent().getName()}/{own.getName()}")
            files.delete(target, True)
            files.mkdirs(target.getParent())
            files.rename(own, target)
    files.delete(staged, True)
