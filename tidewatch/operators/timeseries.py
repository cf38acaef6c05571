"""Metric series: resampling, gap filling, ARIMA(1,1,0) by column expressions, forecasts and threshold crossings.

A series is (name, labels_hash, source). After resampling it has at most 12 points an hour, whatever its sampling
rate, so windows over a series are bounded by its time span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["name", "labels_hash", "source"]

# Grid, gap limit, gate, split and model choice.
STEP_SECONDS = 300
STEPS_PER_HOUR = 12
MAX_FILL = 3
MIN_POINTS = 72
TRAIN_SHARE = 0.9
MOSTLY = 0.95
TREND_NAMES = "disk|storage|capacity"
HORIZONS = (24, 48, 168)


def resample(samples: DataFrame, arrival: str | None = None) -> DataFrame:
    """Last value of every series in each five-minute slot.

    Of samples with equal times the one that arrived last counts, by the column ``arrival``; without such a column the
    larger value does, so that the outcome does not depend on the order of rows.
    """
    slot = F.floor(F.unix_seconds("timestamp") / STEP_SECONDS)
    order = F.struct("timestamp", *([arrival] if arrival else []), "value")
    return samples.groupBy(*SERIES, slot.alias("slot")).agg(F.max_by("value", order).alias("value"))


def fill_gaps(points: DataFrame) -> DataFrame:
    """Repeat a value into at most three missing slots after it; wider gaps stay closed up.

    Each point is followed by its own copies, so no grid is built and joined. Adds ``ts`` and the position ``pos``
    from 1 in the filled series.
    """
    order = Window.partitionBy(*SERIES).orderBy("slot")
    following = F.coalesce(F.lead("slot").over(order), F.col("slot") + 1)
    last = F.least(F.col("slot") + MAX_FILL, following - 1)
    copies = F.sequence(F.col("slot"), last)
    filled = points.withColumn("__copies", copies)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("__before", F.coalesce(F.sum(F.size("__copies")).over(before), F.lit(0)))
    out = filled.select(*SERIES, "value", "__before", F.posexplode("__copies").alias("__i", "slot"))
    return out.select(
        *SERIES,
        "slot",
        F.timestamp_seconds(F.col("slot") * STEP_SECONDS).alias("ts"),
        "value",
        (F.col("__before") + F.col("__i") + 1).alias("pos"),
    )


def with_differences(points: DataFrame) -> DataFrame:
    """Add the difference to the previous point and the one before that."""
    order = Window.partitionBy(*SERIES).orderBy("pos")
    points = points.withColumn("diff", F.col("value") - F.lag("value").over(order))
    return points.withColumn("prev_diff", F.lag("diff").over(order))


def model_choice(points: DataFrame) -> DataFrame:
    """Per series: points, split, share of non-falling steps, and which model it gets.

    ``points`` needs ``diff`` (see :func:`with_differences`). Series below the gate are left out.
    """
    rising = F.avg((F.col("diff") >= 0).cast("int"))
    per_series = points.groupBy(*SERIES).agg(
        F.count("*").alias("points"), F.coalesce(rising, F.lit(0.0)).alias("rising_share")
    )
    per_series = per_series.filter(F.col("points") >= MIN_POINTS)
    mostly = (F.col("rising_share") >= MOSTLY) & (F.col("points") >= 2)
    trend = F.lower("name").rlike(TREND_NAMES) | mostly
    return per_series.select(
        *SERIES,
        "points",
        F.floor(F.col("points") * TRAIN_SHARE).alias("train_points"),
        "rising_share",
        F.when(trend, "arima").otherwise("autoarima").alias("model_type"),
    )


def _forecast(last_value: Column, last_diff: Column, phi: Column, step: Column) -> Column:
    """Closed form of the AR(1) recursion on differences."""
    factor = F.when(phi == 1, step.cast("double")).otherwise(
        phi * (1 - F.pow(phi, step)) / F.nullif(1 - phi, F.lit(0.0))
    )
    return last_value + last_diff * factor


def fit_arima(points: DataFrame, choice: DataFrame) -> DataFrame:
    """ARIMA(1,1,0) by conditional least squares for the series that got it, with the error on the held-out tail.

    ``points`` needs the columns of :func:`with_differences`.
    """
    chosen = choice.filter(F.col("model_type") == "arima").select(*SERIES, "points", "train_points", "model_type")
    both = points.join(chosen, SERIES)
    train = F.col("pos") <= F.col("train_points")
    lagged = train & F.col("prev_diff").isNotNull()
    fitted = both.groupBy(*SERIES, "model_type", "points", "train_points").agg(
        F.sum(F.when(lagged, F.col("diff") * F.col("prev_diff"))).alias("__cross"),
        F.sum(F.when(lagged, F.col("prev_diff") * F.col("prev_diff"))).alias("__square"),
        F.max_by(F.when(train, F.col("value")), F.when(train, F.col("pos"))).alias("last_value"),
        F.max_by(F.when(train, F.col("diff")), F.when(train, F.col("pos"))).alias("last_diff"),
        F.max(F.when(train, F.col("ts"))).alias("last_ts"),
    )
    phi = F.coalesce(F.col("__cross") / F.nullif(F.col("__square"), F.lit(0.0)), F.lit(0.0))
    fitted = fitted.withColumn("phi", phi).drop("__cross", "__square")
    tail = points.select(*SERIES, "pos", "value").join(fitted, SERIES).filter(F.col("pos") > F.col("train_points"))
    step = F.col("pos") - F.col("train_points")
    error = _forecast(F.col("last_value"), F.col("last_diff"), F.col("phi"), step) - F.col("value")
    errors = tail.groupBy(*SERIES).agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    return fitted.join(errors, SERIES, "left").fillna(0.0, ["rmse"])


def _horizon_steps(models: DataFrame, horizons: tuple[int, ...] | list[int]) -> DataFrame:
    models = models.withColumn("horizon_hours", F.explode(F.array(*[F.lit(h) for h in horizons])))
    steps = F.sequence(F.lit(1), F.col("horizon_hours") * STEPS_PER_HOUR)
    return models.withColumn("step", F.explode(steps))


def step_time(start: Column, step: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + step.cast("bigint") * (STEP_SECONDS * 1_000_000))


def forecast_arima(
    models: DataFrame, horizons: tuple[int, ...] | list[int] = HORIZONS, anchor: Column | None = None
) -> DataFrame:
    """Forecast steps per series and horizon, from the last training point or from ``anchor``."""
    steps = _horizon_steps(models, horizons)
    start = F.col("last_ts") if anchor is None else anchor
    return steps.select(
        *SERIES,
        "model_type",
        "horizon_hours",
        "step",
        step_time(start, F.col("step")).alias("ts"),
        _forecast(F.col("last_value"), F.col("last_diff"), F.col("phi"), F.col("step")).alias("value"),
    )


def threshold_crossings(forecasts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """First step of each series and horizon at or beyond its threshold (metric_name, direction, threshold)."""
    limits = thresholds.select(F.col("metric_name").alias("name"), "direction", "threshold")
    joined = forecasts.join(limits, "name")
    above = (F.col("direction") == "above") & (F.col("value") >= F.col("threshold"))
    below = (F.col("direction") == "below") & (F.col("value") <= F.col("threshold"))
    first = F.min_by(F.struct("ts", "value"), F.col("step")).alias("first")
    crossed = joined.filter(above | below).groupBy(*SERIES, "horizon_hours", "direction", "threshold").agg(first)
    return crossed.select(
        *SERIES,
        "horizon_hours",
        "direction",
        "threshold",
        F.col("first.ts").alias("exhaustion_time"),
        F.col("first.value").alias("predicted_value"),
    )


def crossing_description(crossings: DataFrame) -> DataFrame:
    text = F.format_string(
        "Metric '%s' predicted to cross %s threshold %s at %s (predicted: %.2f)",
        "name",
        "direction",
        F.col("threshold").cast("string"),
        F.date_format("exhaustion_time", "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "predicted_value",
    )
    return crossings.withColumn("description", text)
