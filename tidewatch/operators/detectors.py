"""The four anomaly detectors.

They work on observations: (source, ..., is_error, template_id, latency, n), where n lines look the same. Error rates
and template shares come from one profile of them, latencies from the observations themselves. ``by`` names the
grouping columns, ``["source"]`` for one window or ``["source", "window_start"]`` for many windows at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.functions.skew import running_totals
from tidewatch.session import cut_lineage

# Detector names and limits.
ERROR_RATE_SPIKE = "error_rate_spike"
NOVEL_PATTERN = "novel_pattern"
LATENCY_SHIFT = "latency_shift"
FREQUENCY_DEVIATION = "frequency_deviation"
ANOMALY_TYPES = (ERROR_RATE_SPIKE, NOVEL_PATTERN, LATENCY_SHIFT, FREQUENCY_DEVIATION)
FLAT_STD = 1e-10
MIN_LATENCIES = 10
KS_SIGNIFICANCE = 0.01
MIN_FREQUENCY = 1e-6
RATIO_LOW, RATIO_HIGH = 0.33, 3.0

KS_TERMS = 100
VALUES_PER_CELL = 2000
MAX_CELLS = 1024
CELL_STEP = 32


def observations(logs: DataFrame, *extra: str) -> DataFrame:
    """Log lines as observations of weight one."""
    return logs.select(
        "source",
        *extra,
        S.is_error(F.col("level")).alias("is_error"),
        F.when(F.col("template_id") != "", F.col("template_id")).alias("template_id"),
        S.latency(F.col("fields")).alias("latency"),
        F.lit(1).cast("bigint").alias("n"),
    )


def window_profile(current: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lines and errors per template, lines without a template included."""
    by = by or ["source"]
    bad = F.sum(F.when(F.col("is_error"), F.col("n")).otherwise(0))
    return current.groupBy(*by, "template_id").agg(F.sum("n").alias("count"), bad.alias("errors"))


def observed_rates(profile: DataFrame, by: list[str] | None = None) -> DataFrame:
    rate = F.sum("errors") / F.sum("count")
    return profile.groupBy(*(by or ["source"])).agg(rate.alias("observed_rate"))


def template_shares(profile: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count and share of each template among all lines of its window."""
    by = by or ["source"]
    totals = profile.groupBy(*by).agg(F.sum("count").alias("__total"))
    shares = profile.filter(F.col("template_id").isNotNull()).join(totals, by)
    return shares.select(*by, "template_id", "count", (F.col("count") / F.col("__total")).alias("frequency"))


def error_rate_spikes(
    rates: DataFrame, stats: DataFrame, sensitivity: Column | float = 0.5, by: list[str] | None = None
) -> DataFrame:
    """Error rate against mean and deviation of the baseline. ``sensitivity`` may be a column of ``stats``."""
    by = by or ["source"]
    sensitivity = F.lit(sensitivity) if isinstance(sensitivity, (int, float)) else sensitivity
    above = F.when(F.col("observed_rate") > F.col("error_rate_mean") + 0.01, 10.0)
    z = (F.col("observed_rate") - F.col("error_rate_mean")) / F.nullif(F.col("error_rate_std"), F.lit(0.0))
    scored = rates.join(stats, "source").withColumn(
        "z_score", F.when(F.col("error_rate_std") < FLAT_STD, above).otherwise(z)
    )
    scored = scored.filter(F.col("z_score") > F.lit(5.0) - sensitivity * 3.0)
    score = F.least(F.lit(1.0), F.col("z_score") / 10.0 + 0.2)
    return scored.select(
        *by, "observed_rate", F.col("error_rate_mean").alias("baseline_rate"), "z_score", score.alias("score")
    ).withColumn("severity", S.severity_of(F.col("score")))


def novel_patterns(
    counts: DataFrame, templates: DataFrame, min_occurrences: int = 3, by: list[str] | None = None
) -> DataFrame:
    """Templates that the baseline does not know, seen at least ``min_occurrences`` times."""
    by = by or ["source"]
    frequent = counts.filter(F.col("count") >= min_occurrences)
    novel = frequent.join(templates.select("source", "template_id"), ["source", "template_id"], "left_anti")
    many = F.col("count") >= 10
    return novel.select(
        *by,
        "template_id",
        "count",
        F.when(many, 0.7).otherwise(0.5).alias("score"),
        F.when(many, "high").otherwise("medium").alias("severity"),
    )


def frequency_deviations(
    counts: DataFrame, templates: DataFrame, by: list[str] | None = None, include_vanished: bool = False
) -> DataFrame:
    """Templates whose share of the lines moved by more than about three times either way.

    With ``include_vanished`` known templates that no longer occur in a window of their source are reported too, with
    a factor of zero.
    """
    by = by or ["source"]
    known = templates.select("source", "template_id", F.col("frequency").alias("baseline_frequency"))
    known = known.filter(F.col("baseline_frequency") >= MIN_FREQUENCY)
    now = counts.select(*by, "template_id", F.col("frequency").alias("current_frequency"))
    if include_vanished:
        expected = known.join(counts.select(*by).distinct(), "source")
        pairs = expected.join(now, [*by, "template_id"], "left").fillna(0.0, ["current_frequency"])
    else:
        pairs = now.join(known, ["source", "template_id"])
    pairs = pairs.withColumn("deviation_factor", F.col("current_frequency") / F.col("baseline_frequency"))
    factor = F.col("deviation_factor")
    moved = pairs.filter((factor < RATIO_LOW) | (factor > RATIO_HIGH))
    up = factor > RATIO_HIGH
    drop = F.coalesce(1.0 / F.nullif(factor, F.lit(0.0)), F.lit(float("inf")))
    excess = F.when(up, factor).otherwise(drop)
    moved = moved.withColumn("score", F.least(F.lit(1.0), (excess - 3.0) / 7.0))
    return moved.select(
        *by,
        "template_id",
        "baseline_frequency",
        "current_frequency",
        "deviation_factor",
        F.when(up, "increase").otherwise("decrease").alias("direction"),
        "score",
        S.severity_of(F.col("score")).alias("severity"),
    )


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """Two-sided Kolmogorov-Smirnov p-value: asymptotic series with Stephens' small-sample correction."""
    root = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (root + 0.12 + F.lit(0.11) / root) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    # The truncated series is useless near zero, where the true value is 1.
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def _order_statistics(side: str) -> list[Column]:
    """Values at the two ranks around the 99th percentile, from running counts."""
    rank = (F.col(f"{side}_n") - 1) * 0.99
    beyond = {"low": F.floor(rank), "high": F.ceil(rank)}
    return [F.min(F.when(F.col(side) > r, F.col("value"))).alias(f"{side}_{end}") for end, r in beyond.items()]


def _cell(value: Column) -> Column:
    """How many bounds lie below the value: first in steps, then within the step."""

    def below(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda bound: bound < value))

    def within(step: Column) -> Column:
        start = step * CELL_STEP
        return start + below(F.slice("bounds", start + 1, F.lit(CELL_STEP - 1)))

    # never null, which spares the join on it a second evaluation
    return F.coalesce(S.let(below(F.col("steps")), within), F.lit(0))


def _distribution(values: DataFrame, by: list[str], count: str) -> DataFrame:
    """Running counts of a multiset (``by``, value, ``count``) in order of value: adds ``cell``, ``upto`` and ``n``.

    The value range is cut into cells at approximate quantiles, as many as VALUES_PER_CELL asks for, and counts are put
    together from cells, so one source with many values is spread over many tasks.
    """
    values = cut_lineage(values)  # counted, cut at percentiles, and dealt out
    most = values.groupBy(*by).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0
    cells = min(MAX_CELLS, math.ceil(most / VALUES_PER_CELL))  # of the largest group; others get what they need
    if cells <= 1:
        celled = values.withColumn("cell", F.lit(0))
    else:
        shares = [(i + 1) / cells for i in range(cells - 1)]
        found = values.groupBy(*by).agg(F.percentile_approx("value", shares, 4 * cells).alias("bounds"), F.count("*").alias("__n"))
        stride = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.ceil(F.col("__n") / VALUES_PER_CELL))).cast("int")
        bounds = found.select(*by, F.filter("bounds", lambda _, i: (i + 1) % stride == 0).alias("bounds"))
        every = F.filter("bounds", lambda _, i: i % CELL_STEP == CELL_STEP - 1)
        bounds = bounds.withColumn("steps", every)
        celled = values.join(bounds, by).withColumn("cell", _cell(F.col("value"))).drop("bounds", "steps")
    counted = running_totals(celled, by, ["cell"], ["value"], {"upto": F.col(count)})
    return counted.withColumnRenamed("upto_all", "n")


def ks_distances(observed: DataFrame, latencies: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per window: sizes and means of both samples, the largest gap between their empirical distributions, and the
    values around their 99th percentiles.

    Both sides are multisets (value, n). The largest gap lies at a current value or just before one, so the baseline's
    distribution is only wanted at the different current values of its source: it is run through once per source,
    however many windows look at it.
    """
    by = by or ["source"]
    ours = observed.groupBy(*by, "value").agg(F.sum("n").alias("c"))
    zero = F.lit(0).cast("bigint")
    spots = ours.select("source", "value", zero.alias("b"), F.lit(True).alias("wanted"))
    theirs = latencies.select("source", "value", F.col("n").alias("b"), F.lit(False).alias("wanted"))
    theirs = theirs.join(spots.select("source").distinct(), "source", "left_semi")
    merged = theirs.unionByName(spots).groupBy("source", "value").agg(F.sum("b").alias("b"), F.max("wanted").alias("wanted"))
    known = _distribution(merged, ["source"], "b").withColumnsRenamed({"upto": "baseline", "n": "baseline_n"})
    whole = known.filter("baseline_n > 0").groupBy("source").agg(
        F.max("baseline_n").alias("baseline_n"),
        (F.sum(F.col("value") * F.col("b")) / F.sum("b")).alias("baseline_mean"),
        *_order_statistics("baseline"),
    )
    at = known.filter("wanted").select(
        "source", "value", F.col("baseline").alias("upto_b"), (F.col("baseline") - F.col("b")).alias("below_b")
    )
    current = _distribution(ours, by, "c").withColumnsRenamed({"upto": "current", "n": "current_n"})
    met = current.join(at, ["source", "value"]).join(whole.select("source", "baseline_n"), "source")
    upper = F.abs(F.col("upto_b") / F.col("baseline_n") - F.col("current") / F.col("current_n"))
    lower = F.abs(F.col("below_b") / F.col("baseline_n") - (F.col("current") - F.col("c")) / F.col("current_n"))
    found = met.groupBy(*by).agg(
        F.max(F.greatest(upper, lower)).alias("ks_statistic"),
        F.max("current_n").alias("current_n"),
        (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("current_mean"),
        *_order_statistics("current"),
    )
    return found.join(whole, "source")


def latency_shifts(current: DataFrame, latencies: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Two-sample KS test of the current latencies against the baseline's, for windows that got slower."""
    by = by or ["source"]
    observed = current.filter(F.col("latency").isNotNull()).select(*by, F.col("latency").alias("value"), "n")
    tested = ks_distances(observed, latencies, by).filter(
        (F.col("baseline_n") >= MIN_LATENCIES)
        & (F.col("current_n") >= MIN_LATENCIES)
        & (F.col("current_mean") > F.col("baseline_mean"))
    )

    def p99(side: str) -> Column:
        rank = (F.col(f"{side}_n") - 1) * 0.99
        low, high = F.col(f"{side}_low"), F.col(f"{side}_high")
        return low + (high - low) * (rank - F.floor(rank))

    shift = (F.col("current_mean") - F.col("baseline_mean")) / F.col("baseline_mean") * 100
    tested = tested.select(
        *by,
        p99("baseline").alias("baseline_p99_ms"),
        p99("current").alias("current_p99_ms"),
        "ks_statistic",
        ks_pvalue(F.col("ks_statistic"), F.col("baseline_n"), F.col("current_n")).alias("ks_pvalue"),
        F.when(F.col("baseline_mean") == 0, float("inf")).otherwise(shift).alias("shift_percent"),
    ).filter(F.col("ks_pvalue") < KS_SIGNIFICANCE)
    strong = (F.col("ks_pvalue") < 0.001) & (F.col("shift_percent") > 50)
    medium = F.col("shift_percent") > 20
    return tested.withColumns(
        {
            "score": F.when(strong, 0.85).when(medium, 0.6).otherwise(0.4),
            "severity": F.when(strong, "high").when(medium, "medium").otherwise("low"),
        }
    )
