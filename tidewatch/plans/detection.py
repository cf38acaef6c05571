"""Detection: all detectors over one window, or many, as one anomaly table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import detectors as D
from tidewatch.operators.aggregates import error_samples
from tidewatch.operators.templates import Clusters, with_templates
from tidewatch.plans.baseline import Baseline

# Description texts.
SPIKE_TEXT = "Error rate spike detected (z-score=%.1f, rate=%.3f, baseline=%.3f)"
NOVEL_TEXT = "Novel log pattern detected (template_id=%s, seen %d times, not in baseline)"
SHIFT_TEXT = "Latency shift detected (p99: %.1fms -> %.1fms, shift=%.0f%%, KS p=%.4f)"
MOVED_TEXT = "Template frequency %s (%.1fx baseline, template_id=%s)"
LATENCY_WINDOW_MINUTES = 15


def _anomalies(
    found: DataFrame, kind: str, by: list[str], template: Column, description: Column, context: Column
) -> DataFrame:
    window = F.col("window_start") if "window_start" in by else F.col("detected_at")
    return found.select(
        S.stable_id(F.lit(kind), F.col("source"), template, window).alias("id"),
        F.lit(kind).alias("anomaly_type"),
        "severity",
        "score",
        "source",
        "detected_at",
        template.cast("string").alias("template_id"),
        description.alias("description"),
        F.to_json(context).alias("context"),
    )


def detect(
    current: DataFrame,
    baseline: Baseline,
    detected_at: Column,
    sources: DataFrame | None = None,
    samples: DataFrame | None = None,
    by: list[str] | None = None,
    window_minutes: int = 5,
) -> DataFrame:
    """All anomalies in observations ``current`` against ``baseline``.

    ``sources`` (name, sensitivity, anomaly_types) switches detectors per source and sets their sensitivity; sources
    not listed are skipped. Without it every detector runs with sensitivity 0.5. Sources without a baseline give
    nothing. ``samples`` (source, sample_lines) is attached to error-rate spikes.
    """
    by = by or ["source"]
    stats = baseline.stats.select("source", "error_rate_mean", "error_rate_std")
    if sources is None:
        sensitivity: Column | float = 0.5
    else:
        stats = stats.join(sources.select(F.col("name").alias("source"), "sensitivity"), "source")
        sensitivity = F.col("sensitivity")
    trained = stats.select("source")
    profile = D.window_profile(current, by)  # read by three detectors, over one shuffle
    shares = D.template_shares(profile, by).join(trained, "source", "left_semi")
    minutes = F.lit(window_minutes).alias("window_minutes")
    none = F.lit(None).cast("string")

    def at(found: DataFrame) -> DataFrame:
        return found.withColumn("detected_at", detected_at)

    spikes = at(D.error_rate_spikes(D.observed_rates(profile, by), stats, sensitivity, by))
    spikes = _anomalies(
        spikes,
        D.ERROR_RATE_SPIKE,
        by,
        none,
        F.format_string(
            SPIKE_TEXT, "z_score", "observed_rate", "baseline_rate"
        ),
        F.struct("observed_rate", "baseline_rate", "z_score", minutes),
    )
    novel = at(D.novel_patterns(shares, baseline.templates, by=by))
    novel = _anomalies(
        novel,
        D.NOVEL_PATTERN,
        by,
        F.col("template_id"),
        F.format_string(
            NOVEL_TEXT, "template_id", "count"
        ),
        F.struct("template_id", "count"),
    )
    slower = at(D.latency_shifts(current, baseline.latencies.join(trained, "source", "left_semi"), by))
    slower = _anomalies(
        slower,
        D.LATENCY_SHIFT,
        by,
        none,
        F.format_string(
            SHIFT_TEXT,
            "baseline_p99_ms",
            "current_p99_ms",
            "shift_percent",
            "ks_pvalue",
        ),
        F.struct(
            "baseline_p99_ms",
            "current_p99_ms",
            "ks_statistic",
            "ks_pvalue",
            "shift_percent",
            F.lit(LATENCY_WINDOW_MINUTES).alias("window_minutes"),
        ),
    )
    moved = at(D.frequency_deviations(shares, baseline.templates, by))
    moved = _anomalies(
        moved,
        D.FREQUENCY_DEVIATION,
        by,
        F.col("template_id"),
        F.format_string(
            MOVED_TEXT, "direction", "deviation_factor", "template_id"
        ),
        F.struct(
            "template_id",
            F.col("baseline_frequency").alias("template_frequency_baseline"),
            F.col("current_frequency").alias("template_frequency_current"),
            "deviation_factor",
            "direction",
        ),
    )
    found = spikes.unionByName(novel).unionByName(slower).unionByName(moved)
    if sources is not None:
        enabled = sources.select(F.col("name").alias("source"), F.explode("anomaly_types").alias("anomaly_type"))
        found = found.join(enabled, ["source", "anomaly_type"], "left_semi")
    empty = F.array().cast("array<string>")
    if samples is None:
        found = found.withColumn("sample_lines", empty)
    else:
        found = found.join(samples, "source", "left")
        shown = (F.col("anomaly_type") == D.ERROR_RATE_SPIKE) & F.col("sample_lines").isNotNull()
        found = found.withColumn("sample_lines", F.when(shown, F.col("sample_lines")).otherwise(empty))
    return found.withColumn("alerted", F.lit(False))


def run_detection(
    window: DataFrame,
    baseline: Baseline,
    as_of: Column,
    sources: DataFrame | None = None,
    window_minutes: int = 5,
    clusters: Clusters | None = None,
) -> DataFrame:
    """Detection over the log lines of one window. ``clusters`` are those that the baseline was trained with."""
    if clusters:
        window = with_templates(window, clusters)
    return detect(
        D.observations(window), baseline, as_of, sources, error_samples(window), window_minutes=window_minutes
    )
