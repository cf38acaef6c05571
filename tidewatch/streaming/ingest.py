"""Streams of raw lines and scrapes into stored tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch import schemas
from tidewatch.functions import parsing as P
from tidewatch.functions import scalars as S
from tidewatch.operators.templates import assign_shapes
from tidewatch.sources.envelopes import http_log_lines, loki_log_lines, otlp_metric_samples
from tidewatch.sources.prometheus import prometheus_samples
from tidewatch.sources.store import conform, log_rows, write_batch
from tidewatch.sources.textlogs import number_lines


def ingest_logs(
    lines: DataFrame, ingested_at: Column | None = None, line_format: Column | None = None, year: int | None = None
) -> DataFrame:
    """Raw lines (source, line_number, line) to log rows: parse, stamp, assign templates. Batch or stream.

    A projection without shuffles or Python. Back-pressure comes from the source's rate limit; nothing is dropped
    except lines that cannot be parsed. ``line_format`` names the format (see :func:`format_of`); lines for which it is
    null are parsed as what they look like. ``year`` is that of syslog lines, by default the current one.
    """
    now = F.current_timestamp() if ingested_at is None else ingested_at
    parsed = P.parse_each(lines, line_format, year=datetime.now().year if year is None else year)
    parsed = parsed.withColumns(
        {"timestamp": S.with_ingest_default(S.parse_timestamp(F.col("timestamp")), now), "ingested_at": now}
    )
    return log_rows(assign_shapes(parsed), now)


def format_of(formats: dict[str, str]) -> Column:
    """The configured format of a line's source; null for the others."""
    out = F.lit(None).cast("string")
    for source, name in formats.items():
        out = F.when(F.col("source") == source, name).otherwise(out)
    return out


def write_logs(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    source: Column | None = None,
    once: bool = False,
    formats: dict[str, str] | None = None,
) -> StreamingQuery:
    """Parse the lines of :func:`tidewatch.sources.textlogs.stream_log_files` into the log table.

    Lines are numbered per file within their micro-batch, which holds whole files. ``source`` names the source from
    the file's path; by default it is the file name up to the first dot. ``formats`` gives the format of sources that
    are not to be recognised line by line.
    """
    name = F.regexp_extract("path", r"([^/.]+)[^/]*$", 1) if source is None else source

    def append(batch: DataFrame, batch_id: int) -> None:
        numbered = number_lines(batch).select(name.alias("source"), "line_number", "line")
        rows = ingest_logs(numbered, line_format=format_of(formats or {}))
        write_batch(rows, path, batch_id, F.coalesce("timestamp", "ingested_at"))

    writer = lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _write_bodies(
    rows: Callable[[DataFrame], DataFrame], bodies: DataFrame, path: str, checkpoint: str, once: bool
) -> StreamingQuery:
    """What ``rows`` makes of each micro-batch of landed bodies, into the table at ``path`` by day."""

    def append(batch: DataFrame, batch_id: int) -> None:
        made = rows(batch)
        day = F.coalesce(*[c for c in ("timestamp", "ingested_at") if c in made.columns])
        write_batch(made, path, batch_id, day)

    writer = bodies.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_http_logs(
    bodies: DataFrame, path: str, checkpoint: str, once: bool = False, formats: dict[str, str] | None = None
) -> StreamingQuery:
    """Lines of landed JSON log posts (body, and x_source if known) into the log table."""

    def rows(batch: DataFrame) -> DataFrame:
        return ingest_logs(http_log_lines(batch), line_format=format_of(formats or {}))

    return _write_bodies(rows, bodies, path, checkpoint, once)


def write_loki_logs(
    bodies: DataFrame,
    matchers: list[tuple[str, dict[str, str]]],
    path: str,
    checkpoint: str,
    once: bool = False,
    formats: dict[str, str] | None = None,
) -> StreamingQuery:
    """Lines of landed Loki pushes (body) whose labels match a source into the log table."""

    def rows(batch: DataFrame) -> DataFrame:
        return ingest_logs(loki_log_lines(batch, matchers), line_format=format_of(formats or {}))

    return _write_bodies(rows, bodies, path, checkpoint, once)


def write_otlp_metrics(bodies: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Samples of landed OTLP metric exports (body, received_at) into the metric table."""

    def rows(batch: DataFrame) -> DataFrame:
        return conform(otlp_metric_samples(batch, F.col("received_at")), schemas.METRIC_SAMPLES)

    return _write_bodies(rows, bodies, path, checkpoint, once)


def write_scrapes(
    bodies: DataFrame,
    path: str,
    checkpoint: str,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Samples of landed scrapes (body_id, source, body, scraped_at) into the metric table."""

    def rows(batch: DataFrame) -> DataFrame:
        return conform(prometheus_samples(batch, F.col("scraped_at"), include, exclude), schemas.METRIC_SAMPLES)

    return _write_bodies(rows, bodies, path, checkpoint, once)
