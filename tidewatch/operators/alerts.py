"""Alerts: routing by severity, cooldown, message payloads. The result is an outbox; sending is up to the caller."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.session import cut_lineage

BRAND = "tidewatch"

# Cooldown, severity marks and colours, sample lengths.
COOLDOWN_MINUTES = 30
TELEGRAM_MARK = {"low": "\U0001f535", "medium": "\U0001f7e1", "high": "\U0001f7e0", "critical": "\U0001f534"}
TELEGRAM_OTHER = "⚪"
SLACK_COLOR = {"low": "#3498db", "medium": "#f39c12", "high": "#e67e22", "critical": "#e74c3c"}
SLACK_OTHER = "#95a5a6"
TELEGRAM_SAMPLES, TELEGRAM_SAMPLE_CHARS = 3, 200
EMAIL_SAMPLES, EMAIL_SAMPLE_CHARS = 5, 300

COOLDOWN_KEY = ["source", "anomaly_type", "template_key"]


def with_cooldown_key(anomalies: DataFrame) -> DataFrame:
    """Cooldowns run per source, type and template (empty for anomalies without one)."""
    if "template_id" in anomalies.columns:
        template = F.col("template_id")
    else:
        template = F.get_json_object("context", "$.template_id")
    return anomalies.withColumn("template_key", F.coalesce(template, F.lit("")))


def route(anomalies: DataFrame, channels: DataFrame) -> DataFrame:
    """Every anomaly with each channel that takes its severity; anomalies without a channel drop out.

    Channels are first spread over the severities they accept, which makes the join an equi-join on severity.
    """
    orders = F.array(*[F.struct(F.lit(n).alias("severity"), F.lit(o).alias("o")) for n, o in S.ROUTING_ORDER.items()])
    accepted = channels.withColumn("__level", F.explode(orders))
    accepted = accepted.filter(F.col("__level.o") >= S.routing_order(F.col("min_severity")))
    accepted = accepted.select("*", F.col("__level.severity").alias("severity")).drop("__level")
    return anomalies.join(accepted, "severity")


def routable(anomalies: DataFrame, channels: DataFrame) -> DataFrame:
    """Anomalies that at least one channel takes."""
    lowest = channels.agg(F.min(S.routing_order(F.col("min_severity"))).alias("__lowest"))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(o).alias("o")) for n, o in S.ROUTING_ORDER.items()]))
    severities = lowest.withColumn("__s", names).filter(F.col("__s.o") >= F.col("__lowest"))
    return anomalies.join(severities.select(F.col("__s.n").alias("severity")), "severity", "left_semi")


# --- cooldown -------------------------------------------------------------------------------------------------
#
# An alert goes out if none of its key went out less than the cooldown before. That is a chain through time, so the
# batch form cuts each key into chunks of time. For a chunk, the time of its last alert depends only on where the
# chain enters it, and that in steps: a later entry never gives an earlier end. Each chunk reports these steps, they
# are composed to those of longer stretches until few are left of a key, the chain's places are handed back down, and
# then every chunk picks its alerts knowing where the chain enters.
# Detection finds at most one anomaly per key and window, so a chunk holds at most as many as it has windows.


def _chain_ends(times: np.ndarray, cooldown: int) -> np.ndarray:
    """For each time as first alert: the last alert of the chain among ``times``."""
    ends = np.searchsorted(times, times + cooldown, side="left")
    own = np.arange(len(times))
    ends = np.where(ends < len(times), ends, own)
    while True:
        further = ends[ends]
        if (further == ends).all():
            return times[ends]
        ends = further


def _chain(times: np.ndarray, free_from: int, cooldown: int) -> list[int]:
    """Alerts among ``times`` when none may go out before ``free_from``."""
    kept = []
    at = int(np.searchsorted(times, free_from, side="left"))
    while at < len(times):
        kept.append(int(times[at]))
        at = int(np.searchsorted(times, times[at] + cooldown, side="left"))
    return kept


NEVER = -(2**62)
CHUNK_COOLDOWNS = 48
FAN = 32  # chunks, or blocks of chunks, that one task takes one after the other
KEY_SCHEMA = "source string, anomaly_type string, template_key string"


def _after(entries: np.ndarray, ends: np.ndarray, free_from: np.ndarray, cooldown: int) -> np.ndarray:
    """When the key is free again after a stretch of time that is entered free from ``free_from`` on."""
    step = np.searchsorted(entries, free_from, side="left")
    inside = step < len(entries)
    out = free_from.copy()
    out[inside] = ends[step[inside]] + cooldown
    return out


def _composed(parts: list[tuple[np.ndarray, np.ndarray]], cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """One stretch of time from consecutive ones, each given by its entries and where their chains end.

    Chains that have met stay together, so only the last entry of each different end is kept; ends lie in the last
    cooldown of the stretch, so their number does not grow with its length.
    """
    entries, ends = parts[0]
    for more, more_ends in parts[1:]:
        ends = np.append(_after(more, more_ends, ends + cooldown, cooldown) - cooldown, more_ends)
        entries = np.append(entries, more)
        last = np.append(ends[1:] != ends[:-1], True)
        entries, ends = entries[last], ends[last]
    return entries, ends


def _stretches(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches (block, entries, ends) in order of time."""
    ordered = pdf.sort_values(["block", "entry"]).groupby("block")
    return [(int(b), part["entry"].to_numpy(np.int64), part["chain_end"].to_numpy(np.int64)) for b, part in ordered]


def _chunk_starts(summary: DataFrame, blocks: int, starts: DataFrame, cooldown: int, fan: int) -> DataFrame:
    """From when on each key is free at the start of each of its chunks (``block``, ``free_from``).

    ``summary`` is a step function for each chunk: for what ``entry`` the chain ends where. The functions of ``fan`` neighbours
    are composed to that of a block, those of blocks to that of a larger block, until ``fan`` at most are left of a key. Then
    each block is entered with what its predecessors lead to, and hands its own start on to what it is made of. So a
    key's history takes a logarithmic number of joins, and no task has more of it than ``fan`` step functions.
    """
    above = F.floor(F.col("block") / fan).cast("bigint")
    functions = [summary]

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        entries, ends = _composed([(e, c) for _, e, c in _stretches(pdf)], cooldown)
        return pd.DataFrame({**dict(zip([*COOLDOWN_KEY, "block"], key)), "entry": entries, "chain_end": ends})

    while blocks > fan:
        lower = functions[-1].withColumn("above", above)
        schema = f"{KEY_SCHEMA}, block bigint, entry bigint, chain_end bigint"
        functions.append(cut_lineage(lower.groupBy(*COOLDOWN_KEY, "above").applyInPandas(compose, schema)))
        blocks = -(-blocks // fan)

    def enter(key: tuple, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        free_from = np.array([NEVER if start.empty else start["free_from"].iloc[0]], np.int64)
        out = []
        for block, entries, ends in _stretches(pdf):
            out.append((*key[: len(COOLDOWN_KEY)], block, int(free_from[0])))
            free_from = _after(entries, ends, free_from, cooldown)
        return pd.DataFrame(out, columns=[*COOLDOWN_KEY, "block", "free_from"])

    schema = f"{KEY_SCHEMA}, block bigint, free_from bigint"
    starts = functions[-1].groupBy(*COOLDOWN_KEY).cogroup(starts.groupBy(*COOLDOWN_KEY)).applyInPandas(enter, schema)
    for function in reversed(functions[:-1]):
        parts = function.withColumn("above", above).groupBy(*COOLDOWN_KEY, "above")
        starts = parts.cogroup(starts.groupBy(*COOLDOWN_KEY, "block")).applyInPandas(enter, schema)
    return starts


def cooldown_kept(
    anomalies: DataFrame, cooldown_minutes: int = COOLDOWN_MINUTES, running: DataFrame | None = None, fan: int = FAN
) -> DataFrame:
    """The anomalies that are alerted: those outside the cooldown of their key, in order of ``detected_at``.

    Of anomalies of a key at the same instant the one with the lowest id counts. ``running`` holds cooldowns from
    earlier runs (source, anomaly_type, template_key, expires_at). The time of each key is cut into chunks, see
    :func:`_chunk_starts`.
    """
    cooldown = cooldown_minutes * 60 * 1_000_000
    span = cooldown * CHUNK_COOLDOWNS
    keyed = with_cooldown_key(anomalies).withColumn("__t", F.unix_micros("detected_at"))
    instants = keyed.groupBy(*COOLDOWN_KEY, "__t").agg(F.min("id").alias("id"))
    times = instants.select(*COOLDOWN_KEY, F.floor(F.col("__t") / span).alias("block"), F.col("__t").alias("t"))
    ends = keyed.agg(F.floor(F.min("__t") / span).alias("first"), F.floor(F.max("__t") / span).alias("last")).first()
    first, last = (ends["first"], ends["last"]) if ends["first"] is not None else (0, 0)
    times = times.withColumn("block", F.col("block") - first)

    def steps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["t"].to_numpy())
        ends = _chain_ends(at, cooldown)
        last = np.append(ends[1:] != ends[:-1], True)
        return pd.DataFrame(
            {**dict(zip([*COOLDOWN_KEY, "block"], key)), "entry": at[last], "chain_end": ends[last]}
        )

    by_chunk = [*COOLDOWN_KEY, "block"]
    summary = times.groupBy(*by_chunk).applyInPandas(steps, f"{KEY_SCHEMA}, block bigint, entry bigint, chain_end bigint")
    if last - first + 1 > fan:
        summary = cut_lineage(summary)
    if running is None:
        expiry = times.sparkSession.createDataFrame([], f"{KEY_SCHEMA}, free_from bigint")
    else:
        expiry = running.select(*COOLDOWN_KEY, F.unix_micros("expires_at").alias("free_from"))
        expiry = expiry.groupBy(*COOLDOWN_KEY).agg(F.max("free_from").alias("free_from"))
        expiry = expiry.join(times.select(*COOLDOWN_KEY).distinct(), COOLDOWN_KEY, "left_semi")
    entry_points = _chunk_starts(summary, last - first + 1, expiry, cooldown, fan)

    def pick(key: tuple, pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        kept = _chain(np.sort(pdf["t"].to_numpy()), int(entry["free_from"].iloc[0]), cooldown)
        return pd.DataFrame({**dict(zip(COOLDOWN_KEY, key[:-1])), "__t": pd.Series(kept, dtype="int64")})

    picked = times.groupBy(*by_chunk).cogroup(entry_points.groupBy(*by_chunk))
    picked = picked.applyInPandas(pick, f"{KEY_SCHEMA}, __t bigint")
    kept = instants.join(picked, [*COOLDOWN_KEY, "__t"], "left_semi").select("id")
    return with_cooldown_key(anomalies).join(kept, "id", "left_semi")


def cooldowns(kept: DataFrame, cooldown_minutes: int = COOLDOWN_MINUTES) -> DataFrame:
    """Running cooldowns after these alerts, for the next run."""
    expires = F.max("detected_at") + F.make_dt_interval(mins=F.lit(cooldown_minutes))
    return kept.groupBy(*COOLDOWN_KEY).agg(expires.alias("expires_at"))


def active_cooldowns(running: DataFrame, as_of: Column) -> DataFrame:
    """Cooldowns that have not expired."""
    return running.filter(F.col("expires_at") > as_of)


def mark_alerted(anomalies: DataFrame, kept: DataFrame) -> DataFrame:
    sent = kept.select("id", F.lit(True).alias("__sent"))
    joined = anomalies.drop("alerted").join(sent, "id", "left")
    return joined.withColumn("alerted", F.coalesce("__sent", F.lit(False))).drop("__sent")


# --- payloads -------------------------------------------------------------------------------------------------


def _choose(severity: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, value in table.items():
        out = F.when(severity == name, F.lit(value)).otherwise(out)
    return out


def _title() -> Column:
    return F.replace(F.col("anomaly_type"), F.lit("_"), F.lit(" "))


def _score() -> Column:
    return F.format_string("%.2f", F.col("score"))


def _time() -> Column:
    return F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _lines(count: int, chars: int) -> Column:
    shown = F.slice("sample_lines", 1, count)
    return F.transform(shown, lambda line: F.concat(F.lit("  "), F.left(line, F.lit(chars))))


def telegram_payload() -> Column:
    head = F.concat_ws(
        "\n",
        F.concat(_choose(F.col("severity"), TELEGRAM_MARK, TELEGRAM_OTHER), F.lit(f" *{BRAND} alert*\n")),
        F.concat(F.lit("*Type:* "), _title()),
        F.concat(F.lit("*Severity:* "), F.col("severity")),
        F.concat(F.lit("*Source:* "), F.col("source")),
        F.concat(F.lit("*Score:* "), _score(), F.lit("\n")),
        F.concat(F.col("description"), F.lit("\n")),
    )
    samples = F.array_join(_lines(TELEGRAM_SAMPLES, TELEGRAM_SAMPLE_CHARS), "\n")
    block = F.concat(F.lit("\n*Sample lines:*\n```\n"), samples, F.lit("\n```"))
    text = F.concat(head, F.when(F.size("sample_lines") > 0, block).otherwise(""))
    return F.to_json(F.struct(text.alias("text"), F.lit("Markdown").alias("parse_mode")))


def slack_payload() -> Column:
    def text(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("text"))

    def line(name: str, value: Column) -> Column:
        return text("mrkdwn", F.concat(F.lit(f"*{name}:* "), value))

    fields = F.array(
        line("Severity", F.col("severity")), line("Source", F.col("source")), line("Score", _score()), line("Time", _time())
    )
    block = "struct<type:string,text:struct<type:string,text:string>,fields:array<struct<type:string,text:string>>>"
    header = text("plain_text", F.concat(F.lit(f"{BRAND}: "), _title()))
    blocks = F.array(
        F.struct(F.lit("header"), header, F.lit(None)).cast(block),
        F.struct(F.lit("section"), F.lit(None), fields).cast(block),
        F.struct(F.lit("section"), text("mrkdwn", F.col("description")), F.lit(None)).cast(block),
    )
    color = _choose(F.col("severity"), SLACK_COLOR, SLACK_OTHER)
    attachment = F.struct(color.alias("color"), blocks.alias("blocks"))
    return F.to_json(F.struct(F.array(attachment).alias("attachments")))


def email_payload() -> Column:
    subject = F.concat(
        F.lit(f"[{BRAND}] "), F.upper("severity"), F.lit(": "), _title(), F.lit(" on "), F.col("source")
    )
    head = F.concat_ws(
        "\n",
        F.lit(f"Anomaly detected by {BRAND}\n"),
        F.concat(F.lit("Type: "), F.col("anomaly_type")),
        F.concat(F.lit("Severity: "), F.col("severity")),
        F.concat(F.lit("Source: "), F.col("source")),
        F.concat(F.lit("Score: "), _score()),
        F.concat(F.lit("Time: "), _time(), F.lit("\n")),
        F.concat(F.col("description"), F.lit("\n")),
    )
    samples = F.concat(
        F.lit("\nSample lines:\n"), F.array_join(_lines(EMAIL_SAMPLES, EMAIL_SAMPLE_CHARS), "\n"), F.lit("\n")
    )
    body = F.concat(head, F.when(F.size("sample_lines") > 0, samples).otherwise(""))
    return F.to_json(F.struct(subject.alias("subject"), body.alias("body")))


def alertmanager_payload() -> Column:
    labels = F.struct(
        F.concat(F.lit(f"{BRAND}_"), F.col("anomaly_type")).alias("alertname"), F.col("severity"), F.col("source")
    )
    notes = F.struct(F.col("description").alias("summary"), F.col("score").cast("string").alias("score"))
    alert = F.struct(labels.alias("labels"), notes.alias("annotations"), _time().alias("startsAt"))
    return F.to_json(F.array(alert))


def outbox(anomalies: DataFrame, channels: DataFrame, cooldown_minutes: int = COOLDOWN_MINUTES, running: DataFrame | None = None) -> DataFrame:
    """Messages to send: anomalies some channel takes, outside their cooldown, once per channel."""
    kept = cooldown_kept(routable(anomalies, channels), cooldown_minutes, running)
    kind = F.col("channel_type")
    payload = (
        F.when(kind == "telegram", telegram_payload())
        .when(kind == "slack", slack_payload())
        .when(kind == "email", email_payload())
        .when(kind == "alertmanager", alertmanager_payload())
    )
    routed = route(kept, channels).filter(kind.isin("telegram", "slack", "email", "alertmanager"))
    return routed.select(F.col("id").alias("anomaly_id"), "channel_type", payload.alias("payload"))
