"""Alert cooldown as keyed state: in the order in which anomalies come, or in that of event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.alerts import COOLDOWN_KEY, COOLDOWN_MINUTES, KEY_SCHEMA, with_cooldown_key


def stream_cooldown(
    anomalies: DataFrame, cooldown_minutes: int = COOLDOWN_MINUTES, lateness: str = "10 minutes"
) -> DataFrame:
    """Ids and times of the alerts of an anomaly stream; route anomalies before, so that only those count which a
    channel takes.

    State per key is one number, the end of its cooldown. It is dropped once the watermark has passed it.
    """
    cooldown = cooldown_minutes * 60 * 1_000_000

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        free_from = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        kept = []
        for t, name in zip(rows["t"], rows["id"]):
            if free_from is None or t >= free_from:
                kept.append((*key, name, t))
                free_from = int(t) + cooldown
        state.update((free_from,))
        state.setTimeoutTimestamp(max(free_from // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=[*COOLDOWN_KEY, "id", "t"])

    keyed = with_cooldown_key(anomalies).withWatermark("detected_at", lateness)
    keyed = keyed.select(*COOLDOWN_KEY, "id", "detected_at", F.unix_micros("detected_at").alias("t"))
    alerted = keyed.groupBy(*COOLDOWN_KEY).applyInPandasWithState(
        keep,
        "source string, anomaly_type string, template_key string, id string, t bigint",
        "free_from bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return alerted.withColumn("detected_at", F.timestamp_micros("t")).drop("t")


class OrderedCooldown(StatefulProcessor):
    """Anomalies of a key wait until the watermark has passed them and are then taken in order of time.

    State is the end of the key's cooldown and the instants that wait, each with its lowest id; input is put there
    batch by batch. A timer stands at the earliest of them.
    """

    def __init__(self, cooldown: int) -> None:
        self.cooldown = cooldown  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free_from = handle.getValueState("free_from", "t long")
        self.timer = handle.getValueState("timer", "ms long")
        self.waiting = handle.getMapState("waiting", "t long", "id string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            for t, name in chunk.groupby("t")["id"].min().items():
                known = self.waiting.getValue((t,))[0] if self.waiting.containsKey((t,)) else None
                if known is None or name < known:
                    self.waiting.updateValue((t,), (name,))
        yield self._released(key, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield self._released(key, timerValues)

    def _released(self, key: Any, timerValues: Any) -> pd.DataFrame:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((t[0], name[0]) for t, name in self.waiting.iterator())
        free_from = self.free_from.get()[0] if self.free_from.exists() else None
        kept = []
        for t, name in waiting:
            if t > passed:
                break
            self.waiting.removeKey((t,))
            if free_from is None or t >= free_from:
                kept.append((*key, name, t))
                free_from = t + self.cooldown
        rest = [t for t, _ in waiting if t > passed]
        if free_from is not None and (rest or free_from > passed):
            self.free_from.update((free_from,))
        elif self.free_from.exists():
            self.free_from.clear()
        # an end of cooldown that nothing waits for is forgotten when its time has come
        due = rest[0] if rest else free_from if free_from is not None and free_from > passed else None
        self._wake(None if due is None else due // 1000 + 1)
        return pd.DataFrame(kept, columns=[*COOLDOWN_KEY, "id", "t"])

    def _wake(self, ms: int | None) -> None:
        before = self.timer.get()[0] if self.timer.exists() else None
        if before == ms:
            return
        if before is not None:
            self.handle.deleteTimer(before)
            self.timer.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def close(self) -> None:
        pass


def stream_cooldown_in_order(
    anomalies: DataFrame, cooldown_minutes: int = COOLDOWN_MINUTES, lateness: str = "10 minutes"
) -> DataFrame:
    """Ids and times of the alerts of an anomaly stream, whatever the order in which anomalies come within ``lateness``:
    those of :func:`tidewatch.operators.alerts.cooldown_kept` over all rows that are not later than that.

    An alert comes out when the watermark has passed it. Start the query inside
    :func:`tidewatch.streaming.templates.state_in_rocksdb`.
    """
    keyed = with_cooldown_key(anomalies).withWatermark("detected_at", lateness)
    keyed = keyed.select(*COOLDOWN_KEY, "id", "detected_at", F.unix_micros("detected_at").alias("t"))
    alerted = keyed.groupBy(*COOLDOWN_KEY).transformWithStateInPandas(
        statefulProcessor=OrderedCooldown(cooldown_minutes * 60 * 1_000_000),
        outputStructType=f"{KEY_SCHEMA}, id string, t bigint",
        outputMode="append",
        timeMode="EventTime",
    )
    return alerted.withColumn("detected_at", F.timestamp_micros("t")).drop("t")
