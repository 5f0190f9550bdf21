"""Streaming forms: scoring, confirmation across batches, alert log, service health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from fleethealth.operators.detector import Detector, health_score
from fleethealth.operators.regime import residual_z, residuals


def stream_score(rows: DataFrame, detector: Detector, means: DataFrame | None = None, spreads: DataFrame | None = None, sensors: list[str] = (), regime: list[str] = ()) -> DataFrame:
    """health_score, threshold and alarm of each arriving row; parameter tables are static joins."""
    z = residual_z(residuals(rows, means, list(sensors), list(regime)), spreads, list(sensors), list(regime)) if means is not None else rows
    return z.withColumn("health_score", health_score(detector)).withColumn("threshold", F.lit(detector.threshold)).withColumn("alarm", F.col("health_score") > F.col("threshold"))


def stream_confirm(scored: DataFrame, asset: str, time: str, persistence: int, delay: str = "10 minutes", idle_days: int = 90) -> DataFrame:
    """asset, time, run, alarm_confirmed: the run of alarms of a machine carries over from batch to batch.

    Rows come out at once, in the order in which they are met; a row older than the newest one seen of its machine is left out, as its
    place in the run is gone (``stream_confirm_ordered`` waits for such rows). Rows of equal time count one after the other. A machine
    that has been silent for ``idle_days`` of event time is forgotten, and its run begins anew."""
    kind = dict(scored.dtypes)[asset]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        run, last = state.get if state.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values("_t")
        out = []
        for t, stamp, on in zip(rows["_t"], rows["_time"], rows["_alarm"], strict=True):
            if last is not None and t < last:
                continue
            run, last = (run + 1 if on else 0), int(t)
            out.append((key[0], stamp, run, run >= persistence))
        if last is not None:
            state.update((run, last))
            state.setTimeoutTimestamp(max(last // 1000 + idle_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[asset, time, "run", "alarm_confirmed"])

    rows = scored.withWatermark(time, delay).select(asset, F.col(time).alias("_time"), F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.coalesce("alarm", F.lit(False)).alias("_alarm"))
    return rows.groupBy(asset).applyInPandasWithState(update, f"`{asset}` {kind}, `{time}` timestamp, run int, alarm_confirmed boolean", "run int, last long", "append", GroupStateTimeout.EventTimeTimeout)


class _InOrder(StatefulProcessor):
    """Holds a machine's rows until the watermark has passed them, then counts runs in order of time and ``tie``."""

    def __init__(self, names: list[str], tie_kind: str, persistence: int, idle_ms: int):
        self.names, self.tie_kind, self.persistence, self.idle_ms = names, tie_kind, persistence, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"t long, tie {self.tie_kind}, alarm boolean")
        self.counted = handle.getValueState("counted", "run int, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            held = [(int(t), tie, bool(alarm)) for t, tie, alarm in zip(frame["at_us"].tolist(), frame["tie_key"].tolist(), frame["alarm_on"].tolist(), strict=True)]
            if held:
                self.waiting.appendList(held)
                low = min(held, key=lambda r: r[0])[0]
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        run, last = self.counted.get() if self.counted.exists() else (0, None)
        out = []
        for t, tie, alarm in ready:
            run, last = (run + 1 if alarm else 0), t
            out.append((*key, pd.Timestamp(t, unit="us"), tie, run, run >= self.persistence))
        if ready:
            self.counted.update((run, last))
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        elif last is not None and (forget := last // 1000 + self.idle_ms) * 1000 <= passed:
            self.counted.clear()
        elif last is not None:
            self.handle.registerTimer(forget)
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_confirm_ordered(scored: DataFrame, asset: str, time: str, tie: str, persistence: int, delay: str = "10 minutes", idle_days: int = 90) -> DataFrame:
    """asset, time, tie, run, alarm_confirmed in order of time, then ``tie``, as ``confirm_alarm`` has them, however rows arrive.

    Rows that come late by no more than ``delay`` find their place: a machine's rows are held until the watermark has passed
    them, so a row comes out ``delay`` after its time; later ones than that are dropped by the watermark. A machine that has been silent for ``idle_days`` of event time is
    forgotten. State holds a machine's rows of one delay, and needs the RocksDB state store (``ROCKS_DB`` under ``STATE_STORE``)."""
    if scored.sparkSession.conf.get(STATE_STORE, None) != ROCKS_DB:
        raise ValueError(f"set {STATE_STORE} to {ROCKS_DB}")
    kinds = dict(scored.dtypes)
    rows = scored.withWatermark(time, delay).select(asset, time, F.unix_micros(F.col(time).cast("timestamp")).alias("at_us"), F.col(tie).alias("tie_key"), F.coalesce("alarm", F.lit(False)).alias("alarm_on"))
    processor = _InOrder([asset, time, tie, "run", "alarm_confirmed"], kinds[tie], persistence, idle_days * 86_400_000)
    schema = f"`{asset}` {kinds[asset]}, `{time}` timestamp, `{tie}` {kinds[tie]}, run int, alarm_confirmed boolean"
    return rows.groupBy(asset).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def stream_alert_log(alerts: DataFrame, acks: DataFrame | None = None, delay: str = "1 hour", wait: str = "7 days") -> DataFrame:
    """Alerts once each by id; with late acknowledgements joined within the wait, unanswered ones too."""
    once = alerts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["alert_id"])
    if acks is None:
        return once
    late = acks.withWatermark("acked_ts", delay).withColumnRenamed("alert_id", "ack_id")
    return once.join(late, F.expr(f"alert_id = ack_id AND acked_ts BETWEEN ts AND ts + INTERVAL {wait}"), "left_outer").drop("ack_id")


def stream_service_health(calls: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Calls, latency and cost of each endpoint in tumbling windows."""
    g = calls.withWatermark("ts", delay).groupBy(F.window("ts", width), "endpoint")
    return g.agg(F.count("*").alias("calls"), F.percentile_approx("latency_ms", 0.95).alias("p95_ms"), F.sum("cost_usd").alias("cost_usd")).select(F.col("window.start").alias("start"), "endpoint", "calls", "p95_ms", "cost_usd")
