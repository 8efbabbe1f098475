"""Delivery retries as keyed state: attempts, waits of 2^n minutes by timer, and an end after the fourth try."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import CHANNELS, MAX_ATTEMPTS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: a delivery that nobody attempts again is forgotten after a week
KEEP_MS = 7 * 24 * 3600 * 1000
UNIT_S = 60
STATE = T.StructType([T.StructField("attempts", T.IntegerType()), T.StructField("state", T.StringType()), T.StructField("next_retry_s", T.LongType())])
#: kind: "attempted" for each outcome that counted, "due" when a wait is over
CHANGE = T.StructType([T.StructField("delivery_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("state", T.StringType()),
                       T.StructField("last_error", T.StringType()), T.StructField("next_retry_s", T.LongType()), T.StructField("at_s", T.LongType())])


def after_attempt(attempts: int, channel: str | None, ok: bool, error: str | None, at_s: int, unit_s: int = UNIT_S) -> tuple[str, str | None, int | None]:
    """(state, last_error, next_retry_s) after one more attempt, the rule of ``alerts.advance_deliveries`` for one row."""
    tried = attempts + 1
    if channel not in CHANNELS:
        return "dead", f"no adapter for {channel}", None
    if ok:
        return "sent", None, None
    if tried >= MAX_ATTEMPTS:
        return "dead", error, None
    return "failed", error, at_s + 2**tried * unit_s


class RetryState(StatefulProcessor):
    """One delivery: every outcome moves it on, a timer says when the next attempt is due, and it is forgotten when it is over.

    Of the outcomes of one tick only as many as there are attempts left are held, the earliest; what comes after the end is
    ignored for as long as the end is remembered.
    """

    def __init__(self, unit_s: int = UNIT_S, keep_ms: int | None = KEEP_MS):
        self.unit_s, self.keep_ms = unit_s, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a time to live counts processing time, which a replay by event time does not have
        self.current = handle.getValueState("delivery", STATE, self.keep_ms) if self.keep_ms else handle.getValueState("delivery", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        attempts, state, _ = self.current.get() if self.current.exists() else (0, "queued", None)
        left = 0 if state in ("sent", "dead") else MAX_ATTEMPTS - attempts
        for row in heapq.nsmallest(left, rows, key=lambda r: (r.at_s, not r.ok, r.error or "")):
            if state in ("sent", "dead"):
                break
            state, error, retry = after_attempt(attempts, row.channel, row.ok, row.error, row.at_s, self.unit_s)
            attempts += 1
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            if retry is not None:
                self.handle.registerTimer(retry * 1000)
            self.current.update((attempts, state, retry))
            yield Row(delivery_id=key[0], kind="attempted", attempts=attempts, state=state, last_error=error, next_retry_s=retry, at_s=row.at_s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.current.exists():
            attempts, state, retry = self.current.get()
            if state == "failed":
                yield Row(delivery_id=key[0], kind="due", attempts=attempts, state=state, last_error=None, next_retry_s=retry, at_s=expiredTimerInfo.getExpiryTimeInMs() // 1000)

    def close(self) -> None:
        pass


def retry_stream(outcomes: DataFrame, replay: bool = False, unit_s: int = UNIT_S, delay: str = "0 seconds") -> DataFrame:
    """CHANGE rows from a stream of attempts (delivery_id, channel, ok, error, at_s).

    Live, waits end by the clock and a state lives for a week; the query needs a clock trigger then, since one that stops when
    nothing is left never stops while timers may fire. A replay of old attempts runs by their own time: a wait is over
    when the watermark has passed it.
    """
    use_rocks(outcomes.sparkSession)
    rows = outcomes.select(F.col("delivery_id").cast("long").alias("delivery_id"), "channel", "ok", "error", F.col("at_s").cast("long").alias("at_s"))
    if replay:
        rows = rows.withColumn("at", F.timestamp_seconds("at_s")).withWatermark("at", delay)
    return rows.groupBy("delivery_id").transformWithState(RetryState(unit_s, None if replay else KEEP_MS), CHANGE, "Update", "EventTime" if replay else "ProcessingTime")


def use_rocks(spark: SparkSession) -> None:
    """Timers and values with a time to live need this store; it also holds more state than memory."""
    spark.conf.set(PROVIDER, ROCKS)
