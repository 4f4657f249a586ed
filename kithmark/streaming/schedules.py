"""Schedules as a stream: each keeps its own plan as state and fires by its own timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.cron import fire_times

#: Seconds by which a next run may lie in the past when a schedule comes in and still be made up for.
GRACE = 300
PLAN = "expression string, zone string, enabled boolean, next_run_at long"
RUN = "id long, fired_at long, status string, next_run_at long"


def following(expression: str, zone: str, after: int) -> int | None:
    return next(iter(fire_times(expression, zone, after, 1)), None)


class Clockwork(StatefulProcessor):
    """State of a schedule: its expression, zone, whether it is enabled, and its next run, for which a timer is set."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plan = handle.getValueState("plan", PLAN)

    def _set(self, expression: str | None, zone: str | None, enabled: bool, at: int | None) -> None:
        self.plan.update((expression, zone, enabled, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if enabled and at is not None:
            self.handle.registerTimer(at * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples(index=False):
            now = int(r.at.timestamp())
            if r.kind == "set":
                at, enabled = None if pd.isna(r.next_run_at) else int(r.next_run_at), bool(r.enabled)
                if enabled and (at is None or at < now - GRACE):
                    late, at = at is not None, following(r.expression, r.zone, now)
                    if late:
                        out.append((key[0], now, "missed", at))
                self._set(r.expression, r.zone, enabled, at)
            elif r.kind == "manual" and self.plan.exists():  # one more run; the next one stays where it is
                out.append((key[0], now, "manual", self.plan.get()[3]))
            elif r.kind == "drop":
                self._set(None, None, False, None)
                self.plan.clear()
        yield pd.DataFrame(out, columns=["id", "fired_at", "status", "next_run_at"]).astype({"id": "int64", "fired_at": "int64", "next_run_at": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        if not self.plan.exists():
            return
        expression, zone, enabled, at = self.plan.get()
        if not enabled or at is None or at > now:
            return
        after = following(expression, zone, now)
        self._set(expression, zone, enabled, after)
        yield pd.DataFrame({"id": [key[0]], "fired_at": [now], "status": ["due"], "next_run_at": pd.array([after], "Int64")})

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """Timers and value state are kept by RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_schedules(events: DataFrame) -> DataFrame:
    """RUN rows as schedules fire. events, a stream: id, at (timestamp), kind, expression, zone, enabled, next_run_at.

    ``set`` brings a schedule in: without a next run it gets one, and one that lies more than GRACE seconds back is missed, not made up for. ``manual`` runs
    it by hand, ``drop`` ends it, and any other kind only moves the clock, which is the watermark of `at`. A schedule that is due fires once, however often
    it should have since, and moves on to its first time after the clock. Which of what is due finds a place in the queue is for tick() to say, batch by batch.
    """
    with_state_store(events.sparkSession)
    return events.withWatermark("at", "0 seconds").groupBy("id").transformWithStateInPandas(Clockwork(), RUN, "Append", "EventTime")
