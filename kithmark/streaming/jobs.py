"""Job events as streams: parsed tails, windows with late data, and per-phase state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalar as S
from ..sources import tail as tail_source

EVENT = "job_id long, phase string, ts timestamp, done long, total long"


def tail(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """Events from JSON files as they arrive; the checkpoint is the cursor."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(path)


def follow(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """file, line_no (the line's byte offset), value of a folder's growing files; half-written lines are held back. The checkpoint is the cursor."""
    tail_source.register(spark)
    return spark.readStream.format("line_tail").option("suffix", suffix).load(path).withColumnRenamed("position", "line_no")


def throttle(events: DataFrame, gap_seconds: float) -> DataFrame:
    """Events at least gap_seconds after the last one emitted for their job and phase, and every final one (done >= total).

    Compares with the last emitted event, not the one before, so it keeps that one's time as state. Within a batch events
    are taken in order of (ts, done). A Pandas state function, as no window of built-in functions refers to its own output.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        keep = []
        for r in pd.concat(frames).sort_values(["ts", "done"]).itertuples(index=False):
            at = r.ts.timestamp()
            if last is None or at - last >= gap_seconds or r.done >= r.total:
                keep.append(r)
                last = at
        state.update((last,))
        yield pd.DataFrame(keep, columns=["job_id", "phase", "ts", "done", "total"])

    return events.groupBy("job_id", "phase").applyInPandasWithState(run, EVENT, "last double", "append", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, gap_seconds: float) -> DataFrame:
    """The same over a finished table.

    Partitions hold whole keys in order, so a task walks them with the last emitted time as its only state: a long job is
    sorted by Spark, which can spill, and passes in batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in frames:
            keep = []
            for job, phase, at, done, total in pdf[["job_id", "phase", "ts", "done", "total"]].itertuples(index=False, name=None):
                own = (None if job != job else job, phase)  # a missing number is one key, too
                if own != key:
                    key, last = own, None
                show = last is None or at - last >= gap_seconds or done >= total
                keep.append(show)
                last = at if show else last
            yield pdf[keep]

    ordered = events.repartition("job_id", "phase").sortWithinPartitions("job_id", "phase", "ts", "done")
    return ordered.mapInPandas(run, events.schema)


def windowed_counts(events: DataFrame, size: str, late: str, by: str = "phase") -> DataFrame:
    """Events in tumbling windows; what comes later than `late` is dropped once a window is closed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), by).agg(F.count("*").alias("n"), F.sum("done").alias("done"))


def sessions(events: DataFrame, gap: str, late: str, by: str = "job_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))


def once(events: DataFrame, key: list[str], late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


BEAT = "job_id long, phase string, space string, ts double, done long, total long, closing boolean, elapsed double, rate double"


def beats(events: DataFrame, interval: float) -> DataFrame:
    """The events that a long phase narrates: job_id, phase, space, ts, done, total, closing, elapsed, rate.

    events: job_id, line_no, ts (seconds), event, phase, space, done, total. A `phase` event starts its phase anew. The first `progress`
    after it is what rates are measured from and isn't narrated itself; then one is if `interval` seconds have passed since the last one, and so is
    every final one (done >= total), unless its phase took less than a second. The rate is that since the first progress, on a final one that of the whole phase.

    The last narrated event decides, not the one before, so a task walks whole phases in order with their few times as its only state.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, started, first, beat = None, None, None, None
        for pdf in frames:
            out = []
            for job, phase, space, at, event, done, total in pdf[["job_id", "phase", "space", "ts", "event", "done", "total"]].itertuples(index=False, name=None):
                own = (None if job != job else job, phase)  # a missing number is one key, too
                if own != key:
                    key, started, first, beat = own, None, None, None
                if event == "phase":
                    started, first, beat = at, None, at
                    continue
                if first is None:
                    first, started, beat = (at, done), at if started is None else started, at if beat is None else beat
                    continue
                final = total == total and total is not None and done >= total
                if not final and at - beat < interval:
                    continue
                beat, elapsed, span = at, at - started, at - first[0]
                if final and elapsed >= 1:
                    out.append((*own, space, at, done, total, True, elapsed, done / elapsed))
                elif not final:
                    out.append((*own, space, at, done, total, False, elapsed, (done - first[1]) / span if span > 0 else 0.0))
            yield pd.DataFrame(out, columns=["job_id", "phase", "space", "ts", "done", "total", "closing", "elapsed", "rate"]).astype({"job_id": "Int64", "done": "Int64", "total": "Int64"})

    told = events.filter("event IN ('phase', 'progress')").select("job_id", "line_no", "phase", "space", F.col("ts").cast("double").alias("ts"), "event", "done", "total")
    return told.repartition("job_id", "phase").sortWithinPartitions("job_id", "phase", "ts", "line_no").mapInPandas(run, BEAT)


def heartbeats(events: DataFrame, interval: float = 30.0) -> DataFrame:
    """job_id, phase, ts, message: beats() in words, with the time left where the total is known."""
    eta = (F.col("total") - F.col("done")) / F.col("rate")
    left = F.when((F.col("rate") > 0) & (F.col("total") > F.col("done")) & (eta >= 1), F.concat(F.lit(" · ETA "), S.human_duration(eta))).otherwise("")
    part = F.when(F.col("total") > 0, F.concat(F.lit("/"), F.col("total").cast("string"), F.lit(" ("), F.floor(F.col("done") * 100 / F.col("total")).cast("string"), F.lit("%)"))).otherwise("")
    fast = F.when(F.col("rate") > 0, F.concat(F.lit(" · "), S.human_rate(F.col("rate")))).otherwise("")
    whole = F.when(F.col("rate") > 0, F.concat(F.lit(" ("), S.human_rate(F.col("rate")), F.lit(")"))).otherwise("")
    where = F.when(F.col("space") != "", F.concat(F.lit("["), "space", F.lit("] "))).otherwise("")
    head = F.concat(where, "phase", F.lit(": "), F.col("done").cast("string"))
    closing = F.concat(head, F.lit(" done in "), S.human_duration(F.col("elapsed")), whole)
    return beats(events, interval).select("job_id", "phase", "ts", F.when(F.col("closing"), closing).otherwise(F.concat(head, part, fast, left)).alias("message"))
