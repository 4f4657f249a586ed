"""Job events, schedules and other things in time, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cron
from .ids import running_sum


def parse(lines: DataFrame) -> DataFrame:
    """JSON lines (value) as events; what isn't an object becomes a log event that says so."""
    body = F.from_json("value", "event string, phase string, space string, done bigint, total bigint, ts double, message string")
    object_ = F.trim("value").startswith("{") & body["event"].isNotNull()
    pick = lambda c, other=None: F.when(object_, body[c]).otherwise(F.lit(other)).alias(c)
    return lines.select("line_no", pick("event", "log"), pick("phase"), pick("done"), pick("total"), F.when(object_, body["message"]).otherwise(F.concat(F.lit("malformed: "), F.substring("value", 1, 40))).alias("message"))


def sequence(events: DataFrame) -> DataFrame:
    """events with seq from 1 in each job: by source rank, then line."""
    rank = F.when(F.col("event") == "error", 1).when(F.col("event") == "result", 2).otherwise(0)
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("job_id").orderBy(rank, "line_no")).cast("long"))


def ring(events: DataFrame, n: int) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("line_no")))
    return events.withColumn("r", newest).filter(F.col("r") <= n).drop("r")


def latest_phase(events: DataFrame) -> DataFrame:
    """job_id, phase, done, total, percent (0 to 100, half to even) of each phase's last progress."""
    last = events.filter("event = 'progress'").groupBy("job_id", "phase").agg(F.max_by(F.struct("done", "total"), "line_no").alias("l"))
    percent = F.least(F.greatest(F.bround(F.col("l.done") * 100 / F.col("l.total")), F.lit(0.0)), F.lit(100.0)).cast("long")
    return last.select("job_id", "phase", "l.done", "l.total", F.when(F.col("l.total") > 0, percent).alias("percent"))


def phase_runs(events: DataFrame) -> DataFrame:
    """job_id, run, phase, space, first_line, last_line, n: unbroken runs of one phase and space."""
    by = Window.partitionBy("job_id").orderBy("line_no")
    changed = ~(F.col("phase").eqNullSafe(F.lag("phase").over(by)) & F.col("space").eqNullSafe(F.lag("space").over(by)))
    runs = events.withColumn("c", changed.cast("long")).withColumn("run", F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("job_id", "run", "phase", "space").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n"))


def trailing_rate(events: DataFrame, seconds: int) -> DataFrame:
    """line_no, rate: done per second over the trailing window of each job, phase and space, or since the sample before."""
    by = Window.partitionBy("job_id", "phase", "space")
    trail, step = by.orderBy("ts").rangeBetween(-seconds, 0), by.orderBy("ts", "line_no")
    got = events.filter("event = 'progress'").select("*", F.min(F.struct("ts", "line_no", "done")).over(trail).alias("f"), F.lag(F.struct("ts", "line_no", "done")).over(step).alias("p"))
    f = F.when(F.col("f.ts") < F.col("ts"), F.col("f")).otherwise(F.col("p"))
    span = F.col("ts") - f["ts"]
    return got.select("line_no", F.round(F.when(span > 0, F.greatest(F.col("done") - f["done"], F.lit(0)) / span), 6).alias("rate"))


def final_state(events: DataFrame) -> DataFrame:
    """job_id, state: the last result or error decides; neither means lost."""
    ends = F.when(F.col("event").isin("result", "error"), F.col("event"))
    last = events.groupBy("job_id").agg(F.max_by(ends, F.when(ends.isNotNull(), F.col("line_no"))).alias("last"))
    return last.select("job_id", F.when(F.col("last") == "result", "succeeded").when(F.col("last") == "error", "failed").otherwise("lost").alias("state"))


def synthesize_errors(events: DataFrame, states: DataFrame) -> DataFrame:
    """job_id of jobs that failed or got lost without an error event."""
    return states.filter("state <> 'succeeded'").join(events.filter("event = 'error'").select("job_id"), "job_id", "left_anti").select("job_id", F.lit("error").alias("event"), F.concat(F.lit("ended without an error event: "), "state").alias("message"))


def backoff(attempts: DataFrame, base: int = 2, most: int = 300) -> DataFrame:
    """id, lock: seconds that a failed attempt locks its user out: doubling with each failure in a row. attempts: id, user_id, ok."""
    by = Window.partitionBy("user_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    islands = attempts.withColumn("island", F.sum(F.col("ok").cast("int")).over(by))
    n = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("user_id", "island").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    lock = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), n - 1), F.lit(float(most))).cast("long")
    return islands.withColumn("n", n).select("id", "user_id", F.when(F.col("ok"), 0).otherwise(lock).cast("long").alias("lock"))


def due(schedules: DataFrame, now: int) -> DataFrame:
    return schedules.filter((F.col("enabled") == 1) & (F.col("next_run_at") <= now)).orderBy("next_run_at", "id")


def missed(schedules: DataFrame, now: int, grace: int = 300) -> DataFrame:
    """id, boot: missed (too long ago, not made up for), fill (no next run yet), keep."""
    return schedules.filter("enabled = 1").select("id", F.when(F.col("next_run_at").isNull(), "fill").when(F.col("next_run_at") < now - grace, "missed").otherwise("keep").alias("boot"))


def tick(schedules: DataFrame, running: DataFrame, now: int, most: int = 5) -> DataFrame:
    """id, status of what is due: skipped if its job runs or the queue is full, else submitted; earlier ones first.

    running: job. One schedule of a job goes through in a tick; places in the queue are taken in order.
    """
    rows = due(schedules, now).select("id", "job", "next_run_at").join(running.select("job", F.lit(True).alias("busy")).distinct(), "job", "left")
    nth = F.row_number().over(Window.partitionBy("job").orderBy("next_run_at", "id"))
    rows = rows.withColumn("free", F.col("busy").isNull() & (nth == 1))
    rows = running_sum(rows.withColumn("one", F.col("free").cast("int")), ["next_run_at", "id"], "one", "before")
    used = running.count()
    return rows.select("id", F.when(F.col("free") & (F.col("before") + used < most), "submitted").otherwise("skipped").alias("status"))


def fire(schedules: DataFrame, asked: DataFrame, running: DataFrame, now: int, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(runs: id, fired_at, manual, status; schedules: id, next_run_at) after a tick at `now`.

    What is due fires by tick() and moves on to its expression's first time after now, whether it was submitted or skipped. asked: ids to run by hand (id);
    each takes a place behind the due ones, if its job is free, and leaves its schedule where it was. schedules: id, job, enabled, next_run_at, expression, zone.
    """
    went = tick(schedules, running, now, most)
    busy = running.select("job").unionByName(schedules.join(went.filter("status = 'submitted'"), "id", "left_semi").select("job")).distinct()
    used = running.count() + went.filter("status = 'submitted'").count()
    by_hand = schedules.join(asked.select("id").distinct(), "id", "left_semi").select("id", "job").join(busy.withColumn("busy", F.lit(True)), "job", "left")
    nth = F.row_number().over(Window.partitionBy("job").orderBy("id"))
    by_hand = running_sum(by_hand.withColumn("one", (F.col("busy").isNull() & (nth == 1)).cast("int")), ["id"], "one", "before")
    by_hand = by_hand.select("id", F.lit(now).cast("long").alias("fired_at"), F.lit(True).alias("manual"), F.when((F.col("one") == 1) & (F.col("before") + used < most), "submitted").otherwise("skipped").alias("status"))
    runs = went.select("id", F.lit(now).cast("long").alias("fired_at"), F.lit(False).alias("manual"), "status").unionByName(by_hand)
    moved = cron.fires(due(schedules, now).select("id", "expression", "zone", F.lit(now).cast("long").alias("now")), "expression", "zone", "now", 1).select("id", "fire")
    return runs, schedules.join(moved, "id", "left").select("id", F.coalesce("fire", "next_run_at").alias("next_run_at"))


def keep_newest(runs: DataFrame, group: str, n: int = 20) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("fired_at"), F.desc("id")))
    return runs.withColumn("r", newest).filter(F.col("r") <= n).drop("r")


def stage_benchmark(rows: DataFrame, warmup: int) -> DataFrame:
    """stage, n, seconds, ms_each, percent over rows (i, stage, seconds) after the warm-up."""
    kept = rows.filter(F.col("i") >= warmup).groupBy("stage").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))
    total = F.sum("seconds").over(Window.partitionBy(F.lit(0)))
    return kept.select("stage", "n", F.round("seconds", 6).alias("seconds"), F.round(F.col("seconds") * 1000 / F.col("n"), 6).alias("ms_each"), F.round(F.try_divide(F.col("seconds") * 100, total), 6).alias("percent"))
