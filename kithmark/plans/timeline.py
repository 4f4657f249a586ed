"""Queries over job events, schedules and other things in time."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import events
from ..streaming import jobs
from .registry import query
from .standins import Tables
from .storage import shared_dir


@query("SELECT line_no, CASE WHEN line_no % 11 = 0 THEN 'log' ELSE event END AS event, CASE WHEN line_no % 11 = 0 THEN NULL ELSE phase END AS phase, CASE WHEN line_no % 11 = 0 THEN NULL ELSE done END AS done, CASE WHEN line_no % 11 = 0 THEN 'malformed: oops' END AS message FROM job_events")
def evt_parse(t: Tables) -> DataFrame:
    lines = t.job_events.select("line_no", F.when(F.col("line_no") % 11 == 0, "oops").otherwise(F.to_json(F.struct("event", "phase", "done", "total"))).alias("value"))
    return events.parse(lines).select("line_no", "event", "phase", "done", "message")


@query("SELECT event, phase, done, count(*) AS n FROM job_events GROUP BY ALL")
def evt_tail(t):
    """Lines of files by way of the stream that follows them, parsed."""
    folder = f"{shared_dir(t.spark)}/kithmark/tail-{uuid4().hex}"
    t.job_events.select(F.to_json(F.struct("event", "phase", "space", "done", "total"))).write.text(f"{folder}/in")
    parsed = events.parse(jobs.follow(t.spark, f"{folder}/in", ".txt"))
    parsed.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return t.spark.read.schema(parsed.schema).parquet(f"{folder}/out").groupBy("event", "phase", "done").agg(F.count("*").alias("n"))


SEQ = "s AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE event WHEN 'error' THEN 1 WHEN 'result' THEN 2 ELSE 0 END, line_no) AS seq FROM job_events)"


@query(f"WITH {SEQ} SELECT job_id, line_no, seq FROM s")
def win_seq(t):
    return events.sequence(t.job_events).select("job_id", "line_no", "seq")


@query(f"WITH {SEQ} SELECT job_id, seq, event FROM s WHERE job_id = 7 AND seq > 20")
def evt_cursor(t):
    return events.sequence(t.job_events.filter("job_id = 7")).filter("seq > 20").select("job_id", "seq", "event")


@query("SELECT job_id, line_no FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY line_no DESC) <= 20")
def win_ring(t):
    return events.ring(t.job_events, 20).select("job_id", "line_no")


@query("SELECT job_id, phase, done, total, CAST(least(greatest(round_even(done * 100 / total, 0), 0), 100) AS BIGINT) AS percent FROM job_events WHERE event = 'progress' QUALIFY row_number() OVER (PARTITION BY job_id, phase ORDER BY line_no DESC) = 1")
def win_latest_phase(t):
    return events.latest_phase(t.job_events)


RUNS = """c AS (SELECT *, CASE WHEN phase IS NOT DISTINCT FROM lag(phase) OVER w AND space IS NOT DISTINCT FROM lag(space) OVER w THEN 0 ELSE 1 END AS c FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY line_no)), r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY job_id ORDER BY line_no) AS BIGINT) AS run FROM c)"""


@query(f"WITH {RUNS} SELECT job_id, run, phase, space, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n FROM r GROUP BY 1, 2, 3, 4")
def evt_phase_machine(t):
    return events.phase_runs(t.job_events)


@query("""WITH p AS (SELECT *, min(struct_pack(ts := ts, line_no := line_no, done := done)) OVER (PARTITION BY job_id, phase, space ORDER BY ts RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW) AS f, lag(struct_pack(ts := ts, line_no := line_no, done := done)) OVER (PARTITION BY job_id, phase, space ORDER BY ts, line_no) AS p FROM job_events WHERE event = 'progress'),
x AS (SELECT line_no, ts, done, CASE WHEN f.ts < ts THEN f ELSE p END AS f FROM p) SELECT line_no, round(CASE WHEN ts - f.ts > 0 THEN greatest(done - f.done, 0) / (ts - f.ts) END, 6) AS rate FROM x""")
def win_trailing_rate(t):
    return events.trailing_rate(t.job_events, 259_200)


FINAL = "f AS (SELECT job_id, CASE max_by(event, line_no) FILTER (event IN ('result', 'error')) WHEN 'result' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'lost' END AS state FROM job_events GROUP BY 1)"


@query(f"WITH {FINAL} SELECT job_id, state FROM f")
def evt_final(t):
    return events.final_state(t.job_events)


@query(f"WITH {FINAL.replace('FROM job_events GROUP', 'FROM job_events WHERE job_id % 2 = 0 OR event NOT IN (' + chr(39) + 'error' + chr(39) + ', ' + chr(39) + 'result' + chr(39) + ') GROUP')} SELECT job_id, 'error' AS event, 'ended without an error event: ' || state AS message FROM f WHERE state <> 'succeeded' AND job_id NOT IN (SELECT job_id FROM job_events WHERE event = 'error' AND job_id % 2 = 0)")
def evt_synth_error(t):
    seen = t.job_events.filter("job_id % 2 = 0 OR event NOT IN ('error', 'result')")
    return events.synthesize_errors(seen, events.final_state(seen))


LOCK = "a AS (SELECT event_id AS id, user_id, event_type = 'purchase' AS ok FROM events), i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY id) AS g FROM a), n AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, g ORDER BY id) AS n FROM i)"


@query(f"WITH {LOCK} SELECT id, user_id, CASE WHEN ok THEN CAST(0 AS BIGINT) ELSE CAST(least(2 * pow(2, n - 1), 300) AS BIGINT) END AS lock FROM n")
def win_backoff(t):
    return events.backoff(t.events.select(F.col("event_id").alias("id"), "user_id", (F.col("event_type") == "purchase").alias("ok")))


@query("SELECT id, schedule_id, fired_at FROM schedule_runs QUALIFY row_number() OVER (PARTITION BY schedule_id ORDER BY fired_at DESC, id DESC) <= 20")
def win_retention(t):
    return events.keep_newest(t.schedule_runs, "schedule_id").select("id", "schedule_id", "fired_at")


@query("SELECT id, next_run_at FROM schedules WHERE enabled = 1 AND next_run_at <= 1704100000")
def flt_due(t):
    return events.due(t.schedules, 1_704_100_000).select("id", "next_run_at")


@query("SELECT id, CASE WHEN next_run_at IS NULL THEN 'fill' WHEN next_run_at < 1704100000 - 300 THEN 'missed' ELSE 'keep' END AS boot FROM schedules WHERE enabled = 1")
def evt_missed(t):
    return events.missed(t.schedules, 1_704_100_000)


TICK = """d AS (SELECT id, job, next_run_at, job IN (SELECT p_type FROM part WHERE p_partkey IN (5, 6)) AS busy FROM schedules WHERE enabled = 1 AND next_run_at <= 1704100000), n AS (SELECT *, NOT busy AND row_number() OVER (PARTITION BY job ORDER BY next_run_at, id) = 1 AS free FROM d),
p AS (SELECT *, sum(CASE WHEN free THEN 1 ELSE 0 END) OVER (ORDER BY next_run_at, id) AS place FROM n)"""


@query(f"WITH {TICK} SELECT id, CASE WHEN free AND place + 2 <= 5 THEN 'submitted' ELSE 'skipped' END AS status FROM p")
def evt_due_fire(t):
    return events.tick(t.schedules, t.part.filter("p_partkey IN (5, 6)").select(F.col("p_type").alias("job")), 1_704_100_000)


@query("""SELECT id, CASE WHEN enabled = 1 AND next_run_at <= 1704100000 THEN 1704100000 // 86400 * 86400 + id % 24 * 3600 + id % 60 * 60 + CASE WHEN id % 24 * 3600 + id % 60 * 60 > 1704100000 % 86400 // 60 * 60 THEN 0 ELSE 86400 END ELSE next_run_at END AS next_run_at FROM schedules""")
def evt_manual(t):
    """Runs by hand beside those that are due: only the due ones' schedules move on, each to its own next time."""
    every = F.concat_ws(" ", (F.col("id") % 60).cast("string"), (F.col("id") % 24).cast("string"), F.lit("* * *"))
    plans = t.schedules.select("id", "job", "enabled", "next_run_at", every.alias("expression"), F.lit("UTC").alias("zone"))
    return events.fire(plans, plans.filter("id % 2 = 0").select("id"), t.part.filter("p_partkey IN (5, 6)").select(F.col("p_type").alias("job")), 1_704_100_000)[1]


def duration_sql(s: str) -> str:
    return f"(CASE WHEN {s} < 60 THEN CAST(CAST(round_even({s}, 0) AS BIGINT) AS VARCHAR) || 's' WHEN {s} < 3600 THEN printf('%dm %02ds', CAST(floor({s}) AS BIGINT) // 60, CAST(floor({s}) AS BIGINT) % 60) ELSE printf('%dh %02dm', CAST(floor({s}) AS BIGINT) // 3600, CAST(floor({s}) AS BIGINT) // 60 % 60) END)"


def rate_sql(v: str) -> str:
    return f"(CASE WHEN {v} >= 1 THEN printf('%.1f/s', {v}) WHEN {v} > 0 THEN printf('%.1f/min', {v} * 60) ELSE '0/s' END)"


@query(f"""WITH RECURSIVE n AS (SELECT job_id, phase, space, CAST(ts AS DOUBLE) AS ts, event, done, total, row_number() OVER (PARTITION BY job_id, phase ORDER BY ts, line_no) AS r FROM job_events WHERE event IN ('phase', 'progress')),
g AS (SELECT job_id, phase, space, ts, event, done, total, r, ts AS started, CASE WHEN event = 'progress' THEN ts END AS t0, CASE WHEN event = 'progress' THEN done END AS d0, ts AS beat, false AS shown FROM n WHERE r = 1
UNION ALL SELECT n.job_id, n.phase, n.space, n.ts, n.event, n.done, n.total, n.r, CASE WHEN n.event = 'phase' THEN n.ts ELSE g.started END,
  CASE WHEN n.event = 'phase' THEN NULL ELSE coalesce(g.t0, n.ts) END, CASE WHEN n.event = 'phase' THEN NULL ELSE coalesce(g.d0, n.done) END,
  CASE WHEN n.event = 'phase' THEN n.ts WHEN g.t0 IS NOT NULL AND (n.done >= n.total OR n.ts - g.beat >= 21600) THEN n.ts ELSE g.beat END,
  n.event = 'progress' AND g.t0 IS NOT NULL AND (n.done >= n.total AND n.ts - g.started >= 1 OR n.done < n.total AND n.ts - g.beat >= 21600)
  FROM g JOIN n ON n.job_id = g.job_id AND n.phase = g.phase AND n.r = g.r + 1),
m AS (SELECT *, ts - started AS elapsed, CASE WHEN done >= total THEN done / (ts - started) WHEN ts > t0 THEN (done - d0) / (ts - t0) ELSE 0 END AS rate FROM g WHERE shown),
e AS (SELECT *, CASE WHEN rate > 0 AND total > done THEN (total - done) / rate ELSE 0 END AS eta FROM m)
SELECT job_id, phase, ts, '[' || space || '] ' || phase || ': ' || done || CASE WHEN done >= total THEN ' done in ' || {duration_sql("elapsed")} || CASE WHEN rate > 0 THEN ' (' || {rate_sql("rate")} || ')' ELSE '' END
  ELSE '/' || total || ' (' || (done * 100 // total) || '%)' || CASE WHEN rate > 0 THEN ' · ' || {rate_sql("rate")} ELSE '' END || CASE WHEN eta >= 1 THEN ' · ETA ' || {duration_sql("eta")} ELSE '' END END AS message FROM e""")
def win_heartbeat(t):
    """What a long phase says: a line every six hours here, with rate and time left, and a closing one."""
    return jobs.heartbeats(t.job_events, 6 * 3600)


@query("SELECT event_type AS stage, n, round(seconds, 6) AS seconds, round(seconds * 1000 / n, 6) AS ms_each, round(seconds * 100 / sum(seconds) OVER (), 6) AS percent FROM (SELECT event_type, count(*) AS n, sum(value) AS seconds FROM events WHERE event_id >= 50 GROUP BY 1)")
def agg_bench(t):
    return events.stage_benchmark(t.events.select(F.col("event_id").alias("i"), F.col("event_type").alias("stage"), F.col("value").alias("seconds")), 50)


@query("SELECT event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day_start, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def evt_daily_windows(t):
    """Tumbling windows in batch: the same expression that the stream runs under a watermark."""
    got = t.events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return got.select("event_type", F.unix_timestamp("w.start").alias("day_start"), "n", F.round("v", 4).alias("value"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS c FROM events), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS n FROM s GROUP BY user_id, s""")
def evt_sessions(t):
    got = t.events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.unix_timestamp("w.start").alias("started"), "n")


@query("""WITH RECURSIVE n AS (SELECT job_id, phase, ts, done, total, row_number() OVER (PARTITION BY job_id, phase ORDER BY ts, done) AS r FROM job_events WHERE event = 'progress'),
g AS (SELECT job_id, phase, ts, done, total, r, ts AS last, true AS shown FROM n WHERE r = 1 UNION ALL SELECT n.job_id, n.phase, n.ts, n.done, n.total, n.r, CASE WHEN n.ts - g.last >= 21600 OR n.done >= n.total THEN n.ts ELSE g.last END, n.ts - g.last >= 21600 OR n.done >= n.total FROM g JOIN n ON n.job_id = g.job_id AND n.phase = g.phase AND n.r = g.r + 1)
SELECT job_id, phase, ts, done, total FROM g WHERE shown""")
def win_throttle(t):
    """Progress at least six hours after the last one shown for its job and phase, and every final one."""
    return jobs.throttled(t.job_events.filter("event = 'progress'").select("job_id", "phase", "ts", "done", "total"), 6 * 3600)
