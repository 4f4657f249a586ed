"""Schedules that fire by timers against the batch tick."""

from datetime import UTC, datetime

from kithmark.operators import events
from kithmark.streaming import schedules

EVENT = "id long, at timestamp, kind string, expression string, zone string, enabled boolean, next_run_at long"
DAY = 86_400


def stamp(seconds):
    return datetime.fromtimestamp(seconds, UTC)


def test_timers_fire_as_the_batch_tick_does(spark, tmp_path):
    t0 = 10 * DAY
    plans = [(1, "0 * * * *", True, t0 + 3600), (2, "30 5 * * *", True, t0 + 100), (3, "0 0 * * *", True, t0 + 9 * DAY), (4, "0 0 * * *", False, t0 + 10), (5, "@hourly", True, None), (6, "@daily", True, t0 - 1000)]
    steps = [
        [(i, stamp(t0), "set", e, "UTC", on, at) for i, e, on, at in plans],
        [(0, stamp(t0 + 7300), "clock", None, None, None, None)],
        [(3, stamp(t0 + 7301), "manual", None, None, None, None), (0, stamp(t0 + 7400), "clock", None, None, None, None)],
        [(1, stamp(t0 + 7401), "drop", None, None, None, None), (0, stamp(t0 + 12_000), "clock", None, None, None, None)],
        [(0, stamp(t0 + 12_001), "clock", None, None, None, None)],
    ]
    live = schedules.run_schedules(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in/*"))
    out = []
    for k, rows in enumerate(steps):  # each step is a query started anew from the checkpoint
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        live.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cursor").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        found = [tuple(r) for r in spark.read.schema(schedules.RUN).parquet(f"{tmp_path}/out").collect()]
        out.append(sorted(set(found)))
        assert len(found) == len(set(found))
    at = lambda status: sorted((i, n) for i, _, s, n in out[-1] if s == status)
    assert at("missed") == [(6, 11 * DAY)] and at("manual") == [(3, t0 + 9 * DAY)]
    # What was due at the clock of the second step, by the batch tick.
    known = [(i, f"job{i}", 1 if on else 0, {5: t0 + 3600, 6: 11 * DAY}.get(i, n), e, "UTC") for i, e, on, n in plans]
    table = spark.createDataFrame(known, "id long, job string, enabled long, next_run_at long, expression string, zone string")
    went, moved = events.fire(table, table.limit(0).select("id"), table.limit(0).select("job"), t0 + 7300)
    due = {r.id for r in went.filter("status = 'submitted'").collect()}
    assert {i for i, f, s, _ in out[-1] if s == "due" and f == t0 + 7300} == due == {1, 2, 5}
    assert {i: n for i, f, s, n in out[-1] if s == "due" and f == t0 + 7300} == {r.id: r.next_run_at for r in moved.collect() if r.id in due}
    assert {i for i, f, s, _ in out[-1] if s == "due" and f > t0 + 7400} == {5}  # the first one was dropped
