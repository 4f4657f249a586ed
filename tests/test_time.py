"""Tails of growing files, cron fires, heartbeats and picture hashes against plain versions."""

import json
import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithmark.functions import cron, pictures
from kithmark.sources import tail
from kithmark.streaming import jobs

# ---- tails ---------------------------------------------------------------------------------


def drain(spark, folder, to):
    got = jobs.follow(spark, str(folder))
    got.writeStream.format("parquet").option("checkpointLocation", f"{to}/cursor").trigger(availableNow=True).start(f"{to}/out").awaitTermination()
    return sorted((r.file, r.line_no, r.value) for r in spark.read.schema(got.schema).parquet(f"{to}/out").collect())


def test_torn_lines_arrive_whole_and_once(spark, tmp_path):
    """Files grow by pieces that end anywhere; each drain is a query started anew from the checkpoint."""
    rnd, folder = random.Random(1), tmp_path / "in"
    folder.mkdir()
    texts = {f"{k}.jsonl": "".join(json.dumps({"n": i, "s": "é" * rnd.randrange(30)}, ensure_ascii=False) + "\n" for i in range(40)) + "last" for k in "ab"}
    data = {name: text.encode() for name, text in texts.items()}
    (folder / "other.txt").write_text("not followed\n")
    at = dict.fromkeys(data, 0)
    while any(at[name] < len(data[name]) for name in data):
        for name, body in data.items():
            n = rnd.randrange(600, 900)
            with open(folder / name, "ab") as f:
                f.write(body[at[name] : at[name] + n])
            at[name] = min(len(body), at[name] + n)
        got = drain(spark, folder, tmp_path)
        for name in data:  # all whole lines so far, at their places
            body = data[name][: at[name]]
            assert [(p, v) for f, p, v in got if f == name] == list(places(body[: body.rfind(b"\n") + 1]))
    (folder / "a.jsonl.done").touch()
    got = drain(spark, folder, tmp_path)
    assert [v for f, _, v in got if f == "a.jsonl"] == texts["a.jsonl"].split("\n") and [v for f, _, v in got if f == "b.jsonl"] == texts["b.jsonl"].split("\n")[:-1]


def places(body):
    at = 0
    for line in body.split(b"\n")[: body.count(b"\n")]:
        yield at, line.decode()
        at += len(line) + 1


@pytest.mark.parametrize("part", [1, 7, 50, 10_000])
def test_parts_of_a_file_have_each_line_once(tmp_path, monkeypatch, part):
    monkeypatch.setattr(tail, "PART", part)
    monkeypatch.setattr(tail, "STEP", 5)
    body = b"".join(b"x" * (i * 7 % 23) + b"\n" for i in range(60)) + b"rest"
    (tmp_path / "a.jsonl").write_bytes(body)
    reader = tail.LineTailReader(str(tmp_path), ".jsonl")
    end = reader.latestOffset()
    got = [(p, v) for s in reader.partitions({}, end) for _, p, v in reader.read(s)]
    assert end == {"a.jsonl": len(body) - 4} and got == list(places(body))
    (tmp_path / "a.jsonl.done").touch()
    more = [v for s in reader.partitions(end, reader.latestOffset()) for _, _, v in reader.read(s)]
    assert more == ["rest"]


def test_empty_folders_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_bytes(b"")
    (tmp_path / "in" / "b.jsonl").write_bytes(b"half")
    assert drain(spark, tmp_path / "in", tmp_path) == []


# ---- cron ----------------------------------------------------------------------------------


def minute_walk(expression, zone, start, n):
    """Fires by looking at every wall clock minute after the last one."""
    c, tz, out = cron.parse(expression), ZoneInfo(zone), []
    at = datetime.fromtimestamp(start, tz).replace(second=0, microsecond=0, tzinfo=None)
    while len(out) < n:
        at += timedelta(minutes=1)
        dom, dow = at.day in c.days, (at.weekday() + 1) % 7 in c.weekdays
        day = (dom or dow) if not (c.any_day or c.any_weekday) else (dom or c.any_day) and (dow or c.any_weekday)
        if at.month in c.months and day and at.hour in c.hours and at.minute in c.minutes:
            out.append(int(at.replace(tzinfo=tz).timestamp()))
            at = datetime.fromtimestamp(out[-1], tz).replace(tzinfo=None)
    return out


def test_fires_match_a_minute_walk_across_clock_changes(spark):
    spring, autumn = 1711760000, 1729900000  # days before Berlin's changes of 2024
    plans = [(k, e, z, s) for k, (e, z, s) in enumerate((e, z, s) for e in ("30 2 * * *", "*/20 1-3 * * *", "0 12 1,15 * mon", "59 23 28-31 * *", "@hourly") for z in ("Europe/Berlin", "UTC", "America/New_York") for s in (spring, autumn + 1234))]
    df = spark.createDataFrame([*plans, (99, None, "UTC", 0), (98, "0 0 30 2 *", "UTC", 0)], "id long, expression string, zone string, start long")
    got = {}
    for r in cron.fires(df, "expression", "zone", "start", 7).collect():
        got.setdefault(r.id, []).append(r.fire)
    assert got == {k: minute_walk(e, z, s, 7) for k, e, z, s in plans}


# ---- heartbeats ----------------------------------------------------------------------------


def test_heartbeats_of_a_job(spark):
    rows = [(1, 1, 0.0, "phase", "load", "", None, None), (1, 2, 5.0, "progress", "load", "", 10, 100), (1, 3, 20.0, "progress", "load", "", 20, 100), (1, 4, 31.0, "progress", "load", "", 36, 100), (1, 5, 45.0, "progress", "load", "", 50, 100),
            (1, 6, 61.0, "progress", "load", "", 66, 100), (1, 7, 80.0, "progress", "load", "", 100, 100), (1, 8, 90.0, "phase", "load", "shared", None, None), (1, 9, 90.1, "progress", "load", "shared", 1, 2), (1, 10, 90.5, "progress", "load", "shared", 2, 2),
            (2, 1, 0.0, "progress", "scan", None, 0, None), (2, 2, 40.0, "progress", "scan", None, 4, None), (2, 3, 50.0, "log", "scan", None, None, None), (2, 4, 70.0, "progress", "scan", None, 4, 0)]
    events = spark.createDataFrame(rows, "job_id long, line_no long, ts double, event string, phase string, space string, done long, total long")
    got = sorted((r.job_id, r.ts, r.message) for r in jobs.heartbeats(events).collect())
    assert got == [
        (1, 31.0, "load: 36/100 (36%) · 1.0/s · ETA 1m 04s"), (1, 61.0, "load: 66/100 (66%) · 1.0/s · ETA 34s"), (1, 80.0, "load: 100 done in 1m 20s (1.2/s)"),
        (2, 40.0, "scan: 4 · 6.0/min"), (2, 70.0, "scan: 4 done in 1m 10s (3.4/min)"),
    ]
    assert jobs.heartbeats(events.limit(0)).count() == 0


# ---- pictures ------------------------------------------------------------------------------


def plain_hash(pixels):
    """By the sums of the transform's definition."""
    p, n = np.array(pixels, float).reshape(32, 32), np.arange(32)
    low = [sum(p[i, j] * np.cos(np.pi * u * (2 * i + 1) / 64) * np.cos(np.pi * v * (2 * j + 1) / 64) for i in n for j in n) for u in range(8) for v in range(8)]
    median = (sorted(low)[31] + sorted(low)[32]) / 2
    return f"{int(''.join('1' if x > median else '0' for x in low), 2):016x}"


def test_picture_hashes(spark):
    rng = np.random.default_rng(2)
    shots = [rng.integers(0, 256, 1024).tolist() for _ in range(4)] + [((np.add.outer(np.arange(32), np.arange(32)) * 4 + rng.integers(0, 9, (32, 32))) % 256).ravel().tolist()]
    df = spark.createDataFrame([(k, [float(x) for x in s]) for k, s in enumerate(shots)] + [(50, None), (51, [1.0])], "id long, pixels array<double>")
    got = {r.id: r.h for r in df.select("id", pictures.picture_hash(F.col("pixels")).alias("h")).collect()}
    assert got == {k: plain_hash(s) for k, s in enumerate(shots)} | {50: None, 51: None}
    flat = spark.createDataFrame([(0, [0.0] * 1024)], "id long, pixels array<double>")  # nothing is more than the median
    assert flat.select(pictures.picture_hash(F.col("pixels")).alias("h")).first().h == "0" * 16
