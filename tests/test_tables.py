"""SQLite files as tables, review items of a run, and schedules fired by hand, against plain versions."""

import sqlite3

from pyspark.sql import functions as F

from kithmark.operators import events, runs
from kithmark.sources import sqlite

ROWS = [(k if k % 7 else None, f"n'{k}\"", k / 4 if k % 5 else None, bytes([k])) for k in range(-20, 90) if k >= 0 or k % 3 == 0 for k in [abs(k)]]


def test_tables_come_back_and_filters_go_down(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, name string, value double, raw binary").repartition(3)
    sqlite.write_table(df, str(tmp_path), "the table")
    files = sqlite.files_of(str(tmp_path))
    assert len(files) == 3
    got = sqlite.read_table(spark, str(tmp_path), "the table", "id", span=13)
    key = lambda r: (str(r[0]), r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(ROWS, key=key) and got.rdd.getNumPartitions() > 6
    kept = got.filter((F.col("id") >= 10) & (F.col("value") < 12.5) & F.col("name").isin("n'11\"", "n'13\"", "n'80\"") & F.col("raw").isNotNull())
    assert sorted((r.id, r.value) for r in kept.collect()) == sorted((r[0], r[2]) for r in ROWS if r[0] in (11, 13) and r[2] is not None)
    assert got.filter("id IS NULL").count() == sum(r[0] is None for r in ROWS)
    assert got.filter(F.length("name") > 4).count() == sum(len(r[1]) > 4 for r in ROWS)  # stays with Spark


def test_what_is_pushed(tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as c:
        c.execute("CREATE TABLE t (id INTEGER, s TEXT)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(i, str(i)) for i in range(10)])
    reader = sqlite.SqliteReader(str(tmp_path), "t", "id", 4, ["s"])
    left = list(reader.pushFilters([sqlite.ds.GreaterThan(("id",), 3), sqlite.ds.In(("s",), ("5", "7")), sqlite.ds.StringContains(("s",), "x"), sqlite.ds.EqualTo(("a", "b"), 1)]))
    assert [type(f).__name__ for f in left] == ["StringContains", "EqualTo"]
    assert sorted(r for p in reader.partitions() for r in reader.read(p)) == [("5",), ("7",)]
    assert [(p.low, p.high) for p in reader.partitions()] == [(None, 4), (4, 8), (8, None)]


def test_runs_propose_nothing_twice(spark):
    a = spark.createDataFrame([(1, 5, "assign", 0.9), (2, 5, "low_confidence", 0.1), (3, 6, "assign", 0.8)], "face_id long, person_id long, kind string, confidence double")
    r = spark.createDataFrame([(4, 5, 6, 0.7)], "face_id long, from_person_id long, person_id long, confidence double")
    n = spark.createDataFrame([(9, 2, k, f) for k, f in ((1, 30), (2, 31))], "cluster long, size long, rank long, face_id long")
    within, between = spark.createDataFrame([(5, 6, 1), (1001, 2, 1)], "a long, b long, cluster long"), spark.createDataFrame([(5, 6, 0.9), (1, 1002, 0.8)], "a long, b long, similarity double")
    names = spark.createDataFrame([(5, "Eve"), (6, "Ada"), (2, " "), (1001, "Max")], "person_id long, name string")
    old = spark.createDataFrame([("assign", "3:6"), ("reassign", "1:5"), ("new_person", "30")], "kind string, identity string")
    got = [tuple(x) for x in runs.review_items(a, r, n, runs.merges(within, between), names, old, 100).orderBy("item_id").select("item_id", "kind", "identity", "payload_json").collect()]
    assert [g[:3] for g in got] == [(100, "assign", "1:5"), (101, "low_confidence", "2:5"), (102, "reassign", "4:6"), (103, "new_person", "30,31"), (104, "merge", "1:1002"), (105, "merge_named", "5:6"), (106, "merge", "1001:2")]
    assert got[2][3] == '{"face_id":4,"from_person_id":5,"from_person_name":"Eve","person_id":6,"person_name":"Ada"}'
    again = spark.createDataFrame([({"low_confidence": "assign", "merge_named": "merge"}.get(k, k), i) for _, k, i, _ in got] + [("assign", "3:6")], "kind string, identity string")
    assert runs.review_items(a, r, n, runs.merges(within, between), names, again).count() == 0


def test_runs_by_hand_leave_their_schedules(spark):
    rows = [(1, "a", 1, 100, "0 0 * * *"), (2, "b", 1, 10_000_000, "0 0 * * *"), (3, "a", 0, 50, "0 0 * * *"), (4, "c", 1, 90, "30 5 * * *"), (5, "d", 1, 80, "* * * * *"), (6, "e", 1, None, "@daily")]
    plans = spark.createDataFrame([(*r, "UTC") for r in rows], "id long, job string, enabled long, next_run_at long, expression string, zone string")
    went, left = events.fire(plans, spark.createDataFrame([(2,), (3,), (6,), (2,)], "id long"), spark.createDataFrame([("d",)], "job string"), 86_400 * 3 + 61, 4)
    assert sorted((r.id, r.manual, r.status) for r in went.collect()) == [(1, False, "submitted"), (2, True, "submitted"), (3, True, "skipped"), (4, False, "submitted"), (5, False, "skipped"), (6, True, "skipped")]
    assert {r.id: r.next_run_at for r in left.collect()} == {1: 86_400 * 4, 2: 10_000_000, 3: 50, 4: 86_400 * 3 + 5 * 3600 + 1800, 5: 86_400 * 3 + 120, 6: None}
