"""Operators of the library on small frames, against brute force."""

import hashlib
import json
import math
import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithmark.functions import cron
from kithmark.functions import scalar as S
from kithmark.operators import cells, crossref, dedupe, density, events, graph, library, review, whispers
from kithmark.sources import readers
from kithmark.streaming import jobs

PHOTO = "space string, id long, sha256 string, deleted long, width long, height long, filesize long"


def test_exact_groups_keep_the_largest(spark):
    rows = [("a", 1, "x", 0, 1000, 1000, 500), ("a", 2, "x", 0, 2000, 2000, 100), ("a", 3, "x", 0, 2000, 2000, 999), ("a", 4, "y", 0, 1, 1, 1), ("a", 5, None, 0, 1, 1, 1), ("a", 6, "y", 1, 1, 1, 1), ("b", 7, "y", 0, 1, 1, 1)]
    got = dedupe.exact_groups(spark.createDataFrame(rows, PHOTO)).collect()
    assert {r.id: r.keep for r in got} == {1: False, 2: False, 3: True}
    drops = dedupe.drop_ids(dedupe.exact_groups(spark.createDataFrame(rows, PHOTO)))
    assert tuple(dedupe.reclaimable(spark.createDataFrame(rows, PHOTO), drops).first()) == (2, 600)


@pytest.mark.parametrize(("hashes", "threshold", "groups"), [(["0" * 16, "0" * 15 + "1", "f" * 16], 5, [[0, 1]]), (["0" * 16, "0" * 15 + "f"], 2, []), (["0" * 16, "0" * 15 + "f"], 4, [[0, 1]]), (["0" * 16, "0" * 15 + "3", "0" * 15 + "f"], 2, [[0, 1, 2]])])
def test_visual_groups(spark, hashes, threshold, groups):
    got = {}
    for r in dedupe.visual_groups(spark.createDataFrame(list(enumerate(hashes)), "id long, hash string"), threshold).collect():
        got.setdefault(r.component, []).append(r.id)
    assert sorted(sorted(g) for g in got.values()) == groups


def test_hamming_pairs_match_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    items = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8))) for x in base for _ in range(3)]
    got = {(r.a, r.b): r.distance for r in dedupe.hamming_pairs(spark.createDataFrame([(i, f"{x:016x}") for i, x in enumerate(items)], "id long, hash string"), 6).collect()}
    assert got == {(i, j): (items[i] ^ items[j]).bit_count() for i in range(len(items)) for j in range(i + 1, len(items)) if (items[i] ^ items[j]).bit_count() <= 6}


@pytest.mark.parametrize("rows", [1, 10_000, 10**6, 10**8])
def test_hamming_segments_of_all_sizes_find_the_same(spark, rows):
    rng = random.Random(rows)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    items = sorted({x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for x in base for _ in range(6)})
    df = spark.createDataFrame([(i, f"{x:016x}") for i, x in enumerate(items)] + [(900, None)], "id long, hash string")
    got = [(r.a, r.b, r.distance) for r in dedupe.hamming_pairs(df, 5, rows=rows).collect()]
    assert sorted(got) == [(i, j, (items[i] ^ items[j]).bit_count()) for i in range(len(items)) for j in range(i + 1, len(items)) if (items[i] ^ items[j]).bit_count() <= 5]


def test_hamming_pairs_meet_few_candidates():
    """Values probed times the chance to meet, over random hashes."""
    for rows in (10_000, 10**6, 10**8):
        met = sum(sum(math.comb(w, d) for d in range(r + 1)) / 2**w for _, w, r in dedupe.segments(5, rows))
        assert met < 0.01 and met * rows < 2000


def test_text_hashes_by_hand(spark):
    texts = {1: "a b c d e", 2: "a b c d e", 3: "", 4: "one", 5: "a  b", 6: None, 7: " ".join(str(i) for i in range(3000))}
    want = {}
    for i, text in texts.items():
        if text is not None:
            w = text.split(" ")
            h = [int(hashlib.md5(" ".join(w[j : j + 3]).encode()).hexdigest()[:16], 16) for j in range(len(w))]
            want[i] = f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"
    got = {r.id: r.hash for r in dedupe.text_hashes(spark.createDataFrame(list(texts.items()), "id long, text string")).collect()}
    assert got == want
    folded = {r.hash: (r.id, r.copies) for r in dedupe.fold_hashes(dedupe.text_hashes(spark.createDataFrame(list(texts.items()), "id long, text string"))).collect()}
    assert folded[want[1]] == (1, 2) and len(folded) == 5


def unit(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("n", "k", "block"), [(40, 5, 2048), (25, 4, 7), (3, 10, 2)])
def test_knn_matches_brute_force(spark, n, k, block):
    x = unit(np.random.default_rng(3), n, 8)
    got = {(r.src, r.rank): (r.dst, r.similarity) for r in cells.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"), k, block).collect()}
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    assert len(got) == n * min(k, n - 1)
    for (i, r), (j, s) in got.items():
        assert j == np.argsort(-sims[i], kind="stable")[r - 1] and s == pytest.approx(sims[i, j])


def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.repeat(np.eye(16)[:3], 15, axis=0) + rng.normal(scale=0.1, size=(45, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


def test_clusters_of_three_blobs(spark):
    x = blobs(spark)
    near = cells.neighbours(x, 10)
    for least, n in ((0.5, 3), (0.9999, 45)):
        labels = graph.relabel(whispers.chinese_whispers(x, graph.threshold_edges(near, least)))
        got = {r.id: r.cluster for r in labels.collect()}
        assert len(set(got.values())) == n
    sync = graph.spread_labels(x, graph.threshold_edges(near, 0.5), 10).collect()
    assert all(r.label // 15 == r.id // 15 for r in sync)


def test_dense_groups_of_one_component(spark):
    """Three cliques in a chain are three clusters; a clique by itself doesn't split, so it is noise, as are ids without edges."""
    near = [(i, j, 0.9 - abs(i - j) / 1000) for base in (0, 6, 12, 30) for i in range(base, base + 6) for j in range(base, base + 6) if i != j]
    near += [(a, b, 0.2) for x, y in ((5, 6), (11, 12)) for a, b in ((x, y), (y, x))] + [(50, 0, 0.9)]
    got = density.hdbscan(spark.createDataFrame([(i,) for i in [*range(18), *range(30, 36), 50]], "id long"), spark.createDataFrame(near, "src long, dst long, similarity double"), 3)
    assert {r.id: r.label for r in got.collect()} == {i: i // 6 * 6 for i in range(18)} | dict.fromkeys([*range(30, 36), 50])


def test_components_of_a_long_chain(spark):
    ids = list(range(200))
    random.Random(2).shuffle(ids)
    chain = [(a, b) for a, b in zip(ids, ids[1:], strict=False)] + [(1000, 1001)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {i: 0 for i in ids} | {1000: 1000, 1001: 1000}


def test_fusion_needs_all_models(spark):
    rows = [(1, "b", [0.0, 2.0]), (1, "a", [3.0, 4.0]), (2, "a", [1.0, 0.0]), (3, "a", [0.0, 0.0]), (3, "b", [1.0, 0.0])]
    v = spark.createDataFrame(rows, "face_id long, model string, vec array<float>")
    got = {r.face_id: r.vec for r in graph.fuse(library.complete_models(v)).collect()}
    assert set(got) == {1, 3} and got[1] == pytest.approx([0.6 / 2**0.5, 0.8 / 2**0.5, 0.0, 1 / 2**0.5]) and got[3] == pytest.approx([0, 0, 1, 0])


BOX = "g long, face_id long, detector string, x double, y double, w double, h double, det_score double"


def test_nms_and_union_of_detections(spark):
    rows = [(1, 1, "scrfd", 0.0, 0.0, 100.0, 100.0, 0.9), (1, 2, "scrfd", 10.0, 0.0, 100.0, 100.0, 0.8), (1, 3, "scrfd", 300.0, 0.0, 100.0, 100.0, 0.7), (2, 4, "scrfd", 0.0, 0.0, 100.0, 100.0, 0.5)]
    assert {r.face_id for r in crossref.nms(spark.createDataFrame(rows, BOX), ["g"]).collect()} == {1, 3, 4}
    both = [(1, 1, "scrfd", 0.0, 0.0, 100.0, 100.0, 0.9), (1, 2, "yolo", 5.0, 0.0, 100.0, 100.0, 0.6), (1, 3, "yolo", 4.0, 0.0, 100.0, 100.0, 0.8), (1, 4, "yolo", 500.0, 0.0, 10.0, 100.0, 0.8), (2, 5, "yolo", 0.0, 0.0, 50.0, 50.0, 0.4)]
    got = {r.face_id: (r.detector, r.det_score_secondary) for r in crossref.detect_union(spark.createDataFrame(both, BOX), ["g"]).collect()}
    assert got == {1: ("merged", 0.8), 2: ("yolo", None), 5: ("yolo", None)}


def test_greedy_match_is_one_to_one(spark):
    rows = [("a", 1, 1, 0, 10, 5, 0.9), ("a", 1, 1, 1, 11, 6, 0.8), ("a", 1, 2, 0, 10, 5, 0.85), ("a", 1, 2, 1, 11, 6, 0.4), ("a", 1, 3, 1, 11, 6, 0.4)]
    pairs = spark.createDataFrame(rows, "space string, photo_id long, face_id long, position long, syno_face_id long, person_id long, iou double")
    assert {(r.face_id, r.position) for r in crossref.greedy_match(pairs).collect()} == {(1, 0), (3, 1)}


def test_metrics_of_perfect_and_mixed_clusters(spark):
    m = crossref.cluster_metrics(spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 2)], "cluster long, person_id long")).first()
    assert set(m) == {1.0}
    rows = [(1, 1), (1, 2), (1, 1), (2, 2), (2, 2), (3, 1)]
    m = crossref.cluster_metrics(spark.createDataFrame(rows, "cluster long, person_id long")).first()
    same = lambda f: [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if f(a, b)]
    tp, pc, pp = len(same(lambda a, b: a == b)), len(same(lambda a, b: a[0] == b[0])), len(same(lambda a, b: a[1] == b[1]))
    assert m.pairwise_precision == pytest.approx(tp / pc) and m.pairwise_recall == pytest.approx(tp / pp)
    assert m.bcubed_precision == pytest.approx(np.mean([sum(a == b for b in rows) / sum(a[0] == b[0] for b in rows) for a in rows]))


def test_breaker_counts_failures_in_a_row(spark):
    said = ["failed"] * 4 + ["skipped", "applied"] + ["failed", "skipped"] * 5 + ["applied", "failed"]
    rows = [(1, i, o) for i, o in enumerate(said)] + [(2, 0, "failed")]
    got = review.breaker(spark.createDataFrame(rows, "g long, i long, outcome string"), ["g"], "i").collect()
    assert max(r.i for r in got if r.g == 1) == 14 and sum(r.g == 2 for r in got) == 1


def test_orphans_need_a_reference_and_lose_all(spark):
    q = [(1, "pending", '{"face_id":1}'), (2, "pending", '{"face_ids":[1,2]}'), (3, "pending", "junk"), (4, "pending", "{}"), (5, "pending", '{"face_ids":["x",9]}'), (6, "pending", '{"evidence":{"exemplars":{"a:1":[1],"b:2":[7]}}}')]
    queue = spark.createDataFrame(q, "item_id long, status string, payload_json string")
    states = spark.createDataFrame([(1, "lost"), (2, "ok")], "face_id long, state string")
    assert {r.item_id for r in review.orphans(queue, states).collect()} == {1, 5, 6}


def brute_next(after, cron_, zone):
    t = datetime.fromtimestamp(after, UTC) + timedelta(minutes=1)
    t = t.replace(second=0)
    for _ in range(60 * 24 * 400):
        w = t.astimezone(ZoneInfo(zone))
        day_ok = w.month in cron_.months
        dom, dow = w.day in cron_.days, (w.weekday() + 1) % 7 in cron_.weekdays
        day_ok &= (dom or dow) if not (cron_.any_day or cron_.any_weekday) else (dom or cron_.any_day) and (dow or cron_.any_weekday)
        if day_ok and w.hour in cron_.hours and w.minute in cron_.minutes:
            return int(t.timestamp())
        t += timedelta(minutes=1)


@pytest.mark.parametrize("expression", ["0 3 * * *", "*/15 8-9 * * mon-fri", "30 6 1,15 * sun", "@weekly", "0 12 29 feb *", "5/20 0 ? * 7"])
def test_cron_matches_a_minute_by_minute_walk(spark, expression):
    starts = [1_704_067_200 + i * 400_003 for i in range(6)] + [1_704_067_200]
    got = cron.next_fire(spark.createDataFrame([(s,) for s in starts], "at long"), "at", expression, horizon=400).collect()
    assert {r["at"]: r.next_fire for r in got} == {s: brute_next(s, cron.parse(expression), "UTC") for s in starts}


def test_cron_across_clock_changes(spark):
    gap, overlap = int(datetime(2026, 3, 28, 12, tzinfo=UTC).timestamp()), int(datetime(2026, 10, 24, 12, tzinfo=UTC).timestamp())
    got = {r["at"]: r.next_fire for r in cron.next_fire(spark.createDataFrame([(gap,), (overlap,)], "at long"), "at", "30 2 * * *", "Europe/Amsterdam", 10).collect()}
    assert got == {gap: int(datetime(2026, 3, 29, 1, 30, tzinfo=UTC).timestamp()), overlap: int(datetime(2026, 10, 25, 0, 30, tzinfo=UTC).timestamp())}


@pytest.mark.parametrize("bad", ["* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *", "* * * foo *"])
def test_cron_refuses(bad):
    with pytest.raises(ValueError):
        cron.parse(bad)


def test_scalars(spark):
    row = spark.range(1).select(
        S.hamming64(F.lit("8000000000000000"), F.lit("7fffffffffffffff")).alias("h"), S.human_duration(F.lit(4020)).alias("d"), S.human_bytes(F.lit(1536)).alias("b"), S.console_line(F.lit("a\r\x1b[1mb \r ")).alias("c"),
        S.console_line(F.lit("  ")).alias("e"), S.crop_url(F.lit("/data/x/1.jpg"), "/data/").alias("u"), S.crop_url(F.lit("/other/1.jpg"), "/data").alias("n"), S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"),
    ).first()
    assert tuple(row) == (64, "1h 07m", "1.5 KB", "b", "", "/crops/x/1.jpg", None, 0.0)


@pytest.mark.parametrize(("seconds", "said"), [(59.7, "60s"), (-3.0, "0s"), (0.5, "0s"), (61.9, "1m 01s"), (3600.0, "1h 00m"), (7379.9, "2h 02m")])
def test_durations(spark, seconds, said):
    assert spark.range(1).select(S.human_duration(F.lit(seconds))).first()[0] == said


@pytest.mark.parametrize(("rate", "said"), [(0.0, "0/s"), (-1.0, "0/s"), (0.25, "15.0/min"), (1.0, "1.0/s")])
def test_rates(spark, rate, said):
    assert spark.range(1).select(S.human_rate(F.lit(rate))).first()[0] == said


@pytest.mark.parametrize(("text", "reason"), [("Traceback (most recent call last):\n  File\nKeyError: 'x'\n", "KeyError: 'x'"), ("Oops: y \n^^^\n~~\n", "Oops: y"), ("  a\n\tb \n \n", "b"), (" \n", "exited with code 7 and no output"), ("x" * 600, "x" * 500)])
def test_failure_reasons(spark, text, reason):
    assert spark.range(1).select(S.failure_reason(F.lit(text), F.lit(7))).first()[0] == reason


@pytest.mark.parametrize("payload", ['{"face_ids":[1,2],"size":2}', '{"suggested_name":"old","face_ids":[1],"evidence":{"a":[1,{"b":"}"}]}}', '{"x":null,"suggested_name":null,"y":"a,b"}', '{ }', '{"suggested_name":"q\\"}"}'])
def test_a_suggested_name_keeps_the_rest(spark, payload):
    queue = spark.createDataFrame([(1, "new_person", payload), (2, "merge", payload), (3, "new_person", payload)], "item_id long, kind string, payload_json string")
    got = {r.item_id: r.payload_json for r in review.suggest_name(queue, spark.createDataFrame([(1, 'A "b"'), (2, "no")], "item_id long, name string")).collect()}
    assert json.loads(got[1]) == json.loads(payload) | {"suggested_name": 'A "b"'} and got[2] == got[3] == payload


def test_equal_hashes_cost_a_link_each(spark):
    items = spark.createDataFrame([(i, "ab" * 8) for i in range(300)] + [(900, "ab" * 7 + "aa"), (901, "00" * 8)], "id long, hash string")
    assert {r.id: r.component for r in dedupe.visual_groups(items).collect()} == dict.fromkeys([*range(300), 900], 0)


def test_floats_are_decoded_in_the_jvm(spark):
    x = np.array([0.0, -1.5, 3.14159, 1e-20, 65504.0, -2.5e8], "<f4")
    got = spark.createDataFrame([(bytearray(x.tobytes()),), (bytearray(),)], "b binary").select(readers.floats(F.col("b")).alias("v")).collect()
    assert np.array_equal(np.array(got[0].v, "f4"), x) and got[1].v == []


def fake_pages(offset, limit, options):
    return [{"id": i} for i in range(offset, min(offset + limit, 1234))]


def test_paged_source_reads_every_page_once(spark):
    spark.dataSource.register(readers.PagedSource)
    for total in (3000, 500, 0):  # more and fewer rows than were said
        got = spark.read.format("paged").option("fetch", "test_operators:fake_pages").option("total", total).option("page_size", 100).option("pages", 4).load()
        ids = [r.id for r in got.select(F.get_json_object("value", "$.id").cast("long").alias("id")).collect()]
        assert sorted(ids) == list(range(1234))


def test_paged_source_reads_rows_beyond_the_total_side_by_side():
    for rows in (0, 1, 99, 100, 101, 1234, 40_000, 100_000):
        fetch = lambda at, limit, options, rows=rows: [{"id": i} for i in range(at, min(at + limit, rows))]
        reader = readers.PagedReader({"total": "120", "page_size": "100", "pages": "1"})
        reader.fetch = lambda fetch=fetch: fetch
        found = [[json.loads(v)["id"] for (v,) in reader.read(p)] for p in reader.partitions()]
        assert sorted(x for part in found for x in part) == list(range(rows))
        assert max(map(len, found)) <= max(200, rows // 50) and len(found) <= 2 + 2 * readers.PagedReader.BEYOND


def test_pages_of_a_table_read_only_the_rows_around_them(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for part in range(2):
        pq.write_table(pa.table({"a": range(part * 100, part * 100 + 100), "b": ["x"] * 100}), tmp_path / f"part-{part}.parquet", row_group_size=30)
    page = lambda at, n: [r["a"] for r in readers.table_page(at, n, {"table": str(tmp_path), "columns": "a"})]
    readers._group.cache_clear()
    assert page(25, 10) == list(range(25, 35)) and readers._group.cache_info().misses == 2
    assert page(95, 10) == list(range(95, 105)) and page(195, 10) == list(range(195, 200)) and page(200, 10) == []


def test_upsert_and_vanish(spark):
    old = spark.createDataFrame([("a", 1, "x", "h1", 0), ("a", 2, "y", "h2", 1)], "space string, id long, name string, sha string, deleted long")
    new = spark.createDataFrame([("a", 2, "z"), ("a", 3, "n")], "space string, id long, name string")
    got = {r.id: tuple(r)[2:] for r in library.upsert(old, new, ["space", "id"], ["name"], deleted=F.lit(0).cast("long")).collect()}
    assert got == {1: ("x", "h1", 0), 2: ("z", "h2", 0), 3: ("n", None, 0)}
    assert {r.id: r.deleted for r in library.vanish(old, new, ["space", "id"]).collect()} == {1: 1, 2: 1}


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(j, p, 1_700_000_000 + i * 97 * (j + 1) % 5000, i, 100) for j in range(3) for p in ("scan", "embed") for i in range(60)]
    src = spark.createDataFrame(rows, "job_id long, phase string, ts long, done long, total long")
    stamped = src.withColumn("ts", F.timestamp_seconds("ts"))
    stamped.coalesce(1).write.json(f"{tmp_path}/in")
    live = jobs.tail(spark, f"{tmp_path}/in")

    def drained(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name)

    shown = drained(jobs.throttle(live, 300), "append", "shown").select("job_id", "phase", F.col("ts").cast("long").alias("ts"), "done").collect()
    batch = jobs.throttled(stamped.withColumn("ts", F.col("ts").cast("double")), 300).select("job_id", "phase", F.col("ts").cast("long").alias("ts"), "done").collect()
    assert sorted(map(tuple, shown)) == sorted(map(tuple, batch)) and 0 < len(shown) < len(rows)
    counted = drained(jobs.windowed_counts(live, "10 minutes", "1 day"), "complete", "counted").agg(F.sum("n")).first()[0]
    assert counted == len(rows)
    assert drained(jobs.once(live, ["job_id", "phase"], "1 day"), "append", "firsts").count() == 6


def test_tick_takes_places_in_order(spark):
    rows = [(i, f"job{i % 4}", 1, 100 + i) for i in range(8)] + [(9, "job9", 0, 1), (10, "job10", 1, 10_000)]
    s = spark.createDataFrame(rows, "id long, job string, enabled long, next_run_at long")
    got = {r.id: r.status for r in events.tick(s, spark.createDataFrame([("job1",), ("x",), ("y",)], "job string"), 500).collect()}
    assert got == {0: "submitted", 1: "skipped", 2: "submitted", 3: "skipped", **{i: "skipped" for i in range(4, 8)}}


QUEUE = "item_id long, run_id long, kind string, status string, confidence double, decided_at long, payload_json string"


def test_retarget_rewrites_expands_and_refuses(spark):
    face = '{"face_id":1,"space":"personal","person_id":4,"original_person_id":2,"note":"a, b","bbox_normalized":[0.1,0.2]}'
    new = '{"face_ids":[10,11],"size":3}'
    rows = [(1, 1, "assign", "pending", 0.9, None, face), (2, 1, "assign", "applied", 0.9, None, face), (3, 1, "assign", "hidden", 0.9, None, face), (4, 1, "assign", "rejected", 0.9, None, face.replace("personal", "shared")),
            (5, 1, "new_person", "pending", None, None, new), (6, None, "new_person", "failed", None, None, new), (7, 1, "merge", "pending", 0.5, None, "{}"), (8, 1, "new_person", "hidden", None, None, new), (9, 1, "low_confidence", "pending", 0.1, None, "{}")]
    queue = spark.createDataFrame(rows, QUEUE)
    targets = spark.createDataFrame([(i, "personal", 77, 'A "b"' if i != 9 else "") for i in range(1, 10)] + [(99, "personal", 1, "x")], "item_id long, space string, person_id long, name string")
    members = spark.createDataFrame([(1, 3, f) for f in (10, 11, 12, 13, 14)] + [(2, 3, 15)], "run_id long, cluster_id long, face_id long")
    faces = spark.createDataFrame([(10, "personal", 1, 10.0, 20.0, 30.0, 40.0), (11, "shared", 1, 1.0, 1.0, 1.0, 1.0), (12, "personal", 2, 1.0, 1.0, 1.0, 1.0), (13, "personal", 1, 50.0, 0.0, 50.0, 50.0)], "face_id long, space string, photo_id long, x double, y double, w double, h double")
    photos = spark.createDataFrame([("personal", 1, 100, 100), ("shared", 1, 100, 100), ("personal", 2, 0, 100)], "space string, id long, width long, height long")
    got = {r.item_id: r for r in review.retarget(queue, targets, members, faces, photos, 5).collect()}
    assert {i: (r.kind, r.status, r.confidence, r.decided_at) for i, r in got.items()} == {1: ("assign", "approved", None, 5), 9: ("low_confidence", "approved", None, 5), 5: ("new_person", "hidden", None, 5), 6: ("new_person", "hidden", None, 5)} | {i: ("assign", "approved", None, 5) for i in (10, 11, 12)}
    assert json.loads(got[1].payload_json) == {"face_id": 1, "space": "personal", "note": "a, b", "bbox_normalized": [0.1, 0.2], "original_person_id": 4, "person_id": 77, "person_name": 'A "b"', "manual_target": True}
    assert json.loads(got[9].payload_json) == {"original_person_id": None, "person_id": 77, "person_name": None, "manual_target": True}
    assert json.loads(got[5].payload_json) == {"face_ids": [10, 11], "size": 3, "retargeted_to": {"space": "personal", "person_id": 77, "person_name": 'A "b"', "item_ids": [10, 11]}}
    assert json.loads(got[6].payload_json)["retargeted_to"]["item_ids"] == [12]
    made = {i: json.loads(got[i].payload_json) for i in (10, 11, 12)}
    assert [(made[i]["source_item_id"], made[i]["face_id"]) for i in (10, 11, 12)] == [(5, 10), (5, 13), (6, 10)]
    assert made[10] == {"face_id": 10, "photo_id": 1, "space": "personal", "person_id": 77, "person_name": 'A "b"', "bbox_normalized": [0.1, 0.2, 0.4, 0.6], "confidence": None, "manual_target": True, "source_item_id": 5}


def test_undo_refuses_what_became_rows(spark):
    moved = '{"retargeted_to":{"person_id":1}}'
    rows = [(1, "approved", moved), (2, "rejected", '{"original_person_id":3}'), (3, "hidden", moved), (4, "hidden", "not json"), (5, "applied", "{}"), (6, "pending", "{}"), (7, "hidden", '{"retargeted_to":null}'), (8, "approved", None)]
    queue = spark.createDataFrame([(i, 1, "assign", st, 0.5, 9, p) for i, st, p in rows], QUEUE)
    got = {r.item_id: (r.status, r.decided_at) for r in review.undo(queue, queue.filter("item_id < 8").select("item_id")).collect()}
    assert got == {1: ("pending", None), 2: ("pending", None), 3: ("hidden", 9), 4: ("pending", None), 5: ("applied", 9), 6: ("pending", 9), 7: ("pending", None), 8: ("approved", 9)}
