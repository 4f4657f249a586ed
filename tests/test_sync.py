"""Faces in step with their source, with batches that die between their write and their commit."""

import random

import pytest
from pyspark.sql import functions as F

from kithmark.streaming import sync


def rows_of(store):
    return sorted((r.space, r.photo_id, r.face_id, r.person_id) for r in store.faces().collect())


def batches(n=5, seed=3):
    rnd, out = random.Random(seed), []
    for k in range(n):
        rows = []
        for photo in rnd.sample(range(30), 12):
            failed = rnd.random() < 0.2
            faces = [] if failed else [(rnd.randrange(60), k, "x", 0.0, 0.0, 1.0, 1.0) for _ in range(rnd.randrange(4))]
            rows.append(("personal" if photo % 2 else "shared", photo, failed, list({f[0]: f for f in faces}.values())))
        out.append(rows)
    return out


def plain(steps):
    """(space, photo, face) -> (person, batch), then of each face the last batch's, of equal ones the larger photo."""
    held = {}
    for k, rows in enumerate(steps):
        for space, photo, failed, faces in rows:
            if not failed:
                held = {key: v for key, v in held.items() if key[:2] != (space, photo)}
                held |= {(space, photo, f[0]): (f[1], k) for f in faces}
    best = {}
    for (space, photo, face), (person, k) in held.items():
        best[space, face] = max(best.get((space, face), (-1, -1, -1)), (k, photo, person))
    return sorted((space, photo, face, person) for (space, face), (_, photo, person) in best.items())


@pytest.mark.parametrize("dies", [False, True])
def test_a_batch_counts_once(spark, tmp_path, monkeypatch, dies):
    steps, store = batches(), sync.FaceStore(spark, str(tmp_path / "store"), 8)
    live = spark.readStream.schema(sync.LISTED).parquet(f"{tmp_path}/in/*")
    commit = sync.FaceStore._commit
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, sync.LISTED).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        if dies and k in (0, 2, 3):

            def killed(*_):
                raise RuntimeError("killed between write and commit")

            monkeypatch.setattr(sync.FaceStore, "_commit", killed)
            with pytest.raises(Exception, match="killed"):
                sync.follow(live, store, f"{tmp_path}/cursor").awaitTermination()
            monkeypatch.setattr(sync.FaceStore, "_commit", commit)
            assert rows_of(store) == plain(steps[:k])  # nothing of it is seen
        sync.follow(live, store, f"{tmp_path}/cursor").awaitTermination()
        assert rows_of(store) == plain(steps[: k + 1])
    last = store.last()
    store.apply(spark.createDataFrame(steps[0], sync.LISTED), last["batch"])  # the same batch again
    assert store.last() == last and rows_of(store) == plain(steps)
    photos = spark.range(40).select(F.when(F.col("id") % 2 == 1, "personal").otherwise("shared").alias("space"), F.col("id").alias("photo_id"))
    top = last["cursor"]
    assert {(r.space, r.photo_id) for r in store.waiting(photos).collect()} == {(s, p) for p in range(40) for s in ["personal" if p % 2 else "shared"] if p > top[s]}


def test_an_empty_store(spark, tmp_path):
    store = sync.FaceStore(spark, str(tmp_path / "none"))
    photos = spark.createDataFrame([("personal", 1)], "space string, photo_id long")
    assert rows_of(store) == [] and store.waiting(photos).count() == 1
    store.apply(spark.createDataFrame([], sync.LISTED), 0)
    assert rows_of(store) == [] and store.last()["batch"] == 0
