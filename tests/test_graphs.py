"""Neighbours by cells, density clusters by rounds and label propagation by readiness against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithmark.functions import scalar as S
from kithmark.operators import cells, density, graph, whispers


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


def clustered(n=600, dim=12, centers=20, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centers, dim))[np.arange(n) % centers] + rng.normal(scale=0.05, size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# ---- cells ---------------------------------------------------------------------------------


@pytest.mark.parametrize(("cell", "ties"), [(1024, False), (40, False), (40, True), (1, True)])
def test_neighbours_match_brute_force(spark, cell, ties):
    x = clustered(600 if cell > 1 else 40)
    if ties:
        x[1::4] = x[::4]
    got = {(r.src, r["rank"]): (r.dst, r.similarity) for r in cells.neighbours(frame(spark, x), 5, cell).collect()}
    sims = np.round(x @ x.T, cells.DIGITS)
    np.fill_diagonal(sims, -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :5]
    assert {k: v[0] for k, v in got.items()} == {(i, r + 1): order[i, r] for i in range(len(x)) for r in range(5)}
    assert all(s == pytest.approx(sims[i, d], abs=1e-9) for (i, _), (d, s) in got.items())


def test_few_cells_meet_where_vectors_cluster(spark):
    packed = cells.pack(frame(spark, clustered(2000, 12, 50)), 40)
    n = packed.count()
    near = cells.bounds(packed.select("cell", "center", "radius", "norm", F.lit(0.95).alias("least"))).count()
    assert n >= 40 and near < n * n / 5


def test_neighbours_of_unequal_lengths_and_repeated_ids(spark):
    x = np.random.default_rng(4).normal(size=(90, 5)) * np.arange(1, 91)[:, None] / 10
    rows = frame(spark, x).unionByName(frame(spark, x[:3])).unionByName(spark.createDataFrame([(None, [1.0] * 5), (500, None)], "id long, vec array<double>"))
    got = {(r.src, r["rank"]): r.dst for r in cells.neighbours(rows.dropDuplicates(["id"]), 4, 10).collect()}
    sims = np.round(x @ x.T, cells.DIGITS)
    np.fill_diagonal(sims, -np.inf)
    assert got == {(i, r + 1): j for i in range(90) for r, j in enumerate(np.argsort(-sims[i], kind="stable")[:4])}
    assert all(r.src != r.dst for r in cells.neighbours(rows, 4, 10).collect())
    assert cells.neighbours(rows.limit(0), 4).count() == 0


def on_disk(spark):
    return sum(f.length() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()))


@pytest.mark.parametrize("find", [lambda v: cells.neighbours(v, 5, 30), lambda v: cells.close_pairs(v, 0.3, 30)])
def test_shuffles_grow_with_the_vectors_not_with_the_pairs_of_cells(spark, find):
    x = np.random.default_rng(5).normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)  # no clusters: nearly all cells meet
    vectors = frame(spark, x)
    before, threshold = on_disk(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for larger cells
    try:
        assert find(vectors).count() > 1500
        assert on_disk(spark) - before < 4 * x.nbytes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_neighbours_of_floats_copies_and_odd_numbers(spark):
    x = np.random.default_rng(6).normal(size=(200, 8)).astype(np.float32)
    x[50:100] = x[0]  # one vector many times
    x[100], x[101], x[102], x[103, 0] = 1e-30, 1e12, 0, np.nan
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    with np.errstate(invalid="ignore"):
        sims = np.round(x.astype(np.float64) @ x.astype(np.float64).T, cells.DIGITS)
    np.fill_diagonal(sims, -np.inf)
    sims[~np.isfinite(sims)] = -np.inf
    want = {(i, r + 1): j for i in range(200) for r, j in enumerate(np.argsort(-sims[i], kind="stable")[:4]) if np.isfinite(sims[i, j])}
    for cell in (1024, 15):
        assert {(r.src, r["rank"]): r.dst for r in cells.neighbours(rows, 4, cell).collect()} == want


@pytest.mark.parametrize("cell", [1024, 30])
def test_close_pairs_match_brute_force(spark, cell):
    x = clustered(300)
    sims = x @ x.T
    got = {(r.a, r.b) for r in cells.close_pairs(frame(spark, x), 0.9, cell).collect()}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if sims[i, j] > 0.9}


# ---- density -------------------------------------------------------------------------------


def plain_clusters(edges, least, samples):
    """Density clusters of (a, b, distance) edges, one merge after another; id -> label."""
    near, label = {}, {}
    for a, b, d in edges:
        near.setdefault(a, []).append(d), near.setdefault(b, []).append(d)
    core = {x: sorted(d)[min(samples, len(d)) - 1] for x, d in near.items()}
    part = {x: (x,) for x in near}
    birth = {}
    tree = {}  # a part's points -> (left, right, weight)
    for w, a, b in sorted((max(d, core[a], core[b]), a, b) for a, b, d in edges):
        x, y = part[a], part[b]
        if x != y:
            z = x + y
            tree[z] = x, y, w
            part.update(dict.fromkeys(z, z))
    for root in set(part.values()):
        if len(root) < least:
            continue
        clusters, todo = [{"parts": root, "birth": 0.0, "falls": [], "kids": []}], [(root, 0)]
        while todo:
            z, c = todo.pop()
            if z not in tree:
                continue
            x, y, w = tree[z]
            rate, big = 1 / max(w, 1e-12), [p for p in (x, y) if len(p) >= least]
            gone = len(z) if len(big) == 2 else len(z) - sum(map(len, big))
            clusters[c]["falls"].append((rate - clusters[c]["birth"]) * gone)
            for p in big:
                if len(big) == 2:
                    clusters.append({"parts": p, "birth": rate, "falls": [], "kids": []})
                    clusters[c]["kids"].append(len(clusters) - 1)
                todo.append((p, len(clusters) - 1 if len(big) == 2 else c))
        value, pick = {}, {}
        for c in reversed(range(len(clusters))):
            own, below = math.fsum(clusters[c]["falls"]), math.fsum(value[k] for k in clusters[c]["kids"])
            pick[c] = c > 0 and (not clusters[c]["kids"] or below <= own * (1 + 1e-12))
            value[c] = own if pick[c] else below
        todo = [0]
        while todo:
            c = todo.pop()
            if pick[c]:
                label.update(dict.fromkeys(clusters[c]["parts"], min(clusters[c]["parts"])))
            else:
                todo += clusters[c]["kids"]
    return label


def neighbour_lists(n, k, seed, dim=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(scale=0.3, size=(n, dim)) + rng.integers(0, 4, (n, 1)) * 2.0
    far = ((x[:, None] - x[None]) ** 2).sum(2) + np.eye(n) * 1e9
    return [(i, int(j), float(1 - far[i, j] / 40)) for i in range(n) for j in np.argsort(far[i])[:k]]


@pytest.mark.parametrize(("n", "k", "least", "samples", "chunk"), [(150, 6, 4, None, 1_000_000), (150, 6, 4, None, 20), (80, 4, 2, 3, 13)])
def test_density_clusters_match_a_plain_version(spark, n, k, least, samples, chunk):
    near = neighbour_lists(n, k, n + k)
    both = {(i, j) for i, j, _ in near}
    edges = [(i, j, max(1 - s, 1e-6)) for i, j, s in near if i < j and (j, i) in both]
    want = plain_clusters(edges, least, samples or least)
    ids = spark.range(n + 2)
    got = density.hdbscan(ids, spark.createDataFrame(near, "src long, dst long, similarity double"), least, samples, chunk)
    assert {r.id: r.label for r in got.collect()} == {i: want.get(i) for i in range(n + 2)}
    assert len(set(want.values())) > 2


def test_spanning_forest_matches_kruskal(spark):
    rnd = random.Random(7)
    edges = sorted({(a, b) for a, b in ((rnd.randrange(300), rnd.randrange(300)) for _ in range(500)) if a < b})
    edges = [(a, b, float(rnd.randrange(5))) for a, b in edges]  # many equal weights
    root, want = {}, set()

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, w))
    got = density.spanning_forest(spark.createDataFrame(edges, "src long, dst long, w double"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_density_of_nothing(spark):
    near = spark.createDataFrame([], "src long, dst long, similarity double")
    assert [(r.id, r.label) for r in density.hdbscan(spark.range(2), near).collect()] == [(0, None), (1, None)]
    assert density.hdbscan(spark.range(0), near).count() == 0


# ---- whispers ------------------------------------------------------------------------------


def plain_whispers(edges, iterations, seed):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w)), near.setdefault(b, []).append((a, w))
    label = {x: x for x in near}
    for sweep in range(iterations):
        for x in sorted(near, key=lambda x: (hashlib.md5(f"{seed}:{sweep}:{x}".encode()).hexdigest(), x)):
            votes = {}
            for y, w in near[x]:
                votes[label[y]] = votes.get(label[y], 0.0) + w
            label[x] = min(k for k, v in votes.items() if v >= max(votes.values()) - 1e-12)
    return label


@pytest.mark.parametrize(("alone", "iterations"), [(200_000, 30), (0, 2), (40, 2)])
def test_whispers_match_a_plain_version(spark, alone, iterations):
    rnd = random.Random(5)
    edges = sorted({tuple(sorted((g * 20 + rnd.randrange(20), (g * 20 + rnd.randrange(20)) if rnd.random() < 0.9 else rnd.randrange(80)))) for g in range(4) for _ in range(45)})
    edges = [(a, b, rnd.choice([0.5, 0.75, 1.0])) for a, b in edges if a != b] + [(200, 201, 1.0)]
    got = whispers.chinese_whispers(spark.range(210), spark.createDataFrame(edges, "src long, dst long, w double"), iterations, 3, alone)
    want = plain_whispers(edges, iterations, 3)
    assert {r.id: r.label for r in got.collect()} == {i: want.get(i, i) for i in range(210)}


# ---- rounding ------------------------------------------------------------------------------


def test_rounding_takes_the_exact_value(spark):
    rng = random.Random(3)
    values = [1.05, 1.15, 0.15, 2.675, 0.25, 0.75, 0.35, 1.25, 0.05, 2.5, 1e6 + 0.05, 0.95, 9.95, 99.95, 0.0, 1e-9] + [k / 20 for k in range(500)] + [rng.random() * 50 for _ in range(500)]
    df = spark.createDataFrame([(v, (k % 9999) / 9999 + k * 5e-5) for k, v in enumerate(values)], "v double, s double")
    got = df.select("v", "s", S.one_digit(F.col("v")).alias("one"), (S.units(F.col("s"), 4) / 10_000).alias("four"), S.human_rate(F.col("v")).alias("rate")).collect()
    for r in got:
        assert r.one == f"{r.v:.1f}" and r.four == round(r.s, 4)
        assert r.rate == (f"{r.v:.1f}/s" if r.v >= 1 else f"{r.v * 60:.1f}/min" if r.v > 0 else "0/s")


def test_whispers_take_the_turns_of_a_sweep_in_few_rounds(spark, monkeypatch):
    rng = random.Random(8)
    edges = sorted({tuple(sorted(rng.sample(range(150), 2))) for _ in range(900)})
    edges = [(a, b, rng.choice([0.5, 0.75, 1.0])) for a, b in edges]
    rounds, put = [], whispers.written
    monkeypatch.setattr(whispers, "written", lambda df, name: rounds.append(name) or put(df, name))
    got = whispers.chinese_whispers(spark.range(150), spark.createDataFrame(edges, "src long, dst long, w double"), 4, 3, 0)
    want = plain_whispers(edges, 4, 3)
    assert {r.id: r.label for r in got.collect()} == {i: want.get(i, i) for i in range(150)}
    assert len(rounds) < 40


def test_components_and_labels_leave_only_what_is_read(spark, monkeypatch):
    left, put, drop = set(), graph.written, graph.discard
    monkeypatch.setattr(graph, "written", lambda df, name: (found := put(df, name), left.add(found.written_to))[0])
    monkeypatch.setattr(graph, "discard", lambda *tables: (left.difference_update(t.written_to for t in tables), drop(*tables)))
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)], "src long, dst long, w double")
    assert {r.component for r in graph.components(edges).collect()} == {0} and len(left) == 1
    used = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            used.add(batch.num_rows)
            yield batch

    once = edges.mapInArrow(counted, edges.schema)
    assert graph.spread_labels(spark.range(31), once, 3).count() == 31 and used.value == 30  # edges are made once for all rounds
