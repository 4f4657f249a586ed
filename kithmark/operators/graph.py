"""Graphs of vectors: fused vectors, thresholded and mutual edges, components, synchronous label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.storage import discard, written
from .ids import consecutive


def fuse(vectors: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """face_id, vec from (face_id, model, vec): unit vectors of the models times their weights, by model name, joined and made unit."""
    weight = F.lit(1.0)
    for model, w in (weights or {}).items():
        weight = F.when(F.col("model") == model, float(w)).otherwise(weight)
    unit = F.transform(S.l2_normalize(S.doubles(F.col("vec"))), lambda x: x * F.col("weight"))
    rows = vectors.withColumn("weight", weight).select("face_id", "model", unit.alias("vec"))
    parts = rows.groupBy("face_id").agg(F.array_sort(F.collect_list(F.struct("model", "vec"))).alias("parts"))
    return parts.select("face_id", S.l2_normalize(F.flatten(F.transform("parts", lambda p: p["vec"]))).alias("vec"))


def threshold_edges(near: DataFrame, least: float) -> DataFrame:
    """Undirected edges src < dst of weight at least `least`, from either direction, the larger weight."""
    kept = near.filter((F.col("similarity") >= least) & (F.col("src") != F.col("dst")))
    return kept.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("similarity").alias("w"))


def mutual_edges(near: DataFrame) -> DataFrame:
    """Edges that both ends name, with distance max(1 - similarity, 1e-6)."""
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return near.join(back, ["src", "dst"], "left_semi").filter("src < dst").select("src", "dst", F.greatest(1 - F.col("similarity"), F.lit(1e-6)).alias("distance"))


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of all ends of edges src-dst.

    Each round hooks every id to the least label next to it and then jumps to that label's own label, so paths halve;
    rounds are written out until none changes a label.
    """
    both = written(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    kept = labels
    while True:
        seen = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        hooked = labels.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        now = hooked.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        now = written(now, "labels")
        discard(kept)
        labels, kept = now.select("id", "component"), now
        if now.filter("old <> component").isEmpty():
            discard(both)
            return labels


def spread_once(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One synchronous round: each id takes the label of most weight around it, the smallest of equals; alone it keeps its own."""
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    seen = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label", "w")
    votes = seen.repartition("id").groupBy("id", "label").agg(F.round(F.sum("w"), 9).alias("w"))  # both sums over one shuffle
    best = votes.groupBy("id").agg(F.max(F.struct("w", (-F.col("label")).alias("n"))).alias("b")).select("id", (-F.col("b.n")).alias("new"))
    return labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"))


def spread_labels(ids: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """Synchronous label propagation from labels = ids."""
    labels, edges = ids.select("id", F.col("id").alias("label")), written(edges, "spread-edges")
    for _ in range(rounds):
        labels = written(spread_once(labels, edges), "spread")
    return labels


def relabel(labels: DataFrame) -> DataFrame:
    """id, cluster: 0.. in the order of each label's smallest id; a null label (noise) is a cluster of its own."""
    own = F.coalesce(F.col("label").cast("string"), F.concat(F.lit("noise "), F.col("id").cast("string")))
    first = labels.withColumn("g", own).groupBy("g").agg(F.min("id").alias("first"))
    ranked = consecutive(first, ["first"], "cluster")
    return labels.withColumn("g", own).join(ranked, "g").select("id", "cluster")
