"""Asynchronous label propagation: each node in turn takes the label of most weight around it.

The order of a sweep is that of the nodes' hashes. A node's turn depends on its neighbours alone: on the labels that those have after
this sweep who come earlier in it, and that the others have after the sweep before. So all turns of a sweep are taken in one join on what is
known so far, and those again for which an earlier neighbour's label has turned out otherwise, until none has. Labels are the same as if
the nodes had come one by one: whoever comes first is right at once, and others as soon as those before them are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.storage import discard, written
from .graph import components

#: Edges up to which a component's turns are taken in one task, one by one; of larger ones all turns of a sweep in joins. Both give the same.
ALONE = 200_000
#: Nodes that are sent to all tasks at once at most.
FEW = 1_000_000
TIE = 1e-12


def turn(seed: int, sweep: int, node: Column | str) -> Column:
    """A node's place in a sweep: the MD5 of seed, sweep and id as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(sweep)), F.col(node).cast("string") if isinstance(node, str) else node.cast("string")))


def _one_by_one(iterations: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate((pdf["src"], pdf["dst"])))
        a, b, w = np.searchsorted(nodes, pdf["src"]), np.searchsorted(nodes, pdf["dst"]), pdf["w"].to_numpy()
        near: list[list[tuple[int, float]]] = [[] for _ in nodes]
        for x, y, z in zip(a, b, w, strict=True):
            near[x].append((y, z))
            near[y].append((x, z))
        label = nodes.copy()
        for sweep in range(iterations):
            before = label.copy()
            for x in sorted(range(len(nodes)), key=lambda x: (hashlib.md5(f"{seed}:{sweep}:{nodes[x]}".encode()).hexdigest(), nodes[x])):
                votes: dict[int, float] = {}
                for y, z in near[x]:
                    votes[label[y]] = votes.get(label[y], 0.0) + z
                top = max(votes.values())
                label[x] = min(k for k, v in votes.items() if v >= top - TIE)
            if (label == before).all():  # no later order can change anything
                break
        return pd.DataFrame({"id": nodes, "label": label})

    return run


def by_changes(edges: DataFrame, iterations: int, seed: int) -> DataFrame:
    """id, label of the ends of edges (src, dst, w): each sweep's turns at once, then again those that a change concerns, until nothing changes.

    In the sweeps after the first a turn is taken only if a neighbour's label isn't what it was at the node's turn before.
    """
    ends = F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))))
    both = written(edges.select(ends.alias("e"), "w").select("e.u", "e.v", "w"), "whispering")
    none, total = F.lit(False), both.count()
    state = written(both.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("near")).select("id", "near", F.col("id").alias("old"), F.col("id").alias("now"), none.alias("fresh")), "whispers")
    kept, due = state, None  # whose turn it is, everyone's if none are named
    for sweep in range(iterations):
        earlier = F.struct(turn(seed, sweep, "v"), "v") < F.struct(turn(seed, sweep, "u"), "u")

        def beside(moved: DataFrame, when: Column, n: int) -> DataFrame | None:
            """Nodes with a neighbour among the moved, who have n neighbours, that comes when asked for."""
            of = both.select("u", "v").join(moved.select(F.col("id").alias("v")), "v").filter(when).select("u").distinct()
            return F.broadcast(of) if n <= FEW else of if n < total / 4 else None

        while True:
            rows = both if due is None else both.join(due, "u")
            seen = rows.join(state.select(F.col("id").alias("v"), "old", "now"), "v").select("u", F.when(earlier, F.col("now")).otherwise(F.col("old")).alias("label"), "w")
            votes = seen.repartition("u").groupBy("u", "label").agg(F.sum("w").alias("w"))  # both sums over one shuffle
            best = votes.groupBy("u").agg(F.max("w").alias("top"), F.collect_list(F.struct("label", "w")).alias("all"))
            new = best.select(F.col("u").alias("id"), F.array_min(F.transform(F.filter("all", lambda x: x["w"] >= F.col("top") - TIE), lambda x: x["label"])).alias("new"))
            new = state.join(new, "id", "left").select("id", "near", "old", F.coalesce("new", "now").alias("now"), F.coalesce(F.col("new") != F.col("now"), none).alias("fresh"))
            counts, near = Observation(), lambda c: F.coalesce(F.sum(F.when(c, F.col("near"))), F.lit(0))
            state = written(new.observe(counts, near(F.col("fresh")).alias("fresh"), near(F.col("old") != F.col("now")).alias("moved")), "whispers")
            discard(kept)
            kept = state
            if not (n := counts.get["fresh"]):
                break
            due = beside(state.filter("fresh"), earlier, n)
        if not (n := counts.get["moved"]):  # no later order can change anything
            break
        # Who came before a neighbour that then changed has seen what it was.
        due = beside(state.filter("old <> now"), ~earlier, n)
        state = state.select("id", "near", F.col("now").alias("old"), "now", none.alias("fresh"))
    discard(both)
    return kept.select("id", F.col("now").alias("label"))


def chinese_whispers(ids: DataFrame, edges: DataFrame, iterations: int = 30, seed: int = 42, alone: int = ALONE) -> DataFrame:
    """id, label: asynchronous label propagation in a seeded order, at most so many sweeps; one that changes nothing is the last.

    Ties within 1e-12 go to the smallest label; an id without edges keeps its own. Labels never cross components.
    """
    edges = written(edges.select("src", "dst", "w"), "whisper-edges")
    parts = components(edges)
    rows = edges.join(parts, edges["src"] == parts["id"]).select("component", "src", "dst", "w")
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"))
    large = written(sizes.filter(F.col("n") > alone).select("component"), "large-components")
    got = rows.join(large, "component", "left_anti").groupBy("component").applyInPandas(_one_by_one(iterations, seed), "id long, label long")
    if not large.isEmpty():
        got = got.unionByName(by_changes(rows.join(large, "component", "left_semi"), iterations, seed))
    return ids.select("id").join(got, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
