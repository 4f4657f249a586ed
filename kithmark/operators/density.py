"""Density clusters of a graph: spanning forest by rounds, merge tree by chunks, clusters by jumps.

Nothing but the tree of candidate clusters of one component, a small part of its points, is ever in one task as a whole: the forest's
edges are found in rounds over all components at once, merged in chunks of bounded size, and every point and merge finds
its cluster by pointer jumping.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from .graph import components, mutual_edges
from .ids import consecutive

#: Forest edges that are merged at a time.
CHUNK = 1_000_000
#: Shares of stability that differ by less are equal; sums come in any order.
SLACK = 1e-12


def jumped(pointers: DataFrame) -> DataFrame:
    """id, top: where the chain of (id, up) from each id ends. An id that points to itself ends a chain. Chains halve in every round."""
    now = written(pointers.select("id", F.col("up").alias("top")), "jumps")
    while True:
        further = now.select(F.col("id").alias("top"), F.col("top").alias("next"))
        now = written(now.join(further, "top").select("id", F.col("next").alias("top"), (F.col("top") != F.col("next")).alias("moved")), "jumps")
        if now.filter("moved").isEmpty():
            return now.select("id", "top")
        now = now.select("id", "top")


def reachability(edges: DataFrame, samples: int) -> DataFrame:
    """src, dst, w: the larger of an edge's distance and its ends' core distances, that of a point's samples-th nearest neighbour or of its last.

    A point's distances are gathered in one array: neighbour lists are short.
    """
    both = edges.select(F.col("src").alias("id"), "distance").unionByName(edges.select(F.col("dst").alias("id"), "distance"))
    near = both.groupBy("id").agg(F.sort_array(F.collect_list("distance")).alias("d"))
    core = written(near.select("id", F.element_at("d", F.least(F.lit(samples), F.size("d"))).alias("core")), "core")
    got = edges.join(core.select(F.col("id").alias("src"), F.col("core").alias("a")), "src").join(core.select(F.col("id").alias("dst"), F.col("core").alias("b")), "dst")
    return got.select("src", "dst", F.greatest("distance", "a", "b").alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """src, dst, w of the minimum spanning forest of (src, dst, w), each edge once; edges of equal weight go by src, then dst.

    In each round every component takes the least edge that leaves it; components that edges join become one, and of several edges
    between two the least is left. Rounds at least halve the components that have edges.
    """
    left = written(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.struct("w", "src", "dst").alias("e")).filter("u <> v"), "leaving")
    kept = left.select("e").limit(0)
    while True:
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v"), "e"))
        least = written(both.groupBy("u").agg(F.min(F.struct("e", "v")).alias("m")).select("u", F.col("m.v").alias("v"), F.col("m.e").alias("e")), "least")
        if least.isEmpty():
            return kept.select("e.src", "e.dst", "e.w")
        kept = written(kept.unionByName(least.select("e").distinct()), "forest")
        # Two components that take the same edge would point at each other: the lesser is the end.
        back = least.select(F.col("u").alias("v"), F.col("v").alias("back"))
        up = least.join(back, "v").select(F.col("u").alias("id"), F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("up"))
        top = jumped(up)
        left = left.join(top.select(F.col("id").alias("u"), F.col("top").alias("a")), "u").join(top.select(F.col("id").alias("v"), F.col("top").alias("b")), "v").filter("a <> b")
        left = written(left.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("e").alias("e")), "leaving")


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges of one component of a chunk, in the order of its edges, and for each part that it had the part that it ends in.

    pdf: a, b (parts), na, nb (their points), w, node (the merge's own name).
    """
    pdf = pdf.sort_values("node")
    up, size, out = {}, {}, []

    def find(x: int) -> int:
        path = []
        while x in up:
            path.append(x)
            x = up[x]
        for y in path:
            up[y] = x
        return x

    for a, b, na, nb, w, node in zip(*(pdf[c].tolist() for c in ("a", "b", "na", "nb", "w", "node")), strict=True):
        size.setdefault(a, na), size.setdefault(b, nb)
        x, y = find(a), find(b)
        size[node] = size[x] + size[y]
        up[x] = up[y] = node
        out.append((True, node, x, y, w, size[x], size[y]))
    parts = np.unique(pdf[["a", "b"]].to_numpy())
    out += [(False, int(x), find(int(x)), None, None, size[find(int(x))], None) for x in parts]
    return pd.DataFrame(out, columns=["merge", "node", "x", "y", "w", "nx", "ny"]).astype({"y": "Int64", "ny": "Int64"})


def merge_tree(forest: DataFrame, points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node, x, y, w, nx, ny: what each edge of a forest (a, b, w over points 0, 1, ...) merges, by rising weight, and their numbers of points.

    Merges are numbered from the number of points on. A chunk of edges merges what the chunks before have left, each of its components in a task of its own.
    """
    edges = written(consecutive(forest, ["w", "a", "b"], "node", points.count()), "forest-edges")
    low, high = edges.agg(F.min("node"), F.max("node")).first()
    merges, ends = None, None
    for start in range(low or 0, (high or -1) + 1, chunk):
        part = edges.filter((F.col("node") >= start) & (F.col("node") < start + chunk))
        if ends is None:
            part = part.withColumns({"na": F.lit(1).cast("long"), "nb": F.lit(1).cast("long")})
        else:
            for s in "ab":
                part = part.join(ends.select(F.col("point").alias(s), F.col("part").alias(f"p{s}"), F.col("n").alias(f"n{s}")), s, "left")
                part = part.withColumns({s: F.coalesce(f"p{s}", s), f"n{s}": F.coalesce(f"n{s}", F.lit(1).cast("long"))}).drop(f"p{s}")
            part = written(part, "forest-part")
        groups = components(part.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        rows = part.join(groups.withColumnRenamed("id", "a"), "a")
        got = written(rows.groupBy("component").applyInPandas(_merge, "merge boolean, node long, x long, y long, w double, nx long, ny long"), "merges")
        new = got.filter("merge").drop("merge")
        merges = new if merges is None else merges.unionByName(new)
        moved = got.filter("NOT merge").select(F.col("node").alias("part"), F.col("x").alias("now"), F.col("nx").alias("n_now"))
        if ends is None:
            ends = moved.select(F.col("part").alias("point"), F.col("now").alias("part"), F.col("n_now").alias("n"))
        elif start + chunk <= high:
            old = ends.join(moved, "part", "left").select("point", F.coalesce("now", "part").alias("part"), F.coalesce("n_now", "n").alias("n"))
            fresh = moved.filter(F.col("part") < low).select(F.col("part").alias("point"), F.col("now").alias("part"), F.col("n_now").alias("n"))
            ends = written(old.unionByName(fresh), "ends")
    return merges


def _select(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one component's candidate clusters (cluster, parent, stability) the one that each is part of, none where it is part of no chosen one.

    From the leaves up a cluster is chosen unless those below are more stable together; the root never is.
    """
    pdf = pdf.sort_values("cluster")  # merges are numbered upwards, so parts come before wholes
    below, own, chosen = {}, {}, {}
    rows = [(int(c), None if pd.isna(p) else int(p), float(s)) for c, p, s in zip(pdf["cluster"], pdf["parent"], pdf["stability"], strict=True)]
    for c, p, s in rows:
        kids = below.get(c)
        chosen[c] = p is not None and (kids is None or kids <= s * (1 + SLACK))
        own[c] = s if chosen[c] else kids or 0.0
        if p is not None:
            below[p] = below.get(p, 0.0) + own[c]
    of = {}
    for c, p, _ in reversed(rows):
        above = of.get(p) if p is not None else None
        of[c] = above if above is not None else c if chosen[c] else None
    return pd.DataFrame({"cluster": list(of), "chosen": pd.array(list(of.values()), "Int64")})


def hdbscan(ids: DataFrame, near: DataFrame, min_cluster_size: int = 2, min_samples: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """id, label (null: noise): density clusters of the mutual neighbour graph; a cluster's label is its least id.

    By component: mutual reachability, its spanning tree, the tree of clusters that splits into two large parts make, and the most stable of them.
    The whole component is never a cluster of itself: one that doesn't split, or is too small, is noise.
    """
    least = max(2, min_cluster_size)
    edges = written(reachability(written(mutual_edges(near), "mutual"), min_samples or least), "reach")
    forest = spanning_forest(edges)
    used = forest.select(F.col("src").alias("id")).unionByName(forest.select(F.col("dst").alias("id"))).distinct()
    points = written(consecutive(used, ["id"], "node"), "points")
    numbered = forest.join(points.select(F.col("id").alias("src"), F.col("node").alias("a")), "src").join(points.select(F.col("id").alias("dst"), F.col("node").alias("b")), "dst")
    tree = merge_tree(numbered.select("a", "b", "w"), points, chunk)
    if tree is None:
        return ids.select("id", F.lit(None).cast("long").alias("label"))

    tree = tree.withColumn("n", F.col("nx") + F.col("ny")).withColumn("rate", 1 / F.greatest("w", F.lit(1e-12)))
    side = lambda s, o: tree.select(F.col(s).alias("id"), F.col("node").alias("parent"), F.col(f"n{s}").alias("n"), F.col(f"n{o}").alias("other"), F.col("rate").alias("birth"))
    kids = written(side("x", "y").unionByName(side("y", "x")), "kids")
    roots = tree.select(F.col("node").alias("id"), "n").join(kids, "id", "left_anti")
    nodes = kids.unionByName(roots, allowMissingColumns=True)
    starts = (F.col("n") >= least) & (F.col("parent").isNull() | (F.col("other") >= least))
    nodes = written(nodes.withColumn("starts", starts), "nodes")
    # A point or merge belongs to the first cluster that starts at it or above.
    of = written(jumped(nodes.select("id", F.when(F.col("starts") | F.col("parent").isNull(), F.col("id")).otherwise(F.col("parent")).alias("up"))), "cluster-of")

    clusters = nodes.filter("starts").select(F.col("id").alias("cluster"), "parent", F.coalesce("birth", F.lit(0.0)).alias("birth"))
    large = lambda c: F.when(F.col(c) >= least, F.col(c)).otherwise(0)
    gone = F.when((F.col("nx") >= least) & (F.col("ny") >= least), F.col("n")).otherwise(F.col("n") - large("nx") - large("ny"))
    falls = tree.filter(F.col("n") >= least).select(F.col("node").alias("id"), "rate", gone.alias("gone")).join(of, "id").withColumnRenamed("top", "cluster")
    stable = falls.join(clusters, "cluster").groupBy("cluster").agg(F.sum((F.col("rate") - F.col("birth")) * F.col("gone")).alias("stability"))
    clusters = clusters.join(stable, "cluster").join(of.select(F.col("id").alias("parent"), F.col("top").alias("above")), "parent", "left").select("cluster", F.col("above").alias("parent"), "stability")
    clusters = written(clusters, "clusters")
    whole = jumped(clusters.select(F.col("cluster").alias("id"), F.coalesce("parent", "cluster").alias("up")))
    chosen = clusters.join(whole.withColumnRenamed("id", "cluster"), "cluster").groupBy("top").applyInPandas(_select, "cluster long, chosen long")
    found = points.join(of.withColumnRenamed("id", "node"), "node").join(chosen.filter("chosen IS NOT NULL"), F.col("top") == F.col("cluster")).select("id", "chosen")
    found = written(found, "clustered")
    named = found.join(found.groupBy("chosen").agg(F.min("id").alias("label")), "chosen").select("id", "label")
    return ids.select("id").join(named, "id", "left").select("id", "label")
