"""SimHash near-dedup with vantage-point trees over the fingerprints.

A 64-bit fingerprint is cut into three segments. Two fingerprints within 4 bits agree to within
one bit on at least one segment, so a vantage-point tree for each segment, searched with radius 1,
finds every pair (and every pair within 5 bits, which leave one bit to the closest of three segments as well). A tree's inner node holds a vantage point v and a radius: points within the
radius of v go left. A search of radius r about q skips the left branch if d(q, v) - r is above the
radius and the right branch if d(q, v) + r is not, by the triangle inequality; where neither holds the
query crosses the boundary and visits both. Each leaf is a shard: it has its own fingerprints and those
that visit it. Shards are compared in blocks, pairs verified on all 64 bits, and a shard emits a
spanning set of its links, not all pairs.

The trees are fitted on a bounded sample (vantage points and median radii); every fingerprint is
indexed. Equal fingerprints are one node, so groups of copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, written

RADIUS = 4
#: Bits of the segments, from the top. Three of them: 4 // 3 = 1 bit may differ in the closest.
SEGMENTS = ((43, 21), (22, 21), (0, 22))
#: At most this many fingerprints fit a tree (8 MB at the driver), and a sixteenth of all at most; it bounds the tree's leaves as well.
SAMPLE = 1 << 20
#: Fingerprints a leaf should own, and most that one comparing task owns of a leaf.
LEAF, BLOCK = 1024, 4096
#: Links that a task joins up at once.
GATHERED = 1 << 20


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each of the text's word shingles; of all its words if they are fewer; none of a text without words."""
    got = text.lower().split()  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    if not got:
        return np.zeros(0, np.uint64)
    n = max(1, len(got) - words + 1)
    joined = b" ".join(got)
    ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = ends[words - 1 :].tolist() if len(got) >= words else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64, n)


def majority(h: np.ndarray) -> int:
    """SimHash: a bit is set if over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of the text's word shingles."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) for each row; null text has no words: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column("t").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


class Tree:
    """A vantage-point tree over one segment, in heap order: vantage points, radii; a radius of -1 ends a branch there."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, size = depth, 1 << depth
        self.vantage, self.radius = np.zeros(size, np.uint64), np.full(size, -1, np.int16)
        held = {1: points}
        for node in range(1, size):
            own = held.pop(node, None)
            if own is None or len(own) < 2:
                continue
            # The vantage point whose median radius has the fewest points next to it: least crosses the boundary.
            best = None
            for v in own[:: max(1, len(own) // 8)][:8]:
                d = np.bitwise_count(own ^ v).astype(np.int16)
                r = int(np.median(d))
                for radius in (r - 1, r):
                    inside = int((d <= radius).sum())
                    if 0 < inside < len(own):
                        cost = abs(inside / len(own) - 0.5) + ((d >= radius) & (d <= radius + 1)).mean()
                        if best is None or cost < best[0]:
                            best = cost, v, radius, d
            if best is None:
                continue  # all points are alike
            _, v, radius, d = best
            self.vantage[node], self.radius[node] = v, radius
            held[2 * node], held[2 * node + 1] = own[d <= radius], own[d > radius]

    def leaves(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, leaf) for every leaf that the ball of that reach about a point meets; reach 0: the leaf that owns it."""
        at, node, ends = np.arange(len(points)), np.ones(len(points), np.int64), []
        for _ in range(self.depth):
            radius = self.radius[node]
            over = radius < 0
            ends.append((at[over], node[over]))
            at, node, radius = at[~over], node[~over], radius[~over]
            d = np.bitwise_count(points[at] ^ self.vantage[node]).astype(np.int16)
            left, right = d - reach <= radius, d + reach > radius
            at, node = np.concatenate((at[left], at[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
        ends.append((at, node))
        return np.concatenate([a for a, _ in ends]), np.concatenate([n for _, n in ends])


def segment(fp: np.ndarray, k: int) -> np.ndarray:
    shift, bits = SEGMENTS[k]
    return (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)


def components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points over the links a-b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        differs = low < high
        if not differs.any():
            break
        a, b = a[differs], b[differs]
        np.minimum.at(label, high[differs], low[differs])
        while (label[label] != label).any():
            label = label[label]
    return label


def _links(own: np.ndarray, other: np.ndarray, own_at: np.ndarray, other_at: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between own and other points within the radius, tile by tile; of a dense tile enough to join the same points."""
    for i in range(0, len(own), 512):
        x = own[i : i + 512]
        for j in range(0, len(other), 4096):
            near = np.bitwise_count(x[:, None] ^ other[None, j : j + 4096]) <= radius
            if near.sum() <= 8 * sum(near.shape):
                a, b = np.nonzero(near)
            else:  # least row of each column, least row of each row's columns, until nothing changes
                rows, cols, none = np.arange(near.shape[0]), np.full(near.shape[1], -1), near.shape[0]
                while True:
                    cols = np.where(near, rows[:, None], none).min(axis=0)
                    now = np.minimum(rows, np.where(near, cols[None, :], none).min(axis=1))
                    if (now == rows).all():
                        break
                    rows = now
                hit = np.flatnonzero(cols < none)
                yield own_at[i + cols[hit]], other_at[j + hit]
                a = np.flatnonzero(rows < np.arange(len(rows)))
                yield own_at[i + a], own_at[i + rows[a]]
                continue
            yield own_at[i + a], other_at[j + b]


def shard_linker(radius: int):
    """A function from one shard block (shard, block, fp, rep, own) to its spanning links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        fp, rep = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy()
        at = np.arange(len(fp))
        mine = pdf["own"].to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in _links(fp[mine], fp, at[mine], at, radius):
            a.append(x)
            b.append(y)
        label = components_of(len(fp), np.concatenate(a), np.concatenate(b))
        moved = label != at
        return pd.DataFrame({"a": rep[moved], "b": rep[label[moved]]})

    return run


shard_links = shard_linker(RADIUS)


def near_links(nodes: DataFrame, leaf_size: int = LEAF, block: int = BLOCK, radius: int = RADIUS, folder: str | None = None) -> DataFrame:
    """a, b: links that join the same nodes as all pairs within the radius do. nodes: rep (long), fp, each fp once.

    A leaf should own leaf_size nodes; one that owns more than `block` is compared in blocks.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / leaf_size)))), int(np.log2(SAMPLE)) - 4))
    sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, 64 << depth)).toArrow()["fp"].to_numpy().view(np.uint64)
    trees = spark.sparkContext.broadcast([Tree(segment(sample, k), depth) for k in range(len(SEGMENTS))])
    reach = radius // len(SEGMENTS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each node's own leaf, and those that its ball meets, in every tree."""
        for batch in batches:
            fp, rep = batch.column("fp").to_numpy(zero_copy_only=False), batch.column("rep").to_numpy(zero_copy_only=False)
            for k, tree in enumerate(trees.value):
                part = segment(fp.view(np.uint64), k)
                home = np.zeros(len(fp), np.int64)
                at, leaf = tree.leaves(part, 0)
                home[at] = leaf
                at, leaf = tree.leaves(part, reach)
                own = home[at] == leaf
                yield pa.RecordBatch.from_arrays([pa.array(leaf * len(SEGMENTS) + k), pa.array(fp[at]), pa.array(rep[at]), pa.array(own)], names=["shard", "fp", "rep", "own"])

    placed = nodes.select("rep", "fp").mapInArrow(place, "shard long, fp long, rep long, own boolean")
    if n <= block:
        return placed.withColumn("block", F.lit(0)).groupBy("shard", "block").applyInPandas(shard_linker(radius), "a long, b long")
    placed = written(placed, "simhash-shards", folder)
    full = placed.filter("own").groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    placed = placed.join(small(written(full, "simhash-full", folder)), "shard", "left")
    # What a crowded leaf owns is dealt into blocks; whoever is in the leaf meets every block.
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = placed.withColumn("block", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    dealt = dealt.withColumn("own", F.col("own") & (F.col("blocks").isNull() | (F.col("block") == mine)))
    return dealt.select("shard", "block", "fp", "rep", "own").groupBy("shard", "block").applyInPandas(shard_linker(radius), "a long, b long")


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: for the links (u, v) of each GATHERED or so, each node but the least of its component with that least node."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("u", "v"))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        label = components_of(len(nodes), at[: len(u)], at[len(u) :])
        moved = np.flatnonzero(label < np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["u", "v"])

    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many >= GATHERED:
            yield out(held)
            held, many = [], 0
    if many:
        yield out(held)


def connected(links: DataFrame, folder: str | None = None) -> DataFrame:
    """node, root: the smallest node of each linked node's component. links: a, b (longs).

    Tasks first join up what their own links connect. Large-star and small-star rounds, each written to the shared folder, follow until all
    links lead to roots. While links are few the least neighbours are broadcast, so a hub's links stay in their tasks.
    """
    pairs = lambda df: written(df.filter("u <> v").distinct().mapInArrow(stars, "u long, v long"), "links", folder)
    edges = pairs(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        both = edges.select(F.col("u").alias("node"), F.lit(1).alias("low")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("low")))
        # A node with two links to lesser ones, or with one and links from greater ones.
        left = both.groupBy("node").agg(F.sum("low").alias("n"), F.min("low").alias("least")).agg(F.sum("n").alias("links"), F.bool_or((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("least") == 0))).alias("open")).first()
        if not left["open"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        few = F.broadcast if left["links"] * 2 <= BROADCAST_ROWS else lambda df: df
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(few(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(few(least), "u")
        edges = pairs(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def linked_roots(links: DataFrame, folder: str | None = None) -> DataFrame:
    """linked, root: connected() with the roots themselves, written. Nodes without links have no row."""
    linked = connected(links, folder)
    return written(linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "linked"), "roots", folder)


def rooted(nodes: DataFrame, links: DataFrame, node: str = "node", folder: str | None = None) -> DataFrame:
    """nodes (`node`, a long, and least, the least doc_id or null) with component_id, the least doc_id that links reach."""
    linked = linked_roots(links, folder)
    member = nodes.select(F.col(node).alias("linked"), "least").join(small(linked), "linked")
    best = member.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "of")
    named = written(linked.join(small(written(best, "components", folder)), F.col("root") == F.col("of")).drop("of", "root"), "roots-named", folder)
    got = nodes.join(small(named), nodes[node] == named["linked"], "left")
    return got.select(*[nodes[c] for c in nodes.columns], F.when(F.col("linked").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def near_groups(docs: DataFrame, words: int = 4, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id reachable over links of at most `radius` bits).

    Null or empty texts have fingerprint 0 and are linked as any other. A null doc_id takes part:
    where no row of a component has an id it has none (null). Ids may be any long.
    Repeated rows get their row each; an empty table gives none; other columns are ignored.
    """
    fps = written(fingerprints(docs, words, text), "simhash-fps")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")  # a node is a fingerprint, and its name as well
    named = rooted(nodes, near_links(nodes.select(F.col("fp").alias("rep"), "fp"), radius=radius), "fp")
    return fps.join(named.select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def op5(spark, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """The rows of docs whose doc_id is their component's; of rows that repeat such an id one. Rows without an id stay.

    doc_id names a document: rows that share one are taken to be the same.
    """
    return first_of(docs, near_groups(docs, words, radius=radius))


def first_of(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """one_of_each() by groups: doc_id, component_id."""
    found = written(groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") != F.col("component_id")).alias("copy"), F.count("*").alias("n")).filter("copy OR n > 1"), "simhash-copies")
    kept = docs.join(found.filter("copy").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = found.filter("NOT copy").select("doc_id")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
