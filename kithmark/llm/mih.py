"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments of about log2(number of codes) bits, which are m index tables. A query
probes each table with its segment and all values within radius r of it, r growing from 0. Once every table was
probed to radius r, any code not met differs by more than r on each segment, so by m (r + 1) bits at least; a
query is done when its k-th verified distance is below that. A round probes only the values at exactly the new radius, and
only for queries that are not done.

Equal codes are one index entry with their k + 1 smallest ids: no result needs more of them.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written


def sign_code(v: Column) -> Column:
    """The signs of a vector's first 64 parts as a long; bit i is set if part i is above 0. Missing parts are not."""
    bit = lambda i: F.when(F.coalesce(F.get(v, F.lit(i)) > 0, F.lit(False)), F.lit(-(1 << 63) if i == 63 else 1 << i)).otherwise(F.lit(0))
    code = bit(0)
    for i in range(1, 64):
        code = code.bitwiseOR(bit(i).cast("long"))
    return code.cast("long")


def masks(radius: int, width: int) -> list[int]:
    """All values of a segment of that width with that many bits set."""
    return [sum(1 << b for b in c) for c in combinations(range(width), radius)]


def edges_of(n: int) -> list[int]:
    """Where the segments of an index of n codes begin and end."""
    m = max(2, min(16, round(64 / max(4.0, log2(max(2, n))))))
    return [64 * i // m for i in range(m + 1)]


def _segments(code: str, edges: list[int]) -> Column:
    part = lambda a, b: F.shiftrightunsigned(F.col(code), a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
    return F.posexplode(F.array(*(part(a, b) for a, b in zip(edges, edges[1:], strict=False)))).alias("seg", "value")


def top_k(items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, item_id, distance: the k nearest items of each query by (distance, item_id), without itself.

    items and queries have id and code. Rows without an id or a code take no part. Rows that repeat an id
    and code are one item; queries alike. Fewer than k items give fewer results, none give none.
    """
    first = F.dense_rank().over(Window.partitionBy("code").orderBy("id"))  # rows that repeat an id share its place
    items = items.select("id", "code").filter("id IS NOT NULL AND code IS NOT NULL")
    entries = items.withColumn("n", first).filter(F.col("n") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    entries = written(entries, "mih-entries")
    queries = written(queries.select("id", "code").filter("id IS NOT NULL AND code IS NOT NULL").distinct(), "mih-queries")
    edges = edges_of(entries.count())
    widths = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    index = written(entries.select("code", F.size("ids").alias("n_ids"), _segments("code", edges)), "mih-index")
    asked = queries.select(F.col("code").alias("q")).distinct()
    best = None  # q, code, n_ids, distance: distinct codes met so far, the nearest k + 1 ids' worth
    done: list[DataFrame] = []
    open_ = written(asked, "mih-open")
    for radius in range(max(widths) + 1):
        by_width = {w: F.array(*(F.lit(x).cast("long") for x in masks(radius, w))).cast("array<bigint>") for w in sorted(set(widths))}
        mask = by_width[min(widths)]
        for w, values in by_width.items():
            mask = F.when(F.col("seg").isin(*(k for k, x in enumerate(widths) if x == w)), values).otherwise(mask)
        probes = open_.select("q", _segments("q", edges)).withColumn("mask", F.explode(mask))
        probes = probes.select("q", "seg", F.col("value").bitwiseXOR(F.col("mask")).alias("value")).hint("merge")  # its size is not that of open_
        met = probes.join(index, ["seg", "value"]).select("q", "code", "n_ids").distinct().withColumn("distance", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("long"))
        if best is not None:
            met = met.unionByName(best.join(small(open_), "q", "left_semi")).distinct()
        # Enough of the nearest codes to have k + 1 ids; all codes of the last distance stay, as ids decide among them.
        closer = F.coalesce(F.sum("n_ids").over(Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        best = written(met.withColumn("closer", closer).filter(F.col("closer") <= k).drop("closer"), "mih-best")
        covered = len(widths) * (radius + 1) - 1
        sure = best.filter(F.col("distance") <= covered).groupBy("q").agg(F.sum("n_ids").alias("n")).filter(F.col("n") > k).select("q")
        if radius == max(widths):
            sure = open_
        sure = written(sure, "mih-done")
        done.append(best.join(small(sure), "q", "left_semi"))
        open_ = written(open_.join(small(sure), "q", "left_anti"), "mih-open")
        if open_.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    near = found.join(entries, "code").select("q", "distance", F.explode("ids").alias("item_id"))
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy("distance", "item_id"))).filter(F.col("at") <= k + 1)
    got = queries.join(near, queries["code"] == near["q"]).filter("item_id <> id")
    rank = F.row_number().over(Window.partitionBy("id", "code").orderBy("distance", "item_id"))
    return got.select(F.col("id").alias("query_id"), rank.cast("long").alias("rank"), "item_id", "distance").filter(F.col("rank") <= k)


def op8(spark, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    items = written(items, "mih-codes")
    return top_k(items, items.filter("id % 100 = 0"))


OP8_SQL = r"""
WITH b AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END) AS bits FROM embeddings),
q AS (SELECT * FROM b WHERE vec_id % 100 = 0),
d AS (SELECT q.vec_id AS query_id, b.vec_id AS item_id, CAST(len(list_filter(range(1, 65), lambda i: q.bits[i] <> b.bits[i])) AS BIGINT) AS distance FROM q JOIN b ON q.vec_id <> b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank, item_id, distance FROM d)
SELECT * FROM r WHERE rank <= 10
"""
