"""How filters interact: what each removes at each place of every order, by packed counters.

Five filters make 32 masks of failures, and a mask says what happens to a document at each of the 600 steps of the
120 orders. So each mask is a big integer with a field of 64 bits for every step: KEPT, REMOVED and REDUNDANT hold a one where the
document is kept, removed, or fails and was removed before; UNIQUE where it fails this step's filter alone. A part's documents are added up
as such integers (each as often as the part has it), and the sums' fields are the counts. No table has 2**64 rows, so no field overflows into the next.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: (order, step, filter) of every field, from the lowest.
STEPS = [(order, k + 1, f) for order in ORDERS for k, f in enumerate(order)]
BITS = 64


def outcomes(mask: int) -> dict[str, int]:
    """The packed integers of a document whose failing filters are the mask's bits (A is the lowest)."""
    packed = dict.fromkeys(("kept", "removed", "redundant", "unique_fails"), 0)
    for field, (order, step, f) in enumerate(STEPS):
        fails = mask >> FILTERS.index(f) & 1
        gone = any(mask >> FILTERS.index(g) & 1 for g in order[: step - 1])
        one = 1 << BITS * field
        if not gone:
            packed["removed" if fails else "kept"] += one
        elif fails:
            packed["redundant"] += one
        if mask == 1 << FILTERS.index(f):
            packed["unique_fails"] += one
    return packed


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum of packed integers."""
    return np.frombuffer(total.to_bytes(len(STEPS) * BITS // 8, "little"), "<u8").astype(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, part, sha (of the text, 32 bytes), mask of the filters A to D that fail."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    upper = F.char_length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * upper.cast("long") > 5 * F.char_length("text").cast("long"), F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "part", F.unhex(F.sha2("text", 256)).alias("sha"), mask.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents by all five filters. Texts are the same if their SHA-256 is.

    Copies of a text differ in E alone: rows that have its smallest doc_id pass, others fail. So they are counted by text, part and labels,
    which tasks do before anything moves; how many rows have the smallest id is counted along.
    """
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flags = written(flags.filter("doc_id IS NOT NULL AND (good OR toxic)"), "audit-labels")
    rows = written(features(docs), "audit-features")
    known = rows.join(small(flags), "doc_id", "left").select("doc_id", "part", "sha", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    same = ["sha", "part", "mask", "good", "toxic"]
    by_id = known.groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = by_id.groupBy(*same).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least.alias("least"))
    groups = written(groups, "audit-texts")
    first = groups.groupBy("sha").agg(F.min("least.doc_id").alias("first"), F.count("*").alias("many"))
    groups = groups.join(first, "sha")
    passing = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    e = 1 << FILTERS.index("E")
    split = groups.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", passing.alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - passing).alias("n")))).alias("x"))
    return split.groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    docs: doc_id, text, source (null text and source are empty); labels: doc_id, quality, toxic. Documents without labels are
    neither good nor toxic; of several labels of an id any counts. Repeated rows count each, and those that share a text's smallest id
    don't fail E. A null id is no smaller than any other: its row never fails E and makes none fail. An empty table has no
    parts and gives no rows; other columns are ignored, so none can clash.
    """
    counts = mask_counts(docs, labels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0)
        for mask, good, toxic, n in zip(pdf["mask"], pdf["good"], pdf["toxic"], pdf["n"], strict=True):
            packed = outcomes(int(mask))
            for name, fields in packed.items():
                sums[name] += int(n) * fields
            sums["good_lost"] += int(n) * packed["removed"] * bool(good)
            sums["toxic_lost"] += int(n) * packed["removed"] * bool(toxic)
        out = pd.DataFrame({"part": pdf["part"].iloc[0], "filter_order": [s[0] for s in STEPS], "step": np.array([s[1] for s in STEPS], np.int32)} | {name: unpacked(total) for name, total in sums.items()})
        out["shapley"] = out["removed"].groupby([s[2] for s in STEPS]).transform("sum")
        return out

    return counts.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def op12(spark, sf_dir: str) -> DataFrame:
    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH RECURSIVE g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(words) < 50)::INT + 2 * (100 * list_unique(words) < 65 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(first < w.doc_id, false)::INT AS mask FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
p AS (SELECT '' AS o UNION ALL SELECT o || f FROM p, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(o, f)),
s AS (SELECT o AS filter_order, step::INT AS step, substr(o, step, 1) AS f, 1 << (ascii(substr(o, step, 1)) - 65) AS bit, list_sum([1 << (ascii(x) - 65) FOR x IN string_split(substr(o, 1, step - 1), '') IF x <> '']) AS earlier
  FROM p, range(1, 6) r(step) WHERE length(o) = 5),
a AS (SELECT part, filter_order, step, f, sum(n) FILTER ((mask & bit) = 0 AND (mask & coalesce(earlier, 0)::INT) = 0) AS kept, sum(n) FILTER ((mask & bit) > 0 AND (mask & coalesce(earlier, 0)::INT) = 0) AS removed,
  sum(n) FILTER ((mask & bit) > 0 AND (mask & coalesce(earlier, 0)::INT) > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
  sum(good) FILTER ((mask & bit) > 0 AND (mask & coalesce(earlier, 0)::INT) = 0) AS good_lost, sum(toxic) FILTER ((mask & bit) > 0 AND (mask & coalesce(earlier, 0)::INT) = 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM a
"""
