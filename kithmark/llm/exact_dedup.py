"""Exact dedup over an extendible-hash index that lives in the shared folder.

A text's key is 64 bits of its normalised bytes' MD5. The index is a directory over key prefixes: it starts at a
depth that leaves buckets too full, then a bucket with more than ``capacity`` keys splits on the next bit of
the prefix, round by round, and the directory doubles whenever a bucket as deep as itself splits. The directory routes
what tasks have summed of their rows to the owner of its (bucket, key) range. Owners compare the bytes of all texts that share a key, number the
chain of different ones and say who of each stays and how many there are. Every row is routed the same way and looks its text up in its bucket. An index with an
overfull bucket is refused.

Only keys and digests of all rows are shuffled; texts move only if their key occurs twice.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, small, written

#: Keys of a bucket, some 5 MB of index.
CAPACITY = 50_000
#: Parts of a text's rows that are summed apart before they meet at its owner.
SALTS = 8
#: Directory slots, and keys that occur twice, up to which they are broadcast.
SLOTS = TWICE = 2_000_000
#: No more than this many texts are heavy: each has more than this part of all rows.
HEAVY = 100_000


def keyed(docs: DataFrame, text: str = "text", key_bits: int = 64) -> DataFrame:
    """doc_id, norm, key. Null text is empty. key_bits below 64 force collisions, for tests."""
    key = F.conv(F.substring(F.md5("norm"), 1, 16), 16, -10).cast("long")
    key = key if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)
    return docs.select("doc_id", ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("norm")).withColumn("key", key)


def slot(depth: int, key: str = "key") -> Column:
    """The first `depth` bits of a key."""
    return F.shiftrightunsigned(F.col(key), 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth for each of the directory's 2**depth slots; depth). keys: one row per key.

    A bucket is named by its depth and prefix: 2**local_depth + prefix. Rounds end when no bucket is
    overfull; hashed keys take two or three in all. Only the buckets that the last round split are counted again.
    """
    spark, n = keys.sparkSession, keys.count()
    need = ceil(log2(max(1.0, n / capacity)))
    depth = max(0, need - 1)
    slots = spark.range(1 << depth).select(F.col("id").alias("slot"), (F.col("id") + (1 << depth)).alias("bucket"), F.lit(depth).alias("local_depth"), F.lit(True).alias("fresh"))
    while True:
        slots = written(slots, "dedup-directory")
        held = keys.select(slot(depth).alias("slot")).join(small(slots.filter("fresh"), SLOTS), "slot")
        full = held.groupBy("bucket", "local_depth").agg(F.count("*").alias("n")).filter(F.col("n") > capacity)
        full = written(full.select("bucket", "local_depth"), "dedup-overfull")
        top = full.agg(F.max("local_depth")).first()[0]
        if top is None:
            return slots.drop("fresh"), depth
        if top == depth:  # the directory doubles: each slot becomes two
            slots, depth = slots.withColumn("slot", F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1))), depth + 1
        split = slots.join(small(full.select("bucket", F.lit(1).alias("more")), SLOTS), "bucket", "left")
        split = split.select("slot", (F.col("local_depth") + F.coalesce("more", F.lit(0))).alias("local_depth"), F.col("more").isNotNull().alias("fresh"))
        slots = split.select("slot", F.expr(f"shiftleft(1L, local_depth) + shiftrightunsigned(slot, {depth} - local_depth)").alias("bucket"), "local_depth", "fresh")


def routed(df: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """df with the bucket of its key, by way of the directory's slots."""
    return df.withColumn("slot", slot(depth)).join(small(slots.select("slot", "bucket"), SLOTS), "slot").drop("slot")


def index(rows: DataFrame, keys: DataFrame, slots: DataFrame, depth: int, capacity: int) -> DataFrame:
    """bucket, key, chain, sha, keep_id, group_size: one entry per text, written in ranges of (bucket, key).

    rows: doc_id, norm, key; keys: key, n, doc_id, sha (of one of its rows).
    """
    # Texts that share a key meet by their bytes; what a map task has twice it sends once, so no hot text moves more than once a task and salt.
    met = rows.join(small(keys.filter("n > 1").select("key"), TWICE), "key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    met = met.groupBy("key", "norm", "salt").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("salt").withColumn("sha", F.unhex(F.sha2("norm", 256)))
    alone = keys.filter("n = 1").select("key", F.lit("").alias("norm"), "doc_id", "n", "sha")
    owned = routed(met.unionByName(alone), slots, depth).repartitionByRange("bucket", "key")
    texts = owned.groupBy("bucket", "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.first("sha").alias("sha"))
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("norm")).cast("long")
    # Rows find their text by digest, so different bytes must not share one.
    one = F.when(F.count("*").over(Window.partitionBy("bucket", "key", "sha")) > 1, F.raise_error("different texts of one digest")).otherwise(chain)
    found = written(texts.select("bucket", "key", one.alias("chain"), "sha", "keep_id", "group_size"), "dedup-index")
    if not found.filter("chain = 1").groupBy("bucket").agg(F.count("*").alias("keys")).filter(F.col("keys") > capacity).isEmpty():
        raise ValueError("the directory leaves a bucket overfull")
    return found


def exact_groups(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal if identical after lower-casing A-Z; null is empty; the largest doc_id of a
    group stays. Rows that repeat a doc_id count each; a null doc_id loses against any other,
    and a group of only null ids keeps none of them by name (keep_id null, kept on all). An empty
    table gives no rows; other columns of docs are ignored, so none can clash.
    """
    rows = keyed(docs, text, key_bits)
    entries = written(rows.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-entries")
    keys = written(entries.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha")), "dedup-keys")
    slots, depth = directory(keys, capacity)
    found = index(rows, keys, slots, depth, capacity)
    asked = routed(entries, slots, depth)
    # Heavy texts are few whatever the table's size, so theirs is a broadcast; no other has enough rows to fill a task.
    heavy = F.col("group_size") > F.lit(max(1000, entries.count() // HEAVY))
    many = F.broadcast(found.filter(heavy))
    at = ["bucket", "key", "sha"]
    hot = asked.join(many, at)
    rest = asked.join(many.select(*at), at, "left_anti").join(found.filter(~heavy), at)
    return hot.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain")


def op1(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size, CAST('0x' || substr(md5(norm), 1, 16) AS UBIGINT) AS key FROM t GROUP BY norm),
k AS (SELECT DISTINCT key FROM g),
s AS (SELECT greatest(0, CAST(ceil(log2(greatest(1.0, count(*) / {CAPACITY}.0))) AS INT) - 1) AS start FROM k),
p AS (SELECT key, d, CAST(floor(key / pow(2::DOUBLE, 64 - d)) AS BIGINT) AS prefix FROM k, s, range(0, 40) r(d) WHERE d >= start),
f AS (SELECT d, prefix FROM p GROUP BY d, prefix HAVING count(*) <= {CAPACITY}),
b AS (SELECT key, min((1::BIGINT << d) + prefix) AS bucket FROM p JOIN f USING (d, prefix) GROUP BY key)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256, bucket,
  dense_rank() OVER (PARTITION BY key ORDER BY norm) AS chain FROM t JOIN g USING (norm) JOIN b USING (key)
"""
