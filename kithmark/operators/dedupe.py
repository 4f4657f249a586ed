"""Duplicate photos: exact by digest, visual by perceptual hash, and what to keep."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .graph import components


def keep_rule(photos: DataFrame, group: list[str]) -> DataFrame:
    """photos with rank and keep: most pixels, then bytes (unknown as 0), then the smallest id stays."""
    pixels = F.coalesce(F.col("width") * F.col("height"), F.lit(0))
    order = Window.partitionBy(*group).orderBy(pixels.desc(), F.coalesce("filesize", F.lit(0)).desc(), "id")
    ranked = photos.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.withColumn("keep", F.col("rank") == 1)


def exact_groups(photos: DataFrame) -> DataFrame:
    """Live photos of a space that share a digest with another, ranked."""
    known = photos.filter("deleted = 0 AND sha256 IS NOT NULL")
    many = known.groupBy("space", "sha256").agg(F.count("*").alias("n")).filter("n >= 2")
    return keep_rule(known.join(many, ["space", "sha256"]), ["space", "sha256"])


def text_hashes(texts: DataFrame) -> DataFrame:
    """id, hash from (id, text): SimHash by the first half of the MD5 of three-word shingles, so texts that share most shingles differ in few bits.

    A bit is set where more than half of the shingles have it. Words lie between single spaces; a shingle starts at every
    word, the last two are shorter. A null text has no hash. Two bits' counts share a long: their sums are below 2^31 each.
    """
    words = F.split("text", " ")
    runs = F.arrays_zip("words", F.expr("slice(words, 2, size(words))"), F.expr("slice(words, 3, size(words))"))
    rows = texts.filter("text IS NOT NULL").select("id", words.alias("words")).select("id", F.inline(runs).alias("x", "y", "z"))
    number = F.conv(F.substring(F.md5(F.concat_ws(" ", "x", "y", "z")), 1, 16), 16, -10).cast("long")
    rows = rows.select("id", number.alias("m"))
    twos = [F.sum(F.shiftrightunsigned("m", bit).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"t{bit}") for bit in range(32)]
    packed = rows.groupBy("id").agg(F.count("*").alias("n"), *twos)
    counts = packed.select("id", "n", *(F.shiftrightunsigned(f"t{bit}", 32).alias(f"h1_{bit}") for bit in range(32)), *(F.col(f"t{bit}").bitwiseAND(F.lit((1 << 32) - 1)).alias(f"h2_{bit}") for bit in range(32)))
    digit = lambda h, top: sum((F.when(F.col(f"{h}_{top - i}") * 2 > F.col("n"), 8 >> i).otherwise(0) for i in range(4)), F.lit(0))
    digits = [F.substring(F.lit("0123456789abcdef"), digit(h, top) + 1, F.lit(1)) for h in ("h1", "h2") for top in range(31, 0, -4)]
    return counts.select("id", F.concat(*digits).alias("hash"))


def fold_hashes(items: DataFrame) -> DataFrame:
    """id, hash, copies: each hash once, by its smallest id; null hashes are left out."""
    return items.filter("hash IS NOT NULL").groupBy("hash").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "hash", "copies")


def segments(threshold: int, rows: int) -> list[tuple[int, int, int]]:
    """(offset, width, radius) of the bit segments to probe, so that hashes within `threshold` bits are within a segment's radius somewhere.

    Of m segments the first threshold % m + 1 have radius threshold // m, the others one less (none below 0): differences
    that exceed all of them add up to more than the threshold. m is what costs least a row: the values it is
    probed with, and the rows that these are expected to meet. More rows take fewer, wider segments.
    """
    found = []
    for m in range(1, min(threshold + 1, 64) + 1):
        edges = [64 * i // m for i in range(m + 1)]
        radii = [threshold // m - (i > threshold % m) for i in range(m)]
        parts = [(lo, hi - lo, r) for lo, hi, r in zip(edges, edges[1:], radii, strict=False) if r >= 0]
        values = [sum(comb(w, d) for d in range(r + 1)) for _, w, r in parts]
        if sum(values) <= 4096:
            found.append((sum(v + rows * v / 2**w for v, (_, w, _) in zip(values, parts, strict=True)), parts))
    if not found:
        raise ValueError(f"hashes within {threshold} bits of one another can't be found by segments")
    return min(found)[1]


def hamming_pairs(items: DataFrame, threshold: int, scope: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """a, b, distance: pairs a < b of items (id, hash of 16 hex digits) that differ by at most `threshold` bits.

    One side goes in with its own value of each segment, the other with all values within the segment's radius, so an
    equi join on (segment, value) meets every pair; a pair that several segments find is kept in the first. Segments
    follow the number of items (`rows`, counted if not given). Fold equal hashes first (fold_hashes): they meet in full.
    """
    scope = scope or []
    plan = segments(threshold, items.count() if rows is None else rows)
    half = lambda at: F.conv(F.substring("hash", at, 8), 16, 10).cast("long")
    bits = items.filter("hash IS NOT NULL").select("id", *scope, F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("bits"))
    part = lambda value, at, width: F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    own = [F.struct(F.lit(s).alias("segment"), part(F.col("bits"), at, w).alias("value")) for s, (at, w, _) in enumerate(plan)]

    def around(s: int, at: int, width: int, radius: int):
        flips = F.array(*(F.lit(sum(1 << i for i in c)).cast("long") for d in range(radius + 1) for c in combinations(range(width), d)))
        return F.transform(flips, lambda x: F.struct(F.lit(s).alias("segment"), part(F.col("bits"), at, width).bitwiseXOR(x).alias("value")))

    a = bits.select("*", F.explode(F.concat(*(around(s, *p) for s, p in enumerate(plan)))).alias("at")).alias("a")
    b = bits.select("*", F.explode(F.array(*own)).alias("at")).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("at.segment", "at.value", *scope)]
    apart = F.col("a.bits").bitwiseXOR(F.col("b.bits"))
    met = a.join(b, [*on, F.col("a.id") < F.col("b.id")]).filter(F.bit_count(apart) <= threshold)
    earlier = [(F.col("a.at.segment") > s) & (F.bit_count(part(apart, at, w)) <= r) for s, (at, w, r) in enumerate(plan[:-1])]
    for hit in earlier:
        met = met.filter(~hit)
    return met.select(*(F.col(f"a.{c}") for c in scope), F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.bit_count(apart).cast("long").alias("distance"))


def visual_groups(items: DataFrame, threshold: int = 5) -> DataFrame:
    """id, component of items that are near another, directly or through others. Equal hashes are one node, so copies cost a link each."""
    known = written(items.filter("hash IS NOT NULL").select("id", "hash"), "hashes")
    nodes = fold_hashes(known)
    pairs = hamming_pairs(nodes, threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    copies = known.join(nodes.select("hash", F.col("id").alias("first")), "hash").filter("id <> first").select(F.col("first").alias("src"), F.col("id").alias("dst"))
    return components(pairs.unionByName(copies))


def drop_ids(*groups: DataFrame) -> DataFrame:
    """Ids that any group would drop, each once. Groups have id and keep."""
    out = groups[0].filter("NOT keep").select("id")
    for g in groups[1:]:
        out = out.unionByName(g.filter("NOT keep").select("id"))
    return out.distinct()


def reclaimable(photos: DataFrame, drops: DataFrame) -> DataFrame:
    """n_drop, bytes: each dropped id once, unknown sizes as 0."""
    got = drops.select("id").distinct().join(photos.select("id", "filesize"), "id").dropDuplicates(["id"])
    return got.agg(F.count("*").alias("n_drop"), F.coalesce(F.sum(F.coalesce("filesize", F.lit(0))), F.lit(0)).alias("bytes"))
