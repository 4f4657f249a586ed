"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand in a fixed random order, cut into blocks of about ``block_words``
words. A source's target is drawn as whole laps over its blocks plus the first blocks of one more
lap, which gives every source an exact quota of block draws. A binary tree then splits all quotas
among the output shards: at each node the left half's share of every source is one draw from the
multivariate hypergeometric law, so the shards partition the quotas exactly, as if all block draws
had been shuffled together. A shard takes a disjoint run of each source's permuted draws and
orders its documents by a hash, locally.

What a document is taken for is what the shards' runs say about its block: a table with a row for each block and
its draws (lap and shard), which every document looks up. Documents are only mapped until they are
written to their shards; their sizes and places are what is counted. All sources stand in one array, so
they should be some thousands at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UNIT, small, unit_hash, written

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MAX_LAPS = 3
#: Words of an output shard, some 25 MB of text.
SHARD_WORDS = 4_000_000
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs with size (words of the text; null: 0) and base, a digest of the document's id, source and text."""
    source = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    base = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), source, F.md5(F.coalesce("text", F.lit("")))))
    return docs.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "base": base})


def placed(rows: DataFrame, twins: DataFrame | None) -> DataFrame:
    """rows (sized) with place and tie: 104 bits that say where the document stands in its source's permutation.

    Rows of one id, source and text (their bases in `twins`, None if there are none) are told apart by a running
    number: counted in the part of the input that they come from, then over the parts, so no group is in one task.
    """
    def stand(df: DataFrame) -> DataFrame:
        h = F.md5(F.concat_ws(":", "base", F.col("nth").cast("string")))
        half = lambda at: F.conv(F.substring(h, at, 13), 16, 10).cast("long")
        return df.withColumns({"place": half(1), "tie": half(14)}).select(*rows.columns, "place", "tie")

    if twins is None:
        return stand(rows.withColumn("nth", F.lit(0)))
    cut = rows.withColumn("part", F.spark_partition_id())
    many = written(cut.join(twins, "base", "left_semi"), "mix-twins")
    sums = many.groupBy("base", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("base").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = many.withColumn("own", F.row_number().over(Window.partitionBy("base", "part").orderBy("base"))).join(small(sums.select("base", "part", before.alias("before"))), ["base", "part"])
    return stand(rows.join(twins, "base", "left_anti").withColumn("nth", F.lit(0))).unionByName(stand(many.withColumn("nth", F.col("own") - 1 + F.col("before"))))


def twins_of(stats: DataFrame) -> DataFrame | None:
    """The bases that several rows have; None if each row has its own."""
    found = written(stats.groupBy("base").agg(F.count("*").alias("n")).filter("n > 1").select("base"), "mix-repeated")
    return None if found.isEmpty() else small(found)


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_LAPS) -> DataFrame:
    """source, source_size, n_rows, target, at: one row per source, aggregated from sized rows.

    Targets share all words by weight; one that would pass ``most`` times its source stops there and
    the rest share anew. In order of source_size / weight the stopped sources come first, so one
    running sum over the sources finds them.
    """
    by = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("at", at).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")))
    cap = F.lit(most) * F.col("source_size")
    upto = Window.orderBy(F.col("source_size") / F.col("weight"), "at").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumns({"left": F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(upto), F.lit(0)), "share": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0))})
    by = by.withColumn("stopped", cap * F.col("share") <= F.col("left") * F.col("weight"))
    by = by.withColumns({"rest": F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("stopped"), cap)).over(every), F.lit(0)), "open": F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(every)})
    target = F.when(F.col("stopped"), cap.cast("double")).otherwise(F.col("rest").cast("double") * F.col("weight") / F.col("open"))
    return by.select("source", "source_size", "n_rows", target.alias("target"), "at")


def _draw(all_: Column, own: Column, taken: Column, u: Column) -> Column:
    """One hypergeometric draw by inversion: how many of `taken` out of `all_` fall on the `own` ones.

    The weights run over the 12 standard deviations about the mean; what lies beyond is smaller
    than the steps of u. Logarithms keep them in range.
    """
    n, m, k = all_.cast("double"), own.cast("double"), taken.cast("double")
    mean = F.when(n > 0, k * m / n).otherwise(0.0)
    sd = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), mean * (1 - m / n) * (n - k) / (n - 1)))).otherwise(0.0)
    low = F.greatest(F.lit(0), taken + own - all_, F.floor(mean - 12 * sd - 12)).cast("long")
    high = F.least(own, taken, F.ceil(mean + 12 * sd + 12)).cast("long")

    def step(acc: Column, x: Column) -> Column:
        """Log weight of x and log of the sum of the weights up to x."""
        d = x.cast("double")
        up = (m - d + 1) * (k - d + 1) / (d * (n - m - k + d))
        w = F.when(x == low, F.lit(0.0)).otherwise(acc["w"] + F.log(up))
        top = F.greatest(acc["s"], w)
        s = F.when(x == low, w).otherwise(top + F.log(F.exp(acc["s"] - top) + F.exp(w - top)))
        return F.struct(w.alias("w"), s.alias("s"))

    def seek(acc: Column, x: Column, goal: Column) -> Column:
        now = step(acc, x)
        return F.struct(now["w"].alias("w"), now["s"].alias("s"), F.when(acc["x"].isNull() & (now["s"] >= goal), x).otherwise(acc["x"]).alias("x"))

    zero, xs = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s")), F.sequence(low, high)
    goal = F.aggregate(xs, zero, step)["s"] + F.log(u)
    first = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s"), F.lit(None).cast("long").alias("x"))
    return F.when(low >= high, low).otherwise(F.coalesce(F.transform(F.array(goal), lambda g: F.aggregate(xs, first, lambda acc, x: seek(acc, x, g))["x"])[0], high))


def split(node: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, quotas from one row of node 1 with quotas: an array of each source's block draws, in order.

    shards is a power of two. The left child's draws are taken source by source, each given the
    sources before it.
    """
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
    node, width = node.withColumns({"node": F.lit(1).cast("long"), "low": F.lit(0).cast("long"), "all": total}), shards
    while width > 1:
        cap = lambda a, width=width: F.floor(F.col("all") * (F.col("low") + a) / shards).cast("long")  # noqa: E731  draws of the shards before that one
        mine = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct((cap(width // 2) - cap(0)).alias("k"), mine.alias("n"), F.array().cast("array<bigint>").alias("out"))

        def one(acc: Column, q: Column) -> Column:
            u = (unit_hash(F.lit(str(seed)), F.col("node").cast("string"), F.size(acc["out"]).cast("string")) + 0.5) / float(UNIT)
            return F.transform(F.array(_draw(acc["n"], q, acc["k"], u)), lambda x: F.struct((acc["k"] - x).alias("k"), (acc["n"] - q).alias("n"), F.concat(acc["out"], F.array(x)).alias("out")))[0]

        left = F.aggregate("quotas", start, one)["out"]
        node = node.withColumn("left", left)
        right = F.zip_with("quotas", "left", lambda a, b: a - b)
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("low"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("low") + width // 2).alias("low"), right.alias("quotas")))
        node = node.select("all", F.explode(halves).alias("h")).select("all", "h.*")
        width //= 2
        if shards // width == 256:
            node = node.repartition("node")  # from here on the nodes split in many tasks
    return node.select(F.col("low").alias("shard"), "quotas")


def shards_for(rows: DataFrame) -> int:
    """A power of two of output shards: of about SHARD_WORDS words each, at least 64."""
    words = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    return 1 << max(6, (words // SHARD_WORDS).bit_length())


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_LAPS, shards: int = 64, seed: int = 7, block_words: int = 200_000, block_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(one row per source: source, at, source_size, target, laps, blocks; one per block: at, block, draws) from placed rows.

    draws: array of (lap, shard, edge, place, tie); on an edge only documents up to (place, tie) are drawn.
    """
    by = targets(rows, weights, most)
    laps = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    blocks = F.greatest(F.ceil(F.col("source_size") / block_words), F.ceil(F.col("n_rows") / block_rows), F.lit(1)).cast("long")
    by = by.withColumns({"laps": laps, "blocks": blocks}).withColumn("rest", F.col("target") - F.col("laps") * F.col("source_size"))
    by = written(by.withColumnRenamed("source", "by_source"), "mix-sources")
    dealt = rows.select("source", "size", "place", "tie").join(small(by.select("by_source", "at", "blocks", "rest")), F.col("source").eqNullSafe(F.col("by_source"))).select("at", "size", "place", "tie", "rest", _block().alias("block"))
    sums = dealt.groupBy("at", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("at").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    edge = sums.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).select("at", "block", "before")
    edge = written(edge, "mix-edges")  # one block of each source that has a last lap
    inside = dealt.join(small(edge), ["at", "block"])
    order = Window.partitionBy("at").orderBy("place", "tie").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    cut = inside.withColumn("in", middle <= F.col("rest")).groupBy("at").agg(F.max(F.when(F.col("in"), F.struct("place", "tie"))).alias("cut"), F.min("block").alias("last_block"))
    by = by.join(small(written(cut, "mix-cuts")), "at", "left")
    draws = F.col("laps") * F.col("blocks") + F.coalesce(F.col("last_block") + 1, F.lit(0))
    by = written(by.withColumn("draws", draws.cast("long")), "mix-quotas")
    root = by.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "draws"))), lambda x: x["draws"]).alias("quotas"))
    leaves = written(split(root, shards, seed), "mix-leaves")
    runs = leaves.select("shard", F.posexplode("quotas").alias("at", "n"))
    end = F.sum("n").over(Window.partitionBy("at").orderBy("shard"))
    each = runs.withColumn("end", end).filter("n > 0").select("at", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("draw"))
    each = each.join(small(by.select("at", "laps", "blocks", "last_block", "cut")), "at").withColumns({"block": F.col("draw") % F.col("blocks"), "lap": F.floor(F.col("draw") / F.col("blocks")).cast("long")})
    edge = F.coalesce((F.col("lap") == F.col("laps")) & (F.col("block") == F.col("last_block")), F.lit(False))
    draw = F.struct("lap", "shard", edge.alias("edge"), F.col("cut.place").alias("place"), F.col("cut.tie").alias("tie"))
    return by, written(each.groupBy("at", "block").agg(F.array_sort(F.collect_list(draw)).alias("draws")), "mix-blocks")


def _block() -> Column:
    return F.floor(F.col("place").cast("double") / float(UNIT) * F.col("blocks")).cast("long")


def assign(rows: DataFrame, plan: tuple[DataFrame, DataFrame]) -> DataFrame:
    """rows (placed) with source_size, target and draws: an array of (lap, shard), one for each time the mix takes the document."""
    sources, blocks = plan
    got = rows.join(small(sources.select("by_source", "at", "source_size", "target", "blocks")), F.col("source").eqNullSafe(F.col("by_source"))).withColumn("block", _block())
    got = got.join(small(blocks.withColumnRenamed("draws", "all_draws")), ["at", "block"], "left")
    taken = F.filter("all_draws", lambda d: ~d["edge"] | F.coalesce((F.col("place") < d["place"]) | ((F.col("place") == d["place"]) & (F.col("tie") <= d["tie"])), F.lit(False)))
    draws = F.coalesce(F.transform(taken, lambda d: F.struct(d["lap"].alias("lap"), d["shard"].alias("shard"))), F.array().cast("array<struct<lap:bigint,shard:bigint>>"))
    return got.select(*[rows[c] for c in rows.columns], "source_size", "target", draws.alias("draws"))


def mix(docs: DataFrame, shards: int | None = None, seed: int = 7, **options) -> DataFrame:
    """The mix itself: a row of docs as often as it is drawn, dealt into shards and shuffled inside each.

    Null or empty texts have size 0: they follow their place, and count no words. Null sources
    are one source, last. Repeated rows each count and have places of their own, as have rows without an id;
    of rows alike in id, source and text any may be the ones taken. An empty table gives an empty mix. All columns
    of docs are kept as they are, whatever their names.
    """
    rows = sized(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text"), seed).drop("text")
    stats = written(rows.drop("row"), "mix-sized")
    twins = twins_of(stats)
    shards = shards or shards_for(stats)
    plan = mix_plan(placed(stats, twins), shards=shards, seed=seed, **options)
    drawn = assign(placed(rows, twins), plan).select("row", "place", F.explode("draws").alias("draw"))
    order = unit_hash(F.lit(f"{seed} order"), F.col("place").cast("string"), F.col("draw.lap").cast("string"))
    drawn = drawn.withColumns({"shard": F.col("draw.shard"), "turn": order}).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("turn")
    return drawn.select("row.*")


def mixed_words(docs: DataFrame, shards: int | None = None, seed: int = 7, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words, repeats counted), draws (lap and shard of each time)."""
    stats = written(sized(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix-sized")
    rows = placed(stats, twins_of(stats))
    got = assign(rows, mix_plan(rows, shards=shards or shards_for(stats), seed=seed, **options))
    return got.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.size("draws") * F.col("size")).cast("long").alias("taken"), "draws")


def op2(spark, sf_dir: str) -> DataFrame:
    return mixed_words(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("draws")


OP2_SQL = r"""
WITH t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END || ':' || md5(coalesce(text, ''))) AS base FROM documents),
p AS (SELECT doc_id, source, size, substr(md5(base || ':' || (row_number() OVER (PARTITION BY base) - 1)), 1, 26) AS place FROM t),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS pos FROM t GROUP BY source),
w AS (SELECT *, CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
c AS (SELECT *, sum(z) OVER () - coalesce(sum(3 * z) OVER o, 0) AS l, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS sh FROM w WINDOW o AS (ORDER BY z / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * z * sh <= l * w AS stopped FROM c),
g AS (SELECT source, z, CASE WHEN stopped THEN CAST(3 * z AS DOUBLE) ELSE CAST(sum(z) OVER () - coalesce(sum(CASE WHEN stopped THEN 3 * z END) OVER (), 0) AS DOUBLE) * w / CAST(sum(CASE WHEN NOT stopped THEN w END) OVER () AS DOUBLE) END AS target FROM f),
r AS (SELECT p.doc_id, p.size, g.z, g.target, CASE WHEN g.z > 0 THEN CAST(floor(g.target / g.z) AS BIGINT) ELSE 0 END AS laps,
  coalesce(sum(p.size) OVER (PARTITION BY p.source ORDER BY p.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + p.size / 2.0 AS middle
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, z AS source_size, round(target, 4) AS target,
  CAST(size * (laps + CASE WHEN middle <= target - laps * z THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
