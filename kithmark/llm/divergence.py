"""How the sources of a language differ in their terms, by bitmaps of counts.

Each language's frequent terms are numbered in blocks. For a source and a count, the terms of a block that occur
so often in it are a bitset. Two sources' bitsets ANDed and popcounted give how many terms have each pair of counts; as a term's probability
depends on its count alone, each cell is worth its size times the difference of two probabilities. Terms that a source doesn't have
need no bitset: they are what a bitset's cells leave over, and what no bitset holds. Integers throughout.

Sources are dealt into tiles and a task compares two tiles in one block, so its size is bounded whatever a language has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: Documents of its language that a term must be in.
LEAST_DOCS = 30
#: Ranks of part `term`.
TOP = 50
#: Terms that a block has room for, and that it gets on average; what its hash overfills goes to a further block.
ROOM, FILL = 1024, 512
#: Sources of a tile, on average.
TILE = 64
#: Terms whose counts a task holds before it passes them on.
HELD = 200_000

#: Bytes of terms; A-Z as a-z, all others as a space.
LETTERS = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (UTF-8), n (occurrences), docs (documents with it), summed in parts; null text, lang and source are empty."""
    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("t"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                k = len(n)
                columns = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for t, lang, source in zip(batch.column("t"), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                terms = t.as_buffer().to_pybytes().translate(LETTERS).split()
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(terms)
                docs.update(set(terms))
                size += len(n) - before
                if size >= HELD:
                    yield from passed_on()
                    held, size = {}, 0
        yield from passed_on()

    return rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def probability(count: Column | str, n: Column | str, terms: Column | str) -> Column:
    """1 + floor(1000000000 * (count + 5) / (n + 5 * terms)), in decimals of 38 digits."""
    count, n, terms = ((F.col(c) if isinstance(c, str) else c) for c in (count, n, terms))
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)")
    return F.call_function("div", top, (n + 5 * terms).cast("decimal(20,0)")).cast("long") + 1


def compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """lang, a, b, value: for each two sources of two tiles (tile, of `x` and `y`), the sum over one block's terms of their probabilities' differences.

    pdf: a row for each source and count of the block (source, tile, count, p, bits; bits are 64 terms each), with count 0 for every source.
    """
    lang, size, x, y = (pdf[c].iloc[0] for c in ("lang", "size", "x", "y"))
    pdf = pdf.sort_values(["source", "count"], kind="stable")
    names, first = np.unique(pdf["source"].to_numpy(str), return_index=True)
    tile, p = pdf["tile"].to_numpy()[first], pdf["p"].to_numpy(np.int64)
    bits = np.stack(pdf["bits"].to_numpy()).astype(np.int64).view(np.uint64)
    ends, p0 = np.append(first[1:], len(p)), p[first]
    cards = np.bitwise_count(bits).sum(1).astype(np.int64)
    of = np.repeat(np.arange(len(names)), ends - first)
    out = []
    for a in range(len(names)):
        # Each pair once: within a tile the later sources, else those of the other tile.
        others = np.arange(a + 1, len(names)) if x == y else np.flatnonzero(tile == y) if tile[a] == x else np.array([], int)
        if not len(others):
            continue
        rows = np.flatnonzero(np.isin(of, others))
        at = np.searchsorted(others, of[rows])
        value, met, theirs = np.zeros(len(others), np.int64), np.zeros((ends[a] - first[a], len(others)), np.int64), np.zeros(len(rows), np.int64)
        mine = slice(first[a], ends[a])
        for w in range(bits.shape[1]):
            i, j = np.flatnonzero(bits[mine, w]), np.flatnonzero(bits[rows, w])
            if not len(i) or not len(j):
                continue
            cells = np.bitwise_count(bits[mine, w][i][:, None] & bits[rows, w][j][None, :]).astype(np.int64)
            worth = (cells * np.abs(p[mine][i][:, None] - p[rows][j][None, :])).sum(0)
            np.add.at(value, at[j], worth)
            np.add.at(theirs, j, cells.sum(0))
            cut = np.flatnonzero(np.diff(at[j], prepend=-1))
            met[np.ix_(i, at[j][cut])] += np.add.reduceat(cells, cut, axis=1)
        value += ((cards[mine][:, None] - met) * np.abs(p[mine][:, None] - p0[others][None, :])).sum(0)
        np.add.at(value, at, (cards[rows] - theirs) * np.abs(p[rows] - p0[a]))
        had = np.bincount(at, cards[rows], len(others)).astype(np.int64)  # below 2**53: terms of a block
        value += (size - cards[mine].sum() - had + met.sum(0)) * np.abs(p0[a] - p0[others])
        out += [(lang, names[a], names[b], int(v)) for b, v in zip(others, value, strict=True)]
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"]).astype({"value": "int64"})


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, room: int = ROOM, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source).

    Part `pair` has a row for each two sources of a language: the sum over all kept terms of what their probabilities differ by.
    Part `term` has the terms that a source has oftener than its language, up to rank `top`. Null text, lang and source are
    empty. Rows count each, repeats and those without id included. A source without terms, or in a language without kept ones, has its pairs
    (value 0 if the language has none); a language with one source has none. An empty table gives no rows; other columns are ignored, so none can clash.
    """
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    counts = counts.withColumn("in_docs", F.sum("docs").over(whole)).withColumn("in_lang", F.sum("n").over(whole)).filter(F.col("in_docs") >= least_docs)
    kept = written(counts.withColumn("head", F.row_number().over(whole.orderBy("source")) == 1).select("lang", "source", "term", "n", "in_lang", "head"), "divergence-terms")

    langs = kept.filter("head").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_n"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["source_n", "terms", "lang_n"])
    many = F.count("*").over(Window.partitionBy("lang"))
    groups = written(groups.withColumn("tiles", F.ceil(many / tile)).withColumn("tile", F.pmod(F.xxhash64("source"), "tiles")), "divergence-groups")

    p = probability("n", "source_n", "terms")
    own = kept.join(small(groups), ["lang", "source"]).withColumn("p", p)
    over = own.withColumn("value", F.col("p") - probability("in_lang", "lang_n", "terms")).filter("value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    over = over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")

    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / (room // 2)))
    bit = F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    placed = own.withColumn("block", block).withColumn("bit", bit).withColumn("further", F.floor(F.col("bit") / room)).withColumn("bit", F.col("bit") % room)
    placed = written(placed.select("lang", "block", "further", "bit", "source", "n", "p", "tile", "tiles"), "divergence-places")
    words = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).otherwise(F.lit(0).cast("long"))) for w in range(room // 64)]
    levels = placed.groupBy("lang", "block", "further", "source", F.col("n").alias("count"), "p", "tile", "tiles").agg(F.array(*words).alias("bits"))
    blocks = written(placed.groupBy("lang", "block", "further").agg((F.max("bit") + 1).alias("size")), "divergence-blocks")
    none = blocks.join(small(groups), "lang").select("lang", "block", "further", "source", F.lit(0).cast("long").alias("count"), probability(F.lit(0), "source_n", "terms").alias("p"), "tile", "tiles", F.array_repeat(F.lit(0).cast("long"), room // 64).alias("bits"))
    every = levels.unionByName(none).join(small(blocks), ["lang", "block", "further"])
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    every = every.withColumn("x", F.least("tile", "other")).withColumn("y", F.greatest("tile", "other")).drop("other", "tiles")
    pairs = every.groupBy("lang", "block", "further", "x", "y").applyInPandas(compared, "lang string, a string, b string, value long")
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    bare = groups.filter("terms = 0").select("lang", "source")
    bare = bare.select("lang", F.col("source").alias("a")).join(bare.withColumnRenamed("source", "b"), "lang").filter("a < b").withColumn("value", F.lit(0).cast("long"))
    pairs = pairs.unionByName(bare).select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    pairs = pairs.select("lang", F.col("x.a").alias("source"), F.lit("pair").alias("part"), F.col("x.b").alias("item"), "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.unionByName(over)


def op11(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM o GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS lang_n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT s.*, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY s.lang, source) + 5 * v)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (lang_n + 5) // (total + 5 * v) AS q FROM s JOIN v ON s.lang = v.lang),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
t AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM y
UNION ALL SELECT lang, source, 'term', item, value, rank::INT FROM t WHERE rank <= {TOP}
"""
