"""Documents whose word-shingle sets have a Jaccard similarity of 0.8 or more, all of them.

Fingerprints alone can't say: sets of similarity 0.8 lie about 9 bits apart, some 17. So SimHash's
trees only propose links, which join most large groups of copies cheaply; every link is verified on the sets. What the trees leave
apart is tried in rounds by min-hash bands: nodes of one band meet one of them, and those that this leaves apart a few others in the next rounds, so
pairs grow with the nodes, however large a family of near copies is. Then an exact prefix join completes the links: with the shingles of all documents in one order, two sets of n and m that are
similar enough share one of the first n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1, these heads. Only shingles there that documents
of different groups have are looked at, and of those that the very same documents have, as of a passage, one. Of a shingle's documents those of its most frequent group only meet the others.
The first shingle that copies share has all others that they share behind it in both sets, which bounds how late it may come.
Where two documents meet they are listed only if their parity sketches may be those of copies. A sketch has a bit for each class of shingles,
set if an odd number of the set's are in the class. Each shingle that only one of two sets has flips one bit, so sketches of copies differ in no more bits than
(n + m) / 9, which is all that copies may differ by. Sketches have 256 classes where many rows carry them, and four classes a shingle or more
in the prefix join: few pairs pass that are not copies or nearly so. Shingles that a bounded sample shows to be
common come last in the order, which saves work and changes no result.

A set is that of its shingles' XXH64. Documents with the same set are one node. Intermediate tables are deleted when
the groups are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, new_folder, small, written
from .simhash import first_of, linked_roots, majority, near_links, rooted, shingle_hashes

#: Sets are copies if NUM / DEN of their union is shared.
NUM, DEN = 4, 5
#: Documents that show which shingles are common, and such shingles at most.
SAMPLE, COMMON = 8192, 200_000
#: Longs of a parity sketch.
SKETCH = 4
#: Bands, and min-hashes of a band: sets of similarity 0.8 share a band in 0.9998 of all cases. And how many of a band its nodes meet in each round.
BANDS, ROWS, MET = 16, 4, (1, 8)
_FACTORS = np.random.default_rng(45).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def head_size(n):
    return n - -(-n * NUM // DEN) + 1


def alike(shared, n, m):
    """Whether sets of n and m with that many in common are copies. Works on numbers and columns."""
    return shared * (NUM + DEN) >= (n + m) * NUM


def parity(h: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """The parity sketch of distinct hashes, of so many longs (a power of two)."""
    odd = np.bincount((h >> np.uint64(40)).astype(np.int64) % (64 * longs), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parity(h: np.ndarray) -> np.ndarray:
    """A parity sketch of at least four bits a hash: sets that are not copies seldom pass for some."""
    return parity(h, max(SKETCH, 1 << (max(1, len(h)) * 4 // 64).bit_length()))


def bands(h: np.ndarray) -> list[int]:
    """Hashes of the min-hash bands of distinct hashes; none of an empty set."""
    if not len(h):
        return []
    least = np.array([(h * a).min() for a in _FACTORS], np.uint64)  # an odd factor permutes all hashes
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def may_be_alike(x: Column, y: Column, n: Column, m: Column) -> Column:
    """False only for sets of n and m with sketches x and y that can't be copies."""
    differ = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(SKETCH)), F.lit(0))
    return differ * (NUM + DEN) <= (n + m) * (DEN - NUM)


def wide_may_be_alike(x: Column, y: Column, n: Column, m: Column) -> Column:
    """may_be_alike() by sketches of wide_parity(); those of sets of such sizes are as long or one twice as long: then its halves are laid over one another."""

    def folded(w: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(w) <= half, w).otherwise(F.zip_with(F.slice(w, F.lit(1), half), F.slice(w, half + 1, half), lambda a, b: a.bitwiseXOR(b)))

    differ = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return alike(F.least(n, m), n, m) & (differ * (NUM + DEN) <= (n + m) * (DEN - NUM))


def common_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles in three or more of about SAMPLE texts, from rare to common."""
    share = min(1.0, SAMPLE / max(1, texts.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("t").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, words)).view(np.int64))], names=["h"])

    few = texts.filter(F.pmod(F.xxhash64("t", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))).select("t").distinct()
    counts = few.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 2")
    return counts.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()["h"].to_numpy()[::-1].view(np.uint64)


def text_key(t: str) -> Column:
    """Texts, as bytes, by their MD5."""
    return F.unhex(F.md5(t))


def shingle_sets(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """doc_id, key (128 bits of the set), fp, n, bits (its parity sketch), wide (a longer one), bands, head (the set's first shingles), tk (128 bits of the text) for each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    late = common_shingles(texts, words)
    texts = texts.withColumn("tk", text_key("t"))
    held = docs.sparkSession.sparkContext.broadcast((np.sort(late), np.argsort(late) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = held.value
        for batch in batches:
            keys, fps, sizes, sketches, wides, banded, heads = [], [], [], [], [], [], []
            for t in batch.column("t").to_pylist():
                h = shingle_hashes(t, words)
                fps.append(majority(h))
                h = np.unique(h)
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, place[at], 0)
                keys.append(xxhash.xxh3_128_hexdigest(h.tobytes()))
                sizes.append(len(h))
                sketches.append(parity(h))
                wides.append(wide_parity(h))
                banded.append(bands(h))
                heads.append(h[np.argsort(rank, kind="stable")[: head_size(len(h))]].view(np.int64) if len(h) else h.view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(keys, pa.string()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(wides, pa.list_(pa.int64())), pa.array(banded, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64())), batch.column("tk"),
            ], names=["doc_id", "key", "fp", "n", "bits", "wide", "bands", "head", "tk"])

    return texts.mapInArrow(run, "doc_id long, key string, fp long, n long, bits array<long>, wide array<long>, bands array<long>, head array<long>, tk binary")


def named(nodes: DataFrame) -> tuple[DataFrame, Column]:
    """(nodes with rep, a long of their own; how it comes from key). Hashes the key anew in the rare case that two nodes share one."""
    salt = 0
    while True:
        name = F.xxhash64(F.lit(salt), "key")
        if nodes.groupBy(name.alias("rep")).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return nodes.withColumn("rep", name), name
        salt += 1


class Verifier:
    """Tells which pairs of nodes are copies. A node's shingle set is hashed from its text once, when a pair first needs it, and kept in the shared folder.

    docs: the documents; nodes: rep, tk.
    """

    def __init__(self, docs: DataFrame, text: str, nodes: DataFrame, words: int, folder: str):
        self.texts = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).withColumn("tk", text_key("t"))
        self.nodes, self.words, self.folder = nodes, words, folder
        self.held: DataFrame | None = None

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose shingle sets are copies, written. The texts of nodes in pairs move, no others."""
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "near-pairs", self.folder)
        if pairs.isEmpty():
            return pairs
        used = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        if self.held is not None:
            used = used.join(self.held.select("rep"), "rep", "left_anti")
        used = written(self.nodes.select("rep", "tk").join(small(written(used, "near-used", self.folder)), "rep", "left_semi"), "near-wanted", self.folder)
        words = self.words

        def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in batch.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], names=["rep", "body"])

        new = self.texts.join(small(used), "tk").select("rep", "t").dropDuplicates(["rep"]).mapInArrow(hash_sets, "rep long, body binary")
        new = written(new, "near-bodies", self.folder)
        held = self.held = new if self.held is None else self.held.unionByName(new)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (batch.column(c) for c in ("x", "y"))
                keep = []
                for i in range(len(x)):
                    p, q = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                    keep.append(bool(alike(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        both = pairs.join(held.select(F.col("rep").alias("b"), F.col("body").alias("y")), "b").join(held.select(F.col("rep").alias("a"), F.col("body").alias("x")), "a")
        return written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near-links", self.folder)


def met_in_bands(nodes: DataFrame, links: DataFrame, verifier: Verifier, folder: str) -> DataFrame:
    """links and what rounds over the bands add to them. nodes: rep, n, bits, bands.

    In each round a node meets those of each of its bands that hashes of the round put first, if links don't join them yet
    and sizes and sketches don't rule them out.
    """
    each = written(nodes.dropDuplicates(["rep"]).select("rep", "n", "bits", F.explode("bands").alias("band")), "near-bands", folder)
    for many in MET:
        now = each.join(small(linked_roots(links, folder)), F.col("rep") == F.col("linked"), "left").select("rep", "n", "bits", "band", F.coalesce("root", "rep").alias("root"))
        met = now.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.array(*(F.min_by(F.struct("rep", "root", "n", "bits"), F.xxhash64("rep", F.lit(many + k))) for k in range(many))).alias("tops"))
        met = met.filter("low <> high").select("band", F.explode(F.array_distinct("tops")).alias("top"))
        met = written(met.select("band", F.col("top.rep").alias("b"), F.col("top.root").alias("b_root"), F.col("top.n").alias("m"), F.col("top.bits").alias("b_bits")), "near-tops", folder)
        n, m = F.col("n"), F.col("m")
        pairs = now.join(small(met), "band").filter("root <> b_root").filter(alike(F.least(n, m), n, m) & may_be_alike(F.col("bits"), F.col("b_bits"), n, m))
        found = verifier.links(pairs.select(F.col("rep").alias("a"), "b"))
        if found.isEmpty():
            break
        links = links.unionByName(found)
    return links


def split_shingles(each: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """rep, n, pos, h, root: the rows of `each` (rep, n, pos, h) whose shingle nodes of different groups have, groups being what links join; written.

    Of shingles that the very same nodes have, as those of a passage, a node's first stands for all: one row.
    """
    each = each.select("rep", "n", "pos", "h").join(small(linked_roots(links, folder)), F.col("rep") == F.col("linked"), "left").select("rep", "n", "pos", "h", F.coalesce("root", "rep").alias("root"))
    # 128 bits name a shingle's nodes: sums of halves of two hashes. A repeated node is in them as often for all of its shingles.
    halves = [part for k in (1, 2) for x in [F.xxhash64(F.lit(k), "rep")] for part in (F.shiftright(x, 32), x.bitwiseAND(F.lit((1 << 32) - 1)))]
    names = [f"s{i}" for i in range(len(halves))]
    split = each.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), *(F.sum(x).alias(s) for s, x in zip(names, halves, strict=True))).filter("low <> high").select("h", *names)
    met = each.join(small(written(split, "near-split", folder)), "h")
    met = met.groupBy("rep", *names).agg(F.min("pos").alias("pos"), F.min("h").alias("h"), F.first("n").alias("n"), F.first("root").alias("root"))
    return written(met.select("rep", "n", "pos", "h", "root"), "near-met", folder)


def met_in_heads(each: DataFrame, sketches: DataFrame, folder: str) -> DataFrame:
    """a, b: all nodes of different groups that share a shingle of their heads and may be copies. each: rep, n, pos, h, root; sketches: rep, bits, wide."""
    # A shingle's most frequent group doesn't meet itself, so the work grows with the others' nodes times all.
    sizes = each.groupBy("h", "root").agg(F.count("*").alias("many"))
    top = sizes.groupBy("h").agg(F.max_by("root", F.struct("many", "root")).alias("top"))
    few = each.join(sketches.dropDuplicates(["rep"]), "rep").join(small(written(top, "near-top", folder)), "h")
    few = few.withColumn("small", F.col("root") != F.col("top")).drop("top")
    side = lambda df, x: df.select("h", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "root", "n", "pos", "small", "bits", "wide")))
    met = side(few.filter("small"), "a").join(side(few, "b").hint("merge"), "h").filter("root_a <> root_b AND (NOT small_b OR rep_a < rep_b)")
    n, m = F.col("n_a"), F.col("n_b")
    # The first shingle that two sets share has all others that they share behind it in both.
    met = met.filter(alike(F.least(n - F.col("pos_a"), m - F.col("pos_b")), n, m))
    met = met.filter(may_be_alike(F.col("bits_a"), F.col("bits_b"), n, m) & wide_may_be_alike(F.col("wide_a"), F.col("wide_b"), n, m))
    return met.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def copy_groups(docs: DataFrame, words: int = 5, radius: int = 5, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, component_id (the smallest doc_id reachable over pairs of copies).

    Null or empty texts have an empty set and are copies of one another. A null doc_id takes part: a group without
    any id has none. Ids may be any long. Repeated rows get their row each; an empty table gives none; other columns are
    ignored. Texts are read from docs again where pairs need them, so docs should be a written table. radius, that of the fingerprints whose links are tried first, changes no result.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "near")
    sets = written(shingle_sets(docs, words, text), "near-sets", folder)
    nodes = sets.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.min("tk").alias("tk"), F.count("*").alias("rows"))
    nodes, name = named(written(nodes, "near-nodes", folder))
    # Of rows that share a set those with its least id bring its head, as good as one another.
    shared = nodes.filter("rows > 1").select(F.col("rep").alias("r"), F.col("least").alias("l"))
    heads = sets.withColumn("rep", name).join(small(written(shared, "near-shared", folder)), F.col("rep") == F.col("r"), "left")
    heads = heads.filter(F.col("r").isNull() | F.col("doc_id").eqNullSafe(F.col("l"))).select("rep", "n", "bits", "wide", "bands", "head")
    verifier = Verifier(docs, text, nodes, words, folder)

    prints = written(nodes.groupBy("fp").agg(F.min("rep").alias("rep")), "near-prints", folder)
    same = nodes.join(prints.withColumnRenamed("rep", "b"), "fp").select(F.col("rep").alias("a"), "b")
    first = verifier.links(near_links(prints, radius=radius, folder=folder).unionByName(same))
    first = met_in_bands(heads, first, verifier, folder)

    each = split_shingles(heads.select("rep", "n", F.posexplode("head").alias("pos", "h")), first, folder)
    second = verifier.links(met_in_heads(each, heads.select("rep", "bits", "wide"), folder))

    groups = rooted(nodes, first.unionByName(second), "rep", folder).select("rep", "component_id")
    groups = written(groups, "near-named", folder)
    found = written(sets.select("doc_id", name.alias("rep")).join(groups, "rep").select("doc_id", "component_id"), "near-groups")
    discard(spark, folder)
    return found


def one_of_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of docs whose doc_id is their group's; of rows that repeat such an id one. Rows without an id stay."""
    return first_of(docs, copy_groups(docs, words))
