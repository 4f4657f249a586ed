"""Exact neighbours and pairs of vectors by cells around pivots.

Vectors go to their nearest pivot; a cell with too many is dealt into pieces. A cell is one row: its ids and its vectors as one
matrix, with a center and a radius. The largest inner product that two cells can have is bounded from these, so a pair of cells is
multiplied only if its bound reaches what is already found (neighbours) or asked for (pairs). Cells meet as a product of partitions of
their table, which is read again for each: no shuffle moves a cell a second time, and what is on disk grows with the vectors, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions import scalar as S
from ..plans.storage import discard, written

#: Vectors of a cell, on average at most.
CELL = 2048
#: Pivots at most, which bounds what is broadcast; beyond it cells have several pieces. Pivots are picked from so many times as many vectors.
PIVOTS, SPARE = 8192, 4
#: Cells that a cell meets first, best bound first, before the others are bounded by what it has found.
AHEAD = 3
#: Cells whose bounds are compared in one task, on each side.
GROUP = 1024
#: Products are rounded to so many digits, so that equal vectors tie whatever the shapes of the matrices.
DIGITS = 12
SLACK = 1e-9
#: Rows of a cell that are multiplied at a time, products that are taken exactly at a time, and neighbours that a task holds before it passes them on.
STRIP, EXACT, HELD = 512, 1 << 16, 1 << 23
#: Tasks for each partition of cells: each has its best neighbours of a row, so more tasks pass on more rows.
TASKS = 2

PACKED = "cell long, n int, ids binary, body binary, center array<double>, radius double, norm double"


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """n of the rows of x, each the farthest from those before it."""
    picked, far = [0], np.full(len(x), np.inf)
    while len(picked) < min(n, len(x)):
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
        picked.append(int(far.argmax()))
    return x[picked]


def pack(vectors: DataFrame, cell: int = CELL) -> DataFrame:
    """cell, n, ids (longs), body (n rows of floats if vec has floats, else of doubles), center, radius, norm (the longest vector's) of (id, vec), written.

    Rows without id or vector are left out. Pivots are spread over the vectors whose ids' hashes come first.
    """
    single = vectors.schema["vec"].dataType == ArrayType(FloatType(), vectors.schema["vec"].dataType.containsNull)
    rows = vectors.filter("id IS NOT NULL AND vec IS NOT NULL").select(F.col("id").cast("long").alias("id"), (F.col("vec") if single else S.doubles(F.col("vec"))).alias("vec"))
    wanted = max(1, min(PIVOTS, -(-(total := rows.count()) // cell)))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(wanted * SPARE).select("vec").collect()
    some = np.array([r.vec for r in some], np.float64).reshape(len(some), -1 if some else 0)
    pivots = rows.sparkSession.sparkContext.broadcast(spread(some, wanted) if len(some) else some)

    def nearest(batch: pa.RecordBatch) -> np.ndarray:
        p = pivots.value
        half = (p * p).sum(1) / 2
        x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, p.shape[1]))
        return np.concatenate([(x[i : i + 4096] @ p.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(pivots.value), np.int64)
        for batch in batches:
            n += np.bincount(nearest(batch), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["pivot", "n"])

    pieces = np.ones(max(1, len(pivots.value)), np.int64)
    for r in rows.mapInArrow(counted, "pivot long, n long").groupBy("pivot").agg(F.sum("n").alias("n")).collect():  # no more rows than pivots
        pieces[r.pivot] = -(-r.n // cell)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = nearest(batch)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(at.astype(np.int64)), pa.array(pieces[at])], names=["id", "vec", "pivot", "pieces"])

    of = F.col("pivot") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("pieces"))
    rows = rows.mapInArrow(placed, f"id long, vec array<{'float' if single else 'double'}>, pivot long, pieces long").select(of.alias("cell"), "id", "vec")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        body = np.stack(pdf["vec"].to_numpy())
        x = body.astype(np.float64)
        center = x.mean(0)
        row = {"cell": pdf["cell"].iloc[0], "n": len(x), "ids": pdf["id"].to_numpy(np.int64).tobytes(), "body": body.astype("<f4" if single else "<f8").tobytes(), "center": center.tolist(), "radius": float(np.sqrt(((x - center) ** 2).sum(1)).max()), "norm": float(np.sqrt((x * x).sum(1)).max())}
        return pd.DataFrame([row])

    files = max(1, -(-total // (4 * cell)))
    return written(rows.repartition(files, "cell").groupBy("cell").applyInPandas(one, PACKED), "cells")


def bounds(cells: DataFrame) -> DataFrame:
    """x, y, bound: for each two cells the largest inner product that a vector of x and one of y can have, if it reaches x's `least`.

    cells: cell, center, radius, norm, least. Vectors lie within a radius of their center, so their product is bounded by the centers' and the radii, and by
    their lengths and how near they can be.
    """
    groups = max(1, -(-cells.count() // GROUP))
    rows = cells.select("cell", "center", "radius", "norm", "least", F.pmod(F.xxhash64("cell"), F.lit(groups)).alias("g"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))
    left, right = rows.select(F.col("g").alias("l"), F.explode(every).alias("r"), "*", F.lit(True).alias("own")), rows.select(F.explode(every).alias("l"), F.col("g").alias("r"), "*", F.lit(False).alias("own"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["own"]], pdf[~pdf["own"]]
        if q.empty or c.empty:
            return pd.DataFrame({"x": np.zeros(0, np.int64), "y": np.zeros(0, np.int64), "bound": np.zeros(0)})
        a, b = np.stack(q["center"].to_numpy()), np.stack(c["center"].to_numpy())
        (ra, na, least), (rb, nb) = (q[k].to_numpy()[:, None] for k in ("radius", "norm", "least")), (c[k].to_numpy()[None, :] for k in ("radius", "norm"))
        la, lb = np.sqrt((a * a).sum(1))[:, None], np.sqrt((b * b).sum(1))[None, :]
        dot = a @ b.T
        apart = np.sqrt(np.maximum(la**2 + lb**2 - 2 * dot, 0))
        most = np.minimum(dot + la * rb + lb * ra + ra * rb, (na**2 + nb**2 - np.maximum(apart - ra - rb, 0) ** 2) / 2)
        i, j = np.nonzero(most + SLACK >= least)
        return pd.DataFrame({"x": q["cell"].to_numpy()[i], "y": c["cell"].to_numpy()[j], "bound": most[i, j]})

    return left.unionByName(right).groupBy("l", "r").applyInPandas(run, "x long, y long, bound double")


def meetings(left: DataFrame, right: DataFrame, only: Column | None = None) -> DataFrame:
    """x, xi, xb, y, yi, yb, bound: pairs of a cell of left (with `least`) and one of right whose bound reaches that least, and that `only` holds for.

    A product of partitions: each task reads one of each side from where they are written. Cells with a vector that isn't a number have no bound and meet all.
    """
    side = lambda df, s, *more: df.select(F.col("cell").alias(s), F.col("ids").alias(f"{s}i"), F.col("body").alias(f"{s}b"), F.col("center").alias(f"{s}c"), F.sqrt(S.dot(F.col("center"), F.col("center"))).alias(f"{s}l"), F.col("radius").alias(f"{s}r"), F.col("norm").alias(f"{s}n"), *more)
    c = F.col
    dot = S.dot(c("xc"), c("yc"))
    apart = F.sqrt(F.greatest(c("xl") * c("xl") + c("yl") * c("yl") - 2 * dot, F.lit(0.0)))
    gap = F.greatest(apart - c("xr") - c("yr"), F.lit(0.0))
    bound = F.coalesce(F.least(dot + c("xl") * c("yr") + c("yl") * c("xr") + c("xr") * c("yr"), (c("xn") * c("xn") + c("yn") * c("yn") - gap * gap) / 2), F.lit(float("inf")))
    both = side(left, "x", "least", *(["ahead"] if "ahead" in left.columns else [])).hint("shuffle_replicate_nl").join(side(right, "y"), (bound + SLACK >= c("least")) if only is None else only)
    return both.select("x", "xi", "xb", "y", "yi", "yb", bound.alias("bound"))


def _matrix(ids: pa.Scalar, body: pa.Scalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a cell, of floats if a number has four bytes."""
    i, b = np.frombuffer(ids.as_buffer(), np.int64), body.as_buffer()
    return i, np.frombuffer(b, np.float32 if len(b) == 4 * len(i) * dim else np.float64).reshape(len(i), -1)


class _Best:
    """The k best products of each row of a cell so far, and with what: the larger first, equal ones by id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.value, self.dst = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, x: np.ndarray, other: np.ndarray, y: np.ndarray) -> None:
        """Products with the rows of y are made in single precision; those that may count, given how far these can be off, are made again in double."""
        k, m = self.k, len(other)
        nx, ny = (np.sqrt((v.astype(np.float64) ** 2).sum(1)) for v in (x, y))
        fast = bool(np.isfinite(nx).all() and np.isfinite(ny).all() and max(nx.max(), ny.max()) < 1e10)
        off = (x.shape[1] + 8) * 6e-8 * nx * ny.max() + SLACK if fast else np.full(len(x), SLACK)
        p, q = (x.astype(np.float32), y.astype(np.float32)) if fast else (x.astype(np.float64), y.astype(np.float64))
        same = bool(np.isin(self.ids, other).any())
        for at in range(0, len(x), STRIP):
            rows = slice(at, at + STRIP)
            with np.errstate(all="ignore"):
                s = p[rows] @ q.T
            if not fast:
                s[~np.isfinite(s)] = -np.inf
            if same:
                s[self.ids[rows, None] == other[None, :]] = -np.inf
            cut = self.value[rows, -1] - off[rows]
            if m > 2 * k and np.isneginf(cut).any():
                cut = np.maximum(cut, np.partition(s, m - k, axis=1)[:, m - k].astype(np.float64) - 2 * off[rows])
            hit = np.flatnonzero(s >= np.nextafter(cut.astype(s.dtype), s.dtype.type(-np.inf))[:, None])
            r, c = hit // m, hit % m
            v = np.concatenate([np.round(np.einsum("ij,ij->i", x[at + r[i : i + EXACT]].astype(np.float64), y[c[i : i + EXACT]].astype(np.float64)), DIGITS) for i in range(0, len(r), EXACT)]) if len(r) else np.zeros(0)
            r, d = r + at, other[c]
            last, name = self.value[r, -1], self.dst[r, -1]
            keep = np.isfinite(v) & (self.ids[r] != d) & ((v > last) | (v == last) & (d < name))
            self.put(r[keep], v[keep], d[keep])

    def put(self, r: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        if not len(r):
            return
        rows = np.unique(r)
        all_r, all_v, all_d = np.concatenate((np.repeat(rows, self.k), r)), np.concatenate((self.value[rows].ravel(), v)), np.concatenate((self.dst[rows].ravel(), d))
        order = np.lexsort((all_d, -all_v, all_r))
        first = np.searchsorted(all_r[order], rows)
        top = order[first[:, None] + np.arange(self.k)]
        self.value[rows], self.dst[rows] = all_v[top], all_d[top]

    def rows(self) -> pa.RecordBatch:
        kept = np.isfinite(self.value)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(self.ids[:, None], kept.shape)[kept]), pa.array(self.dst[kept]), pa.array(self.value[kept])], names=["src", "dst", "similarity"])


def _met(batches: Iterator[pa.RecordBatch], k: int, dim: int) -> Iterator[tuple[int, _Best]]:
    """Each cell x of the pairs in batches with its best; one whose pairs come far apart may come several times."""
    found: dict[int, _Best] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            x, bound = batch.column("x")[i].as_py(), batch.column("bound")[i].as_py()
            ids, p = _matrix(batch.column("xi")[i], batch.column("xb")[i], dim)
            if x not in found:
                if sum(b.value.size for b in found.values()) > HELD:
                    yield from found.items()
                    found = {}
                found[x] = _Best(ids, k)
            if bound + SLACK < found[x].value[:, -1].min():
                continue
            found[x].meet(p, *_matrix(batch.column("yi")[i], batch.column("yb")[i], dim))
    yield from found.items()


def neighbours(vectors: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """src, dst, rank, similarity: exact k largest inner products for each id, ties by id, itself left out, written. vectors: id, vec.

    Each cell first meets itself and the few cells with the best bounds. The least k-th product of its rows is then what the
    other cells' bounds have to reach; as it meets them in a task, the best so far raise it. Rows that repeat an id are one another's own.
    """
    cells = pack(vectors, cell)
    if (first := cells.select("center").first()) is None:
        return vectors.sparkSession.createDataFrame([], "src long, dst long, similarity double, rank long")
    dim = len(first.center)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, b in _met(batches, k, dim):
            yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([float(b.value[:, -1].min())])], names=["cell", "least"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _met(batches, k, dim):
            yield b.rows()

    left, tasks = cells.withColumn("least", F.lit(float("-inf"))), TASKS * cells.rdd.getNumPartitions()
    if cells.count() > AHEAD + 1:
        order = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("bound"), "y"))
        pairs = bounds(left.select("cell", "center", "radius", "norm", "least")).filter("x <> y").withColumn("at", order).filter(F.col("at") <= AHEAD)
        ahead = written(pairs.groupBy(F.col("x").alias("cell")).agg(F.collect_list("y").alias("ahead")), "cells-ahead")
        near = meetings(left.join(F.broadcast(ahead), "cell", "left"), cells, (F.col("x") == F.col("y")) | F.array_contains("ahead", F.col("y")))
        floors = written(near.coalesce(tasks).mapInArrow(least, "cell long, least double").groupBy("cell").agg(F.max("least").alias("least")), "floors")  # one number a cell
        left = cells.join(F.broadcast(floors), "cell")
    met = meetings(left, cells).coalesce(tasks).mapInArrow(best, "src long, dst long, similarity double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    found = written(met.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k), "neighbours")
    discard(cells)
    return found


def close_pairs(vectors: DataFrame, above: float, cell: int = CELL) -> DataFrame:
    """a, b, similarity: all ids a < b whose vectors' inner product is more than `above`. vectors: id, vec; ids are distinct."""
    cells = pack(vectors, cell)
    first = cells.select("center").first()
    dim = len(first.center) if first else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, p = _matrix(batch.column("xi")[i], batch.column("xb")[i], dim)
                other, q = _matrix(batch.column("yi")[i], batch.column("yb")[i], dim)
                sims = p.astype(np.float64) @ q.astype(np.float64).T
                a, b = np.nonzero(sims > above)
                one, two, s = ids[a], other[b], sims[a, b]
                keep = one < two if batch.column("x")[i].as_py() == batch.column("y")[i].as_py() else one != two
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)[keep]), pa.array(np.maximum(one, two)[keep]), pa.array(s[keep])], names=["a", "b", "similarity"])

    pairs = meetings(cells.withColumn("least", F.lit(float(above))), cells).filter("x <= y")
    return pairs.mapInArrow(run, "a long, b long, similarity double")
