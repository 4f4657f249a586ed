"""Faces of gray pictures by a sliding linear scorer at several scales, and their vectors by a linear projection.

Weights are broadcast and taken up once a task. Scales are planned, scored windows turned into boxes, and overlapping boxes suppressed by Spark's own
expressions; only the products of windows and weights are made in Python. A picture that fails is a row with its error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .crossref import nms

#: What a scan gives: a scored window by its place in the scaled picture, or an error.
WINDOW = "space string, photo_id long, scale double, fx double, fy double, at_y long, at_x long, score double, error string"


@dataclass(frozen=True)
class Scorer:
    """A square kernel that slides by `stride`; a window's score is the logistic of its product. reach: left, top, right and bottom of the box around a window's center."""

    kernel: np.ndarray
    bias: float
    stride: int
    reach: tuple[float, float, float, float]


def resized(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """The pixels nearest to the centers of the new ones."""
    rows, columns = (((np.arange(n) + 0.5) * old / n).astype(np.int64) for n, old in ((height, picture.shape[0]), (width, picture.shape[1])))
    return picture[rows][:, columns]


def picture_of(pixels, height: int, width: int) -> np.ndarray:
    if pixels is None or height is None or width is None or not (height > 0 and width > 0):
        raise ValueError("no picture")
    if len(pixels) != height * width:
        raise ValueError(f"{len(pixels)} values are no picture of {width} x {height}")
    return np.asarray(pixels, np.float64).reshape(int(height), int(width))


def window_scores(picture: np.ndarray, scorer: Scorer) -> np.ndarray:
    """Scores of all windows, by row and column."""
    k = len(scorer.kernel)
    if min(picture.shape) < k:
        return np.zeros((0, 0))
    windows = np.lib.stride_tricks.sliding_window_view(picture, (k, k))[:: scorer.stride, :: scorer.stride]
    return 1 / (1 + np.exp(-(np.einsum("yxij,ij->yx", windows, scorer.kernel) + scorer.bias)))


def scan(pictures: DataFrame, scorer: Scorer, scales: list[float], most: int, least: float) -> DataFrame:
    """WINDOW rows with a score of `least` or more, of pictures (space, id, width, height, pixels: gray values row by row) at their planned scales."""
    weights = pictures.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = weights.value
        for pdf in batches:
            out = []
            for space, photo, width, height, pixels, plan in pdf.itertuples(index=False, name=None):
                try:
                    picture = picture_of(pixels, height, width)
                    for scale in plan:
                        h, w = max(1, round(picture.shape[0] * scale)), max(1, round(picture.shape[1] * scale))
                        scores = window_scores(picture if scale == 1 else resized(picture, h, w), model)
                        out += [(space, photo, scale, w / picture.shape[1], h / picture.shape[0], y, x, scores[y, x], None) for y, x in np.argwhere(scores >= least).tolist()]
                except (ValueError, TypeError) as e:  # a bad photo is a row, not the end of the job
                    out.append((space, photo, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOW.split(", ")]).astype({"photo_id": "Int64", "at_y": "Int64", "at_x": "Int64"})

    plan = S.scale_plan(F.col("width"), F.col("height"), F.array(*map(F.lit, scales)), most)
    return pictures.select("space", "id", "width", "height", "pixels", plan.alias("plan")).mapInPandas(run, WINDOW)


def detect(pictures: DataFrame, scorer: Scorer, scales: list[float], most: int, least: float = 0.5, overlap: float = 0.45) -> tuple[DataFrame, DataFrame]:
    """(space, photo_id, n, x, y, w, h, det_score of the boxes that are left; space, photo_id, error of the pictures that failed).

    n numbers a photo's windows from 1, by scale, row and column. Rows that repeat a picture are one picture: give each an id of its own.
    """
    found = scan(pictures, scorer, scales, most, least)
    k, (left, top, right, bottom) = len(scorer.kernel) / 2, scorer.reach
    cx, cy = F.col("at_x") * scorer.stride + k, F.col("at_y") * scorer.stride + k
    n = F.row_number().over(Window.partitionBy("space", "photo_id").orderBy("scale", "at_y", "at_x")).cast("long")
    boxes = found.filter("error IS NULL").select("space", "photo_id", n.alias("face_id"), ((cx - left) / F.col("fx")).alias("x"), ((cy - top) / F.col("fy")).alias("y"), ((left + right) / F.col("fx")).alias("w"), ((top + bottom) / F.col("fy")).alias("h"), F.col("score").alias("det_score"))
    return nms(boxes, ["space", "photo_id"], overlap).withColumnRenamed("face_id", "n"), found.filter("error IS NOT NULL").select("space", "photo_id", "error")


def embed(boxes: DataFrame, pictures: DataFrame, matrix: np.ndarray) -> DataFrame:
    """boxes with vec: each box, in whole pixels and cut to the picture, as a square of sqrt(columns) pixels, projected by the matrix and made unit."""
    weights, side = pictures.sparkSession.sparkContext.broadcast(matrix), int(matrix.shape[1] ** 0.5)
    names = boxes.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project = weights.value
        for pdf in batches:
            crops = []
            for row in pdf.itertuples(index=False):
                picture = picture_of(row.pixels, row.height, row.width)
                x0, y0, x1, y1 = max(0, int(np.floor(row.x))), max(0, int(np.floor(row.y))), min(int(row.width), int(np.ceil(row.x + row.w))), min(int(row.height), int(np.ceil(row.y + row.h)))
                crops.append(resized(picture[y0:y1, x0:x1], side, side).ravel() if x1 > x0 and y1 > y0 else np.zeros(side * side))
            vec = np.stack(crops) @ project.T if crops else np.zeros((0, len(project)))
            yield pdf[names].assign(vec=list(vec))

    sized = pictures.select("space", F.col("id").alias("photo_id"), "width", "height", "pixels")
    got = boxes.join(sized, ["space", "photo_id"]).select(*names, "width", "height", "pixels")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema.fields)
    return got.mapInPandas(run, f"{schema}, vec array<double>").withColumn("vec", S.l2_normalize(F.col("vec"), 1e-12))


def extract(pictures: DataFrame, scorer: Scorer, matrix: np.ndarray, scales: list[float], most: int, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(boxes with vectors, failed pictures) of one pass."""
    boxes, failed = detect(pictures, scorer, scales, most, least)
    return embed(boxes, pictures, matrix), failed
