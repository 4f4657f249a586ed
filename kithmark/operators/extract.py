"""What extraction passes report: their counts, why a photo was skipped, the advisory second pass, alignment, and stage times."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def extract_stats(found: DataFrame) -> DataFrame:
    """photos, faces, skipped of a run."""
    return found.agg(F.count_distinct("space", "photo_id").alias("photos"), F.count("n").alias("faces"), F.count("error").alias("skipped"))


def skip_reason(kind: Column, text: Column) -> Column:
    """What a user is told about an exception's class and text."""
    said = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(kind == "UnidentifiedImageError", "not a readable image").when(kind.isin("FileNotFoundError", "NotFoundError"), "original is missing").when(said.contains("truncated"), "image file is truncated")
        .when(kind.isin("TimeoutError", "ConnectionError"), "source did not answer").when(kind == "MemoryError", "image is too large").otherwise(F.concat(F.coalesce(kind, F.lit("error")), F.lit(": "), F.substring(said, 1, 80)))
    )


def disagreements(pairs: DataFrame, above: float = 0.3) -> DataFrame:
    """face_id, disagreement of original and restored vectors (a, b) that differ by more than that."""
    from ..functions.scalar import cosine

    got = pairs.withColumn("disagreement", 1 - cosine(F.col("a"), F.col("b")))
    return got.filter(F.col("disagreement") > above).select("face_id", "disagreement")


def similarity_transform(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """2 x 3 matrix of rotation, scale and shift that brings the source points closest to the target's, by least squares."""
    x, y = source[:, 0], source[:, 1]
    zero, one = np.zeros_like(x), np.ones_like(x)
    a = np.concatenate((np.stack((x, -y, one, zero), 1), np.stack((y, x, zero, one), 1)))
    (c, s, tx, ty), *_ = np.linalg.lstsq(a, np.concatenate((target[:, 0], target[:, 1])), rcond=None)
    return np.array([[c, -s, tx], [s, c, ty]])


def align(faces: DataFrame, template: list[tuple[float, float]], points: str = "landmarks") -> DataFrame:
    """face_id and the six numbers of the transform from its landmarks (x1, y1, ...) to the template."""
    goal = np.array(template)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [similarity_transform(np.asarray(v, float).reshape(-1, 2), goal).ravel() for v in pdf[points]]
            yield pd.DataFrame({"face_id": pdf["face_id"], "matrix": got})

    return faces.select("face_id", points).mapInPandas(run, "face_id long, matrix array<double>")


def timed(df: DataFrame, stage: str) -> tuple[str, float]:
    """Seconds that a stage takes, its rows thrown away."""
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return stage, time.time() - start
