"""Hashes of pictures from their pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows and columns of the picture that is hashed, and of the block of low frequencies that is left.
SIDE, LOW = 32, 8


def cosines(rows: int, n: int) -> np.ndarray:
    """The first rows of the DCT-II of n values, as a matrix."""
    return np.cos(np.pi * np.arange(rows)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))


def low_frequencies(pixels: np.ndarray) -> np.ndarray:
    """The LOW x LOW block of each picture's two-dimensional transform; pictures are SIDE x SIDE. Both directions are one constant matrix."""
    c = cosines(LOW, SIDE)
    return c @ pixels.reshape(-1, SIDE, SIDE) @ c.T


def picture_hash(pixels: Column) -> Column:
    """64 bits as 16 hex digits: row by row, whether a low frequency is more than their median. Null unless there are SIDE * SIDE gray values."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        whole = [x is not None and len(x) == SIDE * SIDE for x in batch]
        out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
        if any(whole):
            low = low_frequencies(np.stack(batch[whole].to_numpy()).astype(np.float64)).reshape(-1, LOW * LOW)
            bits = low > np.median(low, axis=1, keepdims=True)
            out[whole] = [b.tobytes().hex() for b in np.packbits(bits, axis=1)]
        return out

    return run(pixels)
