"""Statistics of 8-bit grey rasters given as an array of pixels, row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

GLARE_LEVEL = 250


def blur(px: np.ndarray) -> np.ndarray:
    """Variance of the four-neighbour Laplacian, the border mirrored without repeating its pixel."""
    p = np.pad(px.astype(np.float64), ((0, 0), (1, 1), (1, 1)), mode="reflect")
    lap = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * p[:, 1:-1, 1:-1]
    return lap.reshape(len(px), -1).var(1)


def largest_blob(bright: np.ndarray) -> np.ndarray:
    """Pixels of the largest 8-connected bright region of each raster: labels spread until nothing moves."""
    n, h, w = bright.shape
    label = np.where(bright, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        p = np.pad(label, ((0, 0), (1, 1), (1, 1)))
        near = np.max([p[:, y : y + h, x : x + w] for y in range(3) for x in range(3)], axis=0)
        new = np.where(bright, near, 0)
        if (new == label).all():
            break
        label = new
    flat = label.reshape(n, -1) + np.arange(n)[:, None] * (h * w + 1)
    sizes = np.bincount(flat.ravel(), minlength=n * (h * w + 1)).reshape(n, -1)[:, 1:]
    return sizes.max(1) if h * w else np.zeros(n, np.int64)


def _measure(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        px = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1, width)
        flat = px.reshape(batch.num_rows, -1).astype(np.float64)
        spread = np.percentile(flat, [5, 95], axis=1) if batch.num_rows else np.zeros((2, 0))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(blur(px)),
                pa.array(flat.mean(1)),
                pa.array(spread[1] - spread[0]),
                pa.array(largest_blob(px >= GLARE_LEVEL) / max(1, flat.shape[1])),
            ],
            names=["vec_id", "blur", "brightness", "exposure", "glare"],
        )


def measure(rasters: DataFrame, width: int = 8) -> DataFrame:
    """(vec_id, blur, brightness, exposure, glare) of rasters of one size, a batch at a time in numpy."""
    return rasters.select("vec_id", "px").mapInArrow(
        lambda b: _measure(b, width), "vec_id long, blur double, brightness double, exposure double, glare double"
    )
