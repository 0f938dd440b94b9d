"""Images made smaller by area, and straightened: sums of weighted source pixels, an output tile at a time.

Weights are whole numbers, so a sum is the same however the pixels were dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.tiles import SIDE, TILE, count, image_type, rows_of, span, taken, tile_schema
from larkspur.sources.batches import mapped

#: Fractions of a pixel in a bilinear weight.
FRACTIONS = 32


def working_size(width: Column, height: Column, long_edge: int) -> tuple[Column, Column]:
    """Width and height of the copy whose longer side is at most long_edge; never larger than the image."""
    scale = F.lit(float(long_edge)) / F.greatest(width, height)
    small = lambda n: F.when(scale >= 1, n).otherwise(F.greatest(F.lit(1), F.bround(n * scale).cast("int"))).cast("int")
    return small(width), small(height)


def overlaps(first: int, end: int, n: int, m: int) -> tuple[int, np.ndarray]:
    """(first output pixel, weights by output and source pixel) of source pixels first..end of n, when n become m.

    In units of 1 / (n m) of the side, a source pixel covers m of them and an output pixel n.
    """
    low, high = first * m // n, -(-end * m // n)
    source = np.arange(first, end, dtype=np.int64) * m
    output = np.arange(low, high, dtype=np.int64)[:, None] * n
    return low, np.maximum(0, np.minimum(source + m, output + n) - np.maximum(source, output))


def halves_to_even(total: np.ndarray, of: int) -> np.ndarray:
    """total / of as the nearest whole number, halves to the even one."""
    q, r = np.divmod(total, of)
    return q + ((2 * r > of) | ((2 * r == of) & (q % 2 == 1)))


def _shares(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    """What each source tile adds to each output tile that it overlaps."""
    for batch in batches:
        at, place, sums = [], [], []
        for i, (w, h, ty, tx, raw, ow, oh) in enumerate(rows_of(batch, "width", "height", "ty", "tx", "pixels", "ow", "oh")):
            (top, bottom), (left, right) = span(ty, h, side), span(tx, w, side)
            px = np.frombuffer(raw, np.uint8).reshape(bottom - top, right - left).astype(np.int64)
            y0, wy = overlaps(top, bottom, h, oh)
            x0, wx = overlaps(left, right, w, ow)
            part = wy @ px @ wx.T
            for oy in range(min(y0 // side, count(oh, side) - 1), min((y0 + len(wy) - 1) // side, count(oh, side) - 1) + 1):
                for ox in range(min(x0 // side, count(ow, side) - 1), min((x0 + len(wx) - 1) // side, count(ow, side) - 1) + 1):
                    (a, b), (c, d) = span(oy, oh, side), span(ox, ow, side)
                    ya, xa = max(a, y0), max(c, x0)
                    own = part[ya - y0 : b - y0, xa - x0 : d - x0]
                    at.append(i)
                    place.append((ow, oh, oy, ox, w, h, ya - a, xa - c, own.shape[0], own.shape[1]))
                    sums.append(own.tobytes())
        columns = zip(*place, strict=True) if place else [[]] * 10
        names = ["width", "height", "ty", "tx", "sw", "sh", "y", "x", "rows", "cols"]
        yield taken(batch, at, **{n: pa.array(c, pa.int32()) for n, c in zip(names, columns, strict=True)}, sums=pa.array(sums, pa.binary()))


def _averaged(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for w, h, ty, tx, sw, sh, shares in rows_of(batch, "width", "height", "ty", "tx", "sw", "sh", "shares"):
            (top, bottom), (left, right) = span(ty, h, side), span(tx, w, side)
            total = np.zeros((bottom - top, right - left), np.int64)
            for s in shares:
                part = np.frombuffer(s["sums"], np.int64).reshape(s["rows"], s["cols"])
                total[s["y"] : s["y"] + s["rows"], s["x"] : s["x"] + s["cols"]] += part
            out.append(halves_to_even(total, sw * sh).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=[*TILE, "pixels"])


def shrunk(tiles: DataFrame, width: Column, height: Column, side: int = SIDE) -> DataFrame:
    """The tile table of images made width x height by area, columns of `tiles` that aren't above its own.

    Every output pixel is the mean of the source it covers, source pixels at its border by the part that is
    covered; halves go to the even number. Each tile adds up its own pixels for each output tile, so what
    is shuffled is about the output, and an output tile's task gets the sums of the tiles it covers.
    Images that keep their size aren't shuffled.
    """
    sized = tiles.select(*TILE, "pixels", width.cast("int").alias("ow"), height.cast("int").alias("oh"))
    same = (F.col("ow") == F.col("width")) & (F.col("oh") == F.col("height"))
    shares = mapped(
        sized.where(~same), lambda b: _shares(b, side), tile_schema(tiles, "sw int, sh int, y int, x int, rows int, cols int, sums binary")
    )
    grouped = shares.groupBy(*TILE, "sw", "sh").agg(F.collect_list(F.struct("y", "x", "rows", "cols", "sums")).alias("shares"))
    made = mapped(grouped, lambda b: _averaged(b, side), tile_schema(tiles, "pixels binary"))
    return sized.where(same).select(*TILE, "pixels").unionByName(made)


def working_copy(tiles: DataFrame, long_edge: int = 1024, side: int = SIDE) -> DataFrame:
    """Images with a longer side of at most long_edge: by area, never larger."""
    return shrunk(tiles, *working_size(F.col("width"), F.col("height"), long_edge), side)


# -- straightening


def _wanted(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    """The source tiles that each tile of each output image may need, by the sources of its corners' box."""
    for batch in batches:
        at, place = [], []
        for i, (w, h, ow, oh, m) in enumerate(rows_of(batch, "width", "height", "ow", "oh", "matrix")):
            for oy in range(count(oh, side)):
                for ox in range(count(ow, side)):
                    x, y = _sources(np.array(m), span(oy, oh, side), span(ox, ow, side))
                    x, y = np.floor(x), np.floor(y)
                    met = {
                        (min(int(b) // side, count(h, side) - 1), min(int(a) // side, count(w, side) - 1))
                        for dy in (0, 1)
                        for dx in (0, 1)
                        for b, a in _tile_corners(y + dy, x + dx, h, w, side)
                    }
                    for ty, tx in sorted(met) or [(0, 0)]:
                        at.append(i)
                        place.append((ty, tx, oy, ox))
        ty, tx, oy, ox = (pa.array(c, pa.int32()) for c in (zip(*place, strict=True) if place else [[]] * 4))
        own = {n: batch.column(batch.schema.get_field_index(n)).take(pa.array(at, pa.int32())) for n in ("ow", "oh", "matrix")}
        yield taken(batch, at, ty=ty, tx=tx, oy=oy, ox=ox, **own)


def _tile_corners(y: np.ndarray, x: np.ndarray, h: int, w: int, side: int) -> np.ndarray:
    """A pixel of each tile that the pixels (y, x) lie in; those outside the image lie in none."""
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    ty, tx = np.minimum(y[inside] // side, count(h, side) - 1), np.minimum(x[inside] // side, count(w, side) - 1)
    met = np.unique(ty * count(w, side) + tx)
    return np.stack([met // count(w, side), met % count(w, side)], axis=1) * side


def _sources(m: np.ndarray, ys: tuple[int, int], xs: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Where the pixels of a box of the output lie in the source, to 1 / FRACTIONS of a pixel."""
    y, x = np.mgrid[ys[0] : ys[1], xs[0] : xs[1]].astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = m[6] * x + m[7] * y + m[8]
        sx, sy = (m[0] * x + m[1] * y + m[2]) / d, (m[3] * x + m[4] * y + m[5]) / d
    far = -float(1 << 30)  # where the plane's horizon is met, there is no source
    sx, sy = (np.clip(np.nan_to_num(s, nan=far, posinf=far, neginf=far), far, -far) for s in (sx, sy))
    return np.rint(sx * FRACTIONS) / FRACTIONS, np.rint(sy * FRACTIONS) / FRACTIONS


def _gathered(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    """What each source tile adds to an output tile: its pixels by their bilinear weights."""
    for batch in batches:
        sums = []
        for w, h, ty, tx, raw, ow, oh, oy, ox, m in rows_of(batch, "width", "height", "ty", "tx", "pixels", "ow", "oh", "oy", "ox", "matrix"):
            ys, xs = span(oy, oh, side), span(ox, ow, side)
            total = np.zeros((ys[1] - ys[0], xs[1] - xs[0]), np.int32)
            if raw is not None:
                (top, bottom), (left, right) = span(ty, h, side), span(tx, w, side)
                px = np.frombuffer(raw, np.uint8).reshape(bottom - top, right - left).astype(np.int32)
                x, y = _sources(np.array(m), ys, xs)
                x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
                fx, fy = ((x - x0) * FRACTIONS).astype(np.int32), ((y - y0) * FRACTIONS).astype(np.int32)
                for dy, wy in ((0, FRACTIONS - fy), (1, fy)):
                    for dx, wx in ((0, FRACTIONS - fx), (1, fx)):
                        a, b = y0 + dy, x0 + dx
                        own = (a >= top) & (a < bottom) & (b >= left) & (b < right)
                        total[own] += (wy * wx)[own] * px[a[own] - top, b[own] - left]
            sums.append(total.tobytes())
        names = ["ow", "oh", "oy", "ox"]
        place = [batch.column(batch.schema.get_field_index(n)) for n in names]
        yield pa.RecordBatch.from_arrays([batch.column(0), *place, pa.array(sums, pa.binary())], names=[*TILE, "sums"])


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for (sums,) in rows_of(batch, "sums"):
            total = np.zeros(len(sums[0]) // 4, np.int64)
            for s in sums:
                total += np.frombuffer(s, np.int32)
            out.append(((total + FRACTIONS**2 // 2) // FRACTIONS**2).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=[*TILE, "pixels"])


def warped(tiles: DataFrame, maps: DataFrame, side: int = SIDE) -> DataFrame:
    """The tile table of images drawn anew: maps is (image, ow, oh, matrix), a row for each image to draw.

    The matrix (nine numbers, row by row) leads from a pixel of the ow x oh output to its source, which is read
    bilinearly in steps of 1 / 32; what lies outside the image is black. Output tiles ask for the source tiles they
    need in a join on tile numbers; each adds what its pixels weigh, so no task holds more than one of each.
    Nothing else is done to the pixels. Images without a map, and maps without an image, have no output.
    """
    kind = image_type(tiles)
    dims = tiles.where("ty = 0 and tx = 0").select("image", "width", "height")
    asked = mapped(
        maps.join(dims, "image").select("image", "width", "height", "ow", "oh", "matrix"),
        lambda b: _wanted(b, side), f"image {kind}, ty int, tx int, oy int, ox int, ow int, oh int, matrix array<double>",
    )
    met = asked.join(tiles, ["image", "ty", "tx"]).select("image", "width", "height", "ty", "tx", "pixels", "ow", "oh", "oy", "ox", "matrix")
    sums = mapped(met, lambda b: _gathered(b, side), tile_schema(tiles, "sums binary"))
    grouped = sums.groupBy(*TILE).agg(F.collect_list("sums").alias("sums"))
    return mapped(grouped, _weighed, tile_schema(tiles, "pixels binary"))
