"""Grey images as tables of tiles, and functions of a pixel's surroundings over them.

A tile table has the columns image (of any type), width, height, ty, tx and pixels: the bytes of the tile, row
by row. Tiles are `side` pixels wide and high; the last of a row or column also takes what is left, so that
none is smaller than `side` unless the image is. No task ever holds an image, only tiles with their margins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources.batches import mapped

SIDE = 128
TILE = ["image", "width", "height", "ty", "tx"]
#: Weights of red, green and blue.
GREY = np.array([4899, 9617, 1868], np.int32)
PLACE = "width int, height int, ty int, tx int"


def count(n: int, side: int) -> int:
    """Tiles along n pixels."""
    return max(1, n // side)


def span(i: int, n: int, side: int) -> tuple[int, int]:
    """First pixel of tile i of n pixels, and the one after its last."""
    return i * side, n if i == count(n, side) - 1 else (i + 1) * side


def image_type(df: DataFrame) -> str:
    return df.schema["image"].dataType.simpleString()


def tile_schema(df: DataFrame, columns: str) -> str:
    return f"image {image_type(df)}, {PLACE}, {columns}"


def rows_of(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def taken(batch: pa.RecordBatch, at: list[int], **columns: pa.Array) -> pa.RecordBatch:
    """New columns behind the image column of the batch's rows `at`."""
    key = batch.column(0).take(pa.array(at, pa.int32()))
    return pa.RecordBatch.from_arrays([key, *columns.values()], names=["image", *columns])


def grey_rows(rows: DataFrame) -> DataFrame:
    """Rows of grey pixels of rows of red, green and blue ones, three bytes a pixel: weights in 1 / 2 ** 14, rounded."""

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (raw,) in rows_of(batch, "px"):
                p = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                out.append(((p @ GREY + (1 << 13)) >> 14).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], names=["image", "width", "height", "y", "px"])

    return mapped(rows.select("image", "width", "height", "y", "px"), mixed, f"image {image_type(rows)}, width int, height int, y int, px binary")


def _slices(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, ty, tx, y, px = [], [], [], [], []
        for i, (w, h, row, line) in enumerate(rows_of(batch, "width", "height", "y", "px")):
            for t in range(count(w, side)):
                a, b = span(t, w, side)
                at.append(i)
                ty.append(min(row // side, count(h, side) - 1))
                tx.append(t)
                y.append(row)
                px.append(line[a:b])
        place = [batch.column(k).take(pa.array(at, pa.int32())) for k in (1, 2)]
        yield taken(
            batch, at, width=place[0], height=place[1], ty=pa.array(ty, pa.int32()), tx=pa.array(tx, pa.int32()),
            y=pa.array(y, pa.int32()), px=pa.array(px, pa.binary()),
        )


def _assembled(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, lines = [], batch.column(batch.schema.get_field_index("lines"))
        n = lines.value_lengths().to_numpy()
        ends = np.cumsum(n)
        y, line = lines.flatten().flatten()
        y, level = y.to_numpy(), np.frombuffer(b"".join(line.to_pylist()), np.uint8)
        long = pc.binary_length(line).to_numpy()
        at = 0
        for w, h, ty, tx, first, end in zip(*(batch.column(c).to_pylist() for c in range(1, 5)), ends - n, ends, strict=True):
            (top, bottom), (left, right) = span(ty, h, side), span(tx, w, side)
            px = np.zeros((bottom - top, right - left), np.uint8)
            size = (end - first) * (right - left)
            if (long[first:end] != right - left).any():
                raise ValueError("a row of pixels must be as long as its image is wide")
            px[y[first:end] - top] = level[at : at + size].reshape(end - first, right - left)
            at += size
            out.append(px.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=[*TILE, "pixels"])


def from_rows(rows: DataFrame, side: int = SIDE) -> DataFrame:
    """The tile table of (image, width, height, y, px): a row of pixels each. Rows that are missing are black."""
    cut = mapped(rows.select("image", "width", "height", "y", "px"), lambda b: _slices(b, side), tile_schema(rows, "y int, px binary"))
    grouped = cut.groupBy(*TILE).agg(F.collect_list(F.struct("y", "px")).alias("lines"))  # at most 2 * side - 1 of them
    return mapped(grouped, lambda b: _assembled(b, side), tile_schema(rows, "pixels binary"))


def to_rows(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """(image, y, x, px): a row for each pixel of the tiles."""
    across = F.when(F.col("tx") == F.greatest(F.lit(1), F.floor(F.col("width") / side)) - 1, F.col("width") - F.col("tx") * side).otherwise(side)
    level = F.conv(F.hex(F.substring("pixels", F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
    size = F.octet_length("pixels")
    spread = tiles.where(size > 0).withColumn("i", F.explode(F.sequence(F.lit(0), size - 1))).withColumn("w", across)
    return spread.select(
        "image",
        (F.col("ty") * side + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"),
        (F.col("tx") * side + F.col("i") % F.col("w")).cast("int").alias("x"),
        level.alias("px"),
    )


@dataclass
class Window:
    """A tile with as much of its neighbours as was asked for; at the image's edges there is nothing beyond."""

    pixels: np.ndarray
    inner: tuple[bool, bool, bool, bool]  # whether there is a neighbour above, below, left and right
    halo: int
    top: int
    left: int
    shape: tuple[int, int]
    frame: tuple[int, int]
    carried: dict

    def around(self, a: np.ndarray, radius: int, mode: str) -> np.ndarray:
        """a, continued by radius beyond the image's edges: `reflect`, `edge`, or `constant` for zeros."""
        up, down, left, right = ((0 if i else radius) for i in self.inner)
        return np.pad(a, ((up, down), (left, right)), mode=mode) if radius else a

    def own(self, a: np.ndarray, used: int) -> np.ndarray:
        """The tile's part of an array that was computed with `used` of the halo."""
        up, _, left, _ = ((self.halo - used if i else 0) for i in self.inner)
        return a[up : up + self.shape[0], left : left + self.shape[1]]


def _strips(batches: Iterator[pa.RecordBatch], halo: int, side: int, carry: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Each tile, and what of it borders on each of its up to eight neighbours, addressed to them."""
    for batch in batches:
        at, place, px = [], [], []
        for i, (w, h, ty, tx, raw) in enumerate(rows_of(batch, "width", "height", "ty", "tx", "pixels")):
            (top, bottom), (left, right) = span(ty, h, side), span(tx, w, side)
            own = np.frombuffer(raw, np.uint8).reshape(bottom - top, right - left)
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if not (0 <= ty + dy < count(h, side) and 0 <= tx + dx < count(w, side)) or (halo == 0 and (dy or dx)):
                        continue
                    ys = slice(None) if dy == 0 else slice(0, halo) if dy < 0 else slice(own.shape[0] - halo, None)
                    xs = slice(None) if dx == 0 else slice(0, halo) if dx < 0 else slice(own.shape[1] - halo, None)
                    at.append(i)
                    place.append((w, h, ty + dy, tx + dx, -dy, -dx))
                    px.append(np.ascontiguousarray(own[ys, xs]).tobytes())
        w, h, ty, tx, dy, dx = (pa.array(c, pa.int32()) for c in zip(*place, strict=True)) if place else [pa.array([], pa.int32())] * 6
        more = {c: batch.column(batch.schema.get_field_index(c)).take(pa.array(at, pa.int32())) for c in carry}
        yield taken(batch, at, width=w, height=h, ty=ty, tx=tx, dy=dy, dx=dx, px=pa.array(px, pa.binary()), **more)


def _windows(batch: pa.RecordBatch, halo: int, side: int, carry: tuple[str, ...]) -> Iterator[Window]:
    for w, h, ty, tx, strips, *more in rows_of(batch, "width", "height", "ty", "tx", "strips", *carry):
        (top, bottom), (left, right) = span(ty, h, side), span(tx, w, side)
        parts = {(s["dy"], s["dx"]): s["px"] for s in strips}
        inner = ty > 0, ty + 1 < count(h, side), tx > 0, tx + 1 < count(w, side)
        up, down, before, after = ((halo if i else 0) for i in inner)
        ys = {-1: slice(0, up), 0: slice(up, up + bottom - top), 1: slice(up + bottom - top, None)}
        xs = {-1: slice(0, before), 0: slice(before, before + right - left), 1: slice(before + right - left, None)}
        px = np.zeros((up + bottom - top + down, before + right - left + after), np.uint8)
        for (dy, dx), raw in parts.items():
            view = px[ys[dy], xs[dx]]
            view[:] = np.frombuffer(raw, np.uint8).reshape(view.shape)
        yield Window(px, inner, halo, top, left, (bottom - top, right - left), (h, w), dict(zip(carry, more, strict=True)))


def stencil(
    tiles: DataFrame, halo: int, each: Callable[[Window], dict], columns: dict[str, pa.DataType], ddl: str,
    side: int = SIDE, carry: tuple[str, ...] = (),
) -> DataFrame:
    """TILE columns and what `each` makes of every tile with `halo` pixels of its neighbours: one shuffle.

    `halo` is at most `side`. A group is a tile and at most eight strips, whatever the size of the image.
    Columns to `carry`, the same for all tiles of an image, are there for `each` to read.
    """
    if halo > side:
        raise ValueError("halo must not be above side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [each(w) for w in _windows(batch, halo, side, carry)]
            new = [pa.array([m[name] for m in made], kind) for name, kind in columns.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *new], names=[*TILE, *columns])

    kept = "".join(f", {c} {tiles.schema[c].dataType.simpleString()}" for c in carry)
    sent = mapped(
        tiles.select(*TILE, "pixels", *carry), lambda b: _strips(b, halo, side, carry), tile_schema(tiles, f"dy int, dx int, px binary{kept}")
    )
    grouped = sent.groupBy(*TILE, *carry).agg(F.collect_list(F.struct("dy", "dx", "px")).alias("strips"))
    return mapped(grouped, run, tile_schema(tiles, ddl))


def filtered(
    tiles: DataFrame, halo: int, each: Callable[[Window], np.ndarray], side: int = SIDE, carry: tuple[str, ...] = ()
) -> DataFrame:
    """The tile table of what `each` makes of every tile."""
    one = lambda w: {"pixels": np.ascontiguousarray(each(w), np.uint8).tobytes()}
    return stencil(tiles, halo, one, {"pixels": pa.binary()}, "pixels binary", side, carry)


def histogram(tiles: DataFrame) -> DataFrame:
    """(image, level, n): how many pixels of each image have each level that occurs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, levels, ns = [], [], []
            for i, (raw,) in enumerate(rows_of(batch, "pixels")):
                n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                met = np.flatnonzero(n)
                at += [i] * len(met)
                levels += met.tolist()
                ns += n[met].tolist()
            yield taken(batch, at, level=pa.array(levels, pa.int32()), n=pa.array(ns, pa.int64()))

    counts = mapped(tiles.select("image", "pixels"), counted, f"image {image_type(tiles)}, level int, n long")
    return counts.groupBy("image", "level").agg(F.sum("n").alias("n"))
