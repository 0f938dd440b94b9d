"""Binary maps of grey images in which outlines are looked for: edges, edges after equalising, and the bright region."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import regions
from larkspur.operators.tiles import SIDE, TILE, filtered, histogram, image_type, rows_of, span, taken, tile_schema
from larkspur.operators.tiles import Window as Surroundings
from larkspur.sources.batches import mapped
from larkspur.sources.shared import Shared

# Edge thresholds by the median, cells and clip limit of the equalisation.
LOWER, UPPER = 0.66, 1.33
CELLS, CLIP = 8, 2.0

STRONG, WEAK = 255, 1
#: Tangent of 22.5 degrees, in steps of 1 / 2 ** 15.
TANGENT = int(0.4142135623730951 * (1 << 15) + 0.5)


def smooth(w: Surroundings, a: np.ndarray) -> np.ndarray:
    """Weights 1 4 6 4 1 in both directions, the border mirrored without its pixel; takes two pixels of the halo."""
    p = w.around(a, 2, "reflect").astype(np.int32)
    for _ in range(2):
        p = (p[:-4] + 4 * p[1:-3] + 6 * p[2:-2] + 4 * p[3:-1] + p[4:]).T
    return ((p + 128) >> 8).astype(np.uint8)


def closed(w: Surroundings, a: np.ndarray) -> np.ndarray:
    """The largest of nine, then the smallest of nine; takes two pixels of the halo."""
    for pick in (np.maximum, np.minimum):
        p = w.around(a, 1, "edge")
        p = pick(pick(p[:-2], p[1:-1]), p[2:])
        a = pick(pick(p[:, :-2], p[:, 1:-1]), p[:, 2:])
    return a


def thinned(w: Surroundings, a: np.ndarray, low: int, high: int) -> np.ndarray:
    """STRONG, WEAK or 0 by gradient, only where it is the largest across the edge; takes two pixels of the halo."""
    p = w.around(a, 1, "edge").astype(np.int32)
    across = p[:-2] + 2 * p[1:-1] + p[2:]
    down = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    dx, dy = across[:, 2:] - across[:, :-2], down[2:] - down[:-2]
    m = w.around(np.abs(dx) + np.abs(dy), 1, "constant")
    up, down_, left, right = (1 if i else 0 for i in w.inner)
    inside = slice(up, dx.shape[0] - down_), slice(left, dx.shape[1] - right)
    dx, dy = dx[inside], dy[inside]
    at = lambda y, x: m[1 + y : m.shape[0] - 1 + y, 1 + x : m.shape[1] - 1 + x]
    own = at(0, 0)
    x, y = np.abs(dx) * TANGENT, np.abs(dy) << 15
    flat, steep = y < x, y > x + (np.abs(dx) << 16)
    along = (own > at(0, -1)) & (own >= at(0, 1))
    upright = (own > at(-1, 0)) & (own >= at(1, 0))
    falling = (own > at(-1, -1)) & (own > at(1, 1))
    rising = (own > at(-1, 1)) & (own > at(1, -1))
    top = np.where(flat, along, np.where(steep, upright, np.where((dx < 0) ^ (dy < 0), rising, falling)))
    return np.where(top & (own > high), STRONG, np.where(top & (own > low), WEAK, 0)).astype(np.uint8)


def levels(counts: DataFrame) -> DataFrame:
    """(image, median, split): of (image, level, n), the median and the level that separates best.

    Both come from sums over the levels up to each: at most 256 rows of an image. `split` is the smallest level
    with the largest variance between the pixels up to it and those above; null where all pixels are equal.
    """
    upto = Window.partitionBy("image").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("image")
    moment = F.col("n") * F.col("level")
    sums = counts.select(
        "image", "level", F.sum("n").over(upto).alias("c"), F.sum(moment).over(upto).alias("s"),
        F.sum("n").over(every).alias("all"), F.sum(moment).over(every).alias("whole"),
    )
    above = F.col("all") - F.col("c")
    apart = F.col("s") / F.col("c") - (F.col("whole") - F.col("s")) / F.nullif(above, F.lit(0))
    between = F.coalesce(F.col("c").cast("double") * above * apart * apart, F.lit(-1.0))
    middle = lambda k: F.min(F.when(F.col("c") >= k, F.col("level")))
    found = sums.withColumn("between", between).groupBy("image").agg(
        ((middle(F.floor((F.col("all") + 1) / 2)) + middle(F.floor(F.col("all") / 2) + 1)) / 2).alias("median"),
        F.min_by("level", F.struct(-F.col("between"), F.col("level"))).alias("split"),
        F.max("between").alias("best"),
    )
    return found.select("image", "median", F.when(F.col("best") >= 0, F.col("split")).alias("split"))


# -- equalising


def cell_size(h: int, w: int) -> tuple[int, int]:
    """Height and width of the cells; an image that they don't divide is thought to go on, mirrored."""
    if h % CELLS == 0 and w % CELLS == 0:
        return h // CELLS, w // CELLS
    return h // CELLS + 1, w // CELLS + 1


def _cell_counts(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, keys_, ns, sizes = [], [], [], []
        for i, (w, h, ty, tx, raw) in enumerate(rows_of(batch, "width", "height", "ty", "tx", "pixels")):
            (top, bottom), (left, right) = span(ty, h, side), span(tx, w, side)
            px = np.frombuffer(raw, np.uint8).reshape(bottom - top, right - left).astype(np.int64)
            ch, cw = cell_size(h, w)
            source = lambda n, to: np.pad(np.arange(n), (0, to - n), mode="reflect")
            ys, xs = source(h, ch * CELLS), source(w, cw * CELLS)
            y, x = (np.flatnonzero((s >= a) & (s < b)) for s, a, b in ((ys, top, bottom), (xs, left, right)))
            cell = (y // ch)[:, None] * CELLS + x // cw
            keys = cell * 256 + px[ys[y] - top][:, xs[x] - left]
            n = np.bincount(keys.ravel(), minlength=CELLS * CELLS * 256)
            met = np.flatnonzero(n)
            at.append(np.full(len(met), i))
            keys_.append(met)
            ns.append(n[met])
            sizes.append(np.full(len(met), ch * cw))
        at, key, n, of = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (at, keys_, ns, sizes))
        yield taken(batch, at, cell=pa.array(key // 256), level=pa.array(key % 256), n=pa.array(n), of=pa.array(of))


def _curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cell of an image the level that each level becomes: clipped counts summed up."""
    for batch in batches:
        out = []
        counts, sizes = (batch.column(batch.schema.get_field_index(c)) for c in ("counts", "of"))
        cell, level, many = (c.to_numpy() for c in counts.flatten().flatten())
        pairs = counts.value_lengths().to_numpy()
        ends = np.cumsum(pairs)
        for first, end, of in zip(ends - pairs, ends, sizes.to_pylist(), strict=True):
            n = np.zeros((CELLS * CELLS, 256), np.int64)
            n[cell[first:end], level[first:end]] = many[first:end]
            limit = max(1, int(CLIP * of / 256))
            spare = np.maximum(0, n - limit).sum(1)
            n = np.minimum(n, limit) + (spare // 256)[:, None]
            for k, rest in enumerate((spare % 256).tolist()):
                if rest:
                    n[k, (np.arange(rest) * max(256 // rest, 1))] += 1
            out.append(np.clip(np.rint(np.cumsum(n, axis=1) * (255 / of)), 0, 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["image", "curves"])


def _equalise(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for w, h, ty, tx, raw, curves in rows_of(batch, "width", "height", "ty", "tx", "pixels", "curves"):
            (top, bottom), (left, right) = span(ty, h, side), span(tx, w, side)
            px = np.frombuffer(raw, np.uint8).reshape(bottom - top, right - left)
            curve = np.frombuffer(curves, np.uint8).reshape(CELLS, CELLS, 256).astype(np.float64)
            ch, cw = cell_size(h, w)
            y, x = np.arange(top, bottom) / ch - 0.5, np.arange(left, right) / cw - 0.5
            y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
            fy, fx = (y - y0)[:, None], (x - x0)[None, :]
            near = lambda i: np.clip(i, 0, CELLS - 1)
            at = lambda dy, dx: curve[near(y0 + dy)[:, None], near(x0 + dx)[None, :], px]  # noqa: B023, E731
            mixed = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
            out.append(np.rint(mixed).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=[*TILE, "pixels"])


def equalised(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """Contrast evened out by cells, 8 x 8 of an image: each pixel goes by the curves of the four cells about it.

    Counts by (cell, level) are summed up before an image's curves - 64 of 256 bytes - are made in one task.
    """
    kind = image_type(tiles)
    counts = mapped(tiles.select(*TILE, "pixels"), lambda b: _cell_counts(b, side), f"image {kind}, cell long, level long, n long, of long")
    summed = counts.groupBy("image", "cell", "level").agg(F.sum("n").alias("n"), F.max("of").alias("of"))
    whole = summed.groupBy("image").agg(F.collect_list(F.struct("cell", "level", "n")).alias("counts"), F.max("of").alias("of"))
    curves = mapped(whole, _curves, f"image {kind}, curves binary")
    return mapped(tiles.join(curves, "image").select(*TILE, "pixels", "curves"), lambda b: _equalise(b, side), tile_schema(tiles, "pixels binary"))


# -- the maps


def named(tiles: DataFrame, name: str, *more: str) -> DataFrame:
    """The tile table with (id, map) as its image."""
    return tiles.select(F.struct(F.col("image").alias("id"), F.lit(name).alias("map")).alias("image"), *TILE[1:], "pixels", *more)


def painted(labels: DataFrame, chosen: DataFrame, side: int = SIDE) -> DataFrame:
    """The tile table with 255 where a pixel's region is among chosen (image, node), 0 elsewhere."""

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, local in rows_of(batch, "labels", "local"):
                own = np.frombuffer(raw, "<i4")
                set_ = np.zeros(int(own.max(initial=0)) + 1, np.uint8)
                set_[np.array(local or [], np.int64)] = 255
                out.append(set_[own].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=[*TILE, "pixels"])

    number = F.floor(F.col("node") / regions.NODE)
    by_tile = chosen.groupBy("image", number.alias("tile")).agg(F.collect_list((F.col("node") % regions.NODE).cast("long")).alias("local"))
    across = F.greatest(F.lit(1), F.floor(F.col("width") / side))
    numbered = labels.withColumn("tile", F.col("ty") * across + F.col("tx"))
    both = numbered.join(by_tile, ["image", "tile"], "left").select(*TILE, "labels", "local")
    return mapped(both, paint, tile_schema(labels, "pixels binary"))


def edges(shaded: DataFrame, longest: int, side: int = SIDE) -> DataFrame:
    """Edges of smoothed tiles that carry `low` and `high`: lines with at least one pixel above high, then closed.

    Pixels above `low` are kept as far as they can be reached from one above `high`: a region of several tiles
    is one by its seams, and is strong if a part of it is in any of them.
    """
    shared = Shared(shaded.sparkSession, "edges")
    thin = filtered(
        shaded, 2, lambda w: w.own(thinned(w, w.pixels, w.carried["low"], w.carried["high"]), 2), side, ("low", "high")
    )
    labels = shared.keep(regions.label_tiles(thin, lambda px: px > 0, side, STRONG), "labels")
    roots = shared.keep(regions.region_roots(regions.seams(labels), longest), "roots")
    strong = regions.regions(labels, roots, side).where("seeded").select("image", "root")
    parts = regions.local_regions(labels, side).join(roots, ["image", "node"], "left")
    chosen = parts.select("image", "node", F.coalesce("root", "node").alias("root")).join(strong, ["image", "root"], "left_semi")
    return filtered(painted(labels, chosen, side), 2, lambda w: w.own(closed(w, w.pixels), 2), side)


def binary_maps(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """The tile table of four maps of each image, whose key is (id, map): edges, equalised, region and inverse.

    Edges are those of the smoothed image and of the equalised one, by thresholds from the smoothed image's median.
    The region is what lies above the level that splits its levels best, closed, and the inverse the rest; an image
    of one level only has no region.
    """
    shared = Shared(tiles.sparkSession, "maps")
    soft = lambda t: filtered(t, 2, lambda w: w.own(smooth(w, w.pixels), 2), side)
    plain = shared.keep(soft(tiles), "plain")
    at = levels(histogram(plain)).select(
        "image",
        F.floor(F.greatest(F.lit(0.0), LOWER * F.col("median"))).cast("int").alias("low"),
        F.floor(F.least(F.lit(255.0), UPPER * F.col("median"))).cast("int").alias("high"),
        F.coalesce("split", F.lit(255)).alias("split"),
    )
    at = shared.keep(at, "levels")
    both = named(plain.join(at, "image"), "edges", "low", "high").unionByName(
        named(soft(equalised(tiles, side)).join(at, "image"), "equalised", "low", "high")
    )
    region = filtered(
        named(plain.join(at, "image"), "region", "split"),
        2, lambda w: w.own(closed(w, np.where(w.pixels > w.carried["split"], 255, 0).astype(np.uint8)), 2), side, ("split",),
    )
    region = shared.keep(region, "region")
    turned = region.withColumn("image", F.struct(F.col("image.id").alias("id"), F.lit("inverse").alias("map")))
    inverse = filtered(turned, 0, lambda w: 255 - w.pixels, side)
    lines = edges(both, regions.tiles_across(tiles, side), side)
    return lines.unionByName(region).unionByName(inverse)
