"""Connected regions of images: runs joined inside tiles, seams between tiles joined level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.tiles import SIDE, TILE, count, image_type, rows_of, span, taken, tile_schema
from larkspur.sources.batches import lists, mapped
from larkspur.sources.shared import Shared

#: A region's number is its tile's times this plus its own in the tile.
NODE = 1 << 24
#: Tiles along each side of a group whose seams are joined by one task; groups of so many groups come next.
FAN = 8


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that each can be reached from by the pairs (a, b): roots hook, then paths are halved."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(shorter := root[root], root):
            root = shorter


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of each run of set pixels in a row, in reading order."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edges == 1)
    return row, first, np.nonzero(edges == -1)[1] - 1


def labelled(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels from 1, 0 where the mask isn't set; sizes): 8-connected regions by runs, linear in pixels."""
    row, first, last = runs(mask)
    n = len(row)
    if not n:
        return np.zeros(mask.shape, np.int32), np.zeros(0, np.int64)
    width = mask.shape[1] + 2  # keys of neighbouring rows don't meet
    starts, ends = row * width + first, row * width + last
    # Runs of the row below that touch each run, diagonals included: a range, as runs are in order.
    low = np.searchsorted(ends, starts + width - 1)
    high = np.searchsorted(starts, ends + width + 1, side="right")
    many = np.maximum(0, high - low)
    a = np.repeat(np.arange(n), many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    _, own = np.unique(joined(n, a, b), return_inverse=True)
    labels = np.zeros(mask.size, np.int32)
    length = last - first + 1
    at = np.repeat(row * mask.shape[1] + first - np.cumsum(length) + length, length) + np.arange(length.sum())
    labels[at] = np.repeat(own + 1, length)
    return labels.reshape(mask.shape), np.bincount(own, length).astype(np.int64)


def _label(batches: Iterator[pa.RecordBatch], mask: Callable[[np.ndarray], np.ndarray], side: int, seeds: int) -> Iterator[pa.RecordBatch]:
    """Tiles of a batch are labelled together: one below the other with an empty row between, so that no region has two."""
    for batch in batches:
        places = [(*span(ty, h, side), *span(tx, w, side), ty * count(w, side) + tx) for w, h, ty, tx in rows_of(batch, *TILE[1:])]
        first = np.cumsum([0, *(bottom - top + 1 for top, bottom, *_ in places)])
        px = np.zeros((first[-1], max((right - left for _, _, left, right, _ in places), default=0)), np.uint8)
        set_ = np.zeros(px.shape, bool)
        boxes = [np.s_[at : at + bottom - top, : right - left] for at, (top, bottom, left, right, _) in zip(first[:-1].tolist(), places, strict=True)]
        for here, (raw,) in zip(boxes, rows_of(batch, "pixels"), strict=True):
            px[here] = np.frombuffer(raw, np.uint8).reshape(px[here].shape)
            set_[here] = mask(px[here])
        labels, sizes = labelled(set_)
        n = len(sizes)
        tile = np.repeat(np.arange(len(places)), np.diff(first))
        y, x = np.nonzero(labels)
        own = labels[y, x] - 1
        top, left = (np.array([p[k] for p in places], np.int64) for k in (0, 2))
        whose = np.zeros(n, np.int64)
        whose[own] = tile[y]
        box = np.tile(np.array([1 << 40, 1 << 40, -1, -1]), (n, 1))
        ys, xs = y + (top - first[:-1])[tile[y]], x + left[tile[y]]
        for k, (v, pick) in enumerate(((ys, np.minimum), (xs, np.minimum), (ys, np.maximum), (xs, np.maximum))):
            pick.at(box[:, k], own, v)
        many = np.bincount(whose, minlength=len(places))  # regions come in the order of their tiles
        before = np.cumsum(many) - many
        labels = np.where(labels > 0, labels - before[tile][:, None], 0).astype("<i4")
        parts = [labels[here] for here in boxes]
        seeded = np.bincount(own[px[y, x] >= seeds], minlength=n) > 0
        borders = {}
        for name, pick in (("up", np.s_[0]), ("down", np.s_[-1]), ("before", np.s_[:, 0]), ("after", np.s_[:, -1])):
            lines = [p[pick] if p.size else p.ravel() for p in parts]
            line = np.concatenate(lines) if lines else np.zeros(0, np.int64)
            number = np.repeat(np.array([p[4] * NODE for p in places], np.int64), np.array([len(a) for a in lines], np.int64))
            borders[name] = lists(np.where(line > 0, line + number, -1), [len(a) for a in lines])
        out = {
            "labels": pa.array([p.tobytes() for p in parts], pa.binary()), "sizes": lists(sizes, many), "seeded": lists(seeded, many),
            "boxes": lists(box.ravel(), 4 * many), **borders,
        }
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *out.values()], names=[*TILE, *out])


def label_tiles(tiles: DataFrame, mask: Callable[[np.ndarray], np.ndarray], side: int = SIDE, seeds: int = 256) -> DataFrame:
    """TILE columns, labels (32-bit integers), and of the regions of each tile: sizes, whether a pixel of at least
    `seeds` is in them, bounding boxes (top, left, bottom, right in a row) and the numbers along the four borders."""
    lists = "sizes array<long>, seeded array<boolean>, boxes array<long>, up array<long>, down array<long>, before array<long>, after array<long>"
    return mapped(tiles.select(*TILE, "pixels"), lambda b: _label(b, mask, side, seeds), tile_schema(tiles, f"labels binary, {lists}"))


def seams(labels: DataFrame) -> DataFrame:
    """(image, a, b, ay, ax, by, bx): pairs of regions of neighbouring tiles that touch, and their tiles.

    Tiles meet their neighbours in a join on tile numbers; only borders are shuffled.
    """
    here = labels.select("image", "ty", "tx", "up", "down", "before", "after")

    def met(dy: int, dx: int, own: Column, other: Column) -> DataFrame:
        to = labels.select("image", (F.col("ty") - dy).alias("ty"), (F.col("tx") - dx).alias("tx"), other.alias("other"))
        both = here.withColumn("own", own).join(to, ["image", "ty", "tx"])

        def at(i: Column, step: int) -> Column:
            return F.struct(F.get("own", i).alias("a"), F.get("other", i + step).alias("b"))

        steps = (0,) if dy and dx else (-1, 0, 1)
        places = F.sequence(F.lit(0), F.size("own") - 1)
        pairs = F.flatten(F.transform(places, lambda i: F.array(*(F.when(i + k >= 0, at(i, k)) for k in steps))))
        touching = F.array_distinct(F.filter(pairs, lambda p: (p["a"] >= 0) & (p["b"] >= 0)))
        return both.select(
            "image", F.inline(touching), F.col("ty").alias("ay"), F.col("tx").alias("ax"),
            (F.col("ty") + dy).alias("by"), (F.col("tx") + dx).alias("bx"),
        )

    first = lambda c: F.slice(c, 1, 1)
    last = lambda c: F.slice(c, -1, 1)
    return (
        met(0, 1, F.col("after"), F.col("before"))
        .unionByName(met(1, 0, F.col("down"), F.col("up")))
        .unionByName(met(1, 1, last("down"), first("up")))
        .unionByName(met(1, -1, first("down"), last("up")))
    )


def _group_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, nodes, roots = [], [], []
        for i, (pairs,) in enumerate(rows_of(batch, "pairs")):
            a, b = np.array([p["a"] for p in pairs], np.int64), np.array([p["b"] for p in pairs], np.int64)
            met, own = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = joined(len(met), own[: len(a)], own[len(a) :])
            moved = root != np.arange(len(met))
            at += [i] * int(moved.sum())
            nodes += met[moved].tolist()
            roots += met[root[moved]].tolist()
        yield taken(batch, at, node=pa.array(nodes, pa.int64()), root=pa.array(roots, pa.int64()))


def levels(largest: int, fan: int = FAN) -> int:
    """Rounds until one group holds `largest` tiles a side."""
    n, size = 0, 1
    while size < largest:
        n, size = n + 1, size * fan
    return n


def region_roots(links: DataFrame, largest: int, fan: int = FAN) -> DataFrame:
    """(image, node, root): the smallest region that each of several tiles' regions is one with; others have no row.

    Seams inside groups of fan x fan tiles are joined first, one task a group, then those between such groups of
    a group of groups, and so on: as many rounds as `largest`, the tiles along an image's longer side, has digits
    in base `fan`. A group has the links of its own seams only, so they grow with its sides and not its pixels.
    """
    kind = image_type(links)
    known: DataFrame | None = None
    for level in range(1, max(1, levels(largest, fan)) + 1):
        size = fan**level
        block = lambda c, s=size: F.floor(F.col(c) / s)
        inside = (block("ay") == block("by")) & (block("ax") == block("bx"))
        was = (lambda c, s=size // fan: F.floor(F.col(c) / s))
        later = (was("ay") != was("by")) | (was("ax") != was("bx"))
        here = links.where(inside & later)
        if known is not None:
            for end in ("a", "b"):
                to = known.select("image", F.col("node").alias(end), F.col("root").alias("to"))
                here = here.join(to, ["image", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
        pairs = here.where("a <> b").groupBy("image", block("ay").alias("gy"), block("ax").alias("gx")).agg(
            F.collect_set(F.struct("a", "b")).alias("pairs")
        )
        new = mapped(pairs.select("image", "pairs"), _group_roots, f"image {kind}, node long, root long")
        if known is None:
            known = new
        else:  # what was known ends where the new roots do
            to = new.select("image", F.col("node").alias("root"), F.col("root").alias("to"))
            known = known.join(to, ["image", "root"], "left").select("image", "node", F.coalesce("to", "root").alias("root")).unionByName(new)
    return known


def regions(labels: DataFrame, roots: DataFrame, side: int = SIDE) -> DataFrame:
    """(image, root, size, seeded, top, left, bottom, right): each region whole, over all its tiles."""
    parts = local_regions(labels, side).join(roots, ["image", "node"], "left")
    return parts.groupBy("image", F.coalesce("root", "node").alias("root")).agg(
        F.sum("size").alias("size"), F.max("seeded").alias("seeded"), F.min("top").alias("top"), F.min("left").alias("left"),
        F.max("bottom").alias("bottom"), F.max("right").alias("right"),
    )


def local_regions(labels: DataFrame, side: int = SIDE) -> DataFrame:
    """(image, node, size, seeded, top, left, bottom, right) of each tile's regions."""
    across = F.greatest(F.lit(1), F.floor(F.col("width") / side))
    base = (F.col("ty") * across + F.col("tx")).cast("long") * NODE + 1
    box = lambda k: F.get("boxes", 4 * F.col("i") + k)
    parts = labels.select("image", base.alias("base"), "seeded", "boxes", F.posexplode("sizes").alias("i", "size"))
    return parts.select(
        "image", (F.col("base") + F.col("i")).alias("node"), "size", F.get("seeded", "i").alias("seeded"),
        box(0).alias("top"), box(1).alias("left"), box(2).alias("bottom"), box(3).alias("right"),
    )


def tiles_across(tiles: DataFrame, side: int = SIDE) -> int:
    """Tiles along the longer side of the largest image: one number to the driver."""
    longest = tiles.agg(F.max(F.greatest("width", "height"))).first()[0]
    return count(longest or 1, side)


def region_fraction(tiles: DataFrame, level: int, side: int = SIDE, fan: int = FAN) -> DataFrame:
    """(image, fraction): the largest 8-connected region of pixels of at least `level`, by all pixels of the image.

    An image without such pixels has 0. Cost is linear in pixels: runs inside tiles, borders between them.
    """
    labels = label_tiles(tiles, lambda px: px >= level, side).drop("labels")
    labels = Shared(tiles.sparkSession, "regions").keep(labels, "labels")  # read by every kind of seam
    whole = regions(labels, region_roots(seams(labels), tiles_across(tiles, side), fan), side)
    largest = whole.groupBy("image").agg(F.max("size").alias("size"))
    images = tiles.groupBy("image").agg(F.max(F.col("width").cast("long") * F.col("height")).alias("of"))
    return images.join(largest, "image", "left").select("image", (F.coalesce("size", F.lit(0)) / F.greatest(F.lit(1), F.col("of"))).alias("fraction"))
