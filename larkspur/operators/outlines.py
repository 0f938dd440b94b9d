"""Outlines of regions: pixel sides chained inside tiles, chains closed to loops, loops fitted by four corners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.tiles import SIDE, Window, image_type, rows_of, stencil, taken
from larkspur.sources.batches import mapped

# Outlines are straightened to this part of their length, and kept if their area is in this band of the frame.
TOLERANCE = 0.02
LEAST_AREA, MOST_AREA = 0.02, 0.92

#: Sides of a pixel, clockwise from the top; the region is on the right of each. Steps along, and from it to the left.
ALONG = ((0, 1), (1, 0), (0, -1), (-1, 0))
OUTSIDE = ((-1, 0), (0, 1), (1, 0), (0, -1))


def _sides(w: Window) -> tuple[np.ndarray, np.ndarray]:
    """(number, number of the next) of each side of the tile's set pixels that has no set pixel behind it.

    A side's number is 4 (y width + x) + its place. The next one turns left where it can: pixels that only touch
    at a corner belong together.
    """
    height, width = w.frame
    p = w.around(w.pixels > 0, 1, "constant")
    at = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    set_, flat, across = at(0, 0), p.ravel(), p.shape[1]
    own, following = [], []
    for d, ((ay, ax), (oy, ox)) in enumerate(zip(ALONG, OUTSIDE, strict=True)):
        y, x = np.nonzero(set_ & ~at(oy, ox))
        place = (y + 1) * across + x + 1
        left, ahead = flat[place + (ay + oy) * across + ax + ox], flat[place + ay * across + ax]
        pixel = ((y + w.top) * width + x + w.left) * 4
        turn_left = pixel + ((ay + oy) * width + ax + ox) * 4 + (d + 3) % 4
        straight, turn_right = pixel + (ay * width + ax) * 4 + d, pixel + (d + 1) % 4
        own.append(pixel + d)
        following.append(np.where(left, turn_left, np.where(ahead, straight, turn_right)))
    return np.concatenate(own), np.concatenate(following)


def chains(own: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sides in order, length of each chain, side after each chain): what follows inside the tile is chained.

    Each side finds its chain's head and its place by doubling the steps it looks back; loops are cut at their
    smallest side.
    """
    n = len(own)
    order = np.argsort(own)
    own, following = own[order], following[order]
    to = np.minimum(np.searchsorted(own, following), max(0, n - 1))
    here = own[to] == following if n else np.zeros(0, bool)
    back = np.arange(n)
    back[to[here]] = np.flatnonzero(here)
    steps = max(1, n.bit_length())

    def ranked(back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        head, least, place = back.copy(), np.minimum(np.arange(n), back), (back != np.arange(n)).astype(np.int64)
        for _ in range(steps):
            place += place[head]
            least = np.minimum(least, least[head])
            head = head[head]
        return head, least, place

    head, least, place = ranked(back)
    looped = back[head] != head  # no head was reached
    cut = looped & (least == np.arange(n))
    if cut.any():
        back[cut] = np.flatnonzero(cut)
        head, _, place = ranked(back)
    by = np.lexsort((place, head))
    starts = np.flatnonzero(place[by] == 0)
    lengths = np.diff(np.append(starts, n))
    return own[by], lengths, following[by][starts + lengths - 1] if n else following


def tile_chains(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """TILE columns and the chains of the sides of each tile's set pixels: sides, lengths, following."""

    def each(w: Window) -> dict:
        sides, lengths, following = chains(*_sides(w))
        return {"sides": sides.astype("<i8").tobytes(), "lengths": lengths.tolist(), "following": following.tolist()}

    ints = pa.list_(pa.int64())
    made = stencil(
        tiles, 1, each, {"sides": pa.binary(), "lengths": ints, "following": ints}, "sides binary, lengths array<long>, following array<long>", side
    )
    return made.where(F.size("lengths") > 0)


def loops(parts: list[dict]) -> Iterator[np.ndarray]:
    """The closed loops that chains make up, each from its smallest first side."""
    pieces: dict[int, tuple[np.ndarray, int]] = {}
    for p in parts:
        sides = np.frombuffer(p["sides"], "<i8")
        ends = np.cumsum(p["lengths"])
        for a, b, to in zip(ends - p["lengths"], ends, p["following"], strict=True):
            pieces[int(sides[a])] = (sides[a:b], to)
    for start in sorted(pieces):
        found = []
        while start in pieces:
            piece, start = pieces.pop(start)
            found.append(piece)
        if found:
            yield np.concatenate(found)


def points(sides: np.ndarray, width: int) -> np.ndarray:
    """Middles of sides as (x, y), twice as large and counted from the first pixel's middle; corners only are kept."""
    pixel, d = np.divmod(sides, 4)
    y, x = np.divmod(pixel, width)
    off = np.array([(0, -1), (1, 0), (0, 1), (-1, 0)])[d]
    p = np.stack([2 * x, 2 * y], axis=1) + off
    step = np.roll(p, -1, axis=0) - p
    return p[np.any(step != np.roll(step, 1, axis=0), axis=1)] if len(p) > 2 else p


def twice_area(p: np.ndarray) -> float:
    x, y = p[:, 0].astype(np.float64), p[:, 1].astype(np.float64)
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def length(p: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(p, -1, axis=0) - p).T.astype(np.float64)).sum())


def _off_line(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points from the line through a and b, or from a where they are the same."""
    d = (b - a).astype(np.float64)
    n = np.hypot(*d)
    r = (p - a).astype(np.float64)
    return np.abs(r[:, 0] * d[1] - r[:, 1] * d[0]) / n if n else np.hypot(r[:, 0], r[:, 1])


def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """The corners without which a closed outline would leave its course by more than the tolerance.

    It is parted at two corners far from each other; each part is straight, or parted again where it is farthest
    off. In the end corners on the line between their neighbours go.
    """
    first = int(np.hypot(*(p - p[0]).T.astype(np.float64)).argmax())
    second = int(np.hypot(*(p - p[first]).T.astype(np.float64)).argmax())
    if first == second:
        return p[:1]
    a, b = sorted((first, second))
    ring = np.concatenate([p[a:], p[: a + 1]])
    keep = {0, b - a}
    todo = [(0, b - a), (b - a, len(p))]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        off = _off_line(ring[i + 1 : j], ring[i], ring[j])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    out = ring[sorted(keep)]
    while len(out) > 3:
        off = np.array([_off_line(out[i : i + 1], out[i - 1], out[(i + 1) % len(out)])[0] for i in range(len(out))])
        if off.min() > tolerance / 2:
            break
        out = np.delete(out, int(off.argmin()), axis=0)
    return out


def hull(p: np.ndarray) -> np.ndarray:
    """The convex hull, without points on its sides, in the order in which angles grow."""
    ordered = np.unique(p, axis=0)
    if len(ordered) < 3:
        return ordered

    def chain(points_: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points_:
            while len(out) > 1 and (out[-1] - out[-2])[0] * (q - out[-2])[1] - (out[-1] - out[-2])[1] * (q - out[-2])[0] <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(ordered) + chain(ordered[::-1]))


def smallest_rectangle(p: np.ndarray) -> np.ndarray:
    """Corners of the rectangle of least area around points: one of its sides lies on a side of their hull.

    The calipers' other three touch where the hull's sides have turned by one, two and three right angles.
    """
    h = hull(p).astype(np.float64)
    if len(h) < 3:
        return np.array([h[0], h[-1], h[-1], h[0]])
    step = np.roll(h, -1, axis=0) - h
    unit = step / np.hypot(step[:, 0], step[:, 1])[:, None]
    across = np.stack([-unit[:, 1], unit[:, 0]], axis=1)
    turned = np.unwrap(np.arctan2(step[:, 1], step[:, 0]))

    def touching(angle: float) -> np.ndarray:
        return h[np.searchsorted(np.append(turned, turned + 2 * np.pi), turned + angle - 1e-12) % len(h)]

    far, high, near = touching(np.pi / 2), touching(np.pi), touching(3 * np.pi / 2)
    dot = lambda a, b: (a * b).sum(1)
    low, most, least = dot(h, across), dot(far, unit), dot(near, unit)
    top = dot(high, across)
    k = int(((most - least) * (top - low)).argmin())
    place = lambda u, v: unit[k] * u + across[k] * v
    return np.array([place(least[k], low[k]), place(most[k], low[k]), place(most[k], top[k]), place(least[k], top[k])])


def fitted(p: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """Four corners: those of the straightened outline if it has four and is convex, else of the smallest rectangle."""
    q = simplified(p, tolerance * length(p))
    if len(q) == 4:
        step = np.roll(q, -1, axis=0) - q
        turn = step[:, 0] * np.roll(step[:, 1], -1) - step[:, 1] * np.roll(step[:, 0], -1)
        if (turn > 0).all() or (turn < 0).all():
            return q.astype(np.float64)
    return smallest_rectangle(p)


def shapes(tiles: DataFrame, tolerance: float = TOLERANCE, least: float = LEAST_AREA, most: float = MOST_AREA, side: int = SIDE) -> DataFrame:
    """(image, outline, hole, width, height, contour_area, x1, y1 ... x4, y4): four corners of each outline of the set pixels.

    Outlines of regions and of the holes in them run through the middles of pixel sides, in coordinates of pixel
    middles; those whose area isn't between `least` and `most` of the frame are left out. `outline` is the number of
    its first side, the same however tiles were dealt.

    Sides are chained inside their tiles with one pixel of the neighbours, so what is shuffled is the boundary. Chains
    of an image are closed in one task: this is meant for working copies, whose longer side is bounded.
    """
    kind = image_type(tiles)
    corners = [f"{c}{i}" for i in range(1, 5) for c in "xy"]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (width, height, parts) in enumerate(rows_of(batch, "width", "height", "parts")):
                for loop in loops(parts):
                    if (len(loop) / 4) ** 2 < least * width * height:  # no outline of so few sides encloses that much
                        continue
                    p = points(loop, width)
                    area = twice_area(p) / 8
                    if not least * width * height <= abs(area) <= most * width * height:
                        continue
                    at.append(i)
                    found.append((int(loop.min()), area < 0, width, height, abs(area), *(fitted(p, tolerance) / 2).ravel().tolist()))
            columns = list(zip(*found, strict=True)) if found else [[]] * 13
            kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), *[pa.float64()] * 9]
            names = ["outline", "hole", "width", "height", "contour_area", *corners]
            yield taken(batch, at, **{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    ddl = f"image {kind}, outline long, hole boolean, width int, height int, contour_area double, " + ", ".join(f"{c} double" for c in corners)
    grouped = tile_chains(tiles, side).groupBy("image", "width", "height").agg(F.collect_list(F.struct("sides", "lengths", "following")).alias("parts"))
    return mapped(grouped, close, ddl)
