"""Geometry of a quadrilateral given as eight columns x1 y1 ... x4 y4, clockwise with y downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

X = ["x1", "x2", "x3", "x4"]
Y = ["y1", "y2", "y3", "y4"]


def _p(i: int) -> tuple[Column, Column]:
    return F.col(X[i % 4]), F.col(Y[i % 4])


def cross(i: int) -> Column:
    """Of the edges that meet at the corner after corner i."""
    (ax, ay), (bx, by), (cx, cy) = _p(i), _p(i + 1), _p(i + 2)
    return (bx - ax) * (cy - by) - (by - ay) * (cx - bx)


def is_clockwise_convex() -> Column:
    return (cross(0) > 0) & (cross(1) > 0) & (cross(2) > 0) & (cross(3) > 0)


def area() -> Column:
    total = None
    for i in range(4):
        (ax, ay), (bx, by) = _p(i), _p(i + 1)
        term = ax * by - bx * ay
        total = term if total is None else total + term
    return F.abs(total) / 2


def area_fraction() -> Column:
    return area() / (F.col("frame_width") * F.col("frame_height"))


def side(i: int) -> Column:
    (ax, ay), (bx, by) = _p(i), _p(i + 1)
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def opposite_side_ratio() -> Column:
    """The worse of both pairs of opposite sides, longer over shorter."""
    ratio = lambda a, b: F.greatest(a, b) / F.least(a, b)
    return F.greatest(ratio(side(0), side(2)), ratio(side(1), side(3)))


def border_margin_fraction() -> Column:
    near = F.least(
        *map(F.col, X), *map(F.col, Y), *(F.col("frame_width") - F.col(c) for c in X), *(F.col("frame_height") - F.col(c) for c in Y)
    )
    return F.greatest(F.lit(0.0), near) / F.least("frame_width", "frame_height")


def rectangle_area() -> Column:
    """Of the smallest rectangle around the corners, however it is turned: one of its sides lies on a line through two of them."""
    areas = []
    for i in range(4):
        for j in range(i + 1, 4):
            (ax, ay), (bx, by) = _p(i), _p(j)
            dx, dy = bx - ax, by - ay
            along = [x * dx + y * dy for x, y in map(_p, range(4))]
            across = [y * dx - x * dy for x, y in map(_p, range(4))]
            extent = (F.greatest(*along) - F.least(*along)) * (F.greatest(*across) - F.least(*across))
            areas.append(extent / F.nullif(dx * dx + dy * dy, F.lit(0.0)))
    return F.least(*areas)


def centre() -> tuple[Column, Column]:
    return tuple(sum((F.col(c) for c in cs[1:]), F.col(cs[0])) / 4 for cs in (X, Y))


def canonical_corners() -> Column:
    """Corners by angle about the centre, starting at the smallest (x + y, y, x)."""
    cx, cy = centre()
    corners = F.array(
        *(F.struct(F.atan2(y - cy, x - cx).alias("angle"), x.alias("x"), y.alias("y")) for x, y in map(_p, range(4)))
    )
    around = F.array_sort(corners)
    keys = F.transform(around, lambda c: F.struct((c["x"] + c["y"]).alias("s"), c["y"].alias("y"), c["x"].alias("x")))
    first = F.array_position(keys, F.array_min(keys)).cast("int")
    turned = F.concat(F.slice(around, first, 4), F.slice(around, F.lit(1), first - 1))
    return F.transform(turned, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))


def detection_confidence(rectangularity: Column, aspect: Column) -> Column:
    """Half from how rectangular a shape is, half from its aspect's distance to 63 : 88."""
    off = F.least(F.lit(1.0), F.abs(aspect - F.lit(63.0 / 88.0)) / 0.25)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * rectangularity + 0.5 * (1 - off)))


def warp_multiple(height: float = 1056.0, most: int = 4) -> Column:
    """How many times the artefact's long side the shape's longer long edge is, rounded half to even, from 1 to `most`.

    Long edges are the second and fourth after the quarter turn, which need not hold the longest side.
    """
    long_edge = F.when(short_edge_first(), F.greatest(side(0), side(2))).otherwise(F.greatest(side(1), side(3)))
    return F.greatest(F.lit(1), F.least(F.lit(most), F.bround(long_edge / height, 0).cast("int")))


def short_edge_first() -> Column:
    """Whether the corners need a quarter turn for the short edges to come first."""
    return side(0) + side(2) > side(1) + side(3)


def homography(width: float, height: float) -> list[Column]:
    """The nine row-major entries that map (0,0)-(width,height) onto the quadrilateral, in closed form."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = map(_p, range(4))
    dx1, dx2, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    dy1, dy2, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    det = dx1 * dy2 - dx2 * dy1
    g, h = (sx * dy2 - dx2 * sy) / det, (dx1 * sy - sx * dy1) / det
    one = F.lit(1.0)
    rows = [x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h, one]
    scale = [width, height, 1.0] * 3
    return [r / s for r, s in zip(rows, scale, strict=True)]


def quarter_turned() -> list[Column]:
    """x1, y1 ... x4, y4 from the next corner on where the first edge is a long one, so that it is a short one."""
    return [F.when(short_edge_first(), F.col(c[(i + 1) % 4])).otherwise(F.col(c[i])) for i in range(4) for c in (X, Y)]


def inverse(m: list[Column]) -> list[Column]:
    """The inverse of nine row-major entries, the last of which comes to 1."""
    a, b, c, d, e, f, g, h, i = m
    adjugate = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    return [x / adjugate[8] for x in adjugate]


def shrunk(m: list[Column], multiple: Column) -> list[Column]:
    """A transform followed by a division of both coordinates."""
    return [x / multiple if k < 6 else x for k, x in enumerate(m)]


def transformed(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Where a transform leads a point."""
    d = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / d, (m[3] * x + m[4] * y + m[5]) / d
