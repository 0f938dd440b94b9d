"""From a photograph's tiles to where its card is, and to the card straightened: one plan from maps to a verdict."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import geometry as G
from larkspur.operators import detection, maps, outlines, quality, regions, resample
from larkspur.operators import tiles as tiles_
from larkspur.operators.tiles import SIDE
from larkspur.sources.shared import Shared

# Longer side of the working copy, least rectangularity, band of aspects, size of the straightened card.
WORK_EDGE = 1024
LEAST_RECTANGULARITY = 0.80
LEAST_ASPECT, MOST_ASPECT = 0.45, 0.97
TARGET = (756, 1056)
MOST_MULTIPLE = 4

NOTHING_FOUND = "no card-like quadrilateral was found in the photograph"


def candidates(shapes: DataFrame) -> DataFrame:
    """Shapes that look like a card: (frame, id, short_edge, area, cx, cy, rectangularity, aspect, x1 ... y4).

    Corners go clockwise from the top left. The outline's area by the quadrilateral's tells how rectangular it is.
    Ids number a frame's candidates by map and outline; a frame has few of them.
    """
    ordered = shapes.select("*", F.explode(F.array(G.canonical_corners())).alias("corners")).select(  # put in order once a row
        "image", "outline", "hole", "width", "height", "contour_area",
        *(F.get("corners", i)[c].alias(f"{c}{i + 1}") for i in range(4) for c in ("x", "y")),
    )
    frame = F.col("width").cast("double") * F.col("height")
    edges = [G.side(i) for i in range(4)]
    measured = ordered.withColumn("area", G.area()).where(F.col("area") > 0)
    measured = measured.withColumns({
        "rectangularity": F.col("contour_area") / F.col("area"),
        "aspect": F.least(*edges) / F.greatest(*edges),
        "cx": G.centre()[0],
        "cy": G.centre()[1],
    })
    fits = (
        F.col("area").between(outlines.LEAST_AREA * frame, outlines.MOST_AREA * frame)
        & (F.col("rectangularity") >= LEAST_RECTANGULARITY)
        & F.col("aspect").between(LEAST_ASPECT, MOST_ASPECT)
    )
    number = F.row_number().over(Window.partitionBy("image.id").orderBy("image.map", "outline", "hole"))
    return measured.where(fits).select(
        F.col("image.id").alias("frame"), number.cast("long").alias("id"), F.least("width", "height").cast("double").alias("short_edge"),
        "area", "cx", "cy", F.least(F.lit(1.0), F.col("rectangularity")).alias("rectangularity"), "aspect", *G.X, *G.Y,
    )


def located(tiles: DataFrame, long_edge: int = WORK_EDGE, side: int = SIDE) -> DataFrame:
    """(image, status, reason, frame_width, frame_height, candidates, enclosing_ratio, confidence, x1 ... y4): a row for each image.

    Binary maps of a copy by area, outlines fitted by four corners, candidates grouped about their centres: the
    largest group's largest is the card. Corners are in the original's coordinates, clockwise from the top left.
    An image in which nothing looks like a card is `insufficient`, with the reason and no geometry.
    """
    shared = Shared(tiles.sparkSession, "located")
    small = shared.keep(resample.working_copy(tiles, long_edge, side), "copy")
    found = shared.keep(candidates(outlines.shapes(maps.binary_maps(small, side), side=side)), "candidates")
    best = detection.detect(found.select("frame", "id", "area", "cx", "cy", "short_edge"))
    card = best.join(found.drop("short_edge", "area", "cx", "cy"), ["frame", "id"])
    frames = tiles.where("ty = 0 and tx = 0").select("image", F.col("width").alias("frame_width"), F.col("height").alias("frame_height"))
    scale = F.least(F.lit(1.0), F.lit(float(long_edge)) / F.greatest("frame_width", "frame_height"))
    both = frames.join(card.withColumnRenamed("frame", "image"), "image", "left")
    there = F.col("id").isNotNull()
    limits = {"x": F.col("frame_width"), "y": F.col("frame_height")}
    return both.select(
        "image",
        F.when(there, "located").otherwise("insufficient").alias("status"),
        F.when(~there, NOTHING_FOUND).alias("reason"),
        "frame_width",
        "frame_height",
        "candidates",
        F.col("sleeve").alias("enclosing_ratio"),
        F.when(there, G.detection_confidence(F.col("rectangularity"), F.col("aspect"))).alias("confidence"),
        *(F.when(there, detection.rescaled(F.col(c), scale, limits[c[0]])).alias(c) for i in range(4) for c in (G.X[i], G.Y[i])),
    )


def transforms(quads: DataFrame, target: tuple[int, int] = TARGET, most: int = MOST_MULTIPLE) -> DataFrame:
    """(image, quarter_turns, multiple, backward, matrix) of (image, x1 ... y4).

    `backward` leads from a pixel of the drawing - `multiple` times the target - to its source; `matrix`, the record's,
    from the source to the artefact. Both have nine entries, row by row. The first edge is a short one.
    """
    multiple = G.warp_multiple(float(target[1]), most)
    turned = quads.select("image", G.short_edge_first().cast("int").alias("quarter_turns"), multiple.alias("multiple"), *(
        c.alias(f"{'xy'[k % 2]}{k // 2 + 1}") for k, c in enumerate(G.quarter_turned())
    ))
    width, height = (F.col("multiple") * n - 1.0 for n in target)
    back = turned.withColumn("backward", F.array(*G.homography(width, height)))
    entries = [F.col("backward")[k] for k in range(9)]
    return back.select(
        "image", "quarter_turns", "multiple", "backward", F.array(*G.shrunk(G.inverse(entries), F.col("multiple"))).alias("matrix")
    )


def straightened(
    tiles: DataFrame, quads: DataFrame, target: tuple[int, int] = TARGET, most: int = MOST_MULTIPLE, side: int = SIDE
) -> DataFrame:
    """The tile table of the cards of (image, x1 ... y4), each target[0] x target[1] pixels.

    A card is drawn at the multiple of the target that is nearest to its size in the photograph, bilinearly, and
    brought to the target by area. Nothing is sharpened, smoothed or evened out.
    """
    way = transforms(quads, target, most)
    drawn = resample.warped(
        tiles, way.select("image", (F.col("multiple") * target[0]).alias("ow"), (F.col("multiple") * target[1]).alias("oh"), F.col("backward").alias("matrix")), side
    )
    return resample.shrunk(drawn, F.lit(target[0]), F.lit(target[1]), side)


def glare(tiles: DataFrame, level: int = 250, long_edge: int = WORK_EDGE, side: int = SIDE) -> DataFrame:
    """(image, fraction): the largest blown-out region of the working copy, by its pixels."""
    small = Shared(tiles.sparkSession, "glare").keep(resample.working_copy(tiles, long_edge, side), "copy")
    return regions.region_fraction(small, level, side)


def _bends(w: tiles_.Window) -> dict:
    """How many pixels a tile has, the sum of their Laplacians and that of the squares: whole numbers."""
    p = w.around(w.pixels, 1, "reflect").astype(np.int64)
    bend = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return {"n": bend.size, "total": int(bend.sum()), "squares": int((bend * bend).sum())}


def blur(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """(image, blur): the variance of the four-neighbour Laplacian, the border mirrored without its pixel.

    Tiles give whole sums, so the variance doesn't depend on how they were dealt.
    """
    sums = tiles_.stencil(
        tiles, 1, _bends, dict.fromkeys(("n", "total", "squares"), pa.int64()), "n long, total long, squares long", side
    )
    whole = sums.groupBy("image").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    mean = F.col("total") / F.col("n")
    return whole.select("image", (F.col("squares") / F.col("n") - mean * mean).alias("blur"))


def tones(counts: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(image, brightness, exposure) of (image, level, n): the mean, and the distance of two percentiles, straight in between."""
    upto = Window.partitionBy("image").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("image")
    sums = counts.select("image", "level", "n", F.sum("n").over(upto).alias("c"), F.sum("n").over(every).alias("all"))

    def percentile(q: float):
        at = q * (F.col("all") - 1)
        level = lambda k: F.min(F.when(F.col("c") > k, F.col("level")))
        share = F.max(at - F.floor(at))
        return level(F.floor(at)) + (level(F.ceil(at)) - level(F.floor(at))) * share

    return sums.groupBy("image").agg(
        (F.sum(F.col("n") * F.col("level")) / F.sum("n")).alias("brightness"), (percentile(high) - percentile(low)).alias("exposure")
    )


def measured(tiles: DataFrame, level: int = 250, long_edge: int = WORK_EDGE, side: int = SIDE) -> DataFrame:
    """(image, short_edge, blur, brightness, exposure, glare): what the gate measures of each photograph.

    The short edge is the original's; all else is of the working copy, so that a picture means the same in any size.
    """
    small = Shared(tiles.sparkSession, "measured").keep(resample.working_copy(tiles, long_edge, side), "copy")
    edges = tiles.groupBy("image").agg(F.max(F.least("width", "height")).cast("double").alias("short_edge"))
    found = edges.join(blur(small, side), "image").join(tones(tiles_.histogram(small)), "image")
    return found.join(regions.region_fraction(small, level, side).withColumnRenamed("fraction", "glare"), "image")


def prepared(tiles: DataFrame, long_edge: int = WORK_EDGE, side: int = SIDE) -> DataFrame:
    """Each photograph located, measured and judged: (image, status, score, findings, located, straightened, x1 ... y4).

    Conditions that need a located card are undetermined without one, for the detector's reason; a photograph is
    straightened if it is located and not unusable.
    """
    shared = Shared(tiles.sparkSession, "prepared")
    where = shared.keep(located(tiles, long_edge, side).withColumnRenamed("status", "found"), "where")
    geometric = where.select(
        "image", "found", "reason", *G.X, *G.Y,
        G.opposite_side_ratio().alias("perspective"), G.border_margin_fraction().alias("margin"), F.col("candidates").cast("double").alias("candidates"),
        F.col("enclosing_ratio").alias("sleeve"), G.area_fraction().alias("area"),
    )
    there = F.col("found") == "located"
    geometric = geometric.withColumns({c: F.when(there, F.col(c)) for c in quality.GEOMETRIC})
    rows = geometric.join(measured(tiles, 250, long_edge, side), "image")
    judged = quality.assess(rows)
    return judged.select(
        "image", "status", "score", quality.detailed_findings(F.col("reason")).alias("findings"), there.alias("located"),
        quality.is_straightened(there, F.col("status")).alias("straightened"), *G.X, *G.Y,
    )
