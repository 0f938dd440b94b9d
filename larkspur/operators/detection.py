"""Candidate shapes of a frame: concentric groups, the card among them, what encloses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Centre distance within a group by the frame's short edge; least margin and largest ratio of a sleeve.
CENTRE_TOLERANCE = 0.06
SLEEVE_MARGIN = 7.0
SLEEVE_RATIO = 1.5

_MEMBER = "struct<area:double,id:bigint,cx:double,cy:double>"


def concentric_groups(members: Column, tolerance: Column) -> Column:
    """Members, largest first, each in the first group that has one with a centre within the tolerance, or in a new one.

    members: array of (area, id, cx, cy); equal areas go by id. Frames have few candidates, so an array holds them.
    """
    ordered = F.array_sort(members, lambda a, b: F.when(a["area"] != b["area"], F.signum(b["area"] - a["area"])).otherwise(F.signum(a["id"] - b["id"])).cast("int"))

    def place(groups: Column, m: Column) -> Column:
        near = lambda x: F.hypot(x["cx"] - m["cx"], x["cy"] - m["cy"]) <= tolerance
        fits = F.transform(groups, lambda g: F.exists(g, near))
        at = F.array_position(fits, True)
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.array_append(g, m)).otherwise(g))
        return F.when(at > 0, joined).otherwise(F.array_append(groups, F.array(m)))

    return F.aggregate(ordered, F.array().cast(f"array<array<{_MEMBER}>>"), place)


def enclosing_ratio(group: Column) -> Column:
    """How much larger the largest member is than the smallest, where that looks like a sleeve; else 1."""
    areas = F.transform(group, lambda m: m["area"])
    large, small = F.array_max(areas), F.array_min(areas)
    margin = (F.sqrt(large) - F.sqrt(small)) / 2
    fits = (small > 0) & (margin >= SLEEVE_MARGIN) & (large / small <= SLEEVE_RATIO)
    return F.when(fits, large / small).otherwise(1.0)


def detect(candidates: DataFrame) -> DataFrame:
    """(frame, id, candidates, sleeve): the largest candidate of each frame, its number of groups, its own group's ratio.

    candidates: (frame, id, area, cx, cy, short_edge). Frames without candidates have no row.
    """
    member = F.struct("area", F.col("id").cast("long").alias("id"), "cx", "cy").cast(_MEMBER)
    frames = candidates.groupBy("frame").agg(F.collect_list(member).alias("members"), F.max("short_edge").alias("edge"))
    frames = frames.withColumn("groups", concentric_groups(F.col("members"), F.col("edge") * CENTRE_TOLERANCE))
    first = F.get("groups", F.lit(0))  # groups start with their largest member, in descending order
    return frames.select(
        "frame", F.get(first, F.lit(0))["id"].alias("id"), F.size("groups").alias("candidates"), enclosing_ratio(first).alias("sleeve")
    )


def rescaled(x: Column, scale: Column, limit: Column) -> Column:
    """A coordinate of the working raster in the original frame, kept inside it."""
    return F.least(limit.cast("double"), F.greatest(F.lit(0.0), x / scale))
