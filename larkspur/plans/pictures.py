"""Queries over tiled photographs, and the SQL that states them pixel by pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import geometry as G
from larkspur.operators import detection, image_bytes, maps, outlines, photographs, quality, raster, regions, resample, tiles
from larkspur.plans import registry
from larkspur.plans.registry import query
from larkspur.sources import views as V

#: Photographs of the tables are 64 pixels wide, and so have 16 tiles.
SIDE = 16
LEVEL = 170


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.from_rows(V.photos(spark, sf_dir), SIDE)


def _largest(pixels: str, key: str, set_: str) -> str:
    """CTEs b (largest 8-connected region by key): every set pixel reaches others, step by step."""
    return f"""s AS MATERIALIZED (SELECT {key} AS k, y, x, y * 100000 + x AS p FROM {pixels} WHERE {set_}),
      n AS MATERIALIZED (SELECT a.k, a.p, b.p AS q FROM s a JOIN (SELECT k, p, y + dy AS ny, x + dx AS nx FROM s,
        (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)) b ON b.k = a.k AND b.ny = a.y AND b.nx = a.x),
      r(k, p, q) AS (SELECT k, p, p FROM s UNION SELECT r.k, r.p, n.q FROM r JOIN n ON n.k = r.k AND n.p = r.q),
      b AS (SELECT k, max(c) AS largest FROM (SELECT k, p, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1)"""


def _recursive(views: str, ctes: str, select: str) -> str:
    return V.with_views(views, f", {ctes} {select}").replace("WITH ", "WITH RECURSIVE ", 1).replace(") , ", "), ", 1)


@query(
    "r_photo_regions",
    "",
    _recursive(
        "photos_v",
        _largest("photos_v", "image", f"px >= {LEVEL}"),
        "SELECT image, round(coalesce(max(largest), 0) / count(*), 12) AS fraction FROM photos_v LEFT JOIN b ON k = image GROUP BY image",
    ),
)
def _(spark, sf_dir):
    found = regions.region_fraction(_photos(spark, sf_dir), LEVEL, SIDE, fan=2)
    return found.select("image", F.round("fraction", 12).alias("fraction"))


@query(
    "r_photo_copies",
    "photos_v",
    """SELECT image, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, CAST(round_even(sum(CAST(px AS DOUBLE)
        * (least((y + 1) * oh, (oy + 1) * height) - greatest(y * oh, oy * height))
        * (least((x + 1) * ow, (ox + 1) * width) - greatest(x * ow, ox * width))) / (any_value(width) * any_value(height)), 0) AS INT) AS px
      FROM (SELECT *, unnest(range(y * oh // height, (y * oh + oh - 1) // height + 1)) AS oy FROM (
        SELECT *, unnest(range(x * ow // width, (x * ow + ow - 1) // width + 1)) AS ox FROM (
          SELECT *, greatest(1, CAST(round_even(width * 24 / greatest(width, height), 0) AS INT)) AS ow,
            greatest(1, CAST(round_even(height * 24 / greatest(width, height), 0) AS INT)) AS oh FROM photos_v)))
      GROUP BY image, oy, ox""",
)
def _(spark, sf_dir):
    return tiles.to_rows(resample.working_copy(_photos(spark, sf_dir), 24, SIDE), SIDE)


_LEVELS = """h AS (SELECT image, px, count(*) AS n FROM {0} GROUP BY 1, 2),
  c AS (SELECT image, px, sum(n) OVER w AS c, sum(n * px) OVER w AS s, sum(n) OVER v AS t, sum(n * px) OVER v AS m FROM h
    WINDOW w AS (PARTITION BY image ORDER BY px), v AS (PARTITION BY image)),
  t AS (SELECT image, arg_min(px, [-CAST(c AS DOUBLE) * (t - c) * (s / c - (m - s) / (t - c)) * (s / c - (m - s) / (t - c)), px]) AS split
    FROM c WHERE t > c GROUP BY 1)"""


@query(
    "r_photo_levels",
    "",
    V.with_views(
        "photos_v",
        ", " + _LEVELS.format("photos_v") + " SELECT image, median(px) AS median, any_value(split) AS split FROM photos_v LEFT JOIN t USING (image) GROUP BY 1",
    ).replace(") , ", "), ", 1),
)
def _(spark, sf_dir):
    return maps.levels(tiles.histogram(_photos(spark, sf_dir)))


_MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} >= {1} THEN 2 * ({1} - 1) - ({0}) ELSE {0} END"
_NINE = "(SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)"
_REGION = f"""k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d, unnest([1, 4, 6, 4, 1]) AS w),
  q AS MATERIALIZED (SELECT p.image, p.y, p.x, any_value(p.width) AS width, any_value(p.height) AS height, (sum(p.w * o.px) + 128) // 256 AS px
    FROM (SELECT v.image, y, x, width, height, a.w * b.w AS w, {_MIRROR.format('y + a.d', 'height')} AS sy, {_MIRROR.format('x + b.d', 'width')} AS sx
      FROM photos_v v, k a, k b) p JOIN photos_v o ON o.image = p.image AND o.y = p.sy AND o.x = p.sx GROUP BY 1, 2, 3),
  {_LEVELS.format('q')},
  z AS MATERIALIZED (SELECT image, y, x, width, height, CASE WHEN px > split THEN 255 ELSE 0 END AS px FROM q JOIN t USING (image)),
  d AS MATERIALIZED (SELECT image, y + dy AS y, x + dx AS x, width, height, max(px) AS px FROM z, {_NINE}
    WHERE y + dy BETWEEN 0 AND height - 1 AND x + dx BETWEEN 0 AND width - 1 GROUP BY ALL),
  g AS (SELECT image, y + dy AS y, x + dx AS x, min(px) AS px FROM d, {_NINE}
    WHERE y + dy BETWEEN 0 AND height - 1 AND x + dx BETWEEN 0 AND width - 1 GROUP BY ALL)"""


@query(
    "r_photo_bright_region",
    "",
    V.with_views("photos_v", f", {_REGION} SELECT image, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(px AS INT) AS px FROM g").replace(") , ", "), ", 1),
)
def _(spark, sf_dir):
    found = maps.binary_maps(_photos(spark, sf_dir), SIDE).where("image.map = 'region'")
    return tiles.to_rows(found.withColumn("image", F.col("image.id")), SIDE)


@query("r_photo_maps")
def _(spark, sf_dir):
    """Set pixels of each binary map; tests hold every map against loops."""
    found = tiles.histogram(maps.binary_maps(_photos(spark, sf_dir), SIDE))
    return found.groupBy(F.col("image.id").alias("image"), F.col("image.map").alias("map")).agg(
        F.sum(F.when(F.col("level") > 0, F.col("n")).otherwise(0)).alias("n_set")
    )


@query("g_photo_outlines")
def _(spark, sf_dir):
    """Outlines of cards on a surface, fitted by four corners; tests hold loops and rectangles against walks."""
    cards = tiles.from_rows(V.card_photos(spark, sf_dir), 48)
    bright = tiles.filtered(cards, 0, lambda w: (w.pixels > 128) * 255, 48)
    found = outlines.shapes(bright, side=48)
    return found.select("image", "outline", "hole", F.round("contour_area", 3).alias("contour_area"), *(F.round(c, 3).alias(c) for c in (*G.X, *G.Y)))


@query("r_photo_cards")
def _(spark, sf_dir):
    """Where the card of each photograph is, from tiles to corners; tests hold it to cards put in known places."""
    found = photographs.located(tiles.from_rows(V.card_photos(spark, sf_dir), 48), side=48)
    rounded = [F.round(c, 3).alias(c) for c in ("enclosing_ratio", "confidence", *G.X, *G.Y)]
    return found.select("image", "status", "reason", "frame_width", "frame_height", "candidates", *rounded)


_BENDS = """lap AS (SELECT image, coalesce(lag(px) OVER v, lead(px) OVER v, px) + coalesce(lead(px) OVER v, lag(px) OVER v, px) + coalesce(lag(px) OVER h, lead(px) OVER h, px)
    + coalesce(lead(px) OVER h, lag(px) OVER h, px) - 4 * px AS v FROM photos_v WINDOW v AS (PARTITION BY image, x ORDER BY y), h AS (PARTITION BY image, y ORDER BY x))"""


@query(
    "r_photo_measures",
    "",
    _recursive(
        "photos_v",
        _largest("photos_v", "image", f"px >= {LEVEL}") + ", " + _BENDS,
        """SELECT image, any_value(least(width, height))::DOUBLE AS short_edge, any_value(blur) AS blur, round(avg(px), 9) AS brightness,
          round(quantile_cont(px, 0.95) - quantile_cont(px, 0.05), 9) AS exposure, round(coalesce(any_value(largest), 0) / count(*), 12) AS glare
          FROM photos_v JOIN (SELECT image, round(var_pop(v), 6) AS blur FROM lap GROUP BY 1) USING (image) LEFT JOIN b ON k = image GROUP BY 1""",
    ),
)
def _(spark, sf_dir):
    found = photographs.measured(_photos(spark, sf_dir), LEVEL, side=SIDE)
    places = {"blur": 6, "brightness": 9, "exposure": 9, "glare": 12}
    return found.select("image", "short_edge", *(F.round(c, n).alias(c) for c, n in places.items()))


@query("r_png_pixels", "pixels_v", "SELECT vec_id AS image, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, px FROM pixels_v")
def _(spark, sf_dir):
    files = image_bytes.encode_png(V.rasters(spark, sf_dir))
    return tiles.to_rows(tiles.from_rows(image_bytes.png_rows(files), 4), 4)


@query(
    "r_photo_grey",
    "photos_v",
    """SELECT a.image, CAST(a.y AS INT) AS y, CAST(a.x AS INT) AS x, CAST((4899 * a.px + 9617 * b.px + 1868 * c.px + 8192) // 16384 AS INT) AS px FROM photos_v a
      JOIN photos_v b ON b.image = a.image AND b.y = a.y AND b.x = (a.x + 1) % 64 JOIN photos_v c ON c.image = a.image AND c.y = a.y AND c.x = (a.x + 2) % 64""",
)
def _(spark, sf_dir):
    """Colour rows whose green and blue are those of the next two pixels, made grey."""
    at = lambda i, k: F.substring("px", (i + k) % 64 + 1, F.lit(1))
    places = F.sequence(F.lit(0), F.lit(63))
    mixed = F.unhex(F.array_join(F.transform(places, lambda i: F.concat(*(F.hex(at(i, k)) for k in range(3)))), ""))
    rows = V.photos(spark, sf_dir).withColumn("px", mixed)
    return tiles.to_rows(tiles.from_rows(tiles.grey_rows(rows), SIDE), SIDE)


@query("k_photo_verdicts")
def _(spark, sf_dir):
    """Photographs of cards located, measured and judged end to end; tests hold it to scenes whose faults are known."""
    found = photographs.prepared(tiles.from_rows(V.card_photos(spark, sf_dir), 48), side=48)
    detected = F.transform(F.filter("findings", lambda f: f["verdict"] == "detected"), lambda f: F.concat(f["condition"], F.lit("="), f["severity"]))
    return found.select("image", "status", F.round("score", 6).alias("score"), "located", "straightened", F.array_join(detected, ",").alias("detected"))


# -- transforms

_TURN = "{0} + {2} > {1} + {3}".format(*(registry._side(i) for i in range(1, 5)))
_TURNED = "SELECT vec_id, turn, " + ", ".join(
    f"CASE WHEN turn THEN {c}{i % 4 + 1} ELSE {c}{i} END AS {c}{i}" for i in range(1, 5) for c in "xy"
) + f" FROM (SELECT *, {_TURN} AS turn FROM {{}})"


@query(
    "g_transforms",
    "quads_v",
    f"""SELECT vec_id, k AS corner, CAST(turn AS INT) AS quarter_turns, x, y, CAST(CASE WHEN k IN (1, 4) THEN 0 ELSE round(756 - 1 / m, 6) END AS DOUBLE) AS there_x,
      CAST(CASE WHEN k IN (1, 2) THEN 0 ELSE round(1056 - 1 / m, 6) END AS DOUBLE) AS there_y FROM (SELECT vec_id, turn,
        greatest(1, least(4, CAST(round_even(greatest({registry._side(2)}, {registry._side(4)}) / 1056, 0) AS INT))) AS m, unnest([1, 2, 3, 4]) AS k,
        unnest([round(x1, 6), round(x2, 6), round(x3, 6), round(x4, 6)]) AS x, unnest([round(y1, 6), round(y2, 6), round(y3, 6), round(y4, 6)]) AS y
        FROM ({_TURNED.format('(SELECT vec_id, ' + ', '.join(f'{c}{i} * 4 AS {c}{i}' for i in range(1, 5) for c in 'xy') + ' FROM quads_v)')}))""",
)
def _(spark, sf_dir):
    """Corners of cards four artefacts large go to the artefact's by the record, and come back by the drawing's transform."""
    large = V.quads(spark, sf_dir).select(F.col("vec_id").alias("image"), *((F.col(c) * 4).alias(c) for c in (*G.X, *G.Y)))
    way = photographs.transforms(large).withColumn("corner", F.explode(F.sequence(F.lit(1), F.lit(4))))
    entries = lambda name: [F.col(name)[i] for i in range(9)]
    u = F.when(F.col("corner").isin(1, 4), 0.0).otherwise(F.col("multiple") * 756.0 - 1)
    v = F.when(F.col("corner").isin(1, 2), 0.0).otherwise(F.col("multiple") * 1056.0 - 1)
    x, y = G.transformed(entries("backward"), u, v)
    tx, ty = G.transformed(entries("matrix"), x, y)
    clean = lambda c: F.round(c, 6) + F.lit(0.0)
    return way.select(
        F.col("image").alias("vec_id"), "corner", "quarter_turns", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"),
        clean(tx).alias("there_x"), clean(ty).alias("there_y"),
    )


def _straight_sql(w: int, h: int) -> str:
    d = "((x2 - x3) * (y4 - y3) - (x4 - x3) * (y2 - y3))"
    g = f"(((x1 - x2 + x3 - x4) * (y4 - y3) - (x4 - x3) * (y1 - y2 + y3 - y4)) / {d})"
    hh = f"(((x2 - x3) * (y1 - y2 + y3 - y4) - (x1 - x2 + x3 - x4) * (y2 - y3)) / {d})"
    small = "(SELECT vec_id, " + ", ".join(f"{c}{i} * 0.064 AS {c}{i}" for i in range(1, 5) for c in "xy") + " FROM quads_v WHERE vec_id IN (SELECT image FROM photos_v))"
    return f"""SELECT vec_id AS image, CAST(v // m AS INT) AS y, CAST(u // m AS INT) AS x, CAST(round_even(sum(px) / (m * m), 0) AS INT) AS px FROM (
      SELECT f.vec_id, f.u, f.v, f.m, (coalesce(sum(px * CASE WHEN p.x = fx THEN 32 - sx % 32 ELSE sx % 32 END * CASE WHEN p.y = fy THEN 32 - sy % 32 ELSE sy % 32 END), 0) + 512) // 1024 AS px
      FROM (SELECT *, sx // 32 AS fx, sy // 32 AS fy FROM (SELECT *,
          CAST(round_even(32 * ((a * u + b * v + c) / (g * u + h * v + 1)), 0) AS BIGINT) + 3200000 AS sx,
          CAST(round_even(32 * ((d * u + e * v + f) / (g * u + h * v + 1)), 0) AS BIGINT) + 3200000 AS sy
        FROM (SELECT vec_id, m, (x2 - x1 + g * x2) / w AS a, (x4 - x1 + h * x4) / k AS b, x1 AS c, (y2 - y1 + g * y2) / w AS d, (y4 - y1 + h * y4) / k AS e, y1 AS f, g / w AS g, h / k AS h
          FROM (SELECT *, {g} AS g, {hh} AS h, m * {w} - 1.0::DOUBLE AS w, m * {h} - 1.0::DOUBLE AS k FROM (SELECT *, greatest(1, least(4,
            CAST(round_even(greatest({registry._side(2)}, {registry._side(4)}) / {h}, 0) AS INT))) AS m FROM ({_TURNED.format(small)}))))
        JOIN (SELECT unnest(range({4 * w})) AS u) ON u < m * {w} JOIN (SELECT unnest(range({4 * h})) AS v) ON v < m * {h})) f
      LEFT JOIN (SELECT image, x + 100000 AS x, y + 100000 AS y, px FROM photos_v) p ON p.image = f.vec_id AND p.x IN (fx, fx + 1) AND p.y IN (fy, fy + 1)
      GROUP BY ALL) GROUP BY vec_id, y, x, m"""


@query("r_photo_straightened", "quads_v photos_v", _straight_sql(12, 16))
def _(spark, sf_dir):
    found = _photos(spark, sf_dir)
    small = V.quads(spark, sf_dir).select(F.col("vec_id").alias("image"), *((F.col(c) * 0.064).alias(c) for c in (*G.X, *G.Y)))
    return tiles.to_rows(photographs.straightened(found, small, (12, 16), side=SIDE), SIDE)


# -- SQL for queries that had none

_GLARE = _largest("(SELECT vec_id, i // 8 AS y, i % 8 AS x, px FROM pixels_v)", "vec_id", f"px >= {raster.GLARE_LEVEL}")
registry.LATER_SQL["r_glare"] = _recursive(
    "pixels_v", _GLARE, "SELECT vec_id, coalesce(max(largest), 0) / count(*) AS glare FROM pixels_v LEFT JOIN b ON k = vec_id GROUP BY 1"
)


def _gate_with_glare() -> str:
    full = registry.with_views("pixels_v quads_v", registry._gate_sql(quality.CONDITIONS))
    at = full.index(" SELECT vec_id, round(least(")
    glare = "gl AS (SELECT vec_id, coalesce(max(largest), 0) / count(*) AS glare FROM pixels_v LEFT JOIN b ON k = vec_id GROUP BY 1)"
    measured = registry._MEASURE_SQL.replace("b AS (SELECT vec_id, var_pop", "bl AS (SELECT vec_id, var_pop")
    select = full[at:].replace("FROM m JOIN b USING (vec_id)", "FROM m JOIN bl USING (vec_id) JOIN gl USING (vec_id)")
    return f"{full[:at]}, {measured}, {_GLARE}, {glare}{select}".replace("WITH ", "WITH RECURSIVE ", 1)


registry.LATER_SQL["k_quality_gate"] = _gate_with_glare()

registry.LATER_SQL["g_candidate_groups"] = f"""WITH c AS (SELECT vec_id // 6 AS frame, vec_id AS id, 20000 + 40000 * embedding[1]::DOUBLE AS area, round(100 + 60 * embedding[2]::DOUBLE) AS cx,
        round(100 + 60 * embedding[3]::DOUBLE) AS cy FROM embeddings),
      g AS (SELECT frame, list_reduce([[struct_pack(id := -1::BIGINT, area := 0::DOUBLE, cx := 0::DOUBLE, cy := 0::DOUBLE, grp := 0::BIGINT)]] || list([struct_pack(id := id, area := area, cx := cx, cy := cy, grp := 0::BIGINT)] ORDER BY area DESC, id),
        lambda acc, m: acc || [struct_pack(id := m[1].id, area := m[1].area, cx := m[1].cx, cy := m[1].cy, grp := coalesce(
          list_min([a.grp FOR a IN acc IF a.grp > 0 AND sqrt((a.cx - m[1].cx) * (a.cx - m[1].cx) + (a.cy - m[1].cy) * (a.cy - m[1].cy)) <= 200.0 * {detection.CENTRE_TOLERANCE}]),
          list_max([a.grp FOR a IN acc]) + 1))]) AS members FROM c GROUP BY 1),
      m AS (SELECT frame, unnest(members, recursive := true) FROM g)
      SELECT frame, arg_max(id, area) FILTER (grp = 1) AS id, CAST(max(grp) AS INTEGER) AS candidates,
        CASE WHEN min(area) FILTER (grp = 1) > 0 AND (sqrt(max(area) FILTER (grp = 1)) - sqrt(min(area) FILTER (grp = 1))) / 2 >= {detection.SLEEVE_MARGIN}
          AND max(area) FILTER (grp = 1) / min(area) FILTER (grp = 1) <= {detection.SLEEVE_RATIO}
          THEN max(area) FILTER (grp = 1) / min(area) FILTER (grp = 1) ELSE 1.0 END AS sleeve FROM m WHERE grp > 0 GROUP BY 1"""
