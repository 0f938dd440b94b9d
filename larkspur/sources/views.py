"""Catalog, workflow and image views over the generic tables, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.col("p_brand")
    return read(spark, sf_dir, "part").select(
        brand.alias("set_code"),
        F.lit("tpch").alias("game"),
        F.when(F.substring(brand, 7, 4).cast("int") % 2 == 0, "en").otherwise("ja").alias("language"),
        F.concat(F.lit("Set "), brand).alias("name"),
    ).distinct()


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("set_code"),
        F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("/050")).alias("card_number"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") >= 40, "Rare").when(F.col("p_size") >= 10, "Common").alias("rarity"),
        F.when(F.col("p_type") != "ECONOMY", F.lower("p_type")).alias("variant"),
    )


def external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.when(F.col("l_suppkey") % 3 == 0, "manual").when(F.col("l_suppkey") % 3 == 1, "feed").otherwise("example")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("card_id"),
        provider.alias("provider"),
        F.concat(F.lit("s-"), F.col("l_suppkey").cast("string")).alias("external_id"),
    ).distinct()


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    month = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    months = read(spark, sf_dir, "orders").groupBy(month.alias("m")).agg(
        F.countDistinct("o_custkey").alias("set_count"), F.count("*").alias("card_count")
    )
    ordinal = F.row_number().over(Window.orderBy("m"))  # one row per calendar month
    return months.select(
        F.concat(F.lit("orders-catalog-v0."), ordinal.cast("string"), F.lit(".0")).alias("version"),
        ordinal.cast("long").alias("ordinal"),
        "set_count",
        "card_count",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("token"),
        F.when(key % 3 == 1, "expired").otherwise("active").alias("status"),
        (F.lit(1704067200) + key * 600).alias("expires_at_s"),
    )


STATUSES = (
    "created", "uploading", "uploaded", "identifying", "awaiting_confirmation", "analyzing", "calculating",
    "completed", "failed",
)
TARGETS = ("uploading", "uploaded", "identifying", "awaiting_confirmation", "analyzing", "calculating", "completed", "created")


def _pick(values: tuple[str, ...], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int") + 1)


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), _pick(STATUSES, "o_orderkey").alias("status")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("analysis_id"), "event_id", F.col("ts"), _pick(TARGETS, "event_id").alias("target")
    )


def distribution_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    digit = F.substring("o_orderpriority", 1, 1)
    grade = F.when(digit == "1", "10").when(digit == "2", "9.5").when(digit == "3", "9").when(digit == "4", "8")
    counted = read(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("id"), grade.otherwise("7_or_lower").alias("grade_key")
    ).agg(F.count("*").alias("n"))
    p = F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("id")).cast("double")
    return counted.select("id", "grade_key", "n", p.alias("p"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    base = ((200, 150), (800, 150), (800, 850), (200, 850))
    x = [b[0] + 400 * e(2 * i) for i, b in enumerate(base)]
    y = [b[1] + 400 * e(2 * i + 1) for i, b in enumerate(base)]
    mirrored = F.col("vec_id") % 4 == 0
    swap = lambda v, i: F.when(mirrored, v[{1: 3, 3: 1}[i]]).otherwise(v[i]) if i in (1, 3) else v[i]
    return read(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.lit(1000).alias("frame_width"),
        F.lit(1000).alias("frame_height"),
        *(swap(v, i).alias(f"{n}{i + 1}") for i in range(4) for n, v in (("x", x), ("y", y))),
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array of 64 grey values per row: an 8 by 8 raster, row by row."""
    pixel = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 400 * e.cast("double")).cast("int")))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", pixel).alias("px"))


#: Embeddings that make up a photograph, a row of pixels each.
PHOTO_ROWS = 64


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, width, height, y, px): grey photographs whose rows of pixels are the rasters of consecutive vectors."""
    byte = F.unhex(F.array_join(F.transform("px", lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    lines = rasters(spark, sf_dir).select(
        F.floor(F.col("vec_id") / PHOTO_ROWS).cast("long").alias("image"), (F.col("vec_id") % PHOTO_ROWS).cast("int").alias("y"), byte.alias("px")
    )
    sizes = lines.groupBy("image").agg(F.max(F.octet_length("px")).alias("width"), (F.max("y") + 1).alias("height"))
    return lines.join(sizes, "image").select("image", "width", "height", "y", "px")


def card_photos(spark: SparkSession, sf_dir: str, size: int = 125) -> DataFrame:
    """(image, width, height, y, px): a bright card on a dark surface where each quadrilateral is."""
    import numpy as np
    import pyarrow as pa

    from larkspur.sources.batches import mapped

    y, x = np.mgrid[:size, :size]

    def draw(batches):
        for batch in batches:
            ids, corners = batch.column(0).to_numpy(), np.stack([batch.column(c).to_numpy() for c in places], 1).reshape(-1, 4, 2) * size / 1000
            side = np.roll(corners, -1, axis=1) - corners
            inside = np.ones((len(ids), size, size), bool)
            for k in range(4):
                cx, cy, dx, dy = (c[:, None, None] for c in (*corners[:, k].T, *side[:, k].T))
                inside &= dx * (y - cy) - dy * (x - cx) >= 0
            px = np.where(inside, 200, 50 + (x * 7 + y * 13 + ids[:, None, None]) % 11).astype(np.uint8)
            n = len(ids) * size
            same, at = pa.array(np.full(n, size, np.int32)), pa.array(np.tile(np.arange(size, dtype=np.int32), len(ids)))
            lines = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(px)])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, size)), same, same, at, lines], names=["image", "width", "height", "y", "px"])

    places = [f"{c}{i}" for i in range(1, 5) for c in "xy"]
    corners = quads(spark, sf_dir).select(F.col("vec_id").cast("long").alias("vec_id"), *places)
    return mapped(corners, draw, "image long, width int, height int, y int, px binary", most=16 * 72)  # 16 photographs at once


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.floor(F.col("doc_id") / 2).cast("long").alias("analysis_id"),
        F.when(F.col("doc_id") % 2 == 0, "front").otherwise("back").alias("side"),
        F.col("text").alias("body"),
        "n_chars",
    )


def _cases(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_GRADE = """CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN '10' WHEN '2' THEN '9.5' WHEN '3' THEN '9'
  WHEN '4' THEN '8' ELSE '7_or_lower' END"""

#: The views for DuckDB, to go before a query.
SQL = {
    "sets_v": """SELECT DISTINCT p_brand AS set_code, 'tpch' AS game,
  CASE WHEN CAST(substring(p_brand, 7, 4) AS INT) % 2 = 0 THEN 'en' ELSE 'ja' END AS language,
  'Set ' || p_brand AS name FROM part""",
    "cards_v": """SELECT p_partkey AS id, p_brand AS set_code, lpad(CAST(p_size AS VARCHAR), 3, '0') || '/050' AS card_number,
  p_name AS name, CASE WHEN p_size >= 40 THEN 'Rare' WHEN p_size >= 10 THEN 'Common' END AS rarity,
  CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE lower(p_type) END AS variant FROM part""",
    "external_ids_v": """SELECT DISTINCT l_partkey AS card_id,
  CASE l_suppkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'feed' ELSE 'example' END AS provider,
  's-' || l_suppkey AS external_id FROM lineitem""",
    "versions_v": """SELECT 'orders-catalog-v0.' || row_number() OVER (ORDER BY m) || '.0' AS version,
  row_number() OVER (ORDER BY m) AS ordinal, set_count, card_count
  FROM (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS m, count(DISTINCT o_custkey) AS set_count,
  count(*) AS card_count FROM orders GROUP BY 1)""",
    "sessions_v": """SELECT c_custkey AS id, c_name AS token, CASE WHEN c_custkey % 3 = 1 THEN 'expired' ELSE 'active' END AS status,
  1704067200 + c_custkey * 600 AS expires_at_s FROM customer""",
    "analyses_v": f"SELECT o_orderkey AS id, o_custkey AS session_id, {_cases('o_orderkey', STATUSES)} AS status FROM orders",
    "requests_v": f"SELECT user_id AS analysis_id, event_id, ts, {_cases('event_id', TARGETS)} AS target FROM events",
    "terms_v": f"""SELECT id, grade_key, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY id) AS DOUBLE) AS p
  FROM (SELECT o_custkey AS id, {_GRADE} AS grade_key, count(*) AS n FROM orders GROUP BY 1, 2)""",
    "quads_v": """SELECT vec_id, 1000 AS frame_width, 1000 AS frame_height, ax AS x1, ay AS y1,
  CASE WHEN vec_id % 4 = 0 THEN dx ELSE bx END AS x2, CASE WHEN vec_id % 4 = 0 THEN dy ELSE by_ END AS y2, cx AS x3, cy AS y3,
  CASE WHEN vec_id % 4 = 0 THEN bx ELSE dx END AS x4, CASE WHEN vec_id % 4 = 0 THEN by_ ELSE dy END AS y4
  FROM (SELECT vec_id, 200 + 400 * embedding[1]::DOUBLE AS ax, 150 + 400 * embedding[2]::DOUBLE AS ay,
  800 + 400 * embedding[3]::DOUBLE AS bx, 150 + 400 * embedding[4]::DOUBLE AS by_,
  800 + 400 * embedding[5]::DOUBLE AS cx, 850 + 400 * embedding[6]::DOUBLE AS cy,
  200 + 400 * embedding[7]::DOUBLE AS dx, 850 + 400 * embedding[8]::DOUBLE AS dy FROM embeddings)""",
    "pixels_v": """SELECT vec_id, i, least(255, greatest(0, CAST(floor(128 + 400 * CAST(e AS DOUBLE)) AS INT))) AS px
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)""",
    "photos_v": f"""SELECT image, y, x, px, max(x) OVER (PARTITION BY image) + 1 AS width, max(y) OVER (PARTITION BY image) + 1 AS height FROM (
  SELECT vec_id // {PHOTO_ROWS} AS image, vec_id % {PHOTO_ROWS} AS y, i AS x, least(255, greatest(0, CAST(floor(128 + 400 * CAST(e AS DOUBLE)) AS INT))) AS px
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))""",
    "images_v": """SELECT doc_id AS id, doc_id // 2 AS analysis_id, CASE WHEN doc_id % 2 = 0 THEN 'front' ELSE 'back' END AS side,
  text AS body, n_chars FROM documents""",
}


def with_views(names: str, query: str) -> str:
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in names.split()) + " " + query
