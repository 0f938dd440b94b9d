"""Sharding: proportional stratified interleaving, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import table

SHARDS = 16
SEED = "larkspur-1"
#: Buckets that ranks are counted by: rows of a bucket are what one task has to order.
BUCKETS = 4096


def _unit(hexadecimal: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a number from 0 to below 1."""
    return F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row: counts of shards are at most one apart.

    Rows of a source are shuffled by a seeded digest and ranked; the rank, set off by a phase of the
    source's own and divided by the source's number of rows, is a row's fractional rank. All rows are put
    in its order and cut into `shards` runs of equal length, so every shard has each source in proportion,
    to within a row or two.

    No rank is made in a single task: rows are dealt by ranges of the digest (evenly, as it is uniform)
    within their source, then by ranges of the fractional rank (evenly as well), counted by bucket, and
    ranked within the bucket only. A source with a third of all rows lies in as many buckets as any.

    A null text has no bytes (size 1, crc 0); a null source is a source; rows that are equal in id, source
    and text are interchangeable and keep separate places; further columns are ignored; an empty table
    gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("stratum"),
        F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("digest"),
    ).withColumn("cell", F.floor(_unit(F.col("digest")) * buckets).cast("int"))
    cells = rows.groupBy("stratum", "cell").agg(F.count("*").alias("n"))
    source = Window.partitionBy("stratum")
    earlier = source.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "stratum",
        "cell",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(source).alias("of"),
    )
    rank = F.row_number().over(Window.partitionBy("stratum", "cell").orderBy("digest", "text_crc32", "size"))
    ranked = rows.join(cells, ["stratum", "cell"]).withColumn(
        "fraction",
        (F.col("before") + rank - 1 + _unit(F.md5(F.concat_ws("/", F.lit(seed), "stratum")))) / F.col("of"),
    )
    ranked = ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        "stratum",
        "digest",
        "fraction",
        F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("int").alias("range"),
    )
    ranges = ranked.groupBy("range").agg(F.count("*").alias("n"))  # at most `buckets` rows
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("of"),
    )
    place = F.row_number().over(
        Window.partitionBy("range").orderBy("fraction", "stratum", "digest", "text_crc32", "size")
    )
    placed = ranked.join(F.broadcast(ranges), "range").withColumn("place", F.col("before") + place - 1)
    shard = F.expr(f"cast(place * {shards} div of as int)")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        shard.alias("shard"),
        F.expr(f"place - (cast(place * {shards} div of as int) * of + {shards - 1}) div {shards}").alias("slot"),
    )


def op7_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: DuckDB has no CRC-32 of a text: it is folded over the bytes with the reflected polynomial 0xEDB88320.
ORACLE_SQL = f"""
WITH poly AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda k: 0::BIGINT),
      lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) AS c
    FROM range(256) r(i))
), base AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS body,
    CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum,
    md5('{SEED}/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), crc AS (
  SELECT b.*, xor(4294967295, list_reduce([4294967295::BIGINT] ||
      list_transform(range(1, 2 * strlen(body), 2), lambda k: CAST('0x' || substr(hex(encode(body)), k, 2) AS BIGINT)),
      lambda v, x: xor(v // 256, t[1 + xor(v % 256, x)]))) AS text_crc32
  FROM base b, poly
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY digest, text_crc32, size) - 1
      + CAST('0x' || substr(md5('{SEED}/' || stratum), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)
      / count(*) OVER (PARTITION BY stratum) AS fraction
  FROM crc
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, digest, text_crc32, size) - 1 AS place,
    count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * {SHARDS} // n AS INTEGER) AS shard,
  place - ((place * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
