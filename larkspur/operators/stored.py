"""Tables that are stored in versions: a merge writes anew only the files that hold keys it touches.

A table's folder has `data`, Parquet files that are never changed, and `manifests/<ordinal>.json`, each of which lists the
files of a version with the least and the largest of what they are clustered by. A version is there once its manifest is.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.operators import catalog
from larkspur.sources import files

ROWS_PER_FILE = 1_000_000


class Conflict(RuntimeError):
    """Another writer has published a version since this one read the table."""


class Stored:
    """A stored table, as of its newest version or of one that is named."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        found = files.ordinals(spark, path)
        if not found or version is not None and version not in found:
            raise ValueError(f"{path} has no version{'' if version is None else f' {version}'}")
        self.spark, self.path, self.version = spark, path, found[-1] if version is None else version
        told = json.loads(files.read_text(spark, files.manifest(path, self.version)))
        self.schema = StructType.fromJson(told["schema"])
        self.cluster: list[str] = told["cluster"]
        self.rows_per_file: int = told["rows_per_file"]
        self.files: list[dict] = told["files"]

    def rows(self, names: list[str] | None = None) -> DataFrame:
        """The rows of all files, or of those named. Readers of a version aren't disturbed by later ones."""
        names = [f["file"] for f in self.files] if names is None else names
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{n}" for n in names))

    def between(self, low: object, high: object) -> list[str]:
        """Files that may hold rows whose first clustering column is from low to high, or null."""
        return [f["file"] for f in self.files if f["least"] is None or f["nulls"] or not (f["largest"] < low or f["least"] > high)]

    def starting_with(self, prefix: str) -> DataFrame:
        """Rows whose first clustering column starts with a text: other files aren't opened, others' row groups skipped."""
        names = [f["file"] for f in self.files if f["least"] is not None and f["largest"][: len(prefix)] >= prefix >= f["least"][: len(prefix)]]
        return self.rows(names).where(F.startswith(F.col(self.cluster[0]), F.lit(prefix)))


def _write(rows: DataFrame, path: str, cluster: list[str], rows_per_file: int) -> list[dict]:
    """Writes rows in ranges of what they are clustered by; a dict for each file, of which there is one for some rows_per_file."""
    spark = rows.sparkSession
    stage = uuid.uuid4().hex
    n = rows.count()
    if not n:
        return []
    parts = -(-n // rows_per_file)
    rows.repartitionByRange(parts, *cluster).sortWithinPartitions(*cluster).write.parquet(f"{path}/data/{stage}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/data/{stage}")
    name = F.concat(F.lit(f"{stage}/"), F.col("_metadata.file_name"))
    first = F.col(cluster[0])
    told = written.select(name.alias("file"), first.alias("v")).groupBy("file").agg(
        F.min("v").alias("least"), F.max("v").alias("largest"), F.count("*").alias("rows"), (F.count("*") - F.count("v")).alias("nulls")
    )
    return sorted((r.asDict() for r in told.collect()), key=lambda f: f["file"])  # one row a file


def _publish(spark: SparkSession, path: str, after: int, schema: StructType, cluster: list[str], rows_per_file: int, names: list[dict]) -> Stored:
    """Makes a version of files, next after the one it was made from: the rename fails if another is there."""
    manifest = {"schema": json.loads(schema.json()), "cluster": cluster, "rows_per_file": rows_per_file, "files": names}
    temporary = f"{path}/manifests/.{uuid.uuid4().hex}"
    files.write_text(spark, temporary, json.dumps(manifest, indent=1) + "\n")
    if not files.rename_new(spark, temporary, files.manifest(path, after + 1)):
        files.delete(spark, temporary)
        raise Conflict(f"{path} has a version {after + 1} already")
    return Stored(spark, path, after + 1)


def create(path: str, rows: DataFrame, cluster: list[str], rows_per_file: int = ROWS_PER_FILE) -> Stored:
    """A new table, clustered by columns of which the first is text or a number: files are ranges of it."""
    spark = rows.sparkSession
    names = _write(rows, path, cluster, rows_per_file)
    return _publish(spark, path, 0, rows.schema, cluster, rows_per_file, names)


def merge(
    table: Stored, source: DataFrame, keys: list[str], updates: list[str], stamps: dict[str, Column] | None = None, stored: dict[str, Column] | None = None
) -> Stored:
    """The version after table, into which source is merged by key; only files with keys of source are written anew.

    Where both have a row, `updates` are taken from source, nulls included, and nothing else; a row of source alone is
    inserted. `stamps` are set on each row that is updated or inserted, such as its time. `stored` columns are computed
    from the row whenever it is written. Where the clustering column is a key, files outside source's range aren't even
    opened; of the others, the keys alone are read to tell which are touched. A key may come once in source.

    Of writers that started from one version the first wins; others get a Conflict and start again from what is there.
    """
    spark = table.spark
    given = source.select(*(F.col(c) if c in source.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.schema.names))
    again = source.groupBy(*keys).count().where("count > 1").first()
    if again is not None:
        raise ValueError(f"source has a key more than once: {', '.join(str(again[k]) for k in keys)}")
    names = [f["file"] for f in table.files]
    if table.cluster[0] in keys:
        low, high = source.agg(F.min(table.cluster[0]), F.max(table.cluster[0])).first()
        names = [] if low is None else table.between(low, high)
    touched: set[str] = set()
    if names:
        wanted = source.select(*keys).alias("w")
        held = table.rows(names).select(*keys, _file().alias("file")).alias("h")
        same = reduce(lambda a, b: a & b, (F.col(f"h.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys))
        touched = {r[0] for r in held.join(wanted, same, "left_semi").select("file").distinct().collect()}  # one row a file
    merged = catalog.merge(table.rows(sorted(touched)), given, keys, updates)
    changed = F.col("action") != "kept"
    for name, value in (stamps or {}).items():
        merged = merged.withColumn(name, F.when(changed, value).otherwise(F.col(name)))
    for name, value in (stored or {}).items():
        merged = merged.withColumn(name, value)
    merged = merged.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema))
    new = _write(merged, table.path, table.cluster, table.rows_per_file)
    kept = [f for f in table.files if f["file"] not in touched]
    return _publish(spark, table.path, table.version, table.schema, table.cluster, table.rows_per_file, kept + new)


def _file() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1)


# What is taken anew with a picture, and what was derived from the picture before it.
RETAKEN = ("original_uri", "mime_type", "sha256", "created_at")
DERIVED = ("normalized_uri", "width", "height", "quality_status", "quality_score", "quality_details", "normalization_details")


def retake(table: Stored, pictures: DataFrame) -> Stored:
    """The version in which pictures of (analysis_id, side, RETAKEN) take the place of those there are; what was derived is null."""
    return merge(table, pictures, ["analysis_id", "side"], [*RETAKEN, *DERIVED])
