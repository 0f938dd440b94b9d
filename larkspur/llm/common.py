"""Shared plumbing of the llm operators: scratch tables, Arrow helpers, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_ROWS = 1024
TEXT_BYTES = 8 << 20
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB


class Scratch:
    """Tables that cut lineage, written to the shared folder in spark.checkpoint.dir.

    Every executor can read them, so a lost executor costs a re-read and not a recomputation of
    what came before. They go when `drop` is called or when the driver's interpreter ends. Where the
    setting is missing, a local session makes a folder of its own; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.kept: set[str] = set()
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str, **partition: object) -> DataFrame:
        path = f"{self.root}/{name}"
        self.kept.add(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, name: str = "") -> None:
        self.kept.discard(name)
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            conf = self.spark._jsc.hadoopConfiguration()
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # noqa: BLE001 - at exit the gateway may already be gone
            if name:
                raise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Record batches of at most TEXT_ROWS rows from now on, and of TEXT_BYTES where the session has no bound.

    Spark puts 10,000 rows in a batch, in the JVM and again in the Python worker; with long texts that is
    a large part of an executor's memory.
    """
    rows, size = (f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows)) <= TEXT_ROWS:
        spark.conf.set(rows, TEXT_ROWS)
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, TEXT_BYTES)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows of a record batch in what is run inside: rows with long texts or arrays are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unused(docs: DataFrame, name: str) -> str:
    """name, lengthened until docs has no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcasting if it has at most `rows` rows; else a shuffle join stays."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def smallest_hashes(df: DataFrame, key: str, salt: int, limit: int) -> DataFrame:
    """At most `limit` rows, those with the smallest hashes of their key: a sample that doesn't depend on order.

    Rows whose hash can't be among them by a wide margin are left out first, so what a task hands on for
    the final order doesn't grow with the number of tasks.
    """
    h, n = F.xxhash64(key, F.lit(salt)), df.count()
    if n > 4 * limit:
        df = df.where(h < int(-(2**63) + 2**64 * (4 * limit / n)))
    return df.orderBy(h, key).limit(limit)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def byte_batches(
    batches: Iterable[pa.RecordBatch], max_bytes: int, text: int
) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows whose text column holds about max_bytes."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgotten all at once beyond a bounded number of words."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value
