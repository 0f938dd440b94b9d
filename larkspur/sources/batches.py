"""Arrow batches of a bounded size, for functions whose rows are large or become many."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Most rows and bytes of a batch that Spark hands to a task, and bytes of the pieces that a function gets of it.
ROWS, BYTES = 512, 1 << 20
PIECE = 1 << 18


def bounded(spark: SparkSession) -> None:
    """Record batches of at most ROWS rows from now on, and of BYTES where the session has no bound.

    Spark puts 10,000 rows in a batch, in the JVM and again in each Python worker; with pixels that is a large part
    of an executor's memory.
    """
    rows, size = (f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows)) <= ROWS:
        spark.conf.set(rows, ROWS)
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, BYTES)


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes and at most ROWS rows; a row is never cut."""
    for batch in batches:
        n = batch.num_rows
        rows = max(1, min(ROWS, most * n // max(1, batch.nbytes)))
        for at in range(0, max(1, n), rows):
            yield batch.slice(at, rows)


def lists(values: np.ndarray, lengths: np.ndarray | list[int]) -> pa.ListArray:
    """Lists of so many of the values each, one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(values))


def mapped(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str, most: int = PIECE) -> DataFrame:
    """df.mapInArrow(each, ddl), batches bounded on both sides: `each` gives a batch for each piece that it gets.

    A worker waits for its next task in between, so it gives back what it no longer uses.
    """
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(pieces(batches, most))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, ddl)
