"""Best-fit packing by exact-complement hashing over a histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, byte_batches, shuffle_partitions, table, text_batches
from larkspur.llm.tokenizing import END_ID, MEMO_BYTES, encode_raw, public_path, tidy

CAPACITY = 1024
#: Texts encoded at once: the more, the more often a distinct word of theirs is looked up for several occurrences.
BATCH_BYTES = 4 << 20
#: The same, and bytes of words remembered, by a task that leaves its worker small.
TIDY_BATCH_BYTES = 1 << 20
TIDY_MEMO_BYTES = 48 << 20

END = np.array([END_ID], "<u4").tobytes()

#: (multiplicity, lengths in the order of their places)
Pattern = tuple[int, tuple[int, ...]]


def plan_patterns(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Sequences that hold counts[n] pieces of each length n, as repeated patterns of lengths.

    Longest first: each length is joined with exact complements of its gap - one length, a pair, or a
    triple of lengths, looked up by their sum among those still available - as many times as the
    scarcest of them allows. What no complement fills exactly is placed best fit: the longest piece
    that still goes into the gap, again and again. Each step uses up a length, so that the number of
    patterns is bounded by the capacity and not by the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    plan: list[Pattern] = []

    def times(lengths: tuple[int, ...]) -> int:
        return min(int(left[n]) // lengths.count(n) for n in set(lengths))

    def take(lengths: tuple[int, ...]) -> bool:
        n = times(lengths)
        if n > 0:
            plan.append((n, lengths))
            for x in lengths:
                left[x] -= n
        return n > 0

    if left[capacity]:
        take((capacity,))
    for longest in range(capacity - 1, 0, -1):
        gap = capacity - longest
        if left[longest]:
            take((longest, gap))
        if left[longest]:
            for b in range(gap - 1, (gap - 1) // 2, -1):
                if left[longest] and left[b] and left[gap - b]:
                    take((longest, b, gap - b))
        if left[longest]:
            for b in range(gap - 2, 0, -1):
                if not left[longest]:
                    break
                if not left[b]:
                    continue
                rest = gap - b  # of two lengths, neither above b
                low = np.arange(max(1, rest - b), rest // 2 + 1)
                for c in low[(left[low] > 0) & (left[rest - low] > 0)][::-1].tolist():
                    if not left[longest] or not left[b]:
                        break
                    take((longest, b, rest - c, c))
    while left.any():
        lengths: list[int] = []
        room = capacity
        for n in np.flatnonzero(left)[::-1].tolist():
            fits = min(room // n, int(left[n]))
            lengths += [n] * fits
            room -= n * fits
        take(tuple(lengths))
    return plan


def slots(plan: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, offset): where the pieces of a length go."""
    used: dict[int, int] = {}
    out, base = [], 0
    for times, lengths in plan:
        offset = 0
        for n in lengths:
            first = used.get(n, 0)
            out.append((n, first, first + times, base, offset))
            used[n] = first + times
            offset += n
        base += times
    return out


def _pieces(
    batches: Iterator[pa.RecordBatch], path: str, capacity: int, memo_bytes: int = MEMO_BYTES, batch_bytes: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    for batch in byte_batches(batches, batch_bytes, 1):
        docs, piece, start, length, crc = [], [], [], [], []
        for d, own in zip(
            batch.column(0).to_pylist(), encode_raw(path, [t or "" for t in batch.column(1).to_pylist()], memo_bytes), strict=True
        ):
            raw = memoryview(own + END)
            total = len(raw) // 4
            first = total % capacity or capacity
            at, k = 0, 0
            while at < total:
                n = first if k == 0 else capacity
                docs.append(d)
                piece.append(k)
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                at, k = at + n, k + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(docs, batch.schema.field(0).type),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, small: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each row.

    Only documents of more than `capacity` ids are cut; the first piece takes the remainder. A null
    text is empty and gives one piece with the end id. Rows with equal ids, texts or both are packed
    each on its own; further columns are ignored; an empty table gives an empty result.

    The planner sees only the number of pieces of each length: `capacity` numbers, however large the
    corpus. Pieces find their place by their rank among those of their length. Ranks come from counts
    by (bucket, length), where a bucket is a hash of the document, so no length is ranked in one task.

    small: as one of several stages in the same executors, tasks encode less at once, remember fewer words and leave none behind.
    """
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(
        lambda b: tidy(_pieces)(b, tokenizer, capacity, TIDY_MEMO_BYTES, TIDY_BATCH_BYTES) if small else _pieces(b, tokenizer, capacity),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long",
    )
    buckets = 8 * shuffle_partitions(spark)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    pieces = scratch.keep(pieces, "pieces")
    by_bucket = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = scratch.keep(by_bucket.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    places = spark.createDataFrame(
        slots(plan_patterns(counts, capacity)), "length long, first long, end long, base_sequence long, offset long"
    )
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.join(by_bucket.drop("n"), ["length", "bucket"]).withColumn("rank", F.col("base") + rank - 1)
    placed = ranked.alias("p").join(
        F.broadcast(places).alias("s"),  # a few thousand rows: see plan_patterns
        (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")),
    )
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("p.length").alias("length"),
        "ids_crc32",
        (F.col("base_sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
        "offset",
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))
