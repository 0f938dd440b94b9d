"""Packing by powers of two: documents are split into pieces of binary lengths, equal lengths share a bucket."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, bounded_broadcast, byte_batches, table, text_batches
from larkspur.llm.tokenizing import encode_raw, public_path

CAPACITY = 1024
END_ID = 0
#: Texts encoded at once: the more, the more often a distinct word of theirs is looked up for several occurrences.
BATCH_BYTES = 4 << 20
#: Words that a worker remembers, from task to task.
MEMO_BYTES = 160 << 20
#: Rows of (task, length) that are broadcast: 32 bytes each. Beyond that they are joined in a shuffle.
BASE_ROWS = 200_000


def binary_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: as many of `capacity` as go in, then the powers of two that make up the rest."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, length, ids, doc_tokens, task, place) of each piece; place counts those of a length in this task."""
    task = TaskContext.get().partitionId()
    seen = dict.fromkeys((1 << i for i in range(capacity.bit_length())), 0)
    end = end_id.to_bytes(4, "little")
    for batch in byte_batches(batches, BATCH_BYTES, 1):
        docs, starts, lengths, ids, tokens, places = [], [], [], [], [], []
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for row, own in enumerate(encode_raw(path, texts, MEMO_BYTES)):
            raw, at = own + end, 0
            total = len(raw) // 4
            for n in binary_lengths(total, capacity):
                docs.append(row)
                starts.append(at)
                lengths.append(n)
                ids.append(raw[4 * at : 4 * (at + n)])
                tokens.append(total)
                places.append(seen[n])
                seen[n] += 1
                at += n
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(docs, pa.int32())),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array(tokens, pa.int64()),
                pa.array([task] * len(docs), pa.int32()),
                pa.array(places, pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "task", "place"],
        )


def decompose(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): each piece of each document is a sequence.

    A document's ids, with end_id behind them, are cut into as many pieces of `capacity` (a power of two) as go
    in and the powers of two that make up the rest, longest first. Every piece fills a sequence of its length:
    none crosses documents and none is padded. `ids` are little-endian unsigned 32-bit integers. Sequence ids
    number the sequences without gaps, those of a length in one run, so a batch of equal lengths is a range of ids.

    A null text is empty and gives one piece with the end id. Rows with equal ids, texts or both each have
    pieces of their own; ids may be null or of any type; further columns are ignored; an empty table gives none.

    Ids are written once and never shuffled. A task counts the pieces of each length as it cuts them; only the
    tasks' counts are summed up, and what came before a task is added to its pieces' places. A task that is run
    again after a loss replaces its counts with its rows, as both are in the same file.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "binary-packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(
        lambda b: _pieces(b, tokenizer, capacity, end_id),
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, task int, place long",
    )
    pieces = scratch.keep(pieces, "pieces")
    counts = scratch.keep(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    shorter, base = [], 0
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect():  # a row for each power of two
        shorter.append((r["length"], base))
        base += r["n"]
    first = F.create_map(*(F.lit(x).cast("long") for pair in shorter or [(0, 0)] for x in pair))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", (first[F.col("length")] + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("base"))
    placed = pieces.join(bounded_broadcast(bases, BASE_ROWS), ["length", "task"])
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids",
        "doc_tokens",
        (F.col("base") + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(sequences: DataFrame, path: str) -> None:
    """A folder for each length, so that a reader of one length opens no other's files."""
    sequences.write.mode("overwrite").partitionBy("length").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length, in a dense block of ids each."""
    return spark.read.parquet(path).where(F.col("length") == length)


def op12_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of 1 to 1024 tokens, each a power of two; ids are told by their checksum."""
    sequences = decompose(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))
    return sequences.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
