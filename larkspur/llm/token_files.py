"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, byte_batches, shuffle_partitions, table, text_batches
from larkspur.llm.tokenizing import END_ID, encode_raw, public_path

#: Ids in one ORC row. Longer documents take several rows, so that stripes and read batches stay bounded.
ROW_IDS = 4096
#: Texts encoded at once: the more, the more often a distinct word of theirs is looked up for several occurrences.
BATCH_BYTES = 4 << 20
END = np.array([END_ID], "<u4").tobytes()
STRIPE_BYTES = 64 << 20
#: Rows between two entries of the row index.
INDEX_STRIDE = 1000


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    row = 0
    for batch in byte_batches(batches, BATCH_BYTES, 1):
        owner, docs, parts, ids, ends = [], [], [], [], [0]
        for d, own in zip(
            batch.column(0).to_pylist(), encode_raw(path, [t or "" for t in batch.column(1).to_pylist()]), strict=True
        ):
            own = np.frombuffer(own + END, "<i4")
            for part, at in enumerate(range(0, len(own), ROW_IDS)):
                docs.append(d)
                owner.append(row)
                parts.append(part)
                ends.append(ends[-1] + min(ROW_IDS, len(own) - at))
            ids.append(own)
            row += 1
        values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, batch.schema.field(0).type), pa.array(owner, pa.int64()), pa.array(parts, pa.int32()), values],
            names=["doc_id", "row", "part", "ids"],
        )


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, files: int | None = None) -> None:
    """Writes (doc_id, row, part, ids) to ORC files at `path`, in ascending doc_id order over all files.

    A null text is an empty document (only the end id). Rows with equal ids stay apart: `row` numbers
    the documents of a file, ties ordered by text. Null ids come first. Documents of more than ROW_IDS
    ids take several rows, numbered by `part`. Further columns are ignored.
    """
    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    files = files or shuffle_partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = ordered.mapInArrow(lambda b: _encode(b, tokenizer), f"doc_id {kind}, row long, part int, ids array<int>")
    (
        encoded.write.mode("overwrite")
        .option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with doc_ids, stripes without them are passed over by their metadata."""
    rows = spark.read.orc(path)  # doc_id is of the type that was written
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


@functools.lru_cache(maxsize=64)
def _zeros_operator(power: int) -> tuple[int, ...]:
    """The linear map (32 columns) that 2 ** power zero bytes apply to a CRC-32 register."""
    if power:
        half = _zeros_operator(power - 1)
        return tuple(_apply(half, x) for x in half)
    out = []
    for bit in range(32):
        v = 1 << bit
        for _ in range(8):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return tuple(out)


def _apply(op: tuple[int, ...], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= op[i]
        v >>= 1
        i += 1
    return out


def crc32_join(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings in a row, from theirs and the second one's length."""
    for power in range(second_bytes.bit_length()):
        if second_bytes >> power & 1:
            first = _apply(_zeros_operator(power), first)
    return first ^ second


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        offsets = lists.offsets.to_numpy()
        values = memoryview(lists.values.to_numpy(zero_copy_only=True).astype("<u4", copy=False)).cast("B")
        crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(i) for i in range(4)),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.array(crcs, pa.int64()),
            ],
            names=["file", "doc_id", "row", "part", "n", "crc"],
        )


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for parts in batch.column(batch.schema.get_field_index("parts")).to_pylist():
            crc = parts[0]["crc"]
            for p in parts[1:]:
                crc = crc32_join(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(4)), pa.array(out, pa.int64())],
            names=["file", "doc_id", "row", "n_tokens", "ids_crc32"],
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, read back from them.

    `start` counts the ids of all documents before it. Sums run within files, whose size is bounded,
    and over one row per file; nothing is sorted in a single task but those.
    """
    rows = read_token_orc(spark, path).select(
        F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("file"), "doc_id", "row", "part", "ids"
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(spark, "token-index")
    parts = scratch.keep(rows.mapInArrow(_digest, f"file int, doc_id {kind}, row long, part int, n long, crc long"), "parts")
    # a first part that isn't full is a whole document; only the others are put together
    whole = F.expr(f"part = 0 and n < {ROW_IDS}")
    several = (
        parts.where(~whole)
        .groupBy("file", "doc_id", "row")
        .agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "n", "crc"))).alias("parts"))
        .mapInArrow(_join_parts, f"file int, doc_id {kind}, row long, n_tokens long, ids_crc32 long")
    )
    single = parts.where(whole).select("file", "doc_id", "row", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    docs = scratch.keep(single.union(several), "docs")
    files = docs.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return docs.join(files, "file").select(
        "doc_id",
        (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-orc").path("ids.orc")
    write_token_orc(table(spark, sf_dir, "documents"), path, public_path("byte_bpe_50k.json"))
    return token_index(spark, path)
