"""Vector code compression: product quantisation by Lloyd rounds whose sums are kept up by what changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, arrow_rows, bounded_broadcast, shuffle_partitions, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components beyond are taken as this: so that squared distances of some 3,000 dimensions fit 64 bits.
MOST = 1 << 24
#: Components of the vectors that a task holds at once.
BATCH_VALUES = 1 << 20
CHUNK = 4096
#: Labels whose sums are broadcast when all of them are.
LABEL_ROWS = 100_000


class Codebooks:
    """Entries of each part with their running sums and counts: integers, PARTS x ENTRIES x width of each."""

    def __init__(self, seeds: np.ndarray, parts: int) -> None:
        n, dimensions = seeds.shape
        self.parts, self.width = parts, dimensions // parts
        self.entries = np.ascontiguousarray(seeds.reshape(n, parts, self.width).transpose(1, 0, 2))
        self.sums = np.zeros_like(self.entries)
        self.counts = np.zeros(self.entries.shape[:2], np.int64)

    def add(self, part: int, entry: int, n: int, sums: list[int]) -> None:
        self.counts[part, entry] += n
        self.sums[part, entry] += np.array(sums, np.int64)

    def move(self) -> None:
        """Entries become the floor of their parts' mean; those without parts stay."""
        used = self.counts > 0
        self.entries[used] = self.sums[used] // self.counts[used][:, None]

    def assign(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances over all parts) of rows of integers; ties go to the lower entry."""
        codes = np.zeros((len(q), self.parts), np.int32)
        error = np.zeros(len(q), np.int64)
        for p in range(self.parts):
            books = self.entries[p]
            for a in range(0, len(q), CHUNK):
                x = q[a : a + CHUNK, p * self.width : (p + 1) * self.width]
                d = _distances(x, books)
                best = d.argmin(axis=1)  # the first of equal ones
                codes[a : a + CHUNK, p] = best
                error[a : a + CHUNK] += d[np.arange(len(x)), best]
        return codes, error

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.entries[p][codes[:, p]] for p in range(self.parts)], axis=1)

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


def _distances(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances as exact integers: a product of doubles where none can reach 2 ** 53, else by differences."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    if 4 * max(1, x.shape[1]) * largest * largest < 1 << 53:
        a, b = x.astype(np.float64), books.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(books)), np.int64)
    for j in range(x.shape[1]):
        out += np.square(x[:, j, None] - books[:, j])
    return out


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of a list column as 64-bit integers, filled up with zeros to `dimensions`."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(values) == len(column) * dimensions:
        return values.reshape(len(column), dimensions)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dimensions), np.int64)
    out[np.arange(dimensions) < sizes[:, None]] = values
    return out


def _lists(values: np.ndarray) -> pa.ListArray:
    n, m = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(values.ravel().astype(np.int32)))


def _assign(batches: Iterator[pa.RecordBatch], books: Codebooks, last: bool) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, q, before, codes) of (vec_id, label, q, codes); at last (vec_id, label, codes, error)."""
    for batch in batches:
        q = _matrix(batch.column(2), books.parts * books.width)
        codes, error = books.assign(q)
        ends = [_lists(codes), pa.array(error)] if last else [_lists(q), batch.column(3), _lists(codes)]
        names = ["codes", "error"] if last else ["q", "before", "codes"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *ends], names=["vec_id", "label", *names])


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q): floors of `scale` times each component; without vectors that are null or not finite."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    whole = lambda x: F.floor(F.greatest(F.lit(-2.0 * MOST), F.least(F.lit(2.0 * MOST), x.cast("double") * scale)))
    bounded = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), whole(x).cast("int")))
    return vectors.where(F.col("embedding").isNotNull() & finite).select("vec_id", "label", F.transform("embedding", bounded).alias("q"))


def changes(assigned: DataFrame, parts: int, width: int) -> DataFrame:
    """(part, entry, n, s0 ...): what the parts that changed their entry add to it and take from the one before.

    Parts that stay give no row, so after the first round little is shuffled, and partial sums come first.
    """

    def moved(p):
        own = F.slice("q", p * width + 1, F.lit(width))
        new, old = F.element_at("codes", p + 1), F.element_at("before", p + 1)
        row = lambda entry, sign: F.struct(p.alias("part"), entry.alias("entry"), F.lit(sign).alias("sign"), own.alias("own"))
        return F.when(new != old, F.filter(F.array(row(new, 1), row(old, -1)), lambda r: r["entry"] >= 0)).otherwise(F.array().cast(kind))

    kind = "array<struct<part:int,entry:int,sign:int,own:array<int>>>"
    rows = assigned.select(F.inline(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), moved))))
    sums = [F.sum(F.col("sign") * F.col("own")[j].cast("long")).alias(f"s{j}") for j in range(width)]
    return rows.groupBy("part", "entry").agg(F.sum("sign").alias("n"), *sums)


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, codes, error), codebooks): product quantisation of integer vectors, exact and reproducible.

    Codebooks start as the parts of the `entries` smallest ids (nulls last, then by vector) and take `rounds`
    of Lloyd's: every part goes to the nearest entry, and entries become the floor of their parts' mean. Codes
    and errors (squared distances) are those of the codebooks after the last round.

    Each round is written with the assignments before it. The sums are never taken anew: parts that changed
    their entry are added to one and taken from the other, and only those are shuffled. The driver holds
    entries, sums and counts - `entries` times the dimensions - and tasks get the entries.

    Null vectors and those with null or non-finite components are left out. Vectors that are shorter than
    the longest, or whose length isn't a multiple of `parts`, are filled up with zeros. Components that
    `scale` brings beyond 2 ** 24 count as that. Rows with equal ids, vectors or both each get codes; with fewer rows
    than `entries` the codebooks are that much smaller. No rows give no codes and no codebooks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    rows = scratch.keep(quantised(vectors, scale), "quantised")
    longest = rows.agg(F.max(F.size("q"))).first()[0]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ids = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    if longest is None:
        return spark.createDataFrame([], f"{ids}, codes array<int>, error long"), None
    dimensions = -(-longest // parts) * parts
    smallest = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()
    seeds = np.zeros((len(smallest), dimensions), np.int64)
    for i, r in enumerate(smallest):
        seeds[i, : len(r["q"])] = r["q"]
    books = Codebooks(seeds, parts)
    current, name = rows.withColumn("codes", F.array_repeat(F.lit(-1), parts)), "quantised"
    with arrow_rows(spark, max(1, min(10_000, BATCH_VALUES // max(1, dimensions)))):
        for k in range(rounds):
            shape = f"{ids}, q array<int>, before array<int>, codes array<int>"
            assigned = scratch.keep(current.mapInArrow(lambda b, own=books: _assign(b, own, False), shape), f"round-{k}")
            scratch.drop(name)
            for r in changes(assigned, parts, books.width).collect():  # parts x entries rows at most
                books.add(r["part"], r["entry"], r["n"], list(r)[3:])
            books.move()
            current, name = assigned.select("vec_id", "label", "q", "codes"), f"round-{k}"
        coded = scratch.keep(current.mapInArrow(lambda b: _assign(b, books, True), f"{ids}, codes array<int>, error long"), "codes")
    scratch.drop(name)
    return coded, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors of all rows of its label; nulls are one label, sums beyond a long null.

    Sums are broadcast if there are few labels. Else those of more rows than an average task's share are, of which
    there can't be more than tasks, and only rows of the others are joined in a shuffle.
    """
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("of_rows"))
    same = F.col("label").eqNullSafe(F.col("of"))
    spark = coded.sparkSession
    if sums.limit(LABEL_ROWS + 1).count() <= LABEL_ROWS:
        return coded.join(bounded_broadcast(sums, LABEL_ROWS), same).drop("of", "of_rows")
    share = coded.count() / shuffle_partitions(spark)
    large, small = sums.where(F.col("of_rows") > share), sums.where(F.col("of_rows") <= share)
    rest = coded.join(F.broadcast(large), same, "left_anti").join(small.hint("shuffle_merge"), same)
    return coded.join(F.broadcast(large), same).unionByName(rest).drop("of", "of_rows")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all `embeddings` in 16 parts of 64 entries, with their errors and the codebooks' digest."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(books.text().encode() if books else b"").hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return with_label_error(coded).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _round_sql(k: int) -> str:
    """Assignments by codebook k, and the next codebook: every sum is taken anew."""
    return f"""a{k} AS (SELECT r, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (SELECT r, part, entry,
      CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS BIGINT) AS d
      FROM p JOIN c{k} USING (part)) GROUP BY 1, 2),
    m{k} AS (SELECT part, entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN p USING (r, part), (SELECT unnest(range(1, 5)) AS i) GROUP BY 1, 2, 3),
    c{k + 1} AS (SELECT part, entry, coalesce(z, y) AS y FROM c{k} LEFT JOIN (SELECT part, entry,
      list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS z FROM m{k} GROUP BY 1, 2) USING (part, entry))"""


#: For vectors of 64 components.
ORACLE_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS MATERIALIZED (SELECT r, part, q[4 * part + 1 : 4 * part + 4] AS x FROM v, (SELECT unnest(range(16)) AS part)),
  c0 AS (SELECT part, r - 1 AS entry, x AS y FROM p WHERE r <= 64),
  {", ".join(_round_sql(k) for k in range(ROUNDS + 1)).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")},
  e AS (SELECT r, CAST(sum(d) AS BIGINT) AS error, string_agg(printf('%02x', entry), '' ORDER BY part) AS code FROM a{ROUNDS} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM v JOIN e USING (r)
"""
