"""Nearest neighbours: anisotropic product quantisation, four-bit table scans, exact reranking within error bounds."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, shuffle_partitions, smallest_hashes, table

TOP = 20
#: Codewords of a subspace: four bits.
CODES = 16
#: Dimensions of a subspace.
WIDTH = 2
#: At most so many vectors, those with the smallest hashes of their ids, fit the codebooks.
MAX_TRAIN = 8000
ROUNDS = 6
#: Share of the largest inner products whose errors matter: sets how much more parallel error weighs.
THRESHOLD = 0.2
#: Where vectors are so short that this share wouldn't tell parallel error from the rest, it weighs so much.
LEAST_ETA = 2.0
#: Rows of each block whose exact scores set a query's floor; every row that may reach the floor is reranked too.
RERANK = 512
#: Rows, and components of all of them, that are held as one block.
BLOCK_ROWS = 32_768
BLOCK_VALUES = 4 << 20
#: Smaller blocks than this only to let more tasks work at once are not worth it.
LEAST_ROWS = 4096


@dataclass(frozen=True)
class Quantiser:
    books: np.ndarray  # (subspaces, CODES, WIDTH)
    eta: float  # weight of the squared error parallel to the vector, above 1

    def pad(self, x: np.ndarray) -> np.ndarray:
        m = self.books.shape[0] * WIDTH
        return x if x.shape[1] == m else np.pad(x, ((0, 0), (0, m - x.shape[1])))

    def assign(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes that minimise |r|^2 + (eta - 1) (r . x/|x|)^2, by coordinate descent over the subspaces."""
        x = self.pad(x).astype(np.float32)
        n, m = len(x), self.books.shape[0]
        parts = x.reshape(n, m, WIDTH)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        # per subspace and code: the squared error, and the error along the vector
        error = np.stack([((parts[:, j, None] - self.books[j]) ** 2).sum(2) for j in range(m)], 1)
        along = np.stack([((parts[:, j, None] - self.books[j]) * unit[:, j, None]).sum(2) for j in range(m)], 1)
        codes = error.argmin(2)
        rows = np.arange(n)
        total = along[rows[:, None], np.arange(m), codes].sum(1)
        for _ in range(sweeps):
            for j in range(m):
                rest = total - along[rows, j, codes[:, j]]
                best = (error[:, j] + (self.eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
                codes[:, j] = best
                total = rest + along[rows, j, best]
        return codes.astype(np.uint8)

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two four-bit codes in each byte."""
        codes = self.assign(x)
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, 0::2] | (codes[:, 1::2] << 4)

    def decoded(self, packed: np.ndarray, dims: int) -> np.ndarray:
        """The vectors that packed codes stand for."""
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, : self.books.shape[0]]
        return self.books[np.arange(self.books.shape[0]), codes].reshape(len(packed), -1)[:, :dims]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each byte of a code, the inner product of its two subspaces with the query: (bytes, 256)."""
        one = np.einsum("jcw,jw->jc", self.books, self.pad(q[None])[0].reshape(-1, WIDTH).astype(np.float32))
        if len(one) % 2:
            one = np.pad(one, ((0, 1), (0, 0)))
        return (one[1::2, :, None] + one[0::2, None, :]).reshape(-1, CODES * CODES)


def train(x: np.ndarray, seed: int = 9) -> Quantiser:
    """Alternates between assigning codes and solving for all codewords under the anisotropic loss."""
    dims = x.shape[1]
    m = -(-dims // WIDTH)
    rng = np.random.default_rng(seed)
    x = np.pad(x, ((0, 0), (0, m * WIDTH - dims))).astype(np.float64)
    eta = max(LEAST_ETA, (dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    books = x[rng.integers(0, len(x), CODES)].reshape(CODES, m, WIDTH).transpose(1, 0, 2).copy()
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None]
    size = m * CODES * WIDTH
    slot = np.arange(m)[:, None] * CODES * WIDTH + np.arange(WIDTH)
    quantiser = Quantiser(books.astype(np.float32), eta)
    for _ in range(ROUNDS):
        codes = quantiser.assign(x).astype(np.int64)
        # normal equations of sum (x - Bc)' W (x - Bc) with W = I + (eta - 1) u u': B picks a slot per dimension
        left, right = np.zeros((size, size)), np.zeros(size)
        places = (slot[None] + codes[:, :, None] * WIDTH).reshape(len(x), -1)
        target = x + (eta - 1) * (unit * x).sum(1)[:, None] * unit
        np.add.at(right, places.ravel(), target.ravel())
        np.add.at(left, (places.ravel(), places.ravel()), 1.0)
        spread = np.zeros((len(x), size))
        np.put_along_axis(spread, places, unit, 1)
        left += (eta - 1) * spread.T @ spread
        left[np.diag_indices(size)] += 1e-9
        solved = np.linalg.solve(left, right).reshape(m, CODES, WIDTH)
        used = np.zeros((m, CODES), bool)
        used[np.arange(m)[None], codes] = True
        spare = x[rng.integers(0, len(x), CODES)].reshape(CODES, m, WIDTH).transpose(1, 0, 2)
        books = np.where(used[:, :, None], solved, spare)
        quantiser = Quantiser(books.astype(np.float32), eta)
    return quantiser


def exact(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each row summed alike wherever it stands."""
    return (rows * q).sum(1)


class Bounds:
    """What exact scores of a block's rows can be, given their table scores.

    With x a row, c = x^.x / |x|^2 of its decoded x^ and r the part of x - x^ across x, a query's table score
    is q.x^ = c q.x - q.r. Where q.x is at least t, the part of q across x is at most sqrt(|q|^2 - (t / |x|)^2)
    for t > 0, and |q| else. Sums in single precision are off by no more than `slack` |q|.
    """

    def __init__(self, rows: np.ndarray, decoded: np.ndarray) -> None:
        self.norm = np.linalg.norm(rows, axis=1)
        self.share = (rows * decoded).sum(1) / self.norm**2
        self.across = np.linalg.norm(rows * self.share[:, None] - decoded, axis=1)
        self.slack = (rows.shape[1] + 16) * 2.0**-23 * (self.norm * (1 + np.abs(self.share)) + np.linalg.norm(decoded, axis=1))

    def reach(self, rough: np.ndarray, length: float, floor: float) -> np.ndarray:
        """Places of the rows whose exact score with a query of this length may be `floor` or more."""
        if floor == -np.inf:
            return np.arange(len(rough))
        apart = np.sqrt(np.maximum(length**2 - (max(floor, 0.0) / self.norm) ** 2, 0.0))
        return np.flatnonzero(~(rough < self.share * floor - self.across * apart - self.slack * length))

    def near(self, single: np.ndarray, places: np.ndarray, length: float, floor: float) -> np.ndarray:
        """Those of the places whose score in single precision doesn't rule `floor` out."""
        return places[~(single < floor - self.slack[places] * length)]


class Block:
    """Rows that queries are searched in: coded once, whatever the number of queries.

    Of equal vectors only the top + 1 with the smallest ids can be in any answer, so the others are left out.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, quantiser: Quantiser, top: int) -> None:
        order = np.lexsort((ids, *rows.T[::-1]))
        ids, rows = ids[order], rows[order]
        new = np.append(True, (rows[1:] != rows[:-1]).any(1))
        nth = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        self.ids, rows = ids[nth <= top], rows[nth <= top]
        self.quantiser, self.top = quantiser, top
        packed = quantiser.packed(rows)
        self.codes = np.ascontiguousarray(packed.T)
        self.single, self.rows = rows.astype(np.float32), rows.astype(np.float64)
        self.bounds = Bounds(self.rows, quantiser.decoded(packed, rows.shape[1]).astype(np.float64))

    def best(self, query_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best `top` rows, the same as by scoring all of them.

        The exact scores of the RERANK + top rows with the largest table scores give a floor that the best
        rows reach; every row that may reach it by its table score and error bound is scored exactly.
        """
        ids, top, keep = self.ids, self.top, min(RERANK + self.top, len(self.ids))
        lut = self.quantiser.tables(query)
        rough = lut[0].take(self.codes[0])
        for j in range(1, len(self.codes)):
            rough += lut[j].take(self.codes[j])
        q, rounded = query.astype(np.float64), query.astype(np.float32)
        length, floor = float(np.linalg.norm(q)), -np.inf
        first = np.argpartition(-rough, keep - 1)[:keep]
        first = first[ids[first] != query_id]
        if len(first) >= top:
            floor = float(np.partition(exact(self.rows[first], q), -top)[-top])
        near = self.bounds.reach(rough, length, floor)
        if len(near) > keep:
            # gathering a large share of the rows costs more than multiplying all
            product = (self.single @ rounded)[near] if 8 * len(near) > len(ids) else self.single[near] @ rounded
            near = self.bounds.near(product, near, length, floor)
        near = near[ids[near] != query_id]
        score = exact(self.rows[near], q)
        order = np.lexsort((ids[near], -score))[:top]
        return ids[near][order], score[order]


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    vectors = batch.column(3)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return batch.column(2).to_numpy(zero_copy_only=False), flat.reshape(batch.num_rows, -1)


def _scan(batches: Iterator[pa.RecordBatch], quantiser: Quantiser, top: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score): of each group the best `top` rows for each of its queries.

    Batches are (grp, asks, vec_id, embedding), sorted by the first two: a group's rows come first and are
    held as one block, then its queries stream by.
    """
    group, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
        cuts = (np.flatnonzero(np.diff(keys)) + 1).tolist()
        for start, end in itertools.pairwise([0, *cuts, batch.num_rows]):
            own, asks = divmod(int(keys[start]), 2)
            if own != group:
                group, held, block = own, [], None
            ids, x = _matrix(batch.slice(start, end - start))
            if not asks:
                held.append((ids, x))
                continue
            if block is None:
                if not held:
                    continue
                block = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), quantiser, top)
                held = []
            found = [block.best(i, q) for i, q in zip(ids.tolist(), x, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(ids, [len(f[0]) for f in found])),
                    pa.array(np.concatenate([f[0] for f in found])),
                    pa.array(np.concatenate([f[1] for f in found])),
                ],
                names=["query_id", "vec_id", "score"],
            )


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: an id, and a vector of finite components that aren't all zero."""
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & whole & F.exists(v, lambda x: x != 0)
    )


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the `top` rows of largest inner product, but itself.

    vectors and queries are (vec_id, embedding). Nulls, zero vectors and vectors with null or non-finite
    components take no part, nor do those whose length isn't that of most rows. Of query rows with one id the
    smallest vector is asked for. Fewer rows than `top` give
    all of them; equal scores go by vec_id; copies of a vector are candidates each. Without rows or
    queries the result is empty. Further columns are ignored.

    Codebooks are fitted on at most MAX_TRAIN rows; every row is coded and scanned, and every row whose table
    score and error bound allow it to be among the best is scored exactly, so none is missed. Rows are dealt to
    groups of at most about BLOCK_ROWS by their place in a kept table, so that neither copies nor repeated ids
    crowd one. Each row goes to one group and is coded once; queries go to all groups, through a shuffle and
    not the driver, and stream past the group's rows. Groups hand on their best `top` per query, scored exactly.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    rows = scratch.keep(usable(vectors).withColumn("place", F.monotonically_increasing_id()), "rows")
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == lengths["d"])
    sample = smallest_hashes(rows, "vec_id", 9, MAX_TRAIN).select("embedding").collect()
    quantiser = spark.sparkContext.broadcast(train(np.array([r[0] for r in sample], np.float64)))
    most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // lengths["d"]))
    spread = min(shuffle_partitions(spark), -(-lengths["n"] // LEAST_ROWS))
    groups = max(-(-lengths["n"] // most), spread)
    asked = usable(queries).where(F.size("embedding") == lengths["d"])
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    own = F.pmod(F.xxhash64("place"), F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = rows.select(own.alias("grp"), F.lit(0).alias("asks"), "vec_id", "embedding").unionByName(
        asked.select(every.alias("grp"), F.lit(1).alias("asks"), "vec_id", "embedding")
    )
    dealt = dealt.repartition(max(groups, shuffle_partitions(spark)), "grp").sortWithinPartitions("grp", "asks")
    found = dealt.mapInArrow(lambda b: _scan(b, quantiser.value, top), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op9_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
