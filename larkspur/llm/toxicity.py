"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import smallest_hashes, table, text_batches
from larkspur.llm.tokenizing import tidy

#: Orders of the character n-grams.
ORDERS = (3, 4, 5)
#: n-grams are hashed into 2 ** BITS features.
BITS = 18
#: At most so many labelled rows of class 0 and of class 1 are fitted, those with the smallest hashes of their ids.
MAX_ROWS = (4000, 2000)
#: Texts are hashed in overlapping stretches of this many characters.
CHUNK = 1 << 20
FOLDS = 5
#: Fitted rows whose numbers are held at a time.
BLOCK = 64
EPOCHS = 40
SMOOTHING = 1.0
L2 = 2e-3


def features(text: str | None) -> np.ndarray:
    """The distinct hashed n-grams of the whole text, ASCII letters in lower case, ascending."""
    seen = np.zeros(1 << BITS, bool)
    text = text or ""
    reach = max(ORDERS) - 1
    for at in range(0, max(1, len(text)), CHUNK):
        part = " " * (at == 0) + text[at : at + CHUNK + reach] + " " * (at + CHUNK + reach >= len(text))
        codes = np.frombuffer(part.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint64(32), codes)
        for n in ORDERS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += codes[k : len(codes) - n + 1 + k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            seen[h >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class Model:
    """weights already hold the log-count ratios: a score is the logistic of bias + their sum."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _packed(index: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows' ascending n-grams in half of the memory: their low 16 bits, and by row how many have the same bits above those."""
    bounds = np.arange((1 << max(0, BITS - 16)) + 1) << 16
    return np.concatenate(index).astype(np.uint16), np.concatenate([np.diff(np.searchsorted(x, bounds)) for x in index])


def _unpacked(low: np.ndarray, counts: np.ndarray) -> np.ndarray:
    high = np.tile(np.arange(1 << max(0, BITS - 16), dtype=np.int32) << 16, len(counts) >> max(0, BITS - 16))
    return low.astype(np.int32) + np.repeat(high, counts)


def fit(rows: list[tuple[str | None, int]], prior: float) -> Model:
    """Fits the ratios and a logistic regression on them; prior is the labelled share of class 1.

    Without a row of one of the classes, every score is that of the class there is (0 without any).
    """
    y = np.array([r[1] for r in rows], np.float64)
    if not len(rows) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), 30.0 if len(rows) and y[0] == 1 else -30.0)
    size = 1 << BITS
    pos, neg = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    blocks = []  # first and last row, their packed n-grams one row after the other, and where each row's begin and end
    for a in range(0, len(rows), BLOCK):
        index = [features(r[0]) for r in rows[a : a + BLOCK]]
        blocks.append((a, a + len(index), _packed(index), ends := np.cumsum([0, *map(len, index)])))
        own = np.concatenate(index)
        label = np.repeat(y[a : a + len(index)], np.diff(ends))
        pos += np.bincount(own, label, minlength=size)
        neg += np.bincount(own, 1 - label, minlength=size)
    del index, own, label
    ratio = np.log((pos / (y.sum() + 2 * SMOOTHING)) / (neg / ((1 - y).sum() + 2 * SMOOTHING)))
    w, b0 = np.full(size, 0.1), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    row_weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for t in range(1, EPOCHS + 1):  # full-batch Adam: the same result however the rows are dealt to tasks
        g, g_bias, scaled = np.zeros(size), 0.0, w * ratio
        for a, b, packed, ends in blocks:  # so that only a block's n-grams have numbers beside their places
            own = _unpacked(*packed)
            sums = np.append(0.0, np.cumsum(scaled[own]))
            z = sums[ends[1:]] - sums[ends[:-1]]
            g_row = (1 / (1 + np.exp(-np.clip(z + b0, -60, 60))) - y[a:b]) * row_weight[a:b]
            g += np.bincount(own, np.repeat(g_row, np.diff(ends)), minlength=size)
            g_bias += g_row.sum()
        g = np.append(g * ratio + L2 * w, g_bias)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b0 -= step[-1]
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    return Model((w * ratio).astype(np.float32), b0 + float(np.log(prior / (1 - prior))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


@tidy
def _fit_task(batches: Iterator[pa.RecordBatch], prior: float) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
    model = fit(sorted(rows, key=lambda r: (r[1], r[0] or "")), prior)
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.weights.astype("<f4").tobytes()]), pa.array([model.bias])], names=["weights", "bias"]
    )


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns `labels.toxic` (0 or 1; other values and nulls are no labels) from texts outside the held-out fold.

    A document labelled more than once is toxic if any of its labels says so. The rows that are fitted are
    chosen by a hash of their id, at most MAX_ROWS of the classes, so a model is of fixed size
    and is fitted in one task whose input is bounded. doc_id, lang and source are no features.
    """
    spark = docs.sparkSession
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = known.limit(0)
    for value in (0, 1):
        chosen = chosen.union(smallest_hashes(known.where(F.col("toxic") == value), "doc_id", 10, MAX_ROWS[value]))
    picked = spark.createDataFrame(chosen.collect(), chosen.schema)  # at most sum(MAX_ROWS) ids
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    fitted = rows.repartition(1).mapInArrow(lambda b: _fit_task(b, prior), "weights binary, bias double").collect()
    if not fitted:
        return fit([], prior)
    return Model(np.frombuffer(fitted[0]["weights"], "<f4"), fitted[0]["bias"])


@tidy
def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            scores = np.array([model.score(t) for t in part.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))],
                names=[*part.schema.names[: len(part.columns)], "toxic_score", "toxic_predicted"],
            )


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `toxic_score` (0 to 1) and `toxic_predicted` (1 from 0.5 on) of each row's whole text.

    Empty and null texts get the score of the model's bias. Rows are scored each on its own; other columns
    pass through, and earlier columns of these two names are replaced. An empty table stays empty.
    """
    text_batches(docs.sparkSession)
    rows = docs.drop("toxic_score", "toxic_predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS floats, whatever the corpus
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lambda b: _score(b, shared.value), f"{schema}, toxic_score double, toxic_predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return toxicity_scores(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.col("toxic_predicted").alias("predicted"),
    )
