"""Connected components of a link table by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch

ROUNDS = 200
#: A node with more than a HUB-th of all rows is a hub, so there are fewer than HUB of them.
HUB = 400
#: Links that a task holds and contracts at once; a table of no more than that is settled by one such task.
CHUNK = 1 << 17


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) of what the links (a, b) join; the smallest ones have no row."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)  # of the roots that a link joins, the larger is hung on the smaller
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    hung = label != np.arange(len(nodes))
    return nodes[hung], nodes[label[hung]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) as stars, CHUNK of them at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        u, v = stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            part = batch.slice(start, CHUNK)
            if count and count + part.num_rows > CHUNK:
                yield flush()
                count = 0
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in part.columns))
            count += part.num_rows
    if held:
        yield flush()


def _with_minima(rows: DataFrame, low: DataFrame, limit: int) -> DataFrame:
    """rows (u, v) with the minimum m of their u from low (u, n, m).

    Hubs have more than limit rows, which a join would bring to one task: their minima are put where the rows are.
    """
    hubs = low.where(F.col("n") > limit).select("u", "m").collect()  # fewer than HUB
    plain = low.select("u", "m")
    if not hubs:
        return rows.join(plain, "u")
    minima = F.create_map(*[F.lit(x) for r in hubs for x in (r["u"], r["m"])])
    is_hub = F.col("u").isin([r["u"] for r in hubs])
    return rows.where(~is_hub).join(plain.where(~is_hub), "u").unionByName(rows.where(is_hub).withColumn("m", minima[F.col("u")]))


def _kept(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, tuple]:
    """The edges written, and their count and checksum, taken on the way."""
    seen = Observation()
    edges = scratch.keep(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 2**31).alias("x")), name)
    return edges, (seen.get["n"], seen.get["x"])


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component) of each node with a link: component is the smallest node it reaches.

    links is (a, b) of longs in any direction, repeats and loops allowed. Tasks first contract what they have
    of them to stars, CHUNK links at a time; where no more than CHUNK are left, one more such task settles them, and
    rounds over all tasks do so beyond. Each round hangs every node on the
    smallest one it knows, first its larger neighbours, then its smaller ones, until nothing moves;
    rounds grow as the logarithm of the longest path, and more than ROUNDS of them are an error. A node
    with many links is never gathered: minima are taken by partial aggregation, and rows of the few hubs
    aren't dealt out by them.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").mapInArrow(_contract, "u long, v long")
    (edges, state), before = _kept(edges, scratch, f"{label}-0"), None
    if 0 < state[0] <= CHUNK:
        edges = scratch.keep(edges.coalesce(1).mapInArrow(_contract, "u long, v long"), f"{label}-1")
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for round_ in range(1, ROUNDS):
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, limit = state, max(64, 2 * state[0] // HUB)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
        low = low.select("u", "n", F.least("u", "m").alias("m"))
        large = _with_minima(both.where("v > u"), low, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, state = _kept(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), scratch, f"{label}-{round_}")
        if round_ > 1:
            scratch.drop(f"{label}-{round_ - 2}")
    raise RuntimeError(f"components haven't settled after {ROUNDS} rounds")
