"""Queries over tables larger, or with larger keys, than those of the other tests."""

from __future__ import annotations

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.operators import maps, outlines, regions, tiles
from larkspur.plans import registry
from larkspur.sources import views

#: Most bytes of a batch that a photograph's function may give for any number of rows.
MOST = 8 << 20


def shifted(spark, sf_dir, folder, name, key, *offsets):
    """A copy of a table for each offset of its key, in a folder of its own."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    copies = table.withColumn("by", F.explode(F.array(*map(F.lit, offsets))))
    copies.withColumn(key, (F.col(key) + F.col("by")).cast(table.schema[key].dataType)).drop("by").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["f_search_links"])
def test_offsets_of_large_keys_are_those_of_the_sql(spark, sf_dir, tmp_path, name):
    folder = shifted(spark, sf_dir, tmp_path, "part", "p_partkey", 0, 999_900, 1_180_000)
    df = registry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{folder}/part.parquet/*.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = [tuple(r[columns.index(c)] for c in df.columns) for r in cur.fetchall()]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


@pytest.fixture
def functions(spark, monkeypatch):
    """What is given to mapInArrow from now on."""
    frame, found = type(spark.range(1)), []
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, *more, **named: (found.append(f), real(df, f, *more, **named))[1])
    return found


def test_photographs_are_drawn_in_small_batches(spark, sf_dir, functions):
    views.card_photos(spark, sf_dir)
    quads = views.quads(spark, sf_dir).toArrow().to_batches()[0]
    many = pa.Table.from_batches([quads] * 8).combine_chunks().to_batches()[0]
    drawn = list(functions[0](iter([many])))
    assert sum(b.num_rows for b in drawn) == 125 * many.num_rows
    assert max(b.nbytes for b in drawn) <= MOST


def test_tiles_come_in_small_batches(spark, sf_dir):
    rows = views.card_photos(spark, sf_dir).where("image < 250 and y % 25 = 0")
    copies = rows.withColumn("image", F.explode(F.array(*((F.col("image") + 1000 * k) for k in range(8)))))
    found = tiles.filtered(tiles.filtered(tiles.from_rows(copies, 48), 0, lambda w: w.pixels, 48), 0, lambda w: w.pixels, 48)
    seen = found.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    assert sum(r["n"] for r in seen) == 8000
    assert max(r["n"] for r in seen) <= 1024


def test_curves_of_many_images_take_little_memory(spark, sf_dir, functions):
    maps.equalised(tiles.from_rows(views.card_photos(spark, sf_dir), 48), 48)
    made = functions[-2]
    images, each = 400, 64 * 32
    fields = [pa.array(np.tile(a, images)) for a in (np.repeat(np.arange(64), 32), np.tile(np.arange(32) * 8, 64), np.full(each, 8))]
    counts = pa.ListArray.from_arrays(pa.array(np.arange(images + 1, dtype=np.int32) * each), pa.StructArray.from_arrays(fields, ["cell", "level", "n"]))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(images)), counts, pa.array(np.full(images, 256))], ["image", "counts", "of"])
    tracemalloc.start()
    n = sum(b.num_rows for b in made(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == images
    assert most <= 4 * MOST


def many_tiles(n, side=64):
    px = [np.full((side, side), 250 + k % 6, np.uint8).tobytes() for k in range(6)]
    ints = [pa.array([v] * n, pa.int32()) for v in (side, side, 0, 0)]
    return pa.RecordBatch.from_arrays([pa.array(range(n)), *ints, pa.array([px[k % 6] for k in range(n)], pa.binary())], [*tiles.TILE, "pixels"])


def test_regions_of_many_photographs_come_in_small_batches(spark, sf_dir, functions):
    photos = tiles.from_rows(views.card_photos(spark, sf_dir), 48)
    regions.label_tiles(photos, lambda px: px >= 250, 64)
    found = list(functions[-1](iter([many_tiles(2000)])))
    assert [len(s) for b in found for s in b.column(6).to_pylist()] == [1] * 2000
    assert max(b.nbytes for b in found) <= MOST


def test_chains_of_many_photographs_come_in_small_batches(spark, sf_dir, functions):
    outlines.tile_chains(tiles.from_rows(views.card_photos(spark, sf_dir), 48), 64)
    sent, chained = functions[-2:]
    strips = list(sent(iter([many_tiles(4000)])))
    assert max(b.nbytes for b in strips) <= MOST
    whole = pa.Table.from_batches(strips).combine_chunks()
    parts = pa.StructArray.from_arrays([whole[c].chunk(0) for c in ("dy", "dx", "px")], ["dy", "dx", "px"])
    each = pa.ListArray.from_arrays(pa.array(np.arange(whole.num_rows + 1, dtype=np.int32)), parts)
    grouped = pa.RecordBatch.from_arrays([*(whole[c].chunk(0) for c in tiles.TILE), each], [*tiles.TILE, "strips"])
    found = list(chained(iter([grouped])))
    assert sum(b.num_rows for b in found) == 4000
    assert max(b.nbytes for b in found) <= MOST
