"""Every registered catalogue query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

from larkspur.functions import keys
from larkspur.operators import catalog, raster
from larkspur.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def normal(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(normal(r[n]) for n in names) for r in df.collect()), key=repr)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    want = sorted((tuple(normal(r[columns.index(n)]) for n in names) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_uuid5_is_python_s(spark):
    import uuid

    from pyspark.sql import functions as F

    names = ["tpch/en/BS/4/102/", "ゲーム/ja/SV2a", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(keys.uuid5(F.col("n"))).collect()
    assert [r[0] for r in rows] == [str(uuid.uuid5(keys.NAMESPACE, n)) for n in names]


def test_largest_blob_joins_diagonals():
    bright = np.zeros((2, 4, 4), bool)
    bright[0, [0, 1, 2], [0, 1, 2]] = True
    bright[0, 3, 0] = True
    assert raster.largest_blob(bright).tolist() == [3, 0]


@pytest.mark.parametrize("limit, offset", [(0, 0), (101, 0), (1, -1), (1, 1_000_001)])
def test_bounds_are_checked_first(limit, offset):
    with pytest.raises(ValueError):
        catalog.search(None, limit, offset)
