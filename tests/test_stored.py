"""Stored tables against dictionaries, replays and runs against loops."""

from __future__ import annotations

import glob
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators import stored, workflow

SHAPE = "id long, name string, rarity string, at string"


def table(spark, rows, path, per_file=10):
    return stored.create(str(path), spark.createDataFrame(rows, SHAPE), ["id"], per_file)


def content(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def data(path):
    return {f: open(f, "rb").read() for f in glob.glob(f"{path}/data/*/part-*")}


def test_merges_are_those_of_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    rows = {i: (i, f"n{i}", "r", "old") for i in range(100)}
    t = table(spark, list(rows.values()), tmp_path)
    for step in range(3):
        change = {rng.randrange(140): rng.choice(["x", None]) for _ in range(12)}
        source = spark.createDataFrame([(k, f"s{step}", v) for k, v in change.items()], "id long, name string, rarity string")
        t = stored.merge(t, source, ["id"], ["rarity"], {"at": F.lit(f"v{step}")})
        for k, v in change.items():
            rows[k] = (k, rows[k][1], v, f"v{step}") if k in rows else (k, f"s{step}", v, f"v{step}")
        assert content(t.rows()) == sorted(rows.values(), key=repr)
    assert t.version == 4


def test_untouched_files_stay(spark, tmp_path):
    t = table(spark, [(i, f"n{i}", "r", "old") for i in range(100)], tmp_path)
    before = data(tmp_path)
    assert len(t.files) == 10 and sum(f["rows"] for f in t.files) == 100
    new = stored.merge(t, spark.createDataFrame([(34, "new")], "id long, name string"), ["id"], ["name"])
    kept = {f["file"] for f in t.files} & {f["file"] for f in new.files}
    touched = {f["file"] for f in t.files if f["least"] <= 34 <= f["largest"]}
    assert len(touched) == 1 and kept == {f["file"] for f in t.files} - touched
    after = data(tmp_path)
    assert {f: after[f] for f in before} == before  # old files are all as they were, for readers of the old version
    assert content(stored.Stored(spark, str(tmp_path), 1).rows()) == content(t.rows())
    assert ("new",) in {(r["name"],) for r in new.rows().where("id = 34").collect()}


def test_an_insert_touches_nothing(spark, tmp_path):
    t = table(spark, [(i, "n", "r", "old") for i in range(50)], tmp_path)
    new = stored.merge(t, spark.createDataFrame([(77, "in")], "id long, name string"), ["id"], ["name"])
    assert {f["file"] for f in t.files} < {f["file"] for f in new.files} and new.rows().count() == 51
    same = stored.merge(new, spark.createDataFrame([], "id long, name string"), ["id"], ["name"])
    assert same.files == new.files


def test_keys_of_a_source_come_once_and_writers_in_turn(spark, tmp_path):
    t = table(spark, [(1, "n", "r", "old")], tmp_path)
    one = spark.createDataFrame([(1, "a")], "id long, name string")
    with pytest.raises(ValueError, match="more than once"):
        stored.merge(t, one.union(one), ["id"], ["name"])
    stored.merge(t, one, ["id"], ["name"])
    with pytest.raises(stored.Conflict):
        stored.merge(t, one, ["id"], ["name"])
    with pytest.raises(ValueError, match="version 9"):
        stored.Stored(spark, str(tmp_path), 9)
    with pytest.raises(ValueError, match="no version"):
        stored.Stored(spark, f"{tmp_path}/none")


def test_null_keys_and_many_files(spark, tmp_path):
    rows = [(None, "none", "r", "old"), *((i, f"n{i}", "r", "old") for i in range(30))]
    t = table(spark, rows, tmp_path)
    new = stored.merge(t, spark.createDataFrame([(None, "some"), (3, "three")], "id long, name string"), ["id"], ["name"])
    assert {(r["id"], r["name"]) for r in new.rows().collect()} == {(None, "some"), (3, "three"), *((i, f"n{i}") for i in range(30) if i != 3)}


def test_prefixes_reach_the_scan(spark, tmp_path):
    keys = [f"{i}" for i in range(1, 200)]
    t = stored.create(str(tmp_path), spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "number_key string, id long"), ["number_key", "id"], 20)
    found = t.starting_with("4")
    assert sorted(r["number_key"] for r in found.collect()) == sorted(k for k in keys if k.startswith("4"))
    assert "StringStartsWith(number_key,4)" in found._jdf.queryExecution().toString() or "PushedFilters: [IsNotNull(number_key), StringStartsWith" in found._jdf.queryExecution().toString()
    assert 0 < len(found.inputFiles()) < len(t.files) / 2
    assert t.starting_with("zz").collect() == [] and t.starting_with("199").count() == 1


def test_retakes_clear_what_was_derived(spark, tmp_path):
    columns = ["analysis_id", "side", *stored.RETAKEN, *stored.DERIVED]
    old = spark.createDataFrame([(i, s, *("x" * 11)) for i in range(4) for s in ("front", "back")], "analysis_id long, " + ", ".join(f"{c} string" for c in columns[1:]))
    t = stored.create(str(tmp_path), old, ["analysis_id", "side"])
    again = spark.createDataFrame([(2, "back", *"abcd")], "analysis_id long, side string, " + ", ".join(f"{c} string" for c in stored.RETAKEN))
    for r in stored.retake(t, again).rows().collect():
        new = (r["analysis_id"], r["side"]) == (2, "back")
        assert tuple(r[c] for c in stored.RETAKEN) == (tuple("abcd") if new else ("x",) * 4)
        assert all((r[c] is None) == new for c in stored.DERIVED)


# -- replays and runs


def replayed(rows, start="created"):
    out = {}
    for key, _, _, target in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or datetime.min, r[2])):
        status, applied, n = out.get(key, (start, 0, 0))
        if status in workflow.FORWARD and target in (workflow.FORWARD[status], "failed"):
            status, applied = target, applied + 1
        out[key] = (status, applied, n + 1)
    return out


def test_replay_is_a_loop(spark):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    targets = [*workflow.FORWARD.values(), *workflow.FORWARD.values(), "created", "failed", "nothing", None]
    clients = [1, 1, 1, 2, 3, None, 4]
    rows = [(rng.choice(clients), start + timedelta(seconds=rng.randrange(500)), i, rng.choice(targets[:-3] if i % 9 else targets)) for i in range(4000)]
    rows += [(5, None, 5000, "uploading"), (5, start, 5001, "uploaded"), (6, start, 5002, "failed"), (6, start, 5003, "uploading")]
    frame = spark.createDataFrame(rows, "analysis_id long, ts timestamp, event_id long, target string").repartition(7)
    got = {r["analysis_id"]: (r["status"], r["applied"], r["requests"]) for r in workflow.replay(frame).collect()}
    assert got == replayed(rows)
    assert workflow.replay(frame.where("false")).collect() == []
    runs = workflow.compositions(frame).where("analysis_id = 1").collect()
    assert 1 < len(runs) <= 4 and all(len(r["to"]) == 9 for r in runs)  # a client with most requests is several tasks' work


def test_runs_claim_what_is_uploaded(spark):
    analyses = spark.createDataFrame([(1, "uploaded"), (2, "uploaded"), (3, "uploaded"), (4, "created"), (5, "identifying"), (6, None)], "id long, status string")
    images = spark.createDataFrame([(1, "good"), (1, "poor"), (2, "good"), (2, "unusable"), (4, "unusable")], "analysis_id long, status string")
    versions = spark.createDataFrame([("a-v1.0.0", 1), ("a-v1.1.0", 2)], "version string, ordinal long")
    got = {tuple(r) for r in workflow.run(analyses, images, versions, "0.9", F.lit(7)).select("id", "status", "application_version", "card_database_version", "verdict", "completed_at").collect()}
    assert got == {
        (1, "awaiting_confirmation", "0.9", "a-v1.1.0", "poor", None),
        (2, "failed", "0.9", "a-v1.1.0", "unusable", 7),
        (3, "awaiting_confirmation", "0.9", "a-v1.1.0", "good", None),
        (4, "created", None, None, None, None),
        (5, "identifying", None, None, None, None),
        (6, None, None, None, None, None),
    }
    empty = workflow.run(analyses, images, versions.where("false"), "0.9", F.lit(7)).where("id = 1").first()
    assert empty["card_database_version"] is None and empty["application_version"] == "0.9"
