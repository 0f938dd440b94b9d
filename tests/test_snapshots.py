"""Snapshots: equal bytes for equal rows, versions that appear whole or not at all, and every fault with its place."""

from __future__ import annotations

import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from larkspur.operators import snapshot

SETS = [("tpch", "en", f"S{i}", f"Set {i}", None if i % 2 else "2024-01-0%d" % (i % 9 + 1)) for i in range(7)]
CARDS = [
    ("tpch", "en", f"S{i % 7}", f"{i:03d}/050", f"Name {i} ゲ", None if i % 3 else "Rare", None if i % 4 else "promo", [("feed", f"f{i}"), ("byhand", "x")][: i % 3])
    for i in range(53)
]
SET_SHAPE = "game string, language string, set_code string, name string, release_date string"
CARD_SHAPE = SET_SHAPE.replace("name string, release_date", "card_number string, name string, rarity") + ", variant string, external_ids array<struct<provider:string,external_id:string>>"


def frames(spark, cards=CARDS, parts=3):
    return spark.createDataFrame(SETS, SET_SHAPE).repartition(parts), spark.createDataFrame(cards, CARD_SHAPE).repartition(parts)


def record_bytes(path):
    return [open(f, "rb").read() for f in sorted(glob.glob(f"{path}/records/*/*/file=*/part-*"), key=lambda f: (f.split("/")[-3], int(f.split("file=")[1].split("/")[0])))]


def test_equal_rows_give_equal_bytes(spark, tmp_path):
    a = snapshot.write_snapshot(f"{tmp_path}/a", "cards-v1.0.0", *frames(spark, parts=3), rows_per_file=10)
    b = snapshot.write_snapshot(f"{tmp_path}/b", "cards-v1.0.0", *frames(spark, CARDS[::-1], 5), rows_per_file=10)
    assert a == b and record_bytes(f"{tmp_path}/a") == record_bytes(f"{tmp_path}/b")
    files = record_bytes(f"{tmp_path}/a")
    assert len(files) == 6 + 1 and [f.count(b"\n") for f in files[:6]] == [10] * 5 + [3]
    ordered = files[6:] + files[:6]  # sets, then cards
    want = hashlib.sha256("".join(hashlib.sha256(f).hexdigest() for f in ordered).encode()).hexdigest()
    assert a["metadata"][snapshot.DIGEST] == f"sha256:{want}"
    assert (a["set_count"], a["card_count"], a["external_id_count"]) == (7, 53, sum(len(c[7]) for c in CARDS))


def test_versions_are_read_as_they_were_published(spark, tmp_path):
    path = str(tmp_path)
    snapshot.write_snapshot(path, "cards-v1.0.0", *frames(spark))
    pinned = snapshot.read_snapshot(spark, path, "cards-v1.0.0")[1]
    snapshot.write_snapshot(path, "cards-v1.1.0", *frames(spark, CARDS[:20]))
    assert pinned.count() == 53 and snapshot.read_snapshot(spark, path)[1].count() == 20
    assert snapshot.read_snapshot(spark, path, "cards-v1.0.0")[1].count() == 53
    with pytest.raises(ValueError, match="no manifest of cards-v9.0.0"):
        snapshot.read_snapshot(spark, path, "cards-v9.0.0")
    got = {(r["set_code"], r["card_number"], r["name"], r["rarity"], r["variant"], tuple(sorted((e[0], e[1]) for e in r["external_ids"]))) for r in pinned.collect()}
    assert got == {(c[2], c[3], c[4], c[5], c[6], tuple(sorted(c[7]))) for c in CARDS}


def test_a_version_is_published_once(spark, tmp_path):
    path = str(tmp_path)
    first = snapshot.write_snapshot(path, "cards-v1.0.0", *frames(spark))
    assert snapshot.write_snapshot(path, "cards-v1.0.0", *frames(spark, parts=2)) == first
    assert snapshot.manifests(spark, path) == [1] and len(os.listdir(f"{path}/records")) == 1
    with pytest.raises(ValueError, match="other records"):
        snapshot.write_snapshot(path, "cards-v1.0.0", *frames(spark, CARDS[:5]))
    assert snapshot.read_snapshot(spark, path)[1].count() == 53


def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    snapshot.write_snapshot(path, "cards-v1.0.0", *frames(spark))
    written = snapshot.write_lines

    def dies(lines, folder, rows):
        if folder.endswith("cards"):
            raise OSError("lost")
        written(lines, folder, rows)

    monkeypatch.setattr(snapshot, "write_lines", dies)
    with pytest.raises(OSError, match="lost"):
        snapshot.write_snapshot(path, "cards-v2.0.0", *frames(spark, CARDS[:5]))
    sets, cards, manifest = snapshot.read_snapshot(spark, path)
    assert manifest.first()["version"] == "cards-v1.0.0" and cards.count() == 53


def test_two_writers_take_two_places(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    snapshot.write_snapshot(path, "cards-v1.0.0", *frames(spark))
    listed, calls = snapshot.manifests, []

    def late(session, where):  # another writer publishes between listing and renaming
        out = listed(session, where)
        if not calls:
            calls.append(1)
            snapshot.write_snapshot(path, "cards-v1.1.0", *frames(spark, CARDS[:9]))
        return out

    monkeypatch.setattr(snapshot, "manifests", late)
    snapshot.write_snapshot(path, "cards-v1.2.0", *frames(spark, CARDS[:3]))
    monkeypatch.undo()
    assert snapshot.manifests(spark, path) == [1, 2, 3]
    assert [snapshot.read_snapshot(spark, path, f"cards-v1.{i}.0")[1].count() for i in range(3)] == [53, 9, 3]


def test_changed_records_are_refused(spark, tmp_path):
    path = str(tmp_path)
    snapshot.write_snapshot(path, "cards-v1.0.0", *frames(spark))
    file = glob.glob(f"{path}/records/*/cards/file=0/part-*")[0]
    text = open(file).read()
    os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    open(file, "w").write(text.replace("Name 1", "Name X", 1))
    with pytest.raises(ValueError, match="manifest"):
        snapshot.read_snapshot(spark, path)


def test_an_empty_catalogue(spark, tmp_path):
    sets, cards = frames(spark)
    told = snapshot.write_snapshot(str(tmp_path), "cards-v1.0.0", sets.where("false"), cards.where("false"))
    assert (told["set_count"], told["card_count"], told["external_id_count"]) == (0, 0, 0)


BASE = {"game": "tpch", "language": "en", "set_code": "BS", "name": "Base Set"}
CARD = {"set": "tpch/en/BS", "card_number": "4/102", "name": "Large"}


def faults(spark, tmp_path, sets, cards):
    for name, value in (("sets.json", sets), ("cards.json", cards)):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
    found = snapshot.read_records(spark, f"{tmp_path}/sets.json", f"{tmp_path}/cards.json")
    return found[0].collect(), found[1].collect(), sorted(tuple(r) for r in found[2].collect())


def test_good_arrays_have_no_fault(spark, tmp_path):
    cards = [CARD | {"variant": "promo", "metadata": {"a": [1]}, "external_ids": [{"provider": "feed", "external_id": "7"}]}, CARD | {"rarity": None}]
    sets, got, found = faults(spark, tmp_path, [BASE | {"release_date": "1999-01-09"}], cards)
    assert found == [] and len(sets) == 1 and sets[0]["release_date"] == "1999-01-09"
    assert sorted((r["variant"], r["metadata"], len(r["external_ids"])) for r in got if r["variant"]) == [("promo", '{"a":[1]}', 1)]
    want = hashlib.sha256((tmp_path / "sets.json").read_bytes() + (tmp_path / "cards.json").read_bytes()).hexdigest()
    assert snapshot.array_digest(spark, str(tmp_path)) == f"sha256:{want}"


def test_each_fault_of_a_set_has_its_place(spark, tmp_path):
    bad = [
        BASE,
        {k: v for k, v in BASE.items() if k != "name"},
        BASE | {"set_code": "B2", "language": "english"},
        BASE | {"set_code": "B3", "release_date": "1999-02-30"},
        BASE | {"set_code": "B4", "release_date": 1999},
        BASE | {"set_code": "B5", "metadata": []},
        7,
        BASE,
        BASE | {"set_code": 8},
        BASE | {"set_code": " B6", "game": "No Slug"},
    ]
    sets, _, found = faults(spark, tmp_path, bad, [])
    assert [(p, f) for _, p, f in found] == [
        (1, "missing required field 'name'"),
        (1, "tpch/en/BS is defined twice"),
        (2, "language must be an ISO 639-1 code"),
        (3, "release_date is not an ISO date"),
        (4, "release_date must be an ISO date string"),
        (5, "metadata must be an object"),
        (6, "must be a JSON object"),
        (7, "tpch/en/BS is defined twice"),
        (8, "set_code must be a string"),
        (9, "game must be a lowercase slug"),
        (9, f"set_code must be {snapshot.IDENTIFIER}"),
    ]
    assert {f for f, _, _ in found} == {"sets.json"} and len(sets) == 1


def test_each_fault_of_a_card_has_its_place(spark, tmp_path):
    bad = [
        CARD,
        dict(CARD),
        CARD | {"set": "tpch/en/NOPE"},
        {k: v for k, v in CARD.items() if k != "set"},
        CARD | {"card_number": None},
        CARD | {"card_number": "5", "external_ids": [3, {"provider": "feed"}, {"provider": "Feed", "external_id": "1", "metadata": 2}]},
        CARD | {"card_number": "6", "external_ids": "x"},
        CARD | {"card_number": "7", "rarity": 5, "name": ""},
        "text",
    ]
    _, cards, found = faults(spark, tmp_path, [BASE], bad)
    assert [(p, f) for _, p, f in found] == [
        (1, "tpch/en/BS 4/102 (no variant) appears twice"),
        (2, "no set 'tpch/en/NOPE'"),
        (3, "missing required field 'set'"),
        (4, "card_number must be a string"),
        (5, "external_ids[0]: must be a JSON object"),
        (5, "external_ids[1]: missing required field 'external_id'"),
        (5, "external_ids[2]: metadata must be an object"),
        (5, "external_ids[2]: provider must be a lowercase slug"),
        (6, "external_ids must be an array"),
        (7, f"name must be {snapshot.IDENTIFIER}"),
        (7, "rarity must be a string"),
        (8, "must be a JSON object"),
    ]
    assert len(cards) == 1


@pytest.mark.parametrize("text", ['[{"game"', "[1,]", "no json"])
def test_files_that_are_not_json(spark, tmp_path, text):
    assert [f[2] for f in faults(spark, tmp_path, text, [])[2]] == ["is not JSON"]


def test_a_missing_file_is_named(spark, tmp_path):
    with pytest.raises(ValueError, match="sets.json isn't there"):
        snapshot.read_records(spark, f"{tmp_path}/sets.json", f"{tmp_path}/cards.json")


def test_manifests_have_nine_fields(spark):
    good = {"version": "a-v1.0.0", "source": "x", "generated_at": "2024-01-01T00:00:00+00:00", "set_count": 1, "card_count": 2, "external_id_count": 0}
    rows = [
        ("good", good | {"source_license": "MIT", "metadata": {}}),
        ("latest", good | {"version": "latest-v1.0.0"}),
        ("naive", good | {"generated_at": "2024-01-01T00:00:00"}),
        ("no time", good | {"generated_at": "yesterday"}),
        ("count", good | {"set_count": -1, "card_count": "2"}),
        ("few", {"version": "a-v1.0.0"}),
        ("kind", good | {"source_license": 4, "metadata": [1]}),
    ]
    texts = spark.createDataFrame([(n, json.dumps(v)) for n, v in rows] + [("broken", "{")], "file string, text string")
    got = {}
    for r in snapshot.manifest_faults(texts).collect():
        got.setdefault(r["file"], set()).add(r["fault"])
    count = "must be a whole number that isn't negative"
    missing = {f"missing required field '{c}'" for c in ("source", "generated_at", "set_count", "card_count", "external_id_count")}
    assert got == {
        "latest": {"version must be a version such as name-v1.0.0"},
        "naive": {"generated_at needs an offset"},
        "no time": {"generated_at is not an ISO timestamp"},
        "count": {f"set_count {count}", f"card_count {count}"},
        "few": missing,
        "kind": {"source_license must be a string", "metadata must be an object"},
        "broken": {"is not JSON"},
    }


def test_ids_are_told_by_card(spark):
    cards = spark.createDataFrame([("c", [("p", "1"), ("p", "2")])], "id string, external_ids array<struct<provider:string,external_id:string>>")
    assert snapshot.card_external_ids(cards).orderBy("external_id").select(F.concat_ws("/", "*")).collect()[1][0] == "c/p/2"
