"""Image bytes, snapshots and groups of candidates against plain loops."""

from __future__ import annotations

import math
import struct
import zlib

import pytest
import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import detection, image_bytes, quality, snapshot
from larkspur.sources import views as V


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


FRAME = segment(0xC0, b"\x08" + struct.pack(">HH", 30, 40) + b"\x01\x01\x11\x00")
SCAN = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + b"scan \xff\x00 data" + b"\xff\xd9"
JFIF, TABLE = segment(0xE0, b"JFIF\0"), segment(0xDB, b"q" * 65)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def test_jpeg_loses_metadata_and_nothing_else():
    dirty = b"\xff\xd8" + JFIF + segment(0xE1, b"Exif gps") + TABLE + segment(0xED, b"iptc") + segment(0xFE, b"me") + FRAME + SCAN
    assert image_bytes.inspect(dirty) == ("jpeg", 40, 30, None, b"\xff\xd8" + JFIF + TABLE + FRAME + SCAN)
    again = image_bytes.inspect(dirty)[4]
    assert image_bytes.inspect(again)[4] == again


def test_png_loses_metadata_and_keeps_its_pixels():
    whole = image_bytes.png(3, 2, bytes(range(6)))
    at = 8 + 25
    dirty = whole[:at] + chunk(b"tEXt", b"me") + chunk(b"eXIf", b"gps") + whole[at:]
    assert image_bytes.inspect(dirty) == ("png", 3, 2, None, whole)
    pixels = next(c for k, c in image_bytes.png_chunks(whole) if k == b"IDAT")
    assert zlib.decompress(pixels[8:-4]) == b"\0\x00\x01\x02\0\x03\x04\x05"


def huge():
    return image_bytes.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 10_000, 10_000, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


@pytest.mark.parametrize(
    "body, problem",
    [
        (None, "empty"), (b"", "empty"), (b"GIF89a", "not an image"), (b"\xff\xd8\xff", "undecodable"), (b"\xff\xd8" + JFIF + SCAN, "undecodable"),
        (b"\xff\xd8" + JFIF + FRAME, "undecodable"), (huge(), "too many pixels"), (huge()[:-3], "undecodable"),
        (b"\xff\xd8\xff" + bytes(image_bytes.MAX_BYTES), "too large"), (image_bytes.PNG + chunk(b"IDAT", b""), "undecodable"),
    ],
)
def test_what_is_refused(body, problem):
    assert image_bytes.inspect(body)[3:] == (problem, None)


def test_check_images(spark):
    rows = [(1, image_bytes.png(2, 2, b"abcd")), (2, None), (3, b"text")]
    got = image_bytes.check_images(spark.createDataFrame(rows, "id long, body binary")).collect()
    assert [(r["id"], r["format"], r["problem"]) for r in sorted(got)] == [(1, "png", None), (2, None, "empty"), (3, None, "not an image")]
    assert image_bytes.check_images(spark.createDataFrame([], "id string, body binary")).collect() == []


def grouped(rows, tolerance):
    groups = []
    for m in sorted(rows, key=lambda r: (-r["area"], r["id"])):
        home = next((g for g in groups if any(math.hypot(m["cx"] - x["cx"], m["cy"] - x["cy"]) <= tolerance for x in g)), None)
        if home is None:
            groups.append([m])
        else:
            home.append(m)
    return groups


def test_candidate_groups(spark, sf_dir):
    from larkspur.plans.more import _candidates

    rows = _candidates(spark, sf_dir)
    frames = {}
    for r in rows.collect():
        frames.setdefault(r["frame"], []).append(r)
    want = {}
    for frame, own in frames.items():
        groups = grouped(own, 0.06 * 200)
        areas = [m["area"] for m in groups[0]]
        ratio = max(areas) / min(areas) if min(areas) > 0 else 0
        sleeve = min(areas) > 0 and (math.sqrt(max(areas)) - math.sqrt(min(areas))) / 2 >= 7 and ratio <= 1.5
        want[frame] = (groups[0][0]["id"], len(groups), ratio if sleeve else 1.0)
    got = {r["frame"]: (r["id"], r["candidates"], r["sleeve"]) for r in detection.detect(rows).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(abs(got[k][2] - want[k][2]) < 1e-9 for k in want)
    assert any(v[1] < len(frames[k]) for k, v in got.items())


def test_records_are_read_tolerantly(spark):
    rows = ["not json", None, "[]", '{"findings": {}}', '{"findings": [null, 3, {"condition": 4, "verdict": "clear"}, {"condition": "blur", "verdict": "clear"}]}']
    frame = spark.createDataFrame([(r,) for r in rows], "r string").select(quality.stored_findings(F.col("r")).alias("f"))
    assert [[tuple(x) for x in r["f"]] for r in frame.collect()] == [[], [], [], [], [("blur", "clear", None)]]


# -- pixels of PNG files


def filtered_png(px, kind):
    """An encoder that filters every row in one way, or each in another."""
    h, w, n = px.shape
    raw, above = b"", np.zeros((w, n), int)
    for y in range(h):
        row = px[y].astype(int)
        left = np.vstack([np.zeros((1, n), int), row[:-1]])
        corner = np.vstack([np.zeros((1, n), int), above[:-1]])
        k = y % 5 if kind == "all" else kind
        if k == 4:
            p = left + above - corner
            far = [abs(p - left), abs(p - above), abs(p - corner)]
            guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
        else:
            guess = {0: 0 * row, 1: left, 2: above, 3: (left + above) // 2}[k]
        raw += bytes([k]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    header = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    body = zlib.compress(raw)
    return image_bytes.PNG + chunk(b"IHDR", header) + chunk(b"IDAT", body[:9]) + chunk(b"IDAT", body[9:]) + chunk(b"IEND", b"")


def test_png_files_become_rows(spark):
    rng = np.random.default_rng(7)
    images, files = {}, []
    for n in (1, 2, 3, 4):
        for kind in (0, 1, 2, 3, 4, "all"):
            px = rng.integers(0, 256, (11, 7, n)).astype(np.uint8)
            images[f"{n}-{kind}"] = px
            files.append((f"{n}-{kind}", bytearray(filtered_png(px, kind))))
    files += [("none", None), ("text", bytearray(b"text")), ("short", files[0][1][:60])]
    got = {}
    for r in image_bytes.png_rows(spark.createDataFrame(files, "id string, body binary")).collect():
        assert (r["width"], r["height"]) == (7, 11)
        got.setdefault(r["image"], {})[r["y"]] = list(bytes(r["px"]))
    assert set(got) == set(images)
    for name, px in images.items():
        grey = px[:, :, 0] if px.shape[2] < 3 else (px[:, :, :3].astype(int) @ [4899, 9617, 1868] + 8192) // 16384
        assert [got[name][y] for y in range(11)] == grey.tolist(), name


def test_damaged_pixels_are_found(spark):
    px = np.random.default_rng(8).integers(0, 256, (30, 20, 1)).astype(np.uint8)
    good = filtered_png(px, 0)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    start = good[: 8 + 25]
    files = {
        "good": good,
        "few": start + chunk(b"IDAT", zlib.compress(b"\0" * 100)) + chunk(b"IEND", b""),
        "noise": start + chunk(b"IDAT", b"\x78\x9c" + b"\xff" * 50) + chunk(b"IEND", b""),
        "no pixels": start + chunk(b"IEND", b""),
        "unknown chunk": start + chunk(b"loCa", b"52.5 13.4") + good[8 + 25 :],
    }
    frame = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "id string, body binary")
    found = {r["id"]: (r["problem"], r["clean"]) for r in image_bytes.check_images(frame).collect()}
    assert {k: p for k, (p, _) in found.items()} == {"good": None, "few": "undecodable", "noise": "undecodable", "no pixels": "undecodable", "unknown chunk": None}
    assert bytes(found["unknown chunk"][1]) == good


def test_large_uploads_are_not_read(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(image_bytes, "MAX_BYTES", 400)
    good = filtered_png(np.zeros((4, 4, 1), np.uint8), 0)
    for name, body in (("a.png", good), ("b.png", good + b"x" * 600), ("c.txt", b"text")):
        (tmp_path / name).write_bytes(body)
    found = {r["id"].rsplit("/", 1)[1]: r for r in image_bytes.checked_uploads(spark, str(tmp_path)).collect()}
    assert {k: r["problem"] for k, r in found.items()} == {"a.png": None, "b.png": "too large", "c.txt": "not an image"}
    assert found["a.png"]["sha256"] == hashlib.sha256(good).hexdigest() and found["c.txt"]["sha256"] is None
    large = image_bytes.uploads(spark, str(tmp_path)).where("body is null and length > 400")
    assert large.count() == 1
