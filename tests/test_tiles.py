"""Images as tiles: regions, copies by area, maps, outlines and straightening against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import regions, resample, tiles

SIDE = 16


def table(spark, images, side=SIDE):
    rows = [(name, px.shape[1], px.shape[0], y, bytearray(line.tobytes())) for name, px in images.items() for y, line in enumerate(px)]
    return tiles.from_rows(spark.createDataFrame(rows, "image string, width int, height int, y int, px binary").repartition(5), side)


def whole(frame, side=SIDE):
    out = {}
    for r in frame.collect():
        px = out.setdefault(r["image"], np.full((r["height"], r["width"]), -1, np.int64))
        (a, b), (c, d) = tiles.span(r["ty"], r["height"], side), tiles.span(r["tx"], r["width"], side)
        px[a:b, c:d] = np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(b - a, d - c)
    return out


def noise(seed, h, w, top=256):
    return np.random.default_rng(seed).integers(0, top, (h, w)).astype(np.uint8)


def spiral(n):
    px = np.zeros((n, n), np.uint8)
    y, x, dy, dx, px[0, 0] = 0, 0, 0, 1, 255
    while True:
        for _ in range(2):
            a, b, c, d = y + dy, x + dx, y + 2 * dy, x + 2 * dx
            if 0 <= a < n and 0 <= b < n and not px[a, b] and not (0 <= c < n and 0 <= d < n and px[c, d]):
                break
            dy, dx = dx, -dy
        else:
            return px
        y, x = a, b
        px[y, x] = 255


def flood(mask):
    """Label of each pixel by a flood from every pixel in turn."""
    label, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if label[start]:
            continue
        n += 1
        label[start], todo = n, [start]
        while todo:
            y, x = todo.pop()
            for a in range(max(0, y - 1), min(mask.shape[0], y + 2)):
                for b in range(max(0, x - 1), min(mask.shape[1], x + 2)):
                    if mask[a, b] and not label[a, b]:
                        label[a, b] = n
                        todo.append((a, b))
    return label


IMAGES = {
    "spiral": spiral(101),
    "diagonals": np.where((np.add.outer(np.arange(70), np.arange(90)) % 9 == 0), 255, 0).astype(np.uint8),
    "noise": np.where(noise(1, 75, 53) > 150, 255, 0).astype(np.uint8),
    "checks": np.where(np.add.outer(np.arange(64), np.arange(64)) % 2 == 0, 255, 0).astype(np.uint8),
    "dark": np.zeros((40, 20), np.uint8),
    "dot": np.full((1, 1), 255, np.uint8),
    "line": np.full((1, 50), 255, np.uint8),
}


def test_tiles_go_there_and_back(spark):
    got = whole(table(spark, IMAGES))
    assert all(np.array_equal(got[k], v) for k, v in IMAGES.items()) and set(got) == set(IMAGES)
    pixels = tiles.to_rows(table(spark, {"n": noise(2, 37, 41)}), SIDE).collect()
    assert {(r["y"], r["x"]): r["px"] for r in pixels} == {p: int(v) for p, v in np.ndenumerate(noise(2, 37, 41))}


def test_missing_rows_are_black(spark):
    rows = [("a", 2, 3, 1, bytearray(b"\x05\x06"))]
    got = whole(tiles.from_rows(spark.createDataFrame(rows, "image string, width int, height int, y int, px binary"), 4))
    assert got["a"].tolist() == [[0, 0], [5, 6], [0, 0]]


@pytest.mark.parametrize("fan", [2, 8])
def test_regions_are_those_of_a_flood(spark, fan):
    got = regions.region_fraction(table(spark, IMAGES), 250, SIDE, fan).collect()
    want = {k: max(np.bincount(flood(v >= 250).ravel())[1:], default=0) / v.size for k, v in IMAGES.items()}
    assert {r["image"]: r["fraction"] for r in got} == want


def test_regions_of_a_photograph(spark):
    images = {"spiral": spiral(512), "noise": np.where(noise(3, 512, 512) > 140, 255, 0).astype(np.uint8)}
    labels = regions.label_tiles(table(spark, images, 64), lambda px: px > 0, 64)
    found = regions.regions(labels, regions.region_roots(regions.seams(labels), 8, 4), 64).collect()
    for name, px in images.items():
        label = flood(px > 0)
        want = []
        for n in range(1, label.max() + 1):
            y, x = np.nonzero(label == n)
            want.append((len(y), y.min(), x.min(), y.max(), x.max()))
        got = [(r["size"], r["top"], r["left"], r["bottom"], r["right"]) for r in found if r["image"] == name]
        assert sorted(got) == sorted(want)


def test_labels_inside_a_tile_are_linear_and_right():
    for seed in range(6):
        mask = noise(seed, 40, 33) > 60 * (seed % 4)
        label, sizes = regions.labelled(mask)
        want = flood(mask)
        assert len(set(zip(label.ravel(), want.ravel(), strict=True))) == want.max() + 1 - mask.all()
        assert sorted(sizes) == sorted(np.bincount(want.ravel())[1:])


def by_area(px, w, h):
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            total = 0
            for a in range(y * px.shape[0] // h, -(-(y + 1) * px.shape[0] // h)):
                for b in range(x * px.shape[1] // w, -(-(x + 1) * px.shape[1] // w)):
                    wy = min((a + 1) * h, (y + 1) * px.shape[0]) - max(a * h, y * px.shape[0])
                    wx = min((b + 1) * w, (x + 1) * px.shape[1]) - max(b * w, x * px.shape[1])
                    total += wy * wx * int(px[a, b])
            out[y, x] = round(total / px.size)
    return out


def test_copies_by_area(spark):
    images = {"a": noise(4, 90, 61), "b": noise(5, 33, 100), "small": noise(6, 20, 30), "thin": noise(7, 1, 200)}
    got = whole(resample.working_copy(table(spark, images), 40, SIDE))
    for name, px in images.items():
        scale = 40 / max(px.shape)
        h, w = px.shape if scale >= 1 else (max(1, round(n * scale)) for n in px.shape)
        assert np.array_equal(got[name], px if scale >= 1 else by_area(px, w, h)), name


def test_a_shift_and_a_half_pixel(spark):
    px = noise(8, 50, 40)
    maps = spark.createDataFrame(
        [("a", 40, 50, [1.0, 0.0, 3.0, 0.0, 1.0, -2.0, 0.0, 0.0, 1.0]), ("b", 39, 50, [1.0, 0.0, 0.5, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), ("none", 4, 4, [1.0] * 9)],
        "image string, ow int, oh int, matrix array<double>",
    )
    got = whole(resample.warped(table(spark, {"a": px, "b": px, "left": px}), maps, SIDE))
    want = np.zeros((50, 40))
    want[2:, :-3] = px[:-2, 3:]
    assert np.array_equal(got["a"], want)
    assert np.array_equal(got["b"], (px[:, :-1].astype(int) + px[:, 1:] + 1) // 2)
    assert set(got) == {"a", "b"}


def test_working_size_is_python_s(spark):
    sizes = [(4000, 3000), (3, 5000), (1025, 7), (1024, 1024), (10, 20), (2049, 1535)]
    frame = spark.createDataFrame(sizes, "w int, h int").select("w", "h", *resample.working_size(F.col("w"), F.col("h"), 1024))
    for w, h, a, b in (tuple(r) for r in frame.collect()):
        scale = 1024 / max(w, h)
        assert (a, b) == ((w, h) if scale >= 1 else (max(1, round(w * scale)), max(1, round(h * scale))))
