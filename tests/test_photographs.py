"""Photographs from tiles to a verdict: cards are found where they were put, and straightened as they were."""

from __future__ import annotations

import math

import numpy as np
import pytest
from test_maps import scene
from test_tiles import SIDE, flood, noise, table, whole

from larkspur.functions import geometry as G
from larkspur.operators import photographs


def turned(angle, h=160, w=200, cx=100, cy=80, a=33, b=46, surface=40, face=210):
    y, x = np.mgrid[:h, :w]
    c, s = math.cos(angle), math.sin(angle)
    inside = (abs((x - cx) * c + (y - cy) * s) <= a) & (abs(-(x - cx) * s + (y - cy) * c) <= b)
    return np.where(inside, face, surface + np.random.default_rng(1).integers(-8, 9, (h, w))).astype(np.uint8)


SCENES = {
    "upright": scene(1, 160, 120, (30, 26, 118, 89), 40, 210),
    "dark": scene(2, 160, 120, (36, 28, 124, 91), 30, 75),
    "large": scene(3, 640, 480, (144, 114, 496, 366), 40, 210),
    "turned": turned(0.3),
    "landscape": turned(math.pi / 2),
    "clipped": scene(4, 160, 120, (0, 26, 88, 89), 40, 210),
    "empty": np.full((80, 60), 90, np.uint8),
    "grain": noise(5, 90, 70, 30) + 100,
}
two = scene(6, 160, 200, (36, 15, 124, 78), 40, 210)
two[36:124, 115:178] = 205
SCENES["two"] = two
sleeve = scene(7, 300, 240, (60, 55, 236, 181), 40, 220)
held = sleeve[60:236, 55:181].copy()
sleeve[50:246, 45:191] = 120
sleeve[60:236, 55:181] = held
SCENES["sleeve"] = sleeve


@pytest.fixture(scope="module")
def found(spark):
    rows = photographs.located(table(spark, SCENES, 48), 320, 48).collect()
    assert len(rows) == len(SCENES)
    return {r["image"]: r for r in rows}


def corners(r):
    return [(r[f"x{i}"], r[f"y{i}"]) for i in range(1, 5)]


@pytest.mark.parametrize("name, box", [("upright", (30, 26, 118, 89)), ("dark", (36, 28, 124, 91)), ("large", (144, 114, 496, 366))])
def test_cards_are_where_they_were_put(found, name, box):
    top, left, bottom, right = box
    want = [(left, top), (right, top), (right, bottom), (left, bottom)]
    assert found[name]["status"] == "located" and found[name]["candidates"] == 1
    slack = 8 if name == "large" else 4
    assert all(math.hypot(x - a, y - b) < slack for (x, y), (a, b) in zip(corners(found[name]), want, strict=True))
    assert found[name]["confidence"] > 0.8 and found[name]["enclosing_ratio"] == 1.0


def test_corners_go_clockwise_from_the_top_left(found):
    for name in ("upright", "turned", "landscape", "large"):
        c = corners(found[name])
        assert all((b[0] - a[0]) * (d[1] - b[1]) - (b[1] - a[1]) * (d[0] - b[0]) > 0 for a, b, d in zip(c, c[1:] + c[:1], c[2:] + c[:2], strict=True))
        assert sum(c[0]) == min(map(sum, c))


def test_frames_are_the_original_s(found):
    assert all((r["frame_height"], r["frame_width"]) == SCENES[k].shape for k, r in found.items())


@pytest.mark.parametrize("name", ["empty", "grain"])
def test_nothing_is_said_where_nothing_is(found, name):
    assert (found[name]["status"], found[name]["reason"]) == ("insufficient", photographs.NOTHING_FOUND)
    assert all(found[name][c] is None for c in ("candidates", "x1", "y4", "confidence", "enclosing_ratio"))


def test_two_cards_and_a_sleeve(found):
    assert found["two"]["candidates"] == 2
    assert found["sleeve"]["candidates"] == 1
    assert 1.2 < found["sleeve"]["enclosing_ratio"] <= 1.5


def test_a_clipped_card_touches_the_border(found):
    assert min(y for _, y in corners(found["clipped"])) <= 2


# -- straightening

QUAD = (30.0, 20.0, 95.0, 35.0, 88.0, 120.0, 22.0, 100.0)
NAMES = [c for i in range(4) for c in (G.X[i], G.Y[i])]
SHAPE = "image string, " + ", ".join(f"{c} double" for c in NAMES)
TARGET = (63, 88)


def test_the_transform_leads_there_and_back(spark):
    side = (20.0, 30.0, 120.0, 25.0, 118.0, 90.0, 24.0, 95.0)  # on its side: turned
    rows = photographs.transforms(spark.createDataFrame([("a", *QUAD), ("b", *side)], SHAPE), TARGET).collect()
    for r in rows:
        quad = np.array(QUAD if r["image"] == "a" else side).reshape(4, 2)
        assert r["quarter_turns"] == (r["image"] == "b")
        quad = np.roll(quad, -r["quarter_turns"], axis=0)
        m, w, h = r["multiple"], r["multiple"] * TARGET[0] - 1, r["multiple"] * TARGET[1] - 1
        back, there = np.array(r["backward"]).reshape(3, 3), np.array(r["matrix"]).reshape(3, 3)
        for (x, y), (u, v) in zip(quad, [(0, 0), (w, 0), (w, h), (0, h)], strict=True):
            p, q = back @ (u, v, 1), there @ (x, y, 1)
            assert np.allclose(p[:2] / p[2], (x, y), atol=1e-9)
            assert np.allclose(q[:2] / q[2], (u / m, v / m), atol=1e-9)
        inner = there @ (*quad.mean(0), 1)
        assert np.allclose((back @ np.array([inner[0] / inner[2] * m, inner[1] / inner[2] * m, 1]))[:2] / (back @ np.array([inner[0] / inner[2] * m, inner[1] / inner[2] * m, 1]))[2], quad.mean(0))


def drawn(px, back, w, h):
    """Bilinear reading of a whole image, pixel by pixel."""
    out = np.zeros((h, w))
    for v in range(h):
        for u in range(w):
            d = back[6] * u + back[7] * v + back[8]
            x, y = (round(32 * ((back[k] * u + back[k + 1] * v + back[k + 2]) / d)) for k in (0, 3))
            total = 0
            for a, wy in ((y // 32, 32 - y % 32), (y // 32 + 1, y % 32)):
                for b, wx in ((x // 32, 32 - x % 32), (x // 32 + 1, x % 32)):
                    if 0 <= a < px.shape[0] and 0 <= b < px.shape[1]:
                        total += wy * wx * int(px[a, b])
            out[v, u] = (total + 512) // 1024
    return out


def test_a_straightened_card_is_that_of_a_loop(spark):
    px = noise(9, 130, 110)
    quads = spark.createDataFrame([("a", *QUAD), ("big", 5.0, 3.0, 150.0, 1.0, 160.0, 190.0, 2.0, 185.0)], SHAPE)
    images = {"a": px, "big": noise(10, 200, 170)}
    got = whole(photographs.straightened(table(spark, images), quads, TARGET, 4, SIDE))
    for r in photographs.transforms(quads, TARGET).collect():
        m = r["multiple"]
        want = drawn(images[r["image"]], r["backward"], m * TARGET[0], m * TARGET[1])
        boxes = want.reshape(TARGET[1], m, TARGET[0], m).sum((1, 3))
        assert np.array_equal(got[r["image"]], np.array([[round(v / (m * m)) for v in row] for row in boxes]))
        assert m == (2 if r["image"] == "big" else 1)


def test_the_same_bytes_however_tiles_are_dealt(spark):
    px = noise(11, 140, 120)
    quads = spark.createDataFrame([("a", *QUAD)], SHAPE)
    one = whole(photographs.straightened(table(spark, {"a": px}, 16), quads, TARGET, 4, 16), 16)
    two = whole(photographs.straightened(table(spark, {"a": px}, 40).repartition(7), quads, TARGET, 4, 40), 40)
    assert np.array_equal(one["a"], two["a"])


def test_nothing_is_enhanced(spark):
    px = np.full((140, 120), 97, np.uint8)
    px[:70] = 140
    got = whole(photographs.straightened(table(spark, {"a": px}), spark.createDataFrame([("a", *QUAD)], SHAPE), TARGET, 4, SIDE))["a"]
    assert got.min() == 97 and got.max() == 140  # no ringing, no stretched contrast


# -- measuring and judging


def measures(px):
    p = np.pad(px.astype(float), 1, mode="reflect")
    bend = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    low, high = np.percentile(px, [5, 95])
    label = flood(px >= 250)
    return float(min(px.shape)), bend.var(), px.mean(), high - low, max(np.bincount(label.ravel())[1:], default=0) / px.size


def test_measures_are_those_of_whole_images(spark):
    images = {"noise": noise(21, 61, 47), "even": np.full((20, 33), 255, np.uint8), "line": noise(22, 1, 40), "two": noise(23, 2, 2), "card": scene(5, 50, 70, (10, 10, 40, 50))}
    for r in photographs.measured(table(spark, images), side=SIDE).collect():
        got = [r[c] for c in ("short_edge", "blur", "brightness", "exposure", "glare")]
        assert np.allclose(got, measures(images[r["image"]]), rtol=1e-9, atol=1e-9), r["image"]


def test_large_photographs_are_measured_as_their_copies(spark):
    px = np.kron(noise(24, 40, 30), np.ones((4, 4), np.uint8))
    (r,) = photographs.measured(table(spark, {"a": px}), long_edge=40, side=SIDE).collect()
    want = measures(noise(24, 40, 30))
    assert r["short_edge"] == 120 and np.allclose([r["blur"], r["brightness"], r["exposure"]], want[1:4])


def test_photographs_are_prepared(spark):
    dark = (SCENES["upright"] // 12).astype(np.uint8)
    images = {"upright": SCENES["upright"], "empty": SCENES["empty"], "two": SCENES["two"], "dark": dark}
    found = {r["image"]: r for r in photographs.prepared(table(spark, images, 48), 320, 48).collect()}
    findings = {k: {f["condition"]: f for f in r["findings"]} for k, r in found.items()}
    assert all(len(f) == 11 for f in findings.values())
    assert findings["empty"]["multiple_cards"]["verdict"] == "undetermined"
    assert findings["empty"]["multiple_cards"]["reason"] == photographs.NOTHING_FOUND
    assert not found["empty"]["located"] and not found["empty"]["straightened"]
    assert findings["two"]["multiple_cards"]["severity"] == "unusable" and findings["two"]["multiple_cards"]["measurement"] == 2.0
    assert findings["dark"]["excessive_darkness"]["severity"] == "unusable" and found["dark"]["status"] == "unusable"
    assert findings["upright"]["multiple_cards"]["verdict"] == "clear" and findings["upright"]["low_resolution"]["severity"] == "unusable"
