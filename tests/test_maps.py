"""Binary maps and outlines of tiled images against loops over whole images."""

from __future__ import annotations

import math

import numpy as np
import pytest
from test_tiles import SIDE, flood, noise, table, whole

from larkspur.operators import maps, outlines, tiles


def mirrored(i, n):
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
        if n == 1:
            return 0
    return i


def smooth(px):
    h, w = px.shape
    k = (1, 4, 6, 4, 1)
    out = np.zeros((h, w), np.uint8)
    for y in range(h):
        for x in range(w):
            s = sum(k[a] * k[b] * int(px[mirrored(y + a - 2, h), mirrored(x + b - 2, w)]) for a in range(5) for b in range(5))
            out[y, x] = (s + 128) // 256
    return out


def close(px):
    for pick in (max, min):
        h, w = px.shape
        px = np.array([[pick(px[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].ravel()) for x in range(w)] for y in range(h)])
    return px


def canny(px, low, high):
    h, w = px.shape
    at = lambda y, x: int(px[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    gx = np.array([[sum(k * (at(y + k2, x + 1) - at(y + k2, x - 1)) for k2, k in ((-1, 1), (0, 2), (1, 1))) for x in range(w)] for y in range(h)])
    gy = np.array([[sum(k * (at(y + 1, x + k2) - at(y - 1, x + k2)) for k2, k in ((-1, 1), (0, 2), (1, 1))) for x in range(w)] for y in range(h)])
    m = np.abs(gx) + np.abs(gy)
    mag = lambda y, x: m[y, x] if 0 <= y < h and 0 <= x < w else 0
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            v, dx, dy = m[y, x], abs(int(gx[y, x])), abs(int(gy[y, x]))
            if v <= low:
                continue
            if dy * 32768 < dx * 13573:
                top = v > mag(y, x - 1) and v >= mag(y, x + 1)
            elif dy * 32768 > dx * 13573 + dx * 65536:
                top = v > mag(y - 1, x) and v >= mag(y + 1, x)
            else:
                s = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
                top = v > mag(y - 1, x - s) and v > mag(y + 1, x + s)
            out[y, x] = (2 if v > high else 1) if top else 0
    label = flood(out > 0)
    strong = set(label[out == 2].tolist())
    return np.where(np.isin(label, sorted(strong)) & (out > 0), 255, 0)


def split(px):
    best, at = -1.0, None
    n = np.bincount(px.ravel(), minlength=256)
    for t in np.flatnonzero(n)[:-1]:
        a, b = px[px <= t].astype(float), px[px > t].astype(float)
        v = len(a) * float(len(b)) * (a.mean() - b.mean()) ** 2
        if v > best * (1 + 1e-12):
            best, at = v, int(t)
    return at


def equalise(px):
    h, w = px.shape
    ph, pw = (h, w) if h % 8 == 0 and w % 8 == 0 else (h + 8 - h % 8, w + 8 - w % 8)
    big = np.array([[px[mirrored(y, h), mirrored(x, w)] for x in range(pw)] for y in range(ph)])
    ch, cw = ph // 8, pw // 8
    curves = np.zeros((8, 8, 256))
    for i in range(8):
        for j in range(8):
            n = np.bincount(big[i * ch : (i + 1) * ch, j * cw : (j + 1) * cw].ravel(), minlength=256)
            limit = max(1, int(2.0 * ch * cw / 256))
            spare = sum(max(0, int(v) - limit) for v in n)
            n = np.minimum(n, limit) + spare // 256
            rest = spare % 256
            if rest:
                step, k = max(256 // rest, 1), 0
                while k < 256 and rest > 0:
                    n[k] += 1
                    k, rest = k + step, rest - 1
            curves[i, j] = [min(255, round(int(c) * (255 / (ch * cw)))) for c in np.cumsum(n)]
    out = np.zeros((h, w), np.uint8)
    for y in range(h):
        for x in range(w):
            fy, fx = y / ch - 0.5, x / cw - 0.5
            i, j = math.floor(fy), math.floor(fx)
            a, b = fy - i, fx - j
            c = lambda u, v: curves[min(max(u, 0), 7), min(max(v, 0), 7), px[y, x]]  # noqa: B023, E731
            out[y, x] = round((c(i, j) * (1 - b) + c(i, j + 1) * b) * (1 - a) + (c(i + 1, j) * (1 - b) + c(i + 1, j + 1) * b) * a)
    return out


def scene(seed, h, w, box, surface=60, face=200):
    px = (surface + np.random.default_rng(seed).integers(-9, 10, (h, w))).astype(np.uint8)
    t, left, b, r = box
    px[t:b, left:r] = face - 10 * (np.add.outer(np.arange(b - t) // 5, np.arange(r - left) // 5) % 2)
    return px


IMAGES = {
    "card": scene(1, 70, 52, (12, 9, 58, 42)),
    "dark": scene(2, 64, 48, (10, 8, 50, 38), 30, 90),
    "noise": noise(3, 45, 61),
    "even": np.full((33, 20), 77, np.uint8),
    "ramp": np.add.outer(np.arange(40), 3 * np.arange(50)).astype(np.uint8),
}


def test_each_map_is_that_of_a_loop(spark):
    got = {(k["id"], k["map"]): v for k, v in whole(maps.binary_maps(table(spark, IMAGES), SIDE)).items()}
    assert len(got) == 4 * len(IMAGES)
    for name, px in IMAGES.items():
        soft = smooth(px)
        median = float(np.median(soft))
        low, high = int(max(0.0, 0.66 * median)), int(min(255.0, 1.33 * median))
        at = split(soft)
        region = close(np.where(soft > (255 if at is None else at), 255, 0))
        assert np.array_equal(got[name, "region"], region), name
        assert np.array_equal(got[name, "inverse"], 255 - region), name
        assert np.array_equal(got[name, "edges"], close(canny(soft, low, high))), name
        assert np.array_equal(got[name, "equalised"], close(canny(smooth(equalise(px)), low, high))), name


def test_lines_reach_over_seams(spark):
    """A weak line over many tiles is an edge as a whole if one of its ends is strong."""
    px = np.full((100, 130), 100, np.uint8)
    px[50:, :] = 122
    px[50:, :6] = 255
    shaded = maps.named(table(spark, {"l": px}), "edges").selectExpr("*", "70 as low", "200 as high")
    got = whole(maps.edges(shaded, 8, SIDE))
    (found,) = got.values()
    assert np.array_equal(found, close(canny(px, 70, 200)))
    assert found[49, 120] == 255


# -- outlines


def crossings(px):
    """Loops of a whole image, followed side by side."""
    p = np.pad(px > 0, 1)
    step = ((0, 1), (1, 0), (0, -1), (-1, 0))
    out = ((-1, 0), (0, 1), (1, 0), (0, -1))
    left = {(y, x, d) for y, x in zip(*np.nonzero(p), strict=True) for d in range(4) if not p[y + out[d][0], x + out[d][1]]}
    while left:
        at = start = min(left)
        loop = []
        while True:
            left.discard(at)
            loop.append(at)
            y, x, d = at
            (ay, ax), (oy, ox) = step[d], out[d]
            if p[y + ay + oy, x + ax + ox]:
                at = (y + ay + oy, x + ax + ox, (d + 3) % 4)
            elif p[y + ay, x + ax]:
                at = (y + ay, x + ax, d)
            else:
                at = (y, x, (d + 1) % 4)
            if at == start:
                break
        yield [((y - 1) * px.shape[1] + x - 1) * 4 + d for y, x, d in loop]


def test_loops_are_those_of_a_walk(spark):
    ring = np.zeros((60, 70), np.uint8)
    ring[5:50, 8:60] = 255
    ring[15:40, 20:47] = 0
    ring[20:30, 25:30] = 255
    images = {"ring": ring, "noise": np.where(noise(5, 50, 40) > 120, 255, 0).astype(np.uint8), "full": np.full((33, 17), 255, np.uint8)}
    grouped = {}
    for r in outlines.tile_chains(table(spark, images), SIDE).collect():
        grouped.setdefault(r["image"], []).append(r.asDict())
    for name, px in images.items():
        got = [x.tolist() for x in outlines.loops(grouped[name])]
        turn = lambda loop: loop[loop.index(min(loop)) :] + loop[: loop.index(min(loop))]
        assert sorted(map(turn, got)) == sorted(map(turn, crossings(px)))
        areas = sum(outlines.twice_area(outlines.points(np.array(x), px.shape[1])) / 8 for x in got)
        assert abs(areas - (px > 0).sum()) <= 2 * sum(map(len, got)) / 8  # but for cut corners


def test_a_turned_rectangle(spark):
    h, w, angle = 200, 260, math.radians(25)
    y, x = np.mgrid[:h, :w]
    u = (x - 130) * math.cos(angle) + (y - 100) * math.sin(angle)
    v = -(x - 130) * math.sin(angle) + (y - 100) * math.cos(angle)
    px = np.where((abs(u) <= 80) & (abs(v) <= 50), 255, 0).astype(np.uint8)
    (got,) = outlines.shapes(table(spark, {"t": px}, 64), side=64).collect()
    want = [(130 + a * math.cos(angle) - b * math.sin(angle), 100 + a * math.sin(angle) + b * math.cos(angle)) for a in (-80, 80) for b in (-50, 50)]
    for i in range(1, 5):
        assert min(math.hypot(got[f"x{i}"] - a, got[f"y{i}"] - b) for a, b in want) < 2
    assert abs(got["contour_area"] - 160 * 100) < 200 and not got["hole"]


def test_the_smallest_rectangle_is_no_larger_than_any_other():
    rng = np.random.default_rng(4)
    for _ in range(30):
        p = rng.integers(0, 60, (rng.integers(3, 40), 2))
        h = outlines.hull(p)
        if len(h) < 3:
            continue
        got = abs(outlines.twice_area(outlines.smallest_rectangle(p))) / 2
        best = math.inf
        for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
            u = (b - a) / np.hypot(*(b - a))
            s, t = p @ u, p @ np.array([-u[1], u[0]])
            best = min(best, (s.max() - s.min()) * (t.max() - t.min()))
        assert got == pytest.approx(best)


def test_straightened_outlines_stay_near():
    rng = np.random.default_rng(6)
    for _ in range(20):
        angles = np.sort(rng.random(200)) * 2 * np.pi
        p = (np.stack([np.cos(angles), np.sin(angles)], 1) * rng.integers(60, 100, 200)[:, None]).astype(int)
        q = outlines.simplified(p, 8.0)
        assert len(q) < len(p) and {tuple(v) for v in q} <= {tuple(v) for v in p}


def test_shapes_of_nothing(spark):
    assert outlines.shapes(table(spark, {"d": np.zeros((30, 30), np.uint8)}), side=SIDE).collect() == []
    assert tiles.to_rows(table(spark, {"d": np.zeros((3, 3), np.uint8)}), SIDE).count() == 9
