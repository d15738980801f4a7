"""Nearest neighbours at any density and point files read through their index, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arealis.operators import nearest as N
from arealis.sources import point_files as PF

SHAPES = "cat string, id long, polygon array<array<array<struct<lat:double,lon:double>>>>, path array<struct<lat:double,lon:double>>"


def _sphere(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))


def _segment(p, a, b):
    kx, ky = math.cos(math.radians(p[0])) * 111320.0, 110540.0
    ax, ay, bx, by = (a[1] - p[1]) * kx, (a[0] - p[0]) * ky, (b[1] - p[1]) * kx, (b[0] - p[0]) * ky
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(ax + t * dx, ay + t * dy)


def _check(got, dists, k):
    """Distances and, where they differ by more than rounding, ids agree with the full order."""
    by = {}
    for r in got:
        by.setdefault((r.pin, r.cat), []).append((r.pos, r.id, r.dist))
    assert set(by) == set(dists)
    for key, rows in by.items():
        want = sorted((d, i) for i, d in dists[key].items())[:k]
        rows = sorted(rows)
        assert [r[0] for r in rows] == list(range(1, len(want) + 1))
        for (_, i, d), (wd, _) in zip(rows, want, strict=True):
            assert d == pytest.approx(wd, rel=1e-7, abs=1e-3) and dists[key][i] == pytest.approx(wd, rel=1e-7, abs=1e-3)


@pytest.mark.parametrize("leaf", [32, 2])
def test_nearest_points(spark, monkeypatch, leaf):
    monkeypatch.setattr(N, "LEAF", leaf)
    rng = random.Random(12)
    pts = [("a", i, 55 + rng.gauss(0, 0.01), 12 + rng.gauss(0, 0.01)) for i in range(300)]  # a crowd
    pts += [("a", 300 + i, rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(60)]
    pts += [("a", 400 + i, 55.0, 12.0) for i in range(50)] + [("a", 500, -70.0, 179.99), ("a", 501, -70.0, -179.99), ("a", 502, 89.9, 10.0), ("a", 503, 89.9, -170.0)]
    pts += [("few", 1, 10.0, 10.0), ("few", 2, -10.0, -10.0)]
    pins = [(i, 55 + rng.gauss(0, 0.02), 12 + rng.gauss(0, 0.02)) for i in range(30)] + [(100 + i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(60)]
    pins += [(200, 55.0, 12.0), (201, 55.0, 12.0), (202, -70.0, 180.0), (203, 90.0, 0.0), (204, -90.0, 5.0)]
    df = spark.createDataFrame([*pts, ("a", 600, None, 1.0)], "cat string, id long, lat double, lon double").repartition(3)
    pf = spark.createDataFrame([*pins, (300, None, None)], "pin long, lat double, lon double")
    want = {}
    for p, *spot in pins:
        for c, i, *at in pts:
            want.setdefault((p, c), {})[i] = _sphere(spot, at)
    got = N.nearest_points(pf, df, 3).collect()
    _check(got, want, 3)
    assert [r.id for r in sorted(got, key=lambda r: r.pos) if r.pin == 200 and r.cat == "a"] == [400, 401, 402]
    assert N.nearest_points(pf, df.limit(0), 3).count() == 0 and N.nearest_points(pf.limit(0), df, 3).count() == 0


@pytest.mark.parametrize("leaf", [32, 3])
def test_nearest_shapes(spark, monkeypatch, leaf):
    monkeypatch.setattr(N, "LEAF", leaf)
    rng = random.Random(13)
    shapes, want = [], {}
    pt = lambda p: {"lat": p[0], "lon": p[1]}
    segs = {}
    for i in range(60):
        lat, lon = (55 + rng.gauss(0, 0.05), 12 + rng.gauss(0, 0.05)) if i % 2 else (rng.uniform(50, 60), rng.uniform(5, 15))
        if i % 3:
            path = [(lat + rng.uniform(-0.1, 0.1), lon + rng.uniform(-0.1, 0.1)) for _ in range(rng.randint(1, 6))]
            shapes.append(("line", i, None, [pt(p) for p in path]))
            segs["line", i] = list(zip(path, path[1:], strict=False)) or [(path[0], path[0])]
        else:
            r = [(lat, lon), (lat, lon + 0.2), (lat + 0.1, lon + 0.2), (lat + 0.1, lon)]
            shapes.append(("area", i, [[[pt(p) for p in r]]], None))
            segs["area", i] = list(zip(r, r[1:] + r[:1], strict=True))
    pins = [(i, 55 + rng.gauss(0, 0.1), 12 + rng.gauss(0, 0.1)) for i in range(25)] + [(50 + i, rng.uniform(45, 65), rng.uniform(0, 20)) for i in range(25)]
    pins.append((99, shapes[0][2][0][0][0]["lat"] + 0.05, shapes[0][2][0][0][0]["lon"] + 0.1))
    for p, *spot in pins:
        for (c, i), edges in segs.items():
            d = min(_segment(spot, a, b) for a, b in edges)
            if c == "area":
                (s, w), (n, e) = edges[0][0], edges[1][1]
                d = 0.0 if s <= spot[0] <= n and w <= spot[1] <= e else d
            want.setdefault((p, c), {})[i] = d
    df = spark.createDataFrame(shapes, SHAPES)
    got = N.nearest_shapes(spark.createDataFrame(pins, "pin long, lat double, lon double"), df, 3, 0.05).collect()
    _check(got, want, 3)
    assert [(r.id, r.dist) for r in got if r.pin == 99 and r.cat == "area" and r.pos == 1] == [(0, 0.0)]


def test_point_files(spark, tmp_path):
    rng = random.Random(14)
    rows = []
    for i in range(3000):  # areas are bands of latitude; one holds most points
        k = 2 if rng.random() < 0.7 else rng.randint(0, 7)
        rows.append((f"010{k}", rng.choice(["food", "grocery", "transport"]), rng.choice(["x", "y"]), f"n{i % 90:03d}", 54 + (k + rng.random()) / 2, rng.uniform(8, 15)))
    df = spark.createDataFrame(rows, "kommune string, cat string, sub string, name string, lat double, lon double").repartition(5)
    path = f"{tmp_path}/points"
    PF.write_even(df, path, rows_per_file=200)
    back = PF.read_files(spark, path)
    index = PF.file_index(back).cache()
    assert back.count() == 3000 and index.agg(F.max("n")).first()[0] <= 200 and index.filter("kommune = '0102'").count() >= 10
    every = {r.file for r in index.collect()}
    for lat, lon, radius, cats in ((56.0, 11.0, 8000.0, None), (55.2, 11.0, 20000.0, ["food"]), (54.0, 8.0, 50000.0, ["transport", "food"]), (10.0, 10.0, 1000.0, None), (57.0, 9.0, 1000.0, ["none"])):
        got = PF.read_circle(spark, path, index, lat, lon, radius, cats)
        want = sorted((r[0], *r[1:4]) for r in rows if _sphere((lat, lon), (round(r[4], 5), round(r[5], 5))) <= radius and (cats is None or r[1] in cats))
        assert sorted((r.kommune, r.cat, r.sub, r.name) for r in got.collect()) == want
        opened = set(PF.files_for(index, [PF.box_around(lat, lon, radius)], cats))
        assert opened < every and {f.split("/")[-1] for f in (got.inputFiles() if opened else [])} == {f.split("/")[-1] for f in opened}
    for lat, lon, radius in ((89.5, 0.0, 100_000.0), (0.0, 179.9, 50_000.0), (60.0, 10.0, 500_000.0)):
        s, w, n, e = PF.box_around(lat, lon, radius)
        for _ in range(500):
            p = (rng.uniform(-90, 90), rng.uniform(-180, 180)) if rng.random() < 0.3 else (min(90.0, lat + rng.uniform(-6, 6)), (lon + rng.uniform(-12, 12) + 180) % 360 - 180)
            assert _sphere((lat, lon), p) > radius or (s <= p[0] <= n and w <= p[1] <= e)
