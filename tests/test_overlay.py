"""Geometries against areas, by brute force over all pairs."""

import random

from pyspark.sql import functions as F

from arealis.operators import overlay as O

SCHEMA = "id string, polygon array<array<array<struct<lat:double,lon:double>>>>, path array<struct<lat:double,lon:double>>"


def _turn(p, a, b):
    x = (b[1] - a[1]) * (p[0] - a[0]) - (b[0] - a[0]) * (p[1] - a[1])
    return (x > 0) - (x < 0)


def _on(p, a, b):
    return _turn(p, a, b) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _meet(e, f):
    if _turn(f[0], *e) * _turn(f[1], *e) < 0 and _turn(e[0], *f) * _turn(e[1], *f) < 0:
        return True
    return any(_on(p, *e) for p in f) or any(_on(p, *f) for p in e)


def _odd(p, ring):
    n = 0
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a[0] > p[0]) != (b[0] > p[0]) and p[1] < (b[1] - a[1]) * (p[0] - a[0]) / (b[0] - a[0]) + a[1]:
            n += 1
    return n % 2 == 1


def _in(p, polygon):
    return any(part and _odd(p, part[0]) and not any(_odd(p, h) for h in part[1:]) for part in polygon)


def _segments(polygon, path):
    if polygon is not None:
        return [(a, b) for part in polygon for r in part for a, b in zip(r, r[1:] + r[:1], strict=True)]
    return [(path[0], path[0])] if len(path) == 1 else list(zip(path, path[1:], strict=False))


def _touch(polygon, path, area):
    if any(_meet(e, f) for e in _segments(polygon, path) for f in _segments(area, None)):
        return True
    ends = [part[0][0] for part in polygon] if polygon is not None else path[:1]
    return any(_in(p, area) for p in ends) or (polygon is not None and any(_in(part[0][0], polygon) for part in area))


def _box(s, w, n, e):
    return [(s, w), (s, e), (n, e), (n, w)]


def _rows(items):
    pt = lambda p: {"lat": float(p[0]), "lon": float(p[1])}
    out = []
    for i, polygon, path in items:
        out.append((i, None if polygon is None else [[[pt(p) for p in r] for r in part] for part in polygon], None if path is None else [pt(p) for p in path]))
    return out


def test_touching(spark):
    rng = random.Random(11)
    areas = {
        "ring": [[_box(0, 0, 10, 10), _box(2, 2, 8, 8)], [_box(4, 4, 5, 5)]],  # an island in its own hole
        "next": [[_box(0, 10, 10, 20)]],
        "far": [[_box(-40, -40, -39, -39)]],
    }
    fixed = {
        "in hole": ([[_box(6, 6, 7, 7)]], None), "around island": ([[_box(3, 3, 7, 7), _box(3.5, 3.5, 6, 6)]], None), "on island": ([[_box(4.2, 4.2, 4.4, 4.4)]], None),
        "edge to edge": ([[_box(10, 3, 12, 4)]], None), "corner": ([[_box(10, 20, 12, 22)]], None), "covers all": ([[_box(-90, -90, 90, 90)]], None),
        "hole over far": ([[_box(-60, -60, -20, -20), _box(-50, -50, -30, -30)]], None), "far twice": ([[_box(50, 50, 51, 51)], [_box(-39.5, -39.5, -38, -38)]], None),
        "p border": (None, [(5, 10)]), "p inside": (None, [(1, 1)]), "p hole": (None, [(3, 3)]), "p corner": (None, [(10, 20)]), "p out": (None, [(30, 30)]),
        "l through": (None, [(-1, 5), (11, 5)]), "l in hole": (None, [(2.5, 2.5), (2.5, 7)]), "l along": (None, [(0, 2), (0, 3)]), "l inside": (None, [(1, 1), (1, 9)]),
        "empty": (None, []), "none": (None, None), "no parts": ([], None),
    }
    geoms = [(k, *v) for k, v in fixed.items()]
    for i in range(120):
        lat, lon, size = rng.uniform(-3, 13), rng.uniform(-3, 23), rng.choice([0.2, 1, 4])
        if rng.random() < 0.5:
            geoms.append((f"r{i}", None, [(lat + rng.uniform(-size, size), lon + rng.uniform(-size, size)) for _ in range(rng.randint(1, 4))]))
        else:
            geoms.append((f"r{i}", [[_box(lat, lon, lat + size, lon + size)] + ([_box(lat + size / 4, lon + size / 4, lat + size / 2, lon + size / 2)] if rng.random() < 0.5 else [])], None))
    df = spark.createDataFrame(_rows(geoms + [("copy", *fixed["corner"])]), SCHEMA)
    ar = spark.createDataFrame(_rows([(k, v, None) for k, v in areas.items()]), SCHEMA).select(F.col("id").alias("code"), "polygon")
    want = {(i, c) for i, g, p in [*geoms, ("copy", *fixed["corner"])] if g or p for c, a in areas.items() if _touch(g, p, a)}
    for cell in (0.5, 3.0):
        got = [tuple(r) for r in O.touching(df, ar, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {("corner", "next"), ("copy", "next"), ("p border", "ring"), ("covers all", "far"), ("far twice", "far"), ("around island", "ring")} - want == {("around island", "ring")}
    assert not {i for i, c in want if i in ("in hole", "p hole", "l in hole", "p out")} and not {("hole over far", "far")} & want
    assert O.touching(df.limit(0), ar, 1.0).count() == 0 and O.touching(df, ar.limit(0), 1.0).count() == 0
