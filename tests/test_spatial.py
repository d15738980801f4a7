"""Spatial joins and clusters against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arealis.functions import geometry as G
from arealis.operators import graph, spatial as S

R_EARTH = 6371008.8


def metres(a, b):
    la, lo, lb, ob = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 2 * R_EARTH * math.asin(math.sqrt(h))


def points(seed, n, spread=0.05, copies=0):
    rnd = random.Random(seed)
    out = [(i, 55.5 + rnd.random() * spread, 12.5 + rnd.random() * spread) for i in range(n)]
    return out + [(n + i, 55.52, 12.52) for i in range(copies)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, lat double, lon double")


def ring_contains(ring, lat, lon):
    odd = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        if (a > lat) != (c > lat) and lon < (d - b) * (lat - a) / (c - a) + b:
            odd = not odd
    return odd


@pytest.mark.parametrize("cell", [0.003, 0.02, 0.5])
def test_locate_for_any_cell_size(spark, cell):
    rnd = random.Random(5)
    shapes = {}
    for k in range(6):
        cy, cx = 55.5 + rnd.random() * 0.05, 12.5 + rnd.random() * 0.05
        angles = sorted(rnd.random() * 2 * math.pi for _ in range(9))
        shapes[f"p{k}"] = [(cy + 0.02 * math.sin(t), cx + 0.03 * math.cos(t)) for t in angles]
    poly = spark.createDataFrame([(k, [[r]]) for k, r in shapes.items()], f"code string, polygon {G.POLYGON}")
    pts = points(1, 300)
    got = {r.id: r.code for r in S.locate(frame(spark, pts), S.area_index(poly, cell), cell).collect()}
    for i, la, lo in pts:
        inside = sorted(k for k, r in shapes.items() if ring_contains(r, la, lo))
        assert got[i] == (inside[0] if inside else None)


def test_within_radius_and_nearest(spark):
    a, b = points(2, 120, copies=5), points(3, 120, copies=5)
    da, db = frame(spark, a), frame(spark, b)
    got = {(r.a_id, r.b_id) for r in S.within_radius(da, db, 700.0).collect()}
    want = {(i, j) for i, *p in a for j, *q in b if metres(p, q) <= 700.0}
    assert got == want
    near = {r.id: r.nearest_name for r in S.nearest(da, db.withColumn("name", F.lpad(F.col("id").cast("string"), 4, "0")), 700.0, "name").collect()}
    for i, *p in a:
        close = sorted((round(metres(p, q), 6), f"{j:04d}") for j, *q in b if metres(p, q) <= 700.0)
        assert near[i] == (close[0][1] if close else None)


@pytest.mark.parametrize("radius", [150.0, 600.0, 3000.0])
def test_clusters_match_union_find(spark, radius):
    pts = points(7, 150, copies=20)
    parent = {i: i for i, *_ in pts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, *p) in enumerate(pts):
        for j, *q in pts[x + 1:]:
            if metres(p, q) <= radius and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    df = frame(spark, pts).withColumn("g", F.lit("one"))
    got = {r.id: r.component for r in graph.single_linkage(df, ["g"], radius).collect()}
    assert got == {i: root(i) for i, *_ in pts}


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200)
    edges = spark.range(199).filter("id <> 99").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {i: (0 if i <= 99 else 100) for i in range(200)}


def test_tolerance_around_a_zone(spark):
    square = [(55.0, 12.0), (55.0, 12.1), (55.1, 12.1), (55.1, 12.0)]
    z = spark.createDataFrame([("z", [[square]])], f"code string, polygon {G.POLYGON}")
    step = 3 / 110540
    pts = frame(spark, [(1, 55.05, 12.05), (2, 55.1 + step, 12.05), (3, 55.1 + 3 * step, 12.05)])
    got = {r.id: r.code for r in S.locate(pts, S.area_index(z, 0.02, tolerance_m=5.0), 0.02, tolerance_m=5.0).collect()}
    assert got == {1: "z", 2: "z", 3: None}


def test_line_and_area_touch(spark):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    poly = spark.createDataFrame([("a", [[square]])], f"code string, polygon {G.POLYGON}")
    lines = spark.createDataFrame([
        (1, [(-1.0, 0.5), (2.0, 0.5)]), (2, [(0.4, 0.4), (0.6, 0.6)]), (3, [(2.0, 2.0), (3.0, 3.0)]), (4, [(1.0, 1.0), (2.0, 2.0)]),
    ], "id int, path array<struct<lat:double,lon:double>>")
    assert sorted(r.id for r in S.lines_touch_areas(lines, poly, 0.25).collect()) == [1, 2, 4]


def test_coverage_area(spark):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    hole = [(0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25)]
    poly = spark.createDataFrame([("a", [[square, hole]])], f"code string, polygon {G.POLYGON}")
    assert S.coverage(poly, 0.125).count() == 64 - 16


def _around(lat, lon, n, spread_m, seed):
    """Points scattered over a square of ``spread_m`` metres, longitudes kept within a half turn."""
    rng = random.Random(seed)
    side = spread_m / 111_000
    wide = side / max(math.cos(math.radians(lat)), 1e-3)
    wrap = lambda x: (x + 180) % 360 - 180
    return [(i, max(-90.0, min(90.0, lat + rng.uniform(-side, side) / 2)), wrap(lon + rng.uniform(-wide, wide) / 2)) for i in range(n)]


def _metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize(("lat", "lon"), [(0, 12), (45, -30), (-45, 180), (68, 10), (-68, -180), (80, 179.999), (-80, 0), (89.99, 100)])
def test_distances_at_every_latitude(spark, lat, lon):
    pts = _around(lat, lon, 120, 2500, seed=lat)
    df = spark.createDataFrame(pts, "id int, lat double, lon double").coalesce(2)
    got = {(r.a_id, r.b_id) for r in S.within_radius(df, df, 150).select("a_id", "b_id").collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if _metres(a, b) <= 150}


@pytest.mark.parametrize(("lat", "lon"), [(0, 12), (-68, 180), (80, -30)])
def test_clusters_at_every_latitude(spark, lat, lon):
    from arealis.operators.graph import single_linkage

    pts = _around(lat, lon, 90, 1200, seed=7)
    root = list(range(len(pts)))
    for a in pts:
        for b in pts:
            if _metres(a, b) <= 60 and root[a[0]] != root[b[0]]:
                x, y = sorted((root[a[0]], root[b[0]]))
                root = [x if r == y else r for r in root]
    df = spark.createDataFrame([(*p, "g") for p in pts], "id int, lat double, lon double, g string").coalesce(2)
    got = {r.id: r.component for r in single_linkage(df, ["g"], 60.0).collect()}
    assert got == dict(enumerate(root))


def test_contracted_components_against_union_find(spark):
    """Chains, rings, stars, repeated and looping links; every component gets one of its own members."""
    links = [(i, i + 1) for i in range(150)] + [(200 + i, 200 + (i + 1) % 40) for i in range(40)] + [(300, 300 + i) for i in range(1, 60)]
    links += [(500, 501), (501, 500), (500, 500), (600, 600)]
    name = lambda i: "chain" if i <= 150 else {2: "ring", 3: "star", 5: "pair"}[i // 100]
    want = {i: name(i) for a, b in links if a != b for i in (a, b)}
    got = {r.id: r.component for r in graph.contracted(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got.keys() == want.keys()
    names = {n: {got[i] for i in want if want[i] == n} for n in set(want.values())}
    assert all(len(c) == 1 and want[next(iter(c))] == n for n, c in names.items())
    assert graph.contracted(spark.createDataFrame([], "a long, b long")).count() == 0


def test_single_linkage_keeps_null_groups_and_empty_input(spark):
    rows = [(1, 55.0, 12.0, None), (2, 55.0001, 12.0, None), (3, 55.0, 12.0, "x"), (4, 56.0, 12.0, None)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double, g string")
    assert {r.id: r.component for r in graph.single_linkage(df, ["g"], 60.0).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert graph.single_linkage(df.filter("id > 9"), ["g"], 60.0).count() == 0
