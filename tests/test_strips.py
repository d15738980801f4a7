"""Areas and overlaps by strips against exact figures."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from arealis.functions import geometry as G
from arealis.operators import strips as R


def _area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def _clip(ring, by):
    """Ring cut to a convex ring that runs with its inside on the left."""
    for p, q in zip(by, by[1:] + by[:1], strict=True):
        side = lambda t: (q[1] - p[1]) * (t[0] - p[0]) - (q[0] - p[0]) * (t[1] - p[1])  # noqa: E731, B023
        out = []
        for s, t in zip(ring, ring[1:] + ring[:1], strict=True) if ring else []:
            a, b = side(s), side(t)
            if a >= 0:
                out.append(s)
            if a * b < 0:
                out.append((s[0] + (t[0] - s[0]) * a / (a - b), s[1] + (t[1] - s[1]) * a / (a - b)))
        ring = out
    return ring


def _convex(rnd, y, x, size):
    turns = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(6))
    return [(y + size * math.sin(t), x + size * math.cos(t)) for t in turns]


def _layer(spark, shapes):
    return spark.createDataFrame([(k, [[r] for r in parts]) for k, parts in shapes.items()], f"code string, polygon {G.POLYGON}")


@pytest.mark.parametrize("max_error", [0.5, 0.01])
def test_overlap_lies_within_the_stated_error(spark, max_error):
    rnd = random.Random(3)
    a = {f"a{i}": _convex(rnd, rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.uniform(0.1, 2)) for i in range(12)}
    b = {f"b{i}": _convex(rnd, rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.uniform(0.5, 3)) for i in range(8)}
    rows = R.overlap_within(_layer(spark, {k: [r] for k, r in a.items()}), _layer(spark, {k: [r] for k, r in b.items()}), max_error).collect()
    got = {(r.a, r.b): r for r in rows}
    for k, s in a.items():
        for m, t in b.items():
            true = _area(_clip(s, t))
            if (k, m) in got:
                assert abs(got[k, m].area - true) <= got[k, m].error <= max_error
            else:
                assert true <= max_error
    for k in a:
        mine = sorted((r for r in rows if r.a == k), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(1, len(mine) + 1))
        assert all(x.area >= y.area - 1e-9 for x, y in zip(mine, mine[1:], strict=False))


def test_parts_that_overlap_and_holes(spark):
    square = lambda s, w, n, e: [(s, w), (s, e), (n, e), (n, w)]
    two = [[square(0.0, 0.0, 2.0, 2.0)], [square(1.0, 1.0, 3.0, 3.0)]]
    holed = [[square(0.0, 0.0, 4.0, 4.0), square(1.0, 1.0, 3.0, 3.0)]]
    rows = [("two", two), ("two", two), ("holed", holed), ("none", []), ("null", None)]
    df = spark.createDataFrame(rows, f"code string, polygon {G.POLYGON}")
    got = {r.code: r for r in R.area_within(df, 0.001).collect()}
    assert got.keys() == {"two", "holed"}  # what has no vertices has no area to state
    assert abs(got["two"].area - 7) <= got["two"].error <= 0.001
    assert abs(got["holed"].area - 12) <= got["holed"].error <= 0.001
    assert R.area_within(df.filter("code = 'none'"), 0.001).count() == 0
    assert R.overlap_within(df.filter("code = 'none'"), df, 0.001).count() == 0


def test_rows_follow_the_border_and_not_the_area(spark):
    tall = lambda width: _layer(spark, {"x": [[(0.0, 0.0), (0.0, width), (8.0, width), (8.0, 0.0)]]})
    height = F.lit(0.125)
    assert R.spans(tall(1.0), height).count() == R.spans(tall(1000.0), height).count() == 64
    coarse, fine = (R.spans(tall(1.0), R.strip_height([R.sideways_travel(tall(1.0))], e)).count() for e in (0.25, 0.0625))
    assert fine == 4 * coarse
