"""Column functions against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arealis.functions import classify as K
from arealis.functions import geometry as G
from arealis.functions import parsing as P
from arealis.functions import ranking as R
from arealis.functions import text as X


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_numbers(spark):
    assert values(spark, ["2.351", "7,3", "100,0 %", "1 234", "..", "*", "", None, "x"], P.danish_number) == [2351.0, 7.3, 100.0, None, None, None, None, None, None]
    assert values(spark, [" 1 234,5 ", "..", "–", ".", "-", None, "abc", "7"], P.cube_number) == [1234.5, None, None, None, None, None, None, 7.0]


def test_codes_and_periods(spark):
    assert values(spark, ["0101", "101", "K 0147", "000"], P.municipality_code) == ["101", "101", "147", "0"]
    assert values(spark, ["2026K2", "2026K4"], lambda c: P.shift_quarter(c, 1)) == ["2026K3", "2027K1"]
    assert values(spark, ["2026K1"], lambda c: P.shift_quarter(c, -4)) == ["2025K1"]
    assert values(spark, ["2026", "2026K3", "2026Q3", "2026M07", "x"], P.period_order) == [202600, 202609, 202609, 202607, 0]
    assert values(spark, ["2025K3→2026K2", "2025K1–2025K4", "2024K1→2024K4 vs 4Q before", "2023"], P.label_year) == [2026, 2025, 2024, 2023]


LOCATIONS = {
    "55.67610, 12.56830": (55.6761, 12.5683, "plain"),
    "55.67610;12.56830": (55.6761, 12.5683, "plain"),
    "55.67610 12.56830": (55.6761, 12.5683, "plain"),
    "https://x/maps/place/N/@55.6,12.5,17z/data=!3d55.67610!4d12.56830": (55.6761, 12.5683, "place"),
    "https://x/maps/@55.6,12.5,17z": (55.6, 12.5, "at"),
    "https://x/maps?q=55.6%2C12.5": (55.6, 12.5, "param"),
    "https://x/maps/search/55.6,+12.5": (55.6, 12.5, "search"),
    "12.5, 55.6": "outside_dk",
    "https://maps.app.goo.gl/abc": "short_link",
    "": "empty",
    "hello": "no_match",
    "100% 55": "no_match",
}


def test_locations(spark):
    got = values(spark, list(LOCATIONS), P.parse_location)
    for (text, want), r in zip(LOCATIONS.items(), got):
        if isinstance(want, str):
            assert r.error == want and r.lat is None, text
        else:
            assert (r.lat, r.lon, r.source, r.error) == (*want, None), text


def test_export_cells(spark):
    assert values(spark, ["a;b\n c\t d", None, "  x  "], P.csv_cell) == ["a,b c d", "", "x"]
    df = spark.createDataFrame([(1.0,), (1.5,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in df.select(P.csv_number("v")).collect()] == ["1", "1.5", "", "", ""]


def test_table_ids_and_links(spark):
    assert values(spark, ["Københavns Kommune, KKBOL3", "BOL101 and FOLK1A", None], P.city_table_id) == ["KKBOL3", "", ""]
    assert values(spark, ["DST PRIS01", "none", None], P.state_table_id) == ["PRIS01", "", ""]
    assert values(spark, ["dst/FOLK1A", "s20/BM030", "bbr", "x/Y1"], P.table_info_url)[:2] == ["https://api.statbank.dk/v1/tableinfo/FOLK1A", "https://api.statbank.dk/v1/s20/tableinfo/BM030"]


def test_stop_names(spark):
    names = ["Nørreport St. (Metro)", "Nørreport st", "Nørreport Station (x) (y)", "Kgs. Nytorv", "A  B"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    d = X.with_unicode_form(df, "n", "c").select("i", X.stop_name_key(F.col("c")).alias("k")).orderBy("i")
    assert [r.k for r in d.collect()] == ["nørreport", "nørreport", "nørreport", "kgs nytorv", "a b"]


def test_unicode_forms_meet(spark):
    df = spark.createDataFrame([("Aarhus Kommune",), ("Århus",), ("Århus",)], "n string")
    keys = {r.k for r in X.with_unicode_form(df, "n", "c", "NFKC").select(X.area_name_key(F.col("c")).alias("k")).collect()}
    assert keys == {"aarhus"}


def test_age_groups(spark):
    assert values(spark, ["0", "05", "6", "19", "34", "64", "79", "80", "100-", "99", "TOT", "IALT"], K.age_group) == [
        "a0_5", "a0_5", "a6_16", "a17_19", "a20_34", "a35_64", "a65_79", "a80p", "a80p", "a80p", None, None]


def test_service_tags(spark):
    df = spark.createDataFrame([(1, {"shop": "convenience", "amenity": "cafe"}), (2, {"amenity": "pharmacy"}), (3, {"shop": "bakery"}), (4, {"amenity": "bar"})], "i int, t map<string,string>")
    got = {r.i: r.c for r in df.select("i", K.service_class(F.col("t")).alias("c")).collect()}
    assert (got[1].cat, got[1]["sub"], got[1].n_hits) == ("grocery", "convenience", 2)
    assert got[2].cat == "pharmacy" and got[3] is None and got[4]["sub"] == "bar"


def test_period_types(spark):
    assert values(spark, ["2026", "2026K3", "2026M07", "2024/2025", "2025K3→2026K2", "2020–2025", "2026-01-02", "BBR"], K.period_type) == [
        "year", "quarter", "month", "school_year", "window", "window", "snapshot", "snapshot"]


@pytest.mark.parametrize("seed", range(3))
def test_positions_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    shapes = [lambda: rnd.lognormvariate(0, 6), lambda: float(rnd.randint(0, 4)), lambda: 1e9 + rnd.random(), lambda: -rnd.lognormvariate(0, 3), lambda: 7.0]
    rows = [(g, shapes[g]()) for g in range(5) for _ in range(200)] + [(0, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {(r.g, r.v): (r.n, r.n_less, r.n_total) for r in R.positions(df, ["g"], "v").collect()}
    for g, v in rows:
        if v is None:
            continue
        xs = [x for k, x in rows if k == g and x is not None]
        assert got[(g, v)] == (xs.count(v), sum(x < v for x in xs), len(xs))


def test_median_of_even_and_odd_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", 1.0), ("b", 3.0), ("c", None)], "g string, v double")
    assert {r.g: r.median for r in R.medians(df, ["g"], "v").collect()} == {"a": 2.0, "b": 2.0}


SQUARE = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
HOLE = [(4.0, 4.0), (4.0, 6.0), (6.0, 6.0), (6.0, 4.0)]
NEXT = [(0.0, 10.0), (0.0, 20.0), (10.0, 20.0), (10.0, 10.0)]


def test_point_in_polygon_cases(spark):
    poly = spark.createDataFrame([("a", [[SQUARE, HOLE]]), ("b", [[NEXT]])], f"code string, polygon {G.POLYGON}")
    pts = spark.createDataFrame([("in", 1.0, 1.0), ("out", 11.0, 1.0), ("hole", 5.0, 5.0), ("edge", 5.0, 10.0)], "id string, lat double, lon double")
    got = {}
    for r in pts.crossJoin(poly).select("id", "code", G.in_polygon(F.col("polygon"), F.col("lat"), F.col("lon")).alias("i")).collect():
        got.setdefault(r.id, []).append((r.code, r.i))
    hits = {k: [c for c, i in v if i] for k, v in got.items()}
    assert hits["in"] == ["a"] and hits["out"] == [] and hits["hole"] == []
    assert len(hits["edge"]) == 1  # a shared edge belongs to exactly one of two neighbours


def test_known_distances(spark):
    c = lambda v: F.lit(float(v))
    row = spark.range(1).select(
        G.haversine(c(55), c(12), c(56), c(12)).alias("degree"), G.haversine(c(55), c(12), c(55), c(12)).alias("zero"),
    ).first()
    assert row.degree == pytest.approx(G.EARTH_MEAN * math.pi / 180, rel=1e-12) and row.zero == 0


def test_projection_against_the_meridian(spark):
    """On the central meridian the northing is the scaled length of the meridian arc."""
    a, f = 6378137.0, 1 / 298.257222101
    e2, n, top = f * (2 - f), 20000, math.radians(55)
    h = top / n
    g = lambda p: a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    arc = h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * g(i * h) for i in range(n + 1))
    x, y = G.to_utm32(F.lit(55.0), F.lit(9.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(500000, abs=1e-6) and r.y == pytest.approx(arc * 0.9996, abs=1e-3)


def test_projection_round_trip(spark):
    d = spark.createDataFrame([(54.6, 8.1), (55.7, 12.6), (55.1, 15.1), (57.7, 10.6)], "lat double, lon double")
    x, y = G.to_utm32(F.col("lat"), F.col("lon"))
    lat, lon = G.from_utm32(F.col("x"), F.col("y"))
    for r in d.select("lat", "lon", x.alias("x"), y.alias("y")).select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
        assert r.a == pytest.approx(r.lat, abs=1e-9) and r.b == pytest.approx(r.lon, abs=1e-9)


def test_positions_with_outliers_on_either_side(spark):
    from arealis.functions import ranking

    for far in (-1e9, 1e9):
        df = spark.range(20_000).select(F.when(F.col("id") == 0, far).otherwise(F.col("id").cast("double")).alias("v"), (F.col("id") % 2).alias("g"))
        rows = ranking.positions(df, ["g"], "v").collect()
        for g in (0, 1):
            own = sorted((r.v, r.n_less, r.n_total) for r in rows if r.g == g)
            assert [x[1] for x in own] == list(range(10_000)) and own[0][2] == 10_000
        borders = df.agg(F.percentile_approx("v", F.array(*[F.lit(x) for x in ranking._SHARES]), F.lit(5120)).alias("b"))
        sizes = df.join(borders, F.lit(True)).groupBy(ranking._bucket(F.col("b"), F.col("v"))).count().agg(F.max("count")).first()[0]
        assert sizes < 3 * 20_000 / ranking._BUCKETS
