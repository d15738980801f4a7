"""Climate records, export files and code hints on literal rows."""

import random

from pyspark.sql import functions as F

from arealis.model import EXPOSURE_COLUMNS, NEARBY_COLUMNS, PROJECT_COLUMNS
from arealis.operators import climate as C
from arealis.operators import export_files as X
from arealis.operators import quality as Q

SEA = [C.Measure("sealevel_cm", "level", 1, 0.0), C.Measure("surge100_cm", "surge", 1), C.Measure("surge_freq_x", "freq", 1, 1.0)]
RAIN = [C.Measure("rain100_1h_mm", "hour", 1)]
CELL = "stretch string, scenario int, period int, percentile int, absolute int, level double, surge double, freq double"
WET = "code string, scenario int, period int, percentile int, absolute int, hour double"


def _record(spark, risk=True):
    frame = spark.createDataFrame
    sea = [("S1", 0, 1, 50, 1, 0.0, 156.85, 1.0), ("S1", 245, 3, 50, 1, 24.89, 181.74, 4.2), ("S1", 245, 4, 50, 1, 39.44, 196.29, 9.0), ("S1", 245, 3, 10, 1, 15.0, 170.0, 2.0),
           ("S1", 126, 3, 50, 1, 20.0, 175.0, 3.0), ("S1", 585, 3, 50, 1, 30.0, 190.0, 6.0), ("S1", 245, 3, 90, 0, 999.0, 999.0, 999.0)]
    rain = [("101", 0, 1, 50, 1, 40.04), ("101", 45, 3, 50, 1, 44.96)]
    zones = [("101", "today", 5.0, 1000, 50, 1.5), ("101", "2070", None, 1000, 70, 2.0), ("147", "today", None, None, None, 0.0), ("190", "2070", None, None, None, None)]
    return C.record(
        frame([("101", "A"), ("147", "B"), ("151", "C"), ("190", "D")], "code string, name string"), frame([("101", "S1"), ("147", "S9"), ("190", "S1")], "code string, stretch string"),
        frame(sea, CELL), SEA, frame(rain, WET), RAIN, frame([("101", 12, 3.456)], "code string, claims long, claims_per_1000 double"),
        frame([("101", False), ("147", True)], "code string, marginal boolean") if risk else None,
        frame(zones, "code string, horizon string, surge_dw_pct double, dwellings long, dwellings_in_zone long, zone_km2 double"))


def test_climate_record(spark):
    rows = {(r.code, r.indicator, r.horizon): r for r in _record(spark).collect()}
    assert len(rows) == 4 * (3 * 3 + 3 + 1 + 1 + 3)
    level = [rows["101", "sealevel_cm", h] for h in ("today", "2070", "2120")]
    assert [r.value for r in level] == [0.0, 24.9, 39.4] and [r.reason for r in level] == [None] * 3
    assert (level[1].p10, level[1].p90, level[1].low, level[1].high) == (15.0, None, 20.0, 30.0) and level[0].low is None
    assert [rows["101", "surge100_cm", h].value for h in ("today", "2070", "2120")] == [156.9, 181.7, 196.3]
    assert rows["101", "surge_freq_x", "today"].value == 1.0
    assert rows["151", "sealevel_cm", "2070"].reason == C.NOT_COASTAL and rows["147", "sealevel_cm", "2070"].reason == C.NO_STRETCH and not rows["151", "sealevel_cm", "today"].coastal
    assert rows["147", "rain100_1h_mm", "today"].reason == C.NO_AREA_ROW and rows["101", "rain100_1h_mm", "2070"].value == 45.0
    assert rows["101", "weather_claims_1000", "today"].value == 3.5 and rows["101", "weather_claims_1000", "today"].claims == 12
    assert rows["151", "weather_claims_1000", "today"].reason == C.NOT_COMPUTED
    assert [(rows[c, "flood_risk_area", "today"].value, rows[c, "flood_risk_area", "today"].marginal) for c in ("101", "147", "151")] == [(1.0, False), (0.0, True), (0.0, False)]
    surge = {c: rows[c, "surge_dw_pct", "today"] for c in ("101", "147", "151", "190")}
    assert (surge["101"].value, surge["101"].dwellings, surge["101"].dwellings_in_zone, surge["101"].zone_km2, surge["101"].reason) == (5.0, 1000, 50, 1.5, None)
    assert rows["101", "surge_dw_pct", "2120"].value is None and rows["101", "surge_dw_pct", "2120"].dwellings == 1000
    assert [surge[c].reason for c in ("147", "151", "190")] == [C.NO_ZONE, C.NOT_COASTAL, C.NOT_COMPUTED] and surge["147"].zone_km2 == 0.0
    assert {r.reason for r in _record(spark, False).filter("indicator = 'flood_risk_area'").collect()} == {C.NOT_COMPUTED}


def test_project_and_exposure_files(spark):
    schema = ("id long, name string, type string, status string, notes string, open_year int, open_window string, open_year_original int, budget_mdkk double, agency string, "
              "geometry_kind string, length_km double, stations long, source_doc string, source_url string, updated string")
    items = spark.createDataFrame([(1, "M5", "metro", "decided", None, 2035, "2035-36", 2030, 17.5, None, "line", 12.345, 10, "doc", None, "2026"),
                                   (2, "Road", "road", "study", "maybe", None, None, None, None, "VD", None, None, None, None, "u", None)], schema)
    served = spark.createDataFrame([(1, "municipalities", "101 147"), (1, "quarters", "1.1"), (2, "postal_codes", "2100")], "project long, level string, codes string")
    got = {r.id: r for r in X.projects(items, served).collect()}
    assert X.projects(items, served).columns == PROJECT_COLUMNS
    assert tuple(got[1]) == (1, "M5", "metro", "decided", "", "2035-36", "2030", 17.5, "", "101 147", "", "1.1", "line", 12.35, 10, "doc", "", "2026")
    assert (got[2].opening, got[2].status_note, got[2].postal_codes, got[2].length_km) == ("", "maybe", "2100", None)
    rows = spark.createDataFrame([("kommune", "101", "today", 10, 2, 20.0, 1.5, None), ("kommune", "999", "2070", 5, 0, 0.0, None, "2026")],
                                 "level string, code string, horizon string, n long, n_in_zone long, pct double, zone_km2 double, as_of string")
    areas = spark.createDataFrame([("kommune", "101", "Kbh", None, None)], "level string, code string, name string, parent_code string, parent_name string")
    source = spark.createDataFrame([("src", "T1", "url", "2025", "2026-01-01", "free")], "source string, table_id string, source_url string, cat_as_of string, fetched string, licence string")
    out = X.exposure(rows, areas, source)
    assert out.columns == EXPOSURE_COLUMNS
    assert sorted(map(tuple, out.collect())) == [
        ("kommune", "101", "Kbh", "", "", "today", "2020", 10, 2, 20.0, 1.5, "derived", "src", "T1", "url", "2025", "2026-01-01", "free"),
        ("kommune", "999", None, "", "", "2070", "2070", 5, 0, 0.0, None, "projection", "src", "T1", "url", "2026", "2026-01-01", "free")]
    near = spark.createDataFrame([(1, "shop", "Kiosk", None, None, 12.6, "OSM", None)], "pin int, kind string, name string, type string, status string, dist double, source string, source_url string")
    assert X.nearby(near).columns == ["pin", *NEARBY_COLUMNS] and tuple(X.nearby(near).first()) == (1, "shop", "Kiosk", "", "", 13, "OSM", "")


def test_code_hints(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abAB1 é") for _ in range(rng.randint(1, 7)))
    known = [(rng.choice("TU"), "V", word()) for _ in range(150)]
    config = [(rng.choice("TU"), "V", word()) for _ in range(150)] + known[:10] + [("X", "V", "ab"), ("T", "W", "ab"), ("T", "V", "")]
    got = {(r.table, r.var, r.code): r.hints for r in Q.unknown_codes(spark.createDataFrame(config, "table string, var string, code string"), spark.createDataFrame(known, "table string, var string, code string")).collect()}
    want = {}
    for t, v, c in set(config) - set(known):
        hints = sorted({k for a, b, k in known if (a, b) == (t, v) and c and (c.lower() in k.lower() or k.lower() in c.lower())}, key=lambda s: s.encode())
        want[t, v, c] = ",".join(hints) or None
    assert got == want
    assert Q.unknown_codes(spark.createDataFrame(known, "table string, var string, code string"), spark.createDataFrame(known, "table string, var string, code string")).select(F.count("*")).first()[0] == 0
