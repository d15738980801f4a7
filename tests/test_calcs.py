"""Calculations on literal rows with known answers."""

import pytest

from arealis.model import Cube, IndicatorSpec
from arealis.operators import calcs as C

# published counts of one area and its population (fixed values)
COUNTS = {"2025K3": 15323.0, "2025K4": 14713.0, "2026K1": 15205.0, "2026K2": 15045.0}
RATE = IndicatorSpec("crime", "rolling4q_per_1000_pop", select={"code": "1"})


def counts(spark, cells, code="1", area="101"):
    rows = [(area, code, t, None if v is None else float(v)) for t, v in cells.items()]
    return Cube(spark.createDataFrame(rows, "area string, code string, period string, value double"), dims=("code",))


def plain(spark, cells, area="101"):
    return Cube(spark.createDataFrame([(area, t, float(v)) for t, v in cells.items()], "area string, period string, value double"))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_rolling_rate(spark):
    r = one(C.live({"num": counts(spark, COUNTS), "den": plain(spark, {"2026K2": 1, "2026K3": 670389})}, RATE))
    assert r.period == "2025K3→2026K2"
    assert r.value == pytest.approx(60286 / 670.389, abs=1e-9)


def test_population_falls_back_to_last_quarter(spark):
    r = one(C.live({"num": counts(spark, COUNTS), "den": plain(spark, {"2026K2": 670000})}, RATE))
    assert r.value == pytest.approx(60286 / 670.0)


def test_suppressed_quarter_is_null_row(spark):
    r = one(C.live({"num": counts(spark, {**COUNTS, "2026K1": None}), "den": plain(spark, {"2026K3": 670389})}, RATE))
    assert r.value is None


def test_incomplete_window_gives_nothing(spark):
    cells = {k: v for k, v in COUNTS.items() if k != "2025K4"}
    assert C.live({"num": counts(spark, cells), "den": plain(spark, {"2026K3": 1})}, RATE).count() == 0


def test_newest_window_incomplete_does_not_fall_back(spark):
    cells = {f"{y}K{q}": 1.0 for y in (2023, 2024) for q in (1, 2, 3, 4)} | {"2025K2": 1.0}
    assert C.live({"num": counts(spark, cells), "den": plain(spark, {"2025K2": 1, "2025K1": 1})}, RATE).count() == 0


def test_several_codes_are_summed(spark):
    df = counts(spark, {t: 10 for t in COUNTS}, "3210").df.unionByName(counts(spark, {t: 5 for t in COUNTS}, "3410").df).unionByName(
        counts(spark, {t: 999 for t in COUNTS}, "1").df)
    spec = IndicatorSpec("x", "rolling4q_per_1000_pop", select={"code": ["3210", "3410"]})
    r = one(C.live({"num": Cube(df, dims=("code",)), "den": plain(spark, {"2026K3": 1000})}, spec))
    assert r.value == pytest.approx(60.0)


def test_history_uses_calendar_years(spark):
    cells = {f"2025K{q}": 100.0 * q for q in (1, 2, 3, 4)} | {"2026K1": 7.0}
    r = one(C.history({"num": counts(spark, cells), "den": plain(spark, {"2025K4": 1, "2026K1": 2000})}, RATE))
    assert (r.year, r.period, r.value) == ("2025", "2025K1→2025K4", pytest.approx(500.0))


def test_rolling_change_is_filed_under_its_own_year(spark):
    cells = {f"{y}K{q}": (100.0 if y == 2024 else 110.0) for y in (2024, 2025) for q in (1, 2, 3, 4)}
    r = one(C.history({"num": counts(spark, cells)}, IndicatorSpec("y", "rolling4q_yoy_pct", select={"code": "1"})))
    assert r.year == "2025" and r.value == pytest.approx(10.0)


def test_stock_at_end_of_window(spark):
    stock = plain(spark, {"2025": 900, "2026": 1000})
    spec = IndicatorSpec("b", "rolling4q_per_1000_dwellings", select={"code": "1320"})
    r = one(C.live({"num": counts(spark, COUNTS, "1320"), "den": stock}, spec))
    assert r.value == pytest.approx(60286.0)


def test_ratio(spark):
    r = one(C.live({"num": plain(spark, {"2025": 11763}), "den": plain(spark, {"2025": 68802})}, IndicatorSpec("c", "ratio_pct")))
    assert round(r.value, 1) == 17.1


def test_zero_and_missing_cells_in_year_on_year(spark):
    df = spark.createDataFrame([("1", "2024", 0.0), ("1", "2025", 5.0), ("2", "2024", 4.0), ("2", "2025", 5.0), ("3", "2025", 1.0)], "area string, period string, value double")
    rows = C.live({"num": Cube(df)}, IndicatorSpec("y", "yoy_pct")).collect()
    assert [(r.area, round(r.value, 6), r.period) for r in rows] == [("2", 25.0, "2024→2025")]


def test_last_four_published_periods_skip_zero(spark):
    cells = {"2020K1": 100, "2021K1": 0, "2022K1": 4, "2023K1": 6, "2024K1": 8}
    r = one(C.live({"num": plain(spark, cells)}, IndicatorSpec("m", "last4q_mean")))
    assert (r.period, r.value) == ("2021K1–2024K1", pytest.approx(6.0))


def test_history_of_point_figures_uses_the_newest_sub_period(spark):
    cells = {"2024K1": 1, "2024K2": 2, "2024K4": 9, "2025K1": 3, "2025K2": 4}
    rows = C.history({"num": plain(spark, cells)}, IndicatorSpec("p", "passthrough")).collect()
    assert sorted((r.year, r.value) for r in rows) == [("2024", 2.0), ("2025", 4.0)]


def test_a_broken_spec_only_warns(spark):
    cube = plain(spark, {"2025": 5})
    specs = [IndicatorSpec("ok", "passthrough"), IndicatorSpec("bad", "no_such"), IndicatorSpec("worse", "share_of_total")]
    out, warnings = C.compute_registry({s.key: {"num": cube} for s in specs}, specs)
    assert [r.key for r in out.collect()] == ["ok"] and len(warnings) == 2


def test_denominator_period_of_live_and_past_figures(spark):
    num, den = plain(spark, {"2023": 10, "2024": 20}), plain(spark, {"2022": 50, "2024": 100, "2025": 200})
    spec = IndicatorSpec("r", "ratio_pct")
    assert one(C.live({"num": num, "den": den}, spec)).value == pytest.approx(10.0)
    assert {r.year: r.value for r in C.history({"num": num, "den": den}, spec).collect()} == {"2023": pytest.approx(20.0), "2024": pytest.approx(20.0)}
    assert one(C.live({"num": num, "den": den}, IndicatorSpec("r", "ratio_own_year_pct"))).value == pytest.approx(20.0)
