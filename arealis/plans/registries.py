"""The compiled indicator registry over the derived cubes and the builds of other operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import IndicatorSpec
from ..operators.registry import Entry, Snapshot, compile_registry, merged
from . import indicators as I
from . import projections, registers, scans
from . import tables as T
from .common import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_SPEC = IndicatorSpec
CALCULATED = [
    Entry(_SPEC("urgent_n", "passthrough", "nation", select=I.URGENT), "ORDERS1"),
    Entry(_SPEC("urgent_k", "value_div_1000", "nation", select=I.URGENT, display_div=1000.0), "ORDERS1"),
    Entry(_SPEC("high_share", "share_of_total", "nation", share={"var": "prio", "num": I.HIGH}), "ORDERS1"),
    Entry(_SPEC("medium_yoy", "yoy_pct", "nation", select={"prio": "3-MEDIUM"}), "ORDERS1"),
    Entry(_SPEC("mean4", "last4q_mean", "nation"), "ORDERS1"),
    Entry(_SPEC("sum4", "sum4q", "nation"), "ORDERS1"),
    Entry(_SPEC("sum4_stock", "sum4q_per_1000", "nation"), "ORDERS1", "STOCK1"),
    Entry(_SPEC("discount", "discount_pct", "nation", share={"var": "price", "ask": "UDBUD", "real": "REAL"}), "PRICE1"),
    Entry(_SPEC("urgent_ratio", "ratio_pct", "nation", select=I.URGENT), "ORDERS1", "POP1"),
    Entry(_SPEC("per_stock", "per_1000_dwellings", "nation"), "ORDERS1", "STOCK1"),
    Entry(_SPEC("rate", "rolling4q_per_1000_pop", "nation", select=I.SPEC_POP.select), "ORDERS1", "POP1"),
    Entry(_SPEC("rate_stock", "rolling4q_per_1000_dwellings", "nation", select=I.SPEC_POP.select), "ORDERS1", "STOCK1"),
    Entry(_SPEC("rolling_yoy", "rolling4q_yoy_pct", "nation", select=I.SPEC_POP.select), "ORDERS1"),
]
PAST = [
    Entry(_SPEC("urgent_low", "share_of_total", "nation", share={"var": "prio", "num": ["1-URGENT"], "den": ["1-URGENT", "5-LOW"]}), "ORDERS1"),
    *[e for e in CALCULATED if e.spec.key in ("sum4", "urgent_ratio", "rate")],
]
BUILT = [
    Entry(_SPEC("renters_pct", "bbr", "nation")), Entry(_SPEC("dwelling_m2", "bbr", "region"), column="avg_m2"), Entry(_SPEC("growth_5y", "forecast", "nation")),
    Entry(_SPEC("new_dwellings", "net_dwellings", "nation"), column="per_1000"), Entry(_SPEC("public_m2", "public_index", "nation"), column="m2_existing"),
    Entry(_SPEC("public_recent", "public_index", "nation"), column="recent"), Entry(_SPEC("stations_planned", "infra_index", "nation")),
    Entry(_SPEC("grade_avg", "schools", "nation")), Entry(_SPEC("sea_level", "climate", "customer", display_div=100.0), column="value"),
    Entry(_SPEC("from_file", "external", "nation"), column="value"),
]
BROKEN = [
    Entry(_SPEC("no_calc", "no_such_calc"), "ORDERS1"), Entry(_SPEC("no_cube", "passthrough"), "GONE9"), Entry(_SPEC("no_dim", "passthrough", select={"age": "1"}), "ORDERS1"),
    Entry(_SPEC("no_field", "schools"), column="teachers"), Entry(_SPEC("no_cells", "passthrough", "nation", select={"prio": "9-NEVER"}), "ORDERS1"),
]


def cubes(spark, sf):
    return {c.name: c for c in (T.order_cube(spark, sf), T.population_cube(spark, sf), T.stock_cube(spark, sf), T.price_cube(spark, sf))}


def snapshots(spark, sf):
    """One table per kind, from the operator that builds it."""
    at = lambda df, level: df.withColumn("level", F.lit(level))
    public = registers.public_building_index(spark, sf).groupBy("level", "code").agg(F.sum("recent").alias("recent"), F.sum("m2_existing").alias("m2_existing"))
    tables = {
        "bbr": registers.building_stock_profile(spark, sf), "forecast": at(projections.outlook_measures(spark, sf), "nation"),
        "net_dwellings": at(projections.net_additions(spark, sf), "nation"), "public_index": public, "infra_index": registers.project_index_per_area(spark, sf),
        "schools": registers.school_area_aggregates(spark, sf), "climate": at(registers.climate_record_with_reasons(spark, sf), "customer"),
        "external": at(scans.key_value_file_scan(spark, sf), "nation"),
    }
    return {k: Snapshot(df, f"{k} 2026") for k, df in tables.items()}


def _sub(name: str) -> str:
    return f"({(I.ORACLES | registers.ORACLES | projections.ORACLES | scans.ORACLES)[name]})"


_EVER = "(SELECT CAST(max(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) AS BIGINT) FROM orders)"
_NEWEST = f"({I.qlabel(_EVER)})"
_LIVE = {
    "urgent_n": "calc_passthrough", "high_share": "calc_share_of_total", "medium_yoy": "calc_yoy_pct", "mean4": "calc_last4q_mean", "sum4": "calc_sum4q",
    "sum4_stock": "calc_sum4q_per_1000", "discount": "calc_discount_pct", "urgent_ratio": "calc_ratio_pct", "per_stock": "calc_per_1000_dwellings",
    "rate": "rolling4q_per_1000_pop_live",
}
LIVE = " UNION ALL ".join([
    *[f"SELECT '{k}' AS key, 'nation' AS level, area AS code, period, CAST(value AS DOUBLE) AS value FROM {_sub(q)}" for k, q in _LIVE.items()],
    f"SELECT 'urgent_k', 'nation', area, period, round(value / 1000, 6) FROM {_sub('calc_passthrough')}",
    f"SELECT 'rate_stock', 'nation', area, period, value FROM {_sub('rolling4q_per_1000_dwellings')} WHERE ends_with(period, '→' || {_NEWEST})",
    f"SELECT 'rolling_yoy', 'nation', area, period, value FROM {_sub('rolling4q_yoy_pct')} WHERE period LIKE '%→' || {_NEWEST} || ' vs%'",
])


def _field(key: str, kind: str, level: str, source: str, value: str, leveled: bool = True) -> str:
    where = f"WHERE level = '{level}' AND v IS NOT NULL" if leveled else "WHERE v IS NOT NULL"
    cols = "level, CAST(code AS VARCHAR) AS code" if leveled else "CAST(code AS VARCHAR) AS code"
    return f"SELECT '{key}', '{level}', code, '{kind} 2026', v FROM (SELECT {cols}, CAST({value} AS DOUBLE) AS v FROM {source}) {where}"


_PUBLIC = f"(SELECT level, code, sum(recent) AS recent, sum(m2_existing) AS m2_existing FROM {_sub('public_building_index')} GROUP BY ALL)"
READY = " UNION ALL ".join([
    _field("renters_pct", "bbr", "nation", _sub("building_stock_profile"), "renters_pct"), _field("dwelling_m2", "bbr", "region", _sub("building_stock_profile"), "avg_m2"),
    _field("growth_5y", "forecast", "nation", _sub("outlook_measures"), "growth_5y", False), _field("new_dwellings", "net_dwellings", "nation", _sub("net_additions"), "per_1000", False),
    _field("public_m2", "public_index", "nation", _PUBLIC, "m2_existing"), _field("public_recent", "public_index", "nation", _PUBLIC, "recent"),
    _field("stations_planned", "infra_index", "nation", _sub("project_index_per_area"), "stations_planned"), _field("grade_avg", "schools", "nation", _sub("school_area_aggregates"), "grade_avg"),
    _field("sea_level", "climate", "customer", _sub("climate_record_with_reasons"), "round(value / 100, 6)", False), _field("from_file", "external", "nation", _sub("key_value_file_scan"), "round(value, 6)", False),
])


@query(f"{LIVE} UNION ALL {READY}")
def registry_compiled_live(spark, sf):
    """Live figures of every kind of entry; each cube and each snapshot is read once."""
    return rounded(compile_registry(spark, cubes(spark, sf), CALCULATED + BUILT, snapshots(spark, sf)).live())


@query(" UNION ALL ".join(
    f"SELECT '{k}' AS key, 'nation' AS level, area AS code, year, period, CAST(value AS DOUBLE) AS value FROM {_sub(q)}"
    for k, q in (("urgent_low", "calc_share_history"), ("sum4", "calc_sum4q_history"), ("urgent_ratio", "calc_ratio_history"), ("rate", "rolling4q_history"))))
def registry_compiled_history(spark, sf):
    """Yearly figures of several kinds of calculation out of the same folded cells."""
    return rounded(compile_registry(spark, cubes(spark, sf), PAST).history())


@query(f"""SELECT 'rate' AS key, 'nation' AS level, area AS code, quarter, value FROM {_sub('rolling4q_quarterly_series')}
UNION ALL SELECT key, 'nation', area, quarter, value FROM (
  SELECT 'rate_stock' AS key, area, regexp_extract(period, '→([0-9]+K[0-9])', 1) AS quarter, value FROM {_sub('rolling4q_per_1000_dwellings')}
  UNION ALL SELECT 'rolling_yoy', area, regexp_extract(period, '→([0-9]+K[0-9])', 1), value FROM {_sub('rolling4q_yoy_pct')}) WHERE quarter >= '1996K1'""")
def registry_compiled_quarters(spark, sf):
    """Rolling figures of all rolling entries at every window end."""
    return rounded(compile_registry(spark, cubes(spark, sf), CALCULATED).quarters("1996K1"))


_KEYS = ", ".join(f"('{e.spec.key}')" for e in CALCULATED + BUILT)


@query(f"""WITH f AS (SELECT key, count(value) AS areas FROM ({LIVE} UNION ALL {READY}) GROUP BY key)
SELECT k.key, coalesce(areas, 0) AS areas, CASE WHEN coalesce(areas, 0) = 0 THEN 'no figure at the newest period' END AS message FROM (VALUES {_KEYS}) AS k(key) LEFT JOIN f USING (key)
UNION ALL VALUES ('no_calc', 0, 'unknown calculation no_such_calc'), ('no_cube', 0, 'no cube GONE9 for num'), ('no_dim', 0, 'ORDERS1 has no dimension age'),
  ('no_field', 0, 'schools has no field teachers'), ('no_cells', 0, 'no figure at the newest period')""")
def registry_compiled_report(spark, sf):
    """Q13: how many areas each entry has a figure for, and why a broken one has none."""
    return compile_registry(spark, cubes(spark, sf), CALCULATED + BUILT + BROKEN, snapshots(spark, sf)).report()


@query(f"""WITH l AS ({LIVE}), m AS (SELECT CAST(n_nationkey AS VARCHAR) AS code, CAST(n_regionkey AS VARCHAR) AS area, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS w FROM nation)
SELECT key, level, area AS code, period, round(sum(value * CASE WHEN w > 0 THEN w ELSE 1 END) / sum(CASE WHEN w > 0 THEN w ELSE 1 END), 3) AS value
FROM l JOIN m USING (code) WHERE value IS NOT NULL GROUP BY key, level, area, period""")
def registry_compiled_merged(spark, sf):
    """J1, A8 over a registry: figures of codes that are merged into areas, weighted by population."""
    pop = T.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    n = T.table(spark, sf, "nation").join(pop, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    members = n.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_regionkey").cast("string").alias("area"), "weight")
    return rounded(merged(rounded(compile_registry(spark, cubes(spark, sf), CALCULATED).live()), members, "nation"), digits=3)
