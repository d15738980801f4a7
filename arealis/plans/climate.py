"""The climate record over projection cubes derived from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import climate as C
from . import tables as T
from .common import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

SEA = [C.Measure("sealevel_cm", "sea", 1, 0.0), C.Measure("surge100_cm", "surge", 1), C.Measure("surge_freq_x", "freq", 1, 1.0)]
RAIN = [C.Measure("rain100_1h_mm", "hour", 1), C.Measure("cloudbursts_yr", "burst", 2)]
STRETCHES = 150


def _cells(spark, sf, by, scenarios, names):
    """A projection cube: the orders' amounts by scenario, period and percentile."""
    k = F.col("o_orderkey")
    at = lambda values, step: F.element_at(F.array(*[F.lit(v) for v in values]), ((F.floor(k / step) % len(values)) + 1).cast("int"))
    o = T.table(spark, sf, "orders").select(by, at([0, *scenarios.values()], 1).alias("scenario"), at([1, 3, 4], 4).alias("period"), at([10, 50, 90], 12).alias("percentile"),
                                            F.when(k % 11 == 0, 0).otherwise(1).alias("absolute"), T.cents("o_totalprice").alias("c"))
    a, b = names[0], names[1]
    aggs = [(F.sum("c") / F.lit(1000003.0)).alias(a), (F.count(F.lit(1)) * F.lit(1.3)).alias(b)]
    if len(names) > 2:
        aggs.append((F.max("c") / F.lit(70001.0)).alias(names[2]))
    return o.groupBy(*[c for c in o.columns if c != "c"]).agg(*aggs)


def parts(spark, sf):
    c, k = T.table(spark, sf, "customer"), F.col("c_custkey")
    areas = c.select(k.alias("code"), F.col("c_name").alias("name"))
    coast = c.filter(k % 3 > 0).select(k.alias("code"), (k % 160).alias("stretch"))
    sea = _cells(spark, sf, (F.col("o_custkey") % STRETCHES).alias("stretch"), C.SEA, ["sea", "surge", "freq"])
    rain = _cells(spark, sf, F.col("o_custkey").alias("code"), C.RAIN, ["hour", "burst"])
    claims = T.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("code")).agg(F.count(F.lit(1)).alias("claims"))
    claims = claims.withColumn("claims_per_1000", F.col("claims") * 7 / F.lit(3.0))
    risk = c.filter("c_mktsegment = 'BUILDING'").select(k.alias("code"), (k % 4 == 0).alias("marginal"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("horizon")) for i, h in enumerate(C.HORIZONS)])).alias("x")
    z = c.filter(k % 5 > 0).select(k.alias("code"), step).filter((F.col("code") + F.col("x.i")) % 7 > 0)
    zones = z.select("code", "x.horizon", F.when(F.col("code") % 5 > 1, (F.col("code") % 40) + F.col("x.i") * 1.5).alias("surge_dw_pct"), (F.col("code") % 90).alias("dwellings"),
                     (F.col("code") % 9 + F.col("x.i")).cast("long").alias("dwellings_in_zone"), (F.col("code") % 30 / F.lit(4.0)).alias("zone_km2"))
    return areas, coast, sea, SEA, rain, RAIN, claims, risk, zones


def _at(values, step):
    return f"[{', '.join(map(str, values))}][(o_orderkey // {step}) % {len(values)} + 1]"


def _cube(name, by, key, scenarios, cols):
    return f"""{name} AS (SELECT {by} AS {key}, {_at([0, *scenarios.values()], 1)} AS s, {_at([1, 3, 4], 4)} AS p, {_at([10, 50, 90], 12)} AS q, {cols}
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) WHERE o_orderkey % 11 <> 0 GROUP BY ALL)"""


def _bands(name, key, measures, scenarios):
    rows = []
    for m in measures:
        for h, p in C.HORIZONS.items():
            pick = lambda s, q: f"max(CASE WHEN s = {s} AND p = {p} AND q = {q} THEN {m.column} END)"  # noqa: B023, E731
            if h == "today":
                cells = [f"{m.today}::DOUBLE" if m.today is not None else pick(0, 50), *["CAST(NULL AS DOUBLE)"] * 4]
            else:
                cells = [pick(scenarios["mid"], 50), pick(scenarios["mid"], 10), pick(scenarios["mid"], 90), pick(scenarios["low"], 50), pick(scenarios["high"], 50)]
            made = ", ".join(f"round({c}, {m.digits}) AS {n}" for c, n in zip(cells, C.BAND, strict=True))
            rows.append(f"SELECT {key}, '{m.name}' AS indicator, '{h}' AS horizon, {made} FROM {name} GROUP BY {key}")
    return " UNION ALL ".join(rows)


def _values(names):
    return ", ".join(f"('{n}', '{h}')" for n in names for h in C.HORIZONS)


_NONE = "CAST(NULL AS DOUBLE) AS p10, CAST(NULL AS DOUBLE) AS p90, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high"
_NO_ZONES = "CAST(NULL AS BIGINT) AS dwellings, CAST(NULL AS BIGINT) AS dwellings_in_zone, CAST(NULL AS DOUBLE) AS zone_km2"


@query(f"""WITH {_cube("sea", f"o_custkey % {STRETCHES}", "stretch", C.SEA, "sum(c) / 1000003.0::DOUBLE AS sea, count(*) * 1.3::DOUBLE AS surge, max(c) / 70001.0::DOUBLE AS freq")},
{_cube("rain", "o_custkey", "code", C.RAIN, "sum(c) / 1000003.0::DOUBLE AS hour, count(*) * 1.3::DOUBLE AS burst")},
sb AS ({_bands("sea", "stretch", SEA, C.SEA)}), rb AS ({_bands("rain", "code", RAIN, C.RAIN)}),
b AS (SELECT c_custkey AS code, c_name AS name, c_custkey % 3 > 0 AS coastal, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 160 END AS stretch, c_mktsegment AS seg FROM customer),
cl AS (SELECT o_custkey AS code, count(*) AS claims FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
z AS (SELECT code, h.horizon, h.i, CASE WHEN code % 5 > 1 THEN code % 40 + h.i * 1.5::DOUBLE END AS pct, code % 90 AS dwellings, code % 9 + h.i AS inz, code % 30 / 4.0::DOUBLE AS km2
  FROM b, (VALUES ('today', 0), ('2070', 1), ('2120', 2)) AS h(horizon, i) WHERE code % 5 > 0 AND (code + h.i) % 7 > 0),
zf AS (SELECT code, max(pct IS NOT NULL) AS has, max(horizon = 'today') AS td, min_by(dwellings, i) FILTER (WHERE dwellings > 0) AS dwellings FROM z GROUP BY code)
SELECT b.code, name, coastal, CAST(stretch AS VARCHAR) AS stretch, x.indicator, x.horizon, value, p10, p90, low, high, {_NO_ZONES}, CAST(NULL AS BIGINT) AS claims, CAST(NULL AS BOOLEAN) AS marginal,
  CASE WHEN NOT coastal THEN 'not coastal' WHEN stretch NOT IN (SELECT stretch FROM sb) THEN 'no Klimaatlas stretch' END AS reason
FROM b CROSS JOIN (VALUES {_values([m.name for m in SEA])}) AS x(indicator, horizon) LEFT JOIN sb USING (stretch, indicator, horizon)
UNION ALL SELECT b.code, name, coastal, CAST(stretch AS VARCHAR), x.indicator, x.horizon, value, p10, p90, low, high, {_NO_ZONES}, NULL, NULL, CASE WHEN b.code NOT IN (SELECT code FROM rb) THEN 'no Klimaatlas kommune row' END
FROM b CROSS JOIN (VALUES {_values([m.name for m in RAIN])}) AS x(indicator, horizon) LEFT JOIN rb USING (code, indicator, horizon)
UNION ALL SELECT b.code, name, coastal, CAST(stretch AS VARCHAR), 'weather_claims_1000', 'today', round(claims * 7 / 3.0::DOUBLE, 1), {_NONE}, {_NO_ZONES}, claims, NULL, CASE WHEN claims IS NULL THEN 'not computed yet' END FROM b LEFT JOIN cl USING (code)
UNION ALL SELECT code, name, coastal, CAST(stretch AS VARCHAR), 'flood_risk_area', 'today', CASE WHEN seg = 'BUILDING' AND code % 4 <> 0 THEN 1 ELSE 0 END, {_NONE}, {_NO_ZONES}, NULL, seg = 'BUILDING' AND code % 4 = 0, NULL FROM b
UNION ALL SELECT b.code, name, coastal, CAST(stretch AS VARCHAR), 'surge_dw_pct', h.horizon, z.pct, {_NONE}, CASE WHEN has THEN zf.dwellings END, CASE WHEN has THEN z.inz END, z.km2, NULL, NULL,
  CASE WHEN coalesce(has, false) THEN NULL WHEN NOT coastal THEN 'not coastal' WHEN td THEN 'no published surge zone reaches this kommune' ELSE 'not computed yet' END
FROM b CROSS JOIN (VALUES ('today'), ('2070'), ('2120')) AS h(horizon) LEFT JOIN z ON z.code = b.code AND z.horizon = h.horizon LEFT JOIN zf ON zf.code = b.code""")
def climate_record_all_horizons(spark, sf):
    """Every climate figure of an area at three horizons with its range, rain and surge zones included, or the reason why there is none."""
    return C.record(*parts(spark, sf))
