"""The climate record of an area: coast and rain projections, claims, designation and surge zones, with a reason for whatever is missing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Horizons with their period in the projection cubes, scenarios by cube, and the percentile of a main figure.
HORIZONS = {"today": 1, "2070": 3, "2120": 4}
SEA = {"mid": 245, "low": 126, "high": 585}
RAIN = {"mid": 45, "low": 26, "high": 85}
BASE_SCENARIO, MAIN = 0, 50
# Why a figure is missing.
NOT_COASTAL, NOT_COMPUTED, NO_STRETCH, NO_AREA_ROW = "not coastal", "not computed yet", "no Klimaatlas stretch", "no Klimaatlas kommune row"
NO_ZONE = "no published surge zone reaches this kommune"

BAND = ["value", "p10", "p90", "low", "high"]


@dataclass(frozen=True)
class Measure:
    """An indicator of a projection cube: its column, decimals, and what it is today where that holds by definition."""

    name: str
    column: str
    digits: int
    today: float | None = None


def projected(cells: DataFrame, by: str, measures: Sequence[Measure], scenarios: dict[str, int]) -> DataFrame:
    """(by, indicator, horizon, value, p10, p90, low, high) of a projection cube (by, scenario, period, percentile, absolute,
    columns): absolute changes only, one conditional aggregation for all indicators and horizons. Today has no band."""
    here = F.col("absolute") == 1

    def pick(column: str, scenario: int, period: int, percentile: int) -> Column:
        at = here & (F.col("scenario") == scenario) & (F.col("period") == period) & (F.col("percentile") == percentile)
        return F.max(F.when(at, F.col(column)))

    aggs, rows = [], []
    for i, m in enumerate(measures):
        for j, (horizon, period) in enumerate(HORIZONS.items()):
            today = horizon == "today"
            if today:
                made = {"value": F.lit(m.today) if m.today is not None else pick(m.column, BASE_SCENARIO, period, MAIN)}
            else:
                mid = scenarios["mid"]
                made = {
                    "value": pick(m.column, mid, period, MAIN), "p10": pick(m.column, mid, period, 10), "p90": pick(m.column, mid, period, 90),
                    "low": pick(m.column, scenarios["low"], period, MAIN), "high": pick(m.column, scenarios["high"], period, MAIN)}
            aggs += [c.cast("double").alias(f"_{k}{i}_{j}") for k, c in made.items() if not (today and m.today is not None)]
            fields = []
            for k in BAND:
                c = F.lit(m.today).cast("double") if today and k == "value" and m.today is not None else F.col(f"_{k}{i}_{j}") if k in made else F.lit(None).cast("double")
                fields.append(F.round(c, m.digits).alias(k))
            rows.append(F.struct(F.lit(m.name).alias("indicator"), F.lit(horizon).alias("horizon"), *fields))
    wide = cells.filter(here).groupBy(by).agg(*aggs)
    return wide.select(by, F.explode(F.array(*rows)).alias("x")).select(by, "x.*")


def _spine(areas: DataFrame, indicators: Sequence[str]) -> DataFrame:
    pair = [F.struct(F.lit(i).alias("indicator"), F.lit(h).alias("horizon")) for i in indicators for h in HORIZONS]
    return areas.withColumn("x", F.explode(F.array(*pair))).select(*areas.columns, "x.*")


_OUT = ["code", "name", "coastal", "stretch", "indicator", "horizon", *BAND, "dwellings", "dwellings_in_zone", "zone_km2", "claims", "marginal", "reason"]


def _shaped(df: DataFrame) -> DataFrame:
    """All columns of the record, null where an indicator hasn't them."""
    kinds = {"dwellings": "long", "dwellings_in_zone": "long", "zone_km2": "double", "claims": "long", "marginal": "boolean", **dict.fromkeys(BAND, "double")}
    return df.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) if c in df.columns and c not in ("code", "coastal") else F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in _OUT])


def record(areas: DataFrame, coast: DataFrame, sea: DataFrame, sea_measures: Sequence[Measure], rain: DataFrame, rain_measures: Sequence[Measure],
           claims: DataFrame, risk: DataFrame | None, zones: DataFrame) -> DataFrame:
    """One row per area, indicator and horizon, in the columns of ``_OUT``.

    ``areas``: (code, name). ``coast``: (code, stretch), an area's main stretch. ``sea``: by stretch, ``rain``: by code (see ``projected``).
    ``claims``: (code, claims, claims_per_1000). ``risk``: (code, marginal), null if the designation wasn't loaded. ``zones``: (code,
    horizon, surge_dw_pct, dwellings, dwellings_in_zone, zone_km2). A reason is given where an indicator has no figure at any horizon.
    """
    base = areas.join(coast.select("code", "stretch"), "code", "left").withColumn("coastal", F.col("stretch").isNotNull())
    bands = projected(sea, "stretch", sea_measures, SEA)
    listed = bands.select("stretch").distinct().withColumn("_known", F.lit(True))
    sea_rows = _spine(base, [m.name for m in sea_measures]).join(bands, ["stretch", "indicator", "horizon"], "left").join(listed, "stretch", "left")
    sea_rows = sea_rows.withColumn("reason", F.when(~F.col("coastal"), NOT_COASTAL).when(F.col("_known").isNull(), NO_STRETCH))
    wet = projected(rain, "code", rain_measures, RAIN)
    named = wet.select("code").distinct().withColumn("_known", F.lit(True))
    rain_rows = _spine(base, [m.name for m in rain_measures]).join(wet, ["code", "indicator", "horizon"], "left").join(named, "code", "left")
    rain_rows = rain_rows.withColumn("reason", F.when(F.col("_known").isNull(), NO_AREA_ROW))
    today = lambda indicator: base.withColumns({"indicator": F.lit(indicator), "horizon": F.lit("today")})
    claim_rows = today("weather_claims_1000").join(claims, "code", "left").withColumns(
        {"value": F.round("claims_per_1000", 1), "reason": F.when(F.col("claims_per_1000").isNull(), NOT_COMPUTED)})
    if risk is None:
        risk_rows = today("flood_risk_area").withColumn("reason", F.lit(NOT_COMPUTED))
    else:
        each = risk.groupBy("code").agg(F.min("marginal").alias("_m"), F.max("marginal").alias("marginal"))
        risk_rows = today("flood_risk_area").join(each, "code", "left").withColumns(
            {"value": F.when(F.col("_m").isNotNull() & ~F.col("_m"), 1.0).otherwise(0.0), "marginal": F.coalesce("marginal", F.lit(False))})
    # dwellings are the same at all horizons: the first that has any
    facts = zones.groupBy("code").agg(
        F.max(F.col("surge_dw_pct").isNotNull()).alias("_any"), F.max(F.col("horizon") == "today").alias("_today"),
        F.min_by("dwellings", F.when(F.col("dwellings") > 0, F.element_at(F.create_map(*[F.lit(x) for h in HORIZONS.items() for x in h]), F.col("horizon")))).alias("dwellings"))
    at = zones.select("code", "horizon", F.col("surge_dw_pct").alias("value"), F.col("dwellings_in_zone").alias("_in"), "zone_km2")
    surge = _spine(base, ["surge_dw_pct"]).join(at, ["code", "horizon"], "left").join(facts, "code", "left")
    has = F.coalesce("_any", F.lit(False))
    why = F.when(~F.col("coastal"), NOT_COASTAL).when(F.coalesce("_today", F.lit(False)), NO_ZONE).otherwise(NOT_COMPUTED)
    surge = surge.withColumns({"reason": F.when(~has, why), "dwellings": F.when(has, F.col("dwellings")), "dwellings_in_zone": F.when(has, F.col("_in"))})
    out = _shaped(sea_rows)
    for part in (rain_rows, claim_rows, risk_rows, surge):
        out = out.unionByName(_shaped(part))
    return out
