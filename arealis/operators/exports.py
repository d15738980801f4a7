"""Export rows that carry the source of every figure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import parsing as P
from ..model import AREA_COLUMNS
from ..session import tasks_for

# Publishers by database or source key, catalogue keys of publisher pages.
PUBLISHERS = {
    "dst": "Danmarks Statistik", "s20": "Finans Danmark", "s30": "Københavns Kommune", "climate": "Danmarks Statistik",
    "forecast": "Danmarks Statistik", "net_dwellings": "Danmarks Statistik", "bbr": "BBR via Datafordeler",
    "public": "BBR via Datafordeler", "infra": "Curated layer", "schools": "Uddannelsesstatistik.dk (STIL)",
    "boligstat": "Social- og Boligstyrelsen", "lbf": "Landsbyggefonden", "kk_tryghed": "Københavns Kommune",
    "cph_forecast": "Københavns Kommune", "cph_backtest": "Københavns Kommune",
}
PAGE_KEYS = {
    "Social- og Boligstyrelsen, boligstat.dk": "boligstat", "Landsbyggefonden": "lbf", "BBR via Datafordeler": "bbr",
    "the curated infrastructure layer": "infra", "Uddannelsesstatistik.dk (STIL)": "schools",
}
NO_TABLE = "n/a (register/curated)"
NO_SOURCE = "see Data › Sources"
CLIMATE_KEY = "climate/climate_index"
PINS_PER_TASK = 10_000  # each stands for all figures of its area


def publisher(key: Column, label: Column) -> Column:
    db = P.source_db(key)
    k = F.when(db != "", db).otherwise(P.source_table(key))
    named = F.trim(F.get(F.split(F.coalesce(label, F.lit("")), "[,—]"), 0))
    return F.coalesce(K.lookup(k, PUBLISHERS), F.nullif(named, F.lit("")), F.lit(""))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def with_source(indicators: DataFrame, catalogue: DataFrame, built: str) -> DataFrame:
    """Indicators with their six source columns, none of them blank where it can be known.

    The first of these that an indicator has decides: its tables, its projection, its climate
    service, a city table named in the source text, a publisher's page, a state table named in
    the text. The choice is made before the join, so the catalogue is joined once.

    indicators: key, tables (array), proj_table, proj_publisher, proj_db, climate_url, page_label,
    page_url, source; catalogue: key, label, asof, fetched, url, licence.
    """
    tables = F.filter(F.coalesce("tables", F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")
    city, state = P.city_table_id(F.col("source")), P.state_table_id(F.col("source"))
    case = (
        F.when(F.size(tables) > 0, "tables").when(_text("proj_table") != "", "projection")
        .when(_text("climate_url") != "", "climate").when(city != "", "city")
        .when(_text("page_label") != "", "page").when(state != "", "state").otherwise("none")
    )
    proj_db = F.when(_text("proj_db") != "", F.col("proj_db")).when(F.startswith(_text("proj_table"), F.lit("KK")), "s30").otherwise("")
    by_case = lambda **kw: _choose(F.col("_case"), kw)
    d = indicators.withColumns({"_case": case, "_tables": tables}).withColumns({
        "table_id": by_case(
            tables=F.array_join(F.transform("_tables", lambda t: P.source_table(t)), " "), projection=F.col("proj_table"), city=city, state=state),
        "_cat": by_case(
            tables=F.get("_tables", 0), projection=F.when(_text("proj_publisher") == "DST", "forecast").otherwise("cph_forecast"),
            climate=F.lit(CLIMATE_KEY), city=F.concat(F.lit("s30/"), city), page=K.lookup(_text("page_label"), PAGE_KEYS), state=F.concat(F.lit("dst/"), state)),
        "_page": by_case(
            tables=P.table_info_url(F.get("_tables", 0)), projection=P.table_info_url(F.concat(proj_db, F.lit("/"), F.col("proj_table"))),
            climate=F.col("climate_url"), city=P.table_info_url(F.concat(F.lit("s30/"), city)), page=F.col("page_url"), state=P.table_info_url(F.concat(F.lit("dst/"), state))),
    })
    c = catalogue.select(F.col("key").alias("_cat"), *[F.col(x).alias(f"_{x}") for x in ("label", "asof", "fetched", "url", "licence")])
    j = d.join(c, "_cat", "left")
    # a table's own catalogue address comes first, a projection's, service's or page's own one does
    own_first = F.col("_case").isin("projection", "climate", "page")
    first, second = F.nullif(F.col("_page"), F.lit("")), F.nullif(F.col("_url"), F.lit(""))
    url = F.when(own_first, F.coalesce(first, second)).otherwise(F.coalesce(second, first))
    label = F.coalesce(F.nullif(F.trim(_text("source")), F.lit("")), F.nullif(F.trim(_text("_label")), F.lit("")), F.lit(NO_SOURCE))
    return j.withColumns({
        "table_id": F.coalesce(F.nullif("table_id", F.lit("")), F.lit(NO_TABLE)), "source": label, "source_url": F.coalesce(url, F.lit("")),
        "cat_as_of": F.coalesce(F.nullif("_asof", F.lit("")), F.lit(built)), "fetched": F.coalesce(F.nullif("_fetched", F.lit("")), F.lit(built)),
        "licence": F.coalesce("_licence", F.lit("")),
    }).drop("_case", "_tables", "_cat", "_page", "_label", "_asof", "_fetched", "_url", "_licence")


def _choose(case: Column, options: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in options.items():
        out = F.when(case == name, value).otherwise(out)
    return out


def inherit(areas: DataFrame, values: DataFrame, parents: Sequence[tuple[str, str]]) -> DataFrame:
    """Own figures, and for an indicator an area has none of, the newest one of the nearest
    parent that has it: (level, code, key, period, value, inherited_from).

    areas: level, code and one column per parent; parents: (parent level, column), nearest
    first; values: level, code, key, period, value.
    """
    some = values.filter(F.col("value").isNotNull())
    own = some.join(areas.select("level", "code"), ["level", "code"], "left_semi").withColumn("inherited_from", F.lit(""))
    newest = some.groupBy("level", "code", "key").agg(F.max("period").alias("period"), F.max_by("value", "period").alias("value"))
    have = own.select("level", "code", "key").distinct()
    out = own.select("level", "code", "key", "period", "value", "inherited_from")
    for parent_level, column in parents:
        up = newest.filter(F.col("level") == parent_level).select(F.col("code").alias("_p"), "key", "period", "value")
        cand = areas.filter(F.col(column).isNotNull() & (F.col("level") != parent_level)).select("level", "code", F.col(column).alias("_p")).join(up, "_p")
        got = cand.join(have, ["level", "code", "key"], "left_anti")
        out = out.unionByName(got.select("level", "code", "key", "period", "value", F.col("_p").alias("inherited_from")))
        have = have.unionByName(got.select("level", "code", "key"))
    return out


def area_rows(values: DataFrame, areas: DataFrame, indicators: DataFrame) -> DataFrame:
    """The long export: one row per level, area, indicator and published period, 22 columns.

    values as from ``inherit``; areas: level, code, name, parent_code, parent_name, region,
    population; indicators as from ``with_source`` plus label, unit, fmt, direction.
    """
    ind = indicators.withColumnRenamed("key", "indicator").withColumnRenamed("unit", "_unit")
    j = values.withColumnRenamed("key", "indicator").join(areas, ["level", "code"]).join(ind, "indicator")
    inherited = F.col("inherited_from") != ""
    projected = _text("proj_table") != ""
    kind = F.when(projected, "projection")
    derived = K.is_derived(F.col("fmt"), F.col("_unit"), F.lit(None).cast("string"))
    return j.filter(F.col("value").isNotNull()).withColumns({
        "unit": K.unit_text(F.col("fmt"), F.col("_unit")), "value": K.unit_value(F.col("fmt"), F.col("_unit"), F.col("value")),
        "period_type": F.when(projected, "projection").otherwise(K.period_type(F.col("period"))),
        "value_type": K.value_type(inherited, kind, F.lit(None).cast("string"), projected, derived),
        "as_of": F.coalesce(F.nullif("period", F.lit("")), "cat_as_of"), "direction": _text("direction"),
    }).select(*AREA_COLUMNS)


def property_rows(area_rows_df: DataFrame, pins: DataFrame) -> DataFrame:
    """Rows of every area that contains a pin, behind the pin's label and coordinate.

    pins: property_label, lat, lon, level, code. Areas are few and pins many, so an area's pins are dealt out over as many
    tasks as all pins need, and its rows repeated for each.
    """
    n = tasks_for(pins.count(), PINS_PER_TASK)
    dealt = pins.withColumn("_deal", F.pmod(F.xxhash64("property_label", "lat", "lon"), F.lit(n)).cast("int")).repartition(n, "level", "code", "_deal")
    every = area_rows_df.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    # a broadcast of the pins would leave all their rows to the areas' one task
    return dealt.hint("merge").join(every, ["level", "code", "_deal"]).select("property_label", "lat", "lon", *AREA_COLUMNS)


def wide(values: DataFrame, areas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per area of a level and one column per indicator; own value, else the parent's.

    values: code, parent-level values under level ``parent``; keys are given, so no extra job
    looks for them.
    """
    own = values.filter(F.col("level") == "own").groupBy("code").pivot("key", list(keys)).agg(F.max("value"))
    up = values.filter(F.col("level") == "parent").groupBy(F.col("code").alias("parent_code")).pivot("key", list(keys)).agg(F.max("value"))
    up = up.select("parent_code", *[F.col(k).alias(f"_{k}") for k in keys])
    j = areas.join(own, "code", "left").join(up, "parent_code", "left")
    return j.select(*areas.columns, *[F.coalesce(k, f"_{k}").alias(k) for k in keys])


def period_rows(documents: DataFrame, latest_year: str) -> DataFrame:
    """Yearly map and latest figure to rows; the latest replaces the stored one of its year.

    documents: level, code, key, latest, hist (map of year to value).
    """
    hist = F.coalesce("hist", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    kept = F.map_filter(hist, lambda y, v: v.isNotNull() & ~(F.col("latest").isNotNull() & (y == latest_year)))
    last = F.when(F.col("latest").isNotNull(), F.create_map(F.lit(latest_year), F.col("latest")))
    both = F.when(last.isNotNull(), F.map_concat(kept, last)).otherwise(kept)
    return documents.select("level", "code", "key", F.explode(both).alias("period", "value"))


def national_rows(series: DataFrame, meta: DataFrame, catalogue: DataFrame, built: str) -> DataFrame:
    """National series in the same 22 columns. meta: key, label, unit, src."""
    j = series.filter(F.col("value").isNotNull()).join(meta, "key", "left")
    table = P.state_table_id(F.col("src"))
    c = catalogue.select(F.col("key").alias("_cat"), *[F.col(x).alias(f"_{x}") for x in ("fetched", "url", "licence")])
    j = j.withColumn("_t", table).withColumn("_cat", F.concat(F.lit("dst/"), "_t")).join(c, "_cat", "left")
    blank = {n: F.lit("") for n in ("parent_code", "parent_name", "region", "inherited_from", "direction")}
    return j.withColumns({
        **blank, "level": F.lit("denmark"), "code": F.lit("DK"), "name": F.lit("Denmark"), "population": F.lit(None).cast("long"),
        "indicator": F.col("key"), "label": F.coalesce("label", "key"), "unit": _text("unit"), "period_type": K.period_type(F.col("period")),
        "value_type": F.lit("actual"), "source": F.coalesce(F.nullif("src", F.lit("")), F.lit("Danmarks Statistik")),
        "table_id": F.coalesce(F.nullif("_t", F.lit("")), F.lit(NO_TABLE)), "source_url": F.coalesce("_url", F.nullif(P.table_info_url(F.col("_cat")), F.lit("")), F.lit("")),
        "as_of": F.col("period"), "fetched": F.coalesce("_fetched", F.lit(built)), "licence": F.coalesce("_licence", F.lit("")),
    }).select(*AREA_COLUMNS)


def source_rows(catalogue: DataFrame, used_for: DataFrame, built: str) -> DataFrame:
    """The source catalogue; a missing fetch date falls back to the build's. used_for: key, used_for."""
    j = catalogue.join(used_for, "key", "left")
    return j.select(
        "key", "label", publisher(F.col("key"), F.col("label")).alias("publisher"), _text("tables").alias("tables"), _text("asof").alias("as_of"),
        F.coalesce(F.nullif("fetched", F.lit("")), F.lit(built)).alias("fetched"),
        F.coalesce(F.nullif("url", F.lit("")), P.table_info_url(F.col("key"))).alias("url"), _text("licence").alias("licence"), _text("used_for").alias("used_for"),
    )


def exposure_rows(exposure: DataFrame, names: DataFrame) -> DataFrame:
    """Zone exposure per level and horizon. exposure: level, code, horizon, n, n_in_zone, pct."""
    return exposure.join(names, ["level", "code"], "left").select(
        "level", "code", "name", "parent_code", "horizon", K.lookup("horizon", {"today": "2020", "2070": "2070", "2120": "2120"}).alias("zone_year"),
        F.col("n").alias("dwellings"), F.col("n_in_zone").alias("dwellings_in_zone"), F.col("pct").alias("surge_dw_pct"),
        F.when(F.col("horizon") == "today", "derived").otherwise("projection").alias("value_type"))


def project_rows(projects: DataFrame, served: DataFrame) -> DataFrame:
    """Projects with the areas they serve, one text column per level.

    projects: id, name, type, status, open_year, open_window, length_km, stations.
    """
    by_level = served.groupBy(F.col("project").alias("id")).pivot("level", ["kommune", "postnr", "kvarter"]).agg(F.max("codes"))
    opening = F.coalesce(F.nullif("open_window", F.lit("")), F.col("open_year").cast("string"), F.lit(""))
    return projects.join(by_level, "id", "left").select(
        "id", "name", "type", "status", opening.alias("opening"), _text("kommune").alias("municipalities"), _text("postnr").alias("postal_codes"),
        _text("kvarter").alias("quarters"), F.round("length_km", 2).alias("length_km"), "stations")


def nearby_rows(near: DataFrame) -> DataFrame:
    """What lies near a pin, nearest first, in whole metres."""
    return near.select("pin", "kind", "name", F.round("dist", 0).cast("long").alias("distance_m"))


def resolve_horizon(values: DataFrame, wanted: str) -> DataFrame:
    """The figure at the wanted horizon, or today's where an indicator has no horizons; zero
    where an area is not listed but its parent has a zone, null where it has none.

    values: code, has_horizons, today, wanted columns named by horizon, listed, parent_has_zone.
    """
    at = F.when(F.col("has_horizons"), F.col(wanted)).otherwise(F.col("today"))
    return values.select("code", F.when(F.col("listed"), at).when(F.col("parent_has_zone"), 0.0).alias("value"))


def verify_links(indicators: DataFrame, area_vars: DataFrame) -> DataFrame:
    """(key, url): the query that returns the cells a figure is made of: the table's own area
    variable, all periods, and the indicator's own codes.

    indicators: key, db, table, codes (map of variable to code list).
    """
    j = indicators.join(area_vars, "table")
    picked = F.filter(F.map_entries("codes"), lambda e: (e.key != F.col("area_var")) & (e.key != "Tid") & (F.array_join(e.value, ",") != "*") & (F.array_join(e.value, ",") != "SUM"))
    enc = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    extra = F.array_join(F.transform(F.array_sort(picked), lambda e: F.concat(F.lit("&"), enc(e.key), F.lit("="), enc(F.array_join(e.value, ",")))), "")
    db = F.when(F.coalesce("db", F.lit("")) == "", "").otherwise(F.concat("db", F.lit("/")))
    return j.select("key", F.concat(F.lit(P.STATBANK + "/"), db, F.lit("data/"), "table", F.lit("/CSV?"), enc(F.col("area_var")), F.lit("=*&Tid=*"), extra).alias("url"))
