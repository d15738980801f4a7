"""Exports in all their published columns: projects, zone exposure, what is near a pin, and plotted series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..model import AREA_COLUMNS, EXPOSURE_COLUMNS, NEARBY_COLUMNS, PROJECT_COLUMNS, PROPERTY_COLUMNS
from . import exports as E
from . import spatial as S

# The year a zone of each horizon is published for.
ZONE_YEARS = {"today": "2020", "2070": "2070", "2120": "2120"}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def projects(items: DataFrame, served: DataFrame) -> DataFrame:
    """The projects file: what a project is and what it was meant to be, and the areas it serves by level.

    ``items``: id, name, type, status, notes, open_year, open_window, open_year_original, budget_mdkk, agency, geometry_kind,
    length_km, stations, source_doc, source_url, updated. ``served``: project, level (municipalities, postal_codes, quarters), codes.
    """
    levels = ["municipalities", "postal_codes", "quarters"]
    by_level = served.groupBy(F.col("project").alias("id")).pivot("level", levels).agg(F.max("codes"))
    opening = F.coalesce(F.nullif("open_window", F.lit("")), F.col("open_year").cast("string"), F.lit(""))
    plain = {c: _text(c) for c in ("agency", "geometry_kind", "source_doc", "source_url", "updated", *levels)}
    return items.join(by_level, "id", "left").withColumns(
        {**plain, "status_note": _text("notes"), "opening": opening, "opening_original": _text("open_year_original"), "length_km": F.round("length_km", 2)}).select(*PROJECT_COLUMNS)


def exposure(rows: DataFrame, areas: DataFrame, source: DataFrame) -> DataFrame:
    """The climate file: units inside each horizon's zone by area. ``rows``: level, code, horizon, n, n_in_zone, pct, zone_km2, as_of; ``areas``:
    level, code, name, parent_code, parent_name; ``source``: one row as from ``with_source``, shared by all rows."""
    one = source.select("source", "table_id", "source_url", "cat_as_of", "fetched", "licence")
    j = rows.join(areas.select("level", "code", "name", "parent_code", "parent_name"), ["level", "code"], "left").join(F.broadcast(one), how="inner", on=F.lit(True))
    return j.withColumns({
        "parent_code": _text("parent_code"), "parent_name": _text("parent_name"), "zone_year": F.coalesce(K.lookup("horizon", ZONE_YEARS), F.lit("")),
        "dwellings": F.col("n"), "dwellings_in_zone": F.col("n_in_zone"), "surge_dw_pct": F.col("pct"),
        "value_type": F.when(F.col("horizon") == "today", "derived").otherwise("projection"), "as_of": F.coalesce(F.nullif("as_of", F.lit("")), "cat_as_of"),
    }).select(*EXPOSURE_COLUMNS)


def nearby(near: DataFrame) -> DataFrame:
    """What lies near each pin, in whole metres. ``near``: pin, kind, name, type, status, dist, source, source_url."""
    plain = {c: _text(c) for c in ("type", "status", "source", "source_url")}
    return near.withColumns({**plain, "distance_m": F.round("dist", 0).cast("long")}).select("pin", *NEARBY_COLUMNS)


def located(pins: DataFrame, levels: dict[str, tuple[DataFrame, Column]], cell: float) -> DataFrame:
    """(property_label, lat, lon, level, code): a row for every level whose area contains the pin. ``levels``: an index of
    areas, and how the code is written in the export, by level."""
    out = None
    for level, (index, written) in levels.items():
        hit = S.locate(pins, index, cell, "_area").filter(F.col("_area").isNotNull())
        part = hit.select("property_label", "lat", "lon", F.lit(level).alias("level"), written.alias("code"))
        out = part if out is None else out.unionByName(part)
    return out


def property_rows(area_rows: DataFrame, pins: DataFrame) -> DataFrame:
    """All figures of the areas around each pin, behind its label and place."""
    return E.property_rows(area_rows, pins).select(*PROPERTY_COLUMNS)


def plotted(area_rows: DataFrame, chosen: DataFrame, indicators: DataFrame) -> DataFrame:
    """The long export of the areas (level, code) and indicators (indicator) that a chart shows."""
    return area_rows.join(chosen, ["level", "code"], "left_semi").join(indicators, "indicator", "left_semi").select(*AREA_COLUMNS)
