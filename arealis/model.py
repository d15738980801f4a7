"""The data model: cubes, indicator specs and explicit schemas for registers and exports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Cube:
    """A statistical cube in long form.

    Dimensions stay real columns rather than a map, so selections reach the scan and
    unused dimensions are pruned. ``value`` is null where the publisher suppressed a cell.
    """

    df: DataFrame
    area: str = "area"
    period: str = "period"
    value: str = "value"
    dims: tuple[str, ...] = ()
    name: str = ""

    def with_df(self, df: DataFrame) -> "Cube":
        return replace(self, df=df)

    def cells(self) -> DataFrame:
        """The cube under fixed column names area, period, value plus its dimensions."""
        return self.df.select(
            F.col(self.area).alias("area"),
            F.col(self.period).alias("period"),
            F.col(self.value).cast("double").alias("value"),
            *[F.col(d) for d in self.dims],
        )


@dataclass(frozen=True)
class IndicatorSpec:
    """One registry entry: what to calculate and from which selection."""

    key: str
    calc: str
    level: str = "kommune"
    select: dict[str, Any] = field(default_factory=dict)
    share: dict[str, Any] = field(default_factory=dict)
    label: str = ""
    unit: str = ""
    direction: str = "neutral"
    fmt: str = "pct1"
    display_div: float = 1.0
    den_select: dict[str, Any] = field(default_factory=dict)


def select_codes(df: DataFrame, select: dict[str, Any] | None) -> DataFrame:
    """AND of per-dimension equality or IN-list conditions; pushed to the scan by Catalyst."""
    for dim, want in (select or {}).items():
        col = F.col(dim)
        df = df.filter(col.isin(list(want)) if isinstance(want, (list, tuple, set)) else col == want)
    return df


# Column sets of the exports (fixed values: file formats must match).
AREA_COLUMNS = [
    "level", "code", "name", "parent_code", "parent_name", "region", "population",
    "indicator", "label", "unit", "period", "period_type", "value", "value_type",
    "inherited_from", "direction", "source", "table_id", "source_url", "as_of",
    "fetched", "licence",
]
PROPERTY_COLUMNS = ["property_label", "lat", "lon", *AREA_COLUMNS]
PROJECT_COLUMNS = [
    "id", "name", "type", "status", "status_note", "opening", "opening_original",
    "budget_mdkk", "agency", "municipalities", "postal_codes", "quarters",
    "geometry_kind", "length_km", "stations", "source_doc", "source_url", "updated",
]
SOURCE_COLUMNS = [
    "key", "label", "publisher", "tables", "as_of", "fetched", "url", "licence", "used_for",
]
EXPOSURE_COLUMNS = [
    "level", "code", "name", "parent_code", "parent_name", "horizon", "zone_year",
    "dwellings", "dwellings_in_zone", "surge_dw_pct", "zone_km2", "value_type",
    "source", "table_id", "source_url", "as_of", "fetched", "licence",
]
NEARBY_COLUMNS = ["kind", "name", "type", "status", "distance_m", "source", "source_url"]

# Register schemas (fixed values: field names of the public registers).
_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


UNIT_SCHEMA = _struct(
    bygning=_S, status=_S, enh023Boligtype=_S, enh045Udlejningsforhold=_S,
    enh026EnhedensSamledeAreal=_D, enh031AntalVaerelser=_I,
)
BUILDING_SCHEMA = _struct(
    id_lokalId=_S, status=_S, kommunekode=_S, byg021BygningensAnvendelse=_S,
    byg026Opfoerelsesaar=_I, byg027OmTilbygningsaar=_I, byg038SamletBygningsareal=_D,
    byg039BygningensSamledeBoligAreal=_D, byg041BebyggetAreal=_D, byg054AntalEtager=_I,
    husnummer=_S, grund=_S, byg404Koordinat=_struct(wkt=_S, crs=_S),
)
CASE_SCHEMA = _struct(
    id_lokalId=_S, status=_S, kommunekode=_S, sag001Byggesagsnummer=_S, sag012Byggesagskode=_S,
    sag002Byggesagsdato=_S, sag003Byggetilladelsesdato=_S, sag004ForventetPaabegyndelsesdato=_S,
    sag005Paabegyndelsesdato=_S, sag009ForventetFuldfoertDato=_S, sag010FuldfoerelseAfByggeri=_S,
    sag008FaerdigtBygningsareal=_S, sag019Bygherreforhold=_S,
)
LINK_SCHEMA = _struct(
    id_lokalId=_S, status=_S, byggesag=_S, sagstype=_S, niveautype=_S,
    sagsdataBygning=_S, stamdataBygning=_S,
)
CODE_LIST_SCHEMA = T.StructType([
    T.StructField("id", _S), T.StructField("text", _S), T.StructField("unit", _S),
    T.StructField("updated", _S),
    T.StructField("variables", T.ArrayType(T.StructType([
        T.StructField("id", _S), T.StructField("text", _S),
        T.StructField("elimination", T.BooleanType()),
        T.StructField("values", T.ArrayType(_struct(id=_S, text=_S))),
    ]))),
])
MAP_OBJECT_SCHEMA = T.StructType([
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("type", _S), T.StructField("id", T.LongType()),
        T.StructField("lat", _D), T.StructField("lon", _D),
        T.StructField("center", _struct(lat=_D, lon=_D)),
        T.StructField("geometry", T.ArrayType(_struct(lat=_D, lon=_D))),
        T.StructField("tags", T.MapType(_S, _S)),
    ]))),
])
