"""Writers: partitioned point files with an index, area documents, and export files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P

BOM = "\ufeff"


def write_points(points: DataFrame, path: str, area: str = "kommune", order: Sequence[str] = ("cat", "sub", "name"), salts: int = 1) -> None:
    """One folder per area with its points in order, coordinates to five decimals.

    The whole target is replaced, so an area that lost its points leaves no stale file.
    ``salts`` spreads a large area over several files.
    """
    d = points.withColumns({"lat": F.round("lat", 5), "lon": F.round("lon", 5)})
    if salts > 1:
        d = d.repartition(F.col(area), F.pmod(F.xxhash64(*order, "lat", "lon"), F.lit(salts)))
    else:
        d = d.repartition(F.col(area))
    d.sortWithinPartitions(area, *order).write.mode("overwrite").partitionBy(area).json(path)


def point_index(points: DataFrame, area: str = "kommune") -> DataFrame:
    """Per area: count, box to four decimals, and counts by category and by kind as JSON
    (a handful of categories, so the maps stay small)."""
    per_sub = points.groupBy(area, "cat", "sub").agg(
        F.count(F.lit(1)).alias("k"), F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"))
    per_cat = per_sub.groupBy(area, "cat").agg(
        F.sum("k").alias("k"), F.min("s").alias("s"), F.min("w").alias("w"), F.max("n").alias("n"), F.max("e").alias("e"),
        F.collect_list(F.struct(F.concat_ws(":", "cat", "sub").alias("key"), F.col("k").alias("value"))).alias("subs"))
    return per_cat.groupBy(area).agg(
        F.sum("k").alias("n_points"), *[F.round(f(c), 4).alias(name) for f, c, name in ((F.min, "s", "south"), (F.min, "w", "west"), (F.max, "n", "north"), (F.max, "e", "east"))],
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("cat").alias("key"), F.col("k").alias("value")))))).alias("by_cat"),
        F.to_json(F.map_from_entries(F.sort_array(F.flatten(F.collect_list("subs"))))).alias("by_sub"),
    )


def area_documents(values: DataFrame) -> DataFrame:
    """One JSON document per area: latest figure and yearly map per indicator.

    Bounded by indicators x years per area.
    """
    years = F.sort_array(F.collect_list(F.struct(F.col("period").alias("key"), F.col("value").alias("value"))))
    per_key = values.filter(F.col("value").isNotNull()).groupBy("level", "code", "key").agg(
        F.max_by("value", "period").alias("latest"), years.alias("years"))
    entries = F.sort_array(F.collect_list(F.struct("key", "latest", "years")))
    as_map = F.map_from_entries(F.transform("entries", lambda e: F.struct(
        e["key"].alias("key"), F.struct(e.latest.alias("latest"), F.map_from_entries(e.years).alias("hist")).alias("value"))))
    return per_key.groupBy("level", "code").agg(entries.alias("entries")).select("level", "code", F.to_json(as_map).alias("document"))


def as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Export cells: numbers in plain form, text without separators or line breaks."""
    types = dict(df.dtypes)
    out = [P.csv_number(F.col(c)) if types[c] in ("double", "float") else P.csv_cell(F.col(c)) for c in columns]
    return df.select(*[c.alias(n) for c, n in zip(out, columns)])


def write_export(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Semicolon file with a byte-order mark before the header; cells need no quoting."""
    text = as_text(df, columns)
    text.toDF(BOM + columns[0], *columns[1:]).write.mode("overwrite").option("sep", ";").option("header", True).option("quote", "").option("emptyValue", "").csv(path)
