"""GeoJSON features to (code, name, properties, polygon/path/point columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import documents

_FEATURE = T.StructType([
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType()),
    ])),
])


def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(F.get(p, 1).alias("lat"), F.get(p, 0).alias("lon")))


def _open_ring(ring: Column) -> Column:
    """Vertices without the repeated last one (rings are closed by definition)."""
    pts = _points(ring)
    closed = (F.size(pts) > 1) & (F.element_at(pts, 1) == F.element_at(pts, -1))
    return F.when(closed, F.slice(pts, 1, F.size(pts) - 1)).otherwise(pts)


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of collections, each cut into its features by many tasks, or one feature per line."""
    if lines:
        return spark.read.schema(_FEATURE).json(path)
    return documents.elements(spark, path, "features").select(F.from_json("text", _FEATURE).alias("f")).select("f.*")


def polygons(features: DataFrame, code_keys: Sequence[str], name_keys: Sequence[str] = ("navn", "name")) -> DataFrame:
    """(code, name, properties, polygon) of the areal features that carry a code."""
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    multi = F.from_json(text, T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))))
    single = F.array(F.from_json(text, T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))))
    parts = F.when(kind == "MultiPolygon", multi).when(kind == "Polygon", single)
    shape = F.transform(parts, lambda part: F.transform(part, _open_ring))
    pick = lambda keys: F.coalesce(*[F.nullif(F.col("properties")[k], F.lit("")) for k in keys])
    return features.select(pick(code_keys).alias("code"), pick(name_keys).alias("name"), "properties", shape.alias("polygon")).filter(
        F.col("code").isNotNull() & F.col("polygon").isNotNull())


def paths(features: DataFrame, code_keys: Sequence[str]) -> DataFrame:
    """(code, part, path) of the linear features."""
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    multi = F.from_json(text, T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
    single = F.array(F.from_json(text, T.ArrayType(T.ArrayType(T.DoubleType()))))
    all_lines = F.when(kind == "MultiLineString", multi).when(kind == "LineString", single)
    code = F.coalesce(*[F.col("properties")[k] for k in code_keys])
    return features.select(code.alias("code"), F.posexplode(all_lines).alias("part", "_l")).select("code", "part", _points(F.col("_l")).alias("path"))


def points(features: DataFrame, code_keys: Sequence[str]) -> DataFrame:
    """(code, lat, lon) of point and multi-point features."""
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    multi = F.from_json(text, T.ArrayType(T.ArrayType(T.DoubleType())))
    single = F.array(F.from_json(text, T.ArrayType(T.DoubleType())))
    pts = F.when(kind == "MultiPoint", multi).when(kind == "Point", single)
    code = F.coalesce(*[F.col("properties")[k] for k in code_keys])
    return features.select(code.alias("code"), F.explode(pts).alias("p")).select("code", F.get("p", 1).alias("lat"), F.get("p", 0).alias("lon"))


def kinds(features: DataFrame) -> DataFrame:
    """Feature counts by kind of geometry."""
    return features.groupBy(F.col("geometry.type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
