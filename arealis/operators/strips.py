"""Areas and overlaps of polygons with a stated error.

Shapes are cut into strips of one height and measured along each strip's middle line. Between the middle and the rest of a
strip the measured length changes by no more than the border travels sideways there, so an area is wrong by at
most half the height times the border's whole sideways travel. The height follows from the error that is
asked for; a shape has as many rows as its border crosses strips, whatever its area. Nothing of a shape is gathered:
crossings, spans and pairs are rows.

Coordinates are taken as those of a plane, areas are in their square units; the order of axes is the library's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import tasks_for
from .spatial import floor_to_cell, ring_edge_rows

ROWS_PER_TASK = 400_000  # crossings of edges with strips


def sideways_travel(polygons: DataFrame, code: str = "code", polygon: str = "polygon") -> DataFrame:
    """(code, travel): how far an area's border goes sideways in all, holes included."""
    step = F.abs(F.col("e.b_lon") - F.col("e.a_lon"))
    return ring_edge_rows(polygons, code, polygon).groupBy("code").agg(F.sum(step).alias("travel"))


def strip_height(layers: Sequence[DataFrame], max_error: float) -> Column:
    """Greatest power of two that keeps the error below ``max_error`` for any area of the layers, each given by
    its ``sideways_travel``: of one layer its areas, of two every overlap. Null if no border goes sideways.

    Powers of two nest, so runs with different errors share the lines of their strips.
    """
    travel = sum((t.agg(F.max("travel")).scalar() for t in layers[1:]), layers[0].agg(F.max("travel")).scalar())
    return F.pow(F.lit(2.0), F.floor(F.log2(F.try_divide(F.lit(2.0 * max_error), travel))))


def _cut_tasks(edges: DataFrame, height: Column) -> int:
    """Tasks for the strips that edges (e) cross."""
    e = F.col("e")
    rows = floor_to_cell(F.greatest(e.a_lat, e.b_lat), height) - floor_to_cell(F.least(e.a_lat, e.b_lat), height) + 1
    return tasks_for(edges.agg(F.sum(rows)).first()[0], ROWS_PER_TASK)


def spans(polygons: DataFrame, height: Column, code: str = "code", polygon: str = "polygon") -> DataFrame:
    """(code, row, lo, hi, height): disjoint stretches of each strip's middle line inside the area.

    Parts and features of one code may overlap; what they share is counted once. An edge is one row before it is cut and
    thousands after, so tasks go by the crossings: edges are dealt out over them first, strips afterwards.
    """
    e = F.col("e")
    h, low, high = F.col("height"), F.least(e.a_lat, e.b_lat), F.greatest(e.a_lat, e.b_lat)
    first, last = floor_to_cell(low, h), floor_to_cell(high, h)
    edges = ring_edge_rows(polygons, code, polygon).withColumn("height", height).filter("height is not null")
    n = _cut_tasks(edges, h)
    mid = (F.col("row") + 0.5) * h
    crossings = (
        edges.repartition(n, "code", "e").withColumn("row", F.explode(F.sequence(first, last)))
        .filter((e.a_lat > mid) != (e.b_lat > mid))
        .select("code", "feat", "part", "row", "height", ((e.b_lon - e.a_lon) * (mid - e.a_lat) / (e.b_lat - e.a_lat) + e.a_lon).alias("lo"))
        .repartition(n, "code", "row")
    )
    along = Window.partitionBy("code", "feat", "part", "row").orderBy("lo")
    inside = crossings.withColumns({"hi": F.lead("lo").over(along), "i": F.row_number().over(along)}).filter("i % 2 = 1 and hi > lo")
    ordered = Window.partitionBy("code", "row").orderBy("lo", "hi")
    apart = inside.withColumn("_reach", F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.when(F.col("_reach").isNull() | (F.col("lo") > F.col("_reach")), 1).otherwise(0)
    numbered = apart.withColumn("_k", F.sum(fresh).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("code", "row", "_k", "height").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_k")


def area_within(polygons: DataFrame, max_error: float, code: str = "code", polygon: str = "polygon") -> DataFrame:
    """(code, area, error): the true area lies within ``error`` of the given one, and error is at most ``max_error``."""
    travel = sideways_travel(polygons, code, polygon)
    height = strip_height([travel], max_error)
    own = spans(polygons, height, code, polygon).groupBy("code").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("height")).alias("area"))
    stated = travel.withColumn("error", F.coalesce(height * F.col("travel") / 2, F.lit(0.0))).drop("travel")
    return stated.join(own, "code", "left").select("code", F.coalesce("area", F.lit(0.0)).alias("area"), "error")


def overlap_within(a: DataFrame, b: DataFrame, max_error: float, polygon: str = "polygon") -> DataFrame:
    """(a, b, area, error, pos): overlaps of two layers (code, polygon), largest first per ``a``.

    Error is at most ``max_error``; a pair that is not returned overlaps by less. Spans meet in blocks as wide as the
    wider layer's mean span, so they are repeated about three times in all; a pair of spans counts in the block where
    their overlap begins.
    """
    travel = [sideways_travel(x, "code", polygon) for x in (a, b)]
    height = strip_height(travel, max_error)
    sides = [spans(x, height, "code", polygon) for x in (a, b)]
    widths = [s.agg(F.avg(F.col("hi") - F.col("lo"))).scalar() for s in sides]
    n = max(_cut_tasks(ring_edge_rows(x, "code", polygon), height) for x in (a, b))
    block = lambda c: floor_to_cell(c, F.col("_w"))

    def laid(df: DataFrame, tag: str) -> DataFrame:
        wide = df.withColumn("_w", F.greatest(*widths))
        cells = F.explode(F.sequence(block(F.col("lo")), block(F.col("hi")))).alias("block")
        keep = ["_w", "height"] if tag == "a" else []
        return wide.select("row", F.col("code").alias(tag), F.col("lo").alias(f"lo_{tag}"), F.col("hi").alias(f"hi_{tag}"), *keep, cells).repartition(n, "row", "block")

    met = laid(sides[0], "a").join(laid(sides[1], "b"), ["row", "block"])
    start, end = F.greatest("lo_a", "lo_b"), F.least("hi_a", "hi_b")
    area = met.filter((start < end) & (F.col("block") == block(start))).groupBy("a", "b").agg(
        F.sum((end - start) * F.col("height")).alias("area"))
    for t, tag in zip(travel, "ab", strict=True):
        area = area.join(t.select(F.col("code").alias(tag), F.col("travel").alias(f"_{tag}")), tag)
    order = Window.partitionBy("a").orderBy(F.round("area", 9).desc(), "b")  # areas overlapping one area
    return area.select("a", "b", "area", (height * (F.col("_a") + F.col("_b")) / 2).alias("error"), F.row_number().over(order).alias("pos"))
