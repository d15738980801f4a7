"""Which geometries meet which areas: points, lines and polygons against polygons.

Two closed shapes share a point exactly if their borders do, or a part of one lies whole inside the other. Borders are
compared edge by edge where they pass the same grid cell; for the other case one vertex of every part is
enough, because a part whose border meets nothing lies on one side throughout. Containment is counted over rows
(one per vertex and edge of a row strip), so neither a cell's candidates nor a shape's edges are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .spatial import edge_cells, floor_to_cell, ring_edge_rows, segments_meet


def contained(points: DataFrame, polygons: DataFrame, cell: float, code: str = "code", polygon: str = "polygon") -> DataFrame:
    """Distinct (id, code) of the polygons whose inside holds a point (id, lat, lon)."""
    e = F.col("e")
    rows = F.sequence(floor_to_cell(F.least(e.a_lat, e.b_lat), cell), floor_to_cell(F.greatest(e.a_lat, e.b_lat), cell))
    part = ["code", "feat", "part", "cy"]
    strips = ring_edge_rows(polygons, code, polygon).withColumn("cy", F.explode(rows))
    spans = strips.groupBy(*part).agg(F.min(F.least(e.a_lon, e.b_lon)).alias("lo"), F.max(F.greatest(e.a_lon, e.b_lon)).alias("hi"))
    cells = spans.withColumn("cx", F.explode(F.sequence(floor_to_cell(F.col("lo"), cell), floor_to_cell(F.col("hi"), cell)))).drop("lo", "hi")
    keyed = points.select("id", "lat", "lon").distinct().withColumns({"cy": floor_to_cell(F.col("lat"), cell), "cx": floor_to_cell(F.col("lon"), cell)})
    met = keyed.join(cells, ["cy", "cx"]).join(strips, part).filter(G.crosses(e, F.col("lat"), F.col("lon")))
    spot = ["id", "lat", "lon", "code", "feat", "part"]
    odd = met.groupBy(*spot, "ring").agg((F.count(F.lit(1)) % 2).alias("odd")).filter("odd = 1")
    inside = odd.groupBy(*spot).agg(F.min("ring").alias("lo"), F.max("ring").alias("hi")).filter("lo = 0 and hi = 0")
    return inside.select("id", "code").distinct()


def path_segments(path: Column) -> Column:
    """Edges of an open line; of a single vertex the edge from it to itself."""
    p = F.get(path, 0)
    dot = F.struct(p.lat.alias("a_lat"), p.lon.alias("a_lon"), p.lat.alias("b_lat"), p.lon.alias("b_lon"))
    return F.when(F.size(path) == 1, F.array(dot)).otherwise(G.path_edges(path))


def _part_vertices(polygon: Column) -> Column:
    """The first vertex of every part's outer ring."""
    return F.transform(polygon, lambda part: F.get(F.get(part, 0), 0))


def touching(geometries: DataFrame, areas: DataFrame, cell: float, id_col: str = "id") -> DataFrame:
    """Distinct (id, code) of geometries that share a point with an area, borders included.

    ``geometries``: (id, polygon, path), one of both null; a path of one vertex is a point. ``areas``: (code,
    polygon). A geometry without vertices meets nothing. Equal shapes are compared once.
    """
    shape = F.concat(F.hex(F.xxhash64("polygon", "path")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "polygon", "path")))
    named = geometries.select(F.col(id_col).alias("id"), "polygon", "path").withColumn("shape", shape)
    shapes = named.groupBy("shape").agg(F.first("polygon", True).alias("polygon"), F.first("path", True).alias("path"))
    solid, open_ = shapes.filter("polygon is not null").select("shape", "polygon"), shapes.filter("polygon is null and path is not null")
    own = ring_edge_rows(solid, "shape").select(F.col("code").alias("shape"), "e").unionByName(
        open_.select("shape", F.explode(path_segments(F.col("path"))).alias("e")))
    border = edge_cells(ring_edge_rows(areas).select("code", F.col("e").alias("f")).withColumn("e", F.col("f")), cell).drop("e")
    crossing = edge_cells(own, cell).join(border, ["cy", "cx"]).filter(segments_meet(F.col("e"), F.col("f"))).select("shape", "code")
    spots = solid.select("shape", F.explode(_part_vertices(F.col("polygon"))).alias("p")).unionByName(open_.select("shape", F.get("path", 0).alias("p")))
    within = contained(spots.filter("p is not null").select(F.col("shape").alias("id"), "p.lat", "p.lon"), areas, cell).select(F.col("id").alias("shape"), "code")
    marks = areas.select("code", F.explode(_part_vertices(F.col("polygon"))).alias("p")).filter("p is not null").select(F.col("code").alias("id"), "p.lat", "p.lon")
    around = contained(marks, solid, cell, "shape").select(F.col("code").alias("shape"), F.col("id").alias("code"))
    met = crossing.unionByName(within).unionByName(around).distinct()
    return named.select("id", "shape").join(met, "shape").select("id", "code").distinct()
