"""Nearest objects at any distance, and point files that are read through their index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import nearest as N
from ..session import scratch_path
from ..sources import point_files as PF
from . import tables as T
from .common import registrar, rounded
from .exports import export_points
from .shapes import CORRIDOR, _seg_dist, corridors

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

# Pins stand beside the suppliers, so that no two objects are equally far from one.
PINS = "pins AS (SELECT id AS pin, lat + 0.00037::DOUBLE AS lat, lon + 0.00073::DOUBLE AS lon FROM sp)"


def pins(spark, sf):
    s = T.supplier_points(spark, sf)
    return s.select(F.col("id").alias("pin"), (F.col("lat") + F.lit(0.00037)).alias("lat"), (F.col("lon") + F.lit(0.00073)).alias("lon"))


_D = T.haversine_sql("p.lat", "p.lon", "x.lat", "x.lon")


@query(f"""WITH {T.POINTS}, {PINS}, x AS (SELECT segment AS cat, id, lat, lon FROM cp UNION ALL SELECT 'rare', id, lat, lon FROM sp WHERE id % 50 = 0),
r AS (SELECT pin, cat, x.id, {_D} AS dist, row_number() OVER (PARTITION BY pin, cat ORDER BY {_D}, x.id) AS pos FROM pins p, x)
SELECT pin, cat, CAST(pos AS INTEGER) AS pos, id, round(dist, 3) AS dist FROM r WHERE pos <= 3""")
def nearest_points_at_any_distance(spark, sf):
    """The three nearest of every category around every pin, without a radius."""
    c = T.customer_points(spark, sf).select(F.col("segment").alias("cat"), "id", "lat", "lon")
    rare = T.supplier_points(spark, sf).filter("id % 50 = 0").select(F.lit("rare").alias("cat"), "id", "lat", "lon")
    return rounded(N.nearest_points(pins(spark, sf), c.unionByName(rare), 3), "dist", digits=3)


_ED, _SEG = _seg_dist("p.lat", "p.lon", "e"), _seg_dist("p.lat", "p.lon", "s")


@query(f"""WITH {CORRIDOR}, {PINS}, {T.inside_sql('(SELECT pin AS id, lat, lon FROM pins)', 'hold')},
d AS (
  SELECT pin, 'area' AS cat, e.code AS id, CASE WHEN any_value(h.code) IS NOT NULL THEN 0 ELSE min({_ED}) END AS dist
  FROM pins p JOIN ed e ON true LEFT JOIN hold h ON h.id = p.pin AND h.code = e.code GROUP BY pin, e.code
  UNION ALL SELECT pin, 'line', CAST(s.id AS VARCHAR), min({_SEG}) FROM pins p, seg s GROUP BY pin, s.id),
r AS (SELECT *, row_number() OVER (PARTITION BY pin, cat ORDER BY dist, id) AS pos FROM d)
SELECT pin, cat, CAST(pos AS INTEGER) AS pos, id, round(dist, 3) AS dist FROM r WHERE pos <= 3""")
def nearest_lines_and_areas(spark, sf):
    """The three nearest lines and areas of every pin; the distance to each found shape is measured over all of it."""
    lines = corridors(spark, sf).select(F.lit("line").alias("cat"), F.col("id").cast("string").alias("id"), F.lit(None).cast(G.POLYGON).alias("polygon"), "path")
    areas = T.nation_polygons(spark, sf).select(F.lit("area").alias("cat"), F.col("code").alias("id"), "polygon", F.lit(None).cast(G.RING).alias("path"))
    shapes, places = lines.unionByName(areas), pins(spark, sf)
    found = N.nearest_shapes(places, shapes, 3, 0.05).drop("dist").join(shapes, ["cat", "id"]).join(places, "pin")
    lat, lon = F.col("lat"), F.col("lon")
    dist = F.when(F.col("polygon").isNull(), G.path_distance(F.col("path"), lat, lon)).otherwise(G.polygon_distance(F.col("polygon"), lat, lon))
    return found.select("pin", "cat", "pos", "id", F.round(dist, 3).alias("dist"))


ROWS = 100


def _written(spark, sf):
    path = scratch_path(spark, "point-files")
    PF.write_even(export_points(spark, sf), path, rows_per_file=ROWS)
    return path


_SHOWN = "SELECT CAST(nation AS VARCHAR) AS kommune, segment AS cat, 'k' || CAST(id % 3 AS VARCHAR) AS sub, 'name ' || CAST(id AS VARCHAR) AS name, round(lat, 5) AS lat, round(lon, 5) AS lon FROM cp"


@query(f"WITH {T.POINTS}, p AS ({_SHOWN}) SELECT kommune, count(*) AS n, true AS fits, true AS ordered FROM p GROUP BY kommune")
def even_point_files(spark, sf):
    """SK1, SK2: areas split by measured rows: no file above the target, and the order kept within every area."""
    p = PF.read_files(spark, _written(spark, sf))
    per = p.groupBy("kommune", "file").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("cat", "sub", "name")).alias("lo"), F.max(F.struct("cat", "sub", "name")).alias("hi"))
    # files of an area by name: each begins where the one before ended
    before = F.lag("hi").over(Window.partitionBy("kommune").orderBy("file"))
    return per.withColumn("ok", F.coalesce(before <= F.col("lo"), F.lit(True))).groupBy("kommune").agg(
        F.sum("k").alias("n"), (F.max("k") <= ROWS).alias("fits"), F.every("ok").alias("ordered"))


def _circle(lat: str, lon: str, metres: int) -> str:
    return f"{T.haversine_sql(f'{lat}::DOUBLE', f'{lon}::DOUBLE', 'lat', 'lon')} <= {metres}"


@query(f"""WITH {T.POINTS}, p AS ({_SHOWN})
SELECT 'all' AS circle, * FROM p WHERE {_circle('55.7', '11.2', 25000)} UNION ALL SELECT 'some', * FROM p WHERE cat IN ('BUILDING', 'MACHINERY') AND {_circle('56.9', '9.1', 60000)}""")
def points_read_through_index(spark, sf):
    """SK3: radius reads that open only the files whose box and categories can hold a hit."""
    path = _written(spark, sf)
    index = PF.file_index(PF.read_files(spark, path)).persist()  # a row per file, read twice
    one = PF.read_circle(spark, path, index, 55.7, 11.2, 25000.0).withColumn("circle", F.lit("all"))
    two = PF.read_circle(spark, path, index, 56.9, 9.1, 60000.0, ["BUILDING", "MACHINERY"]).withColumn("circle", F.lit("some"))
    return one.unionByName(two).select("circle", "kommune", "cat", "sub", "name", "lat", "lon")


@query(f"""WITH {T.POINTS}, p AS ({_SHOWN}) SELECT kommune, count(*) AS n, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east,
  count(*) FILTER (WHERE cat = 'BUILDING') AS building_n FROM p GROUP BY kommune""")
def point_file_index(spark, sf):
    """SK3: the index by file, added up to areas."""
    i = PF.file_index(PF.read_files(spark, _written(spark, sf)))
    return i.groupBy("kommune").agg(
        F.sum("n").alias("n"), F.min("south").alias("south"), F.min("west").alias("west"), F.max("north").alias("north"), F.max("east").alias("east"),
        F.sum(F.coalesce(F.try_element_at("cats", F.lit("BUILDING")), F.lit(0))).alias("building_n"))
