"""Point files of even size with an index by file, and reads that open only the files they need.

Files follow area, category, kind and name over range partitions cut by measured rows: a large area is written by many
tasks, small ones share a task, and no file holds more rows than asked for. The index has a row per file with its box and its counts, so
a read within a box, a circle or a category opens the files that can hold a hit and no others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import tasks_for

ORDER = ("cat", "sub", "name")
FILES_PER_TASK = 250  # below the thousand from which names of one task's files would no longer sort by number
ROWS_PER_TASK = 1_000_000
_POINT = "cat string, sub string, name string, lat double, lon double"


def write_even(points: DataFrame, path: str, area: str = "kommune", order: Sequence[str] = ORDER, rows_per_file: int = 100_000) -> None:
    """Points as JSON lines below a folder per area, coordinates to five decimals. The target is replaced as a whole.

    A task writes many files, so tasks and what they report grow with the rows and not with the number of files.
    """
    d = points.withColumns({"lat": F.round("lat", 5), "lon": F.round("lon", 5)})
    files = max(1, min(FILES_PER_TASK, ROWS_PER_TASK // rows_per_file))
    parts = tasks_for(d.count(), rows_per_file * files)
    keys = [area, *order, "lat", "lon"]
    ranged = d.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(area).json(path)


def read_files(spark: SparkSession, path: str, files: Sequence[str] | None = None, area: str = "kommune", schema: str = _POINT) -> DataFrame:
    """Points of all files, or of those named, with their area from the folder's name and their ``file``."""
    reader = spark.read.schema(f"{schema}, {area} string")
    df = reader.json(path) if files is None else reader.option("basePath", path).json(list(files)) if files else reader.json(path).limit(0)
    return df.withColumn("file", F.col("_metadata.file_path"))


def file_index(points: DataFrame, area: str = "kommune") -> DataFrame:
    """(file, area, n, south, west, north, east, cats) of every file, in one pass. ``cats`` maps a category to its count."""
    per = points.groupBy("file", area, "cat").agg(
        F.count(F.lit(1)).alias("n"), F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("nn"), F.max("lon").alias("e"))
    counts = F.map_from_entries(F.collect_list(F.struct("cat", "n")))  # a handful of categories
    return per.groupBy("file", area).agg(
        F.sum("n").alias("n"), F.min("s").alias("south"), F.min("w").alias("west"), F.max("nn").alias("north"), F.max("e").alias("east"), counts.alias("cats"))


def box_around(lat: float, lon: float, radius_m: float) -> tuple[float, float, float, float]:
    """(south, west, north, east) of a box that holds the circle; all longitudes where it reaches a pole or the 180th meridian."""
    up = math.degrees(radius_m / G.EARTH_MEAN) * 1.001
    south, north = lat - up, lat + up
    if max(abs(south), abs(north)) >= 90:
        return south, -180.0, north, 180.0
    side = math.degrees(math.asin(min(1.0, math.sin(math.radians(up)) / math.cos(math.radians(lat))))) * 1.001
    west, east = lon - side, lon + side
    return (south, -180.0, north, 180.0) if west < -180 or east > 180 else (south, west, north, east)


def files_for(index: DataFrame, boxes: Sequence[tuple[float, float, float, float]], cats: Sequence[str] | None = None) -> list[str]:
    """Files that can hold a point of the categories in one of the boxes. Only their names reach the driver, as the names of any
    files that are read do."""
    meets = F.lit(False)
    for s, w, n, e in boxes:
        meets = meets | ((F.col("south") <= n) & (F.col("north") >= s) & (F.col("west") <= e) & (F.col("east") >= w))
    if cats is not None:
        meets = meets & F.exists(F.map_keys("cats"), lambda c: c.isin(list(cats)))
    return [r.file for r in index.filter(meets).select("file").toLocalIterator()]


def within(lat: float, lon: float, radius_m: float) -> Column:
    return G.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) <= radius_m


def read_circle(spark: SparkSession, path: str, index: DataFrame, lat: float, lon: float, radius_m: float, cats: Sequence[str] | None = None, area: str = "kommune") -> DataFrame:
    """Points within a radius, of the categories if any are named, from the files that can hold them."""
    files = files_for(index, [box_around(lat, lon, radius_m)], cats)
    df = read_files(spark, path, files, area).filter(within(lat, lon, radius_m))
    return df if cats is None else df.filter(F.col("cat").isin(list(cats)))
