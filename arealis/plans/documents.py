"""Large JSON documents written from the given tables and read back by many tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import geometry as SG
from ..sources import registers as SR
from . import tables as T
from .common import registrar
from .shapes import STEPS, corridors

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


def write_documents(elements, path: str, key: str, parts: int = 2) -> None:
    """A document per partition, all elements (one column of JSON text) in its top-level array ``key``."""

    def run(batches):
        lead = f'{{"note":{{"{key}":[{{"not":"one"}}]}},"{key}":['
        for b in batches:
            texts = b.column(0).to_pylist()
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array([(lead if i == 0 else ",") + t for i, t in enumerate(texts)], pa.string())], ["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]}" if lead == "," else lead + "]}"], pa.string())], ["value"])

    elements.repartition(parts).mapInArrow(run, "value string").write.text(path)


@query("""WITH o AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'way' ELSE 'node' END AS type, 54.0::DOUBLE + (p_partkey % 300) / 100.0::DOUBLE AS lat, 8.0::DOUBLE + (p_partkey % 700) / 100.0::DOUBLE AS lon, p_brand AS brand FROM part)
SELECT type, k AS id, round(CASE WHEN type = 'way' AND k % 3 <> 0 THEN lat + 0.25 ELSE lat END, 6) AS lat, round(CASE WHEN type = 'way' AND k % 3 <> 0 THEN lon + 0.5 ELSE lon END, 6) AS lon, brand
FROM o WHERE k % 7 <> 0""")
def map_objects_from_documents(spark, sf):
    """SC9, H24, U8: nodes at their point, ways at the centre given or at the mean of their vertices, none without a position, each once."""
    k = F.col("p_partkey").cast("long")
    lat, lon, none = F.lit(54.0) + (k % 300) / F.lit(100.0), F.lit(8.0) + (k % 700) / F.lit(100.0), F.lit(None)
    spot = F.struct(lat.alias("lat"), lon.alias("lon"))
    shape = F.array(spot, F.struct((lat + F.lit(0.5)).alias("lat"), (lon + F.lit(1.0)).alias("lon")))
    way, placed = k % 5 == 0, k % 7 != 0
    p = T.table(spark, sf, "part").select(F.struct(
        F.when(way, "way").otherwise("node").alias("type"), k.alias("id"), F.when(~way & placed, lat).otherwise(none).alias("lat"), F.when(~way & placed, lon).otherwise(none).alias("lon"),
        F.when(way & placed & (k % 3 == 0), spot).alias("center"), F.when(way & placed & (k % 3 != 0), shape).alias("geometry"),
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("note"), F.lit('a "quoted" } brace')).alias("tags")).alias("e"), k.alias("k"))
    path = scratch_path(spark, "objects")
    # responses overlap: some objects come twice
    write_documents(p.select("e").unionByName(p.filter("k % 10 = 0").select("e")).select(F.to_json("e")), path, "elements")
    o = SR.map_objects(spark, path)
    return o.select("type", "id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.col("tags")["brand"].alias("brand"))


_ENDS = (STEPS[0], STEPS[-1])


@query(f"""WITH {T.POINTS} SELECT CAST(id AS VARCHAR) AS code, 'line' AS kind, CAST({len(STEPS)} AS INTEGER) AS vertices, round(lat + {_ENDS[0][0]}::DOUBLE, 6) AS lat, round(lon + {_ENDS[1][1]}::DOUBLE, 6) AS lon FROM sp
UNION ALL SELECT CAST(id AS VARCHAR), 'point', 1, round(lat, 6), round(lon, 6) FROM sp WHERE id % 3 <> 0""")
def features_from_documents(spark, sf):
    """SC7: lines and points out of feature collections; features without geometry give none."""
    s, c = T.supplier_points(spark, sf), corridors(spark, sf)
    feature = lambda kind, coordinates: F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("id").cast("string").alias("kode")).alias("properties"),
        F.when(F.lit(kind != ""), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))).alias("geometry"))
    pair = lambda p: F.array(p["lon"], p["lat"])
    lines = c.select(F.to_json(feature("LineString", F.transform("path", pair))).alias("e"))
    points = s.filter("id % 3 <> 0").select(F.to_json(feature("Point", F.array("lon", "lat"))).alias("e"))
    bare = s.filter("id % 3 = 0").select(F.to_json(feature("", F.lit(None).cast("array<double>"))).alias("e"))
    path = scratch_path(spark, "features")
    write_documents(lines.unionByName(points).unionByName(bare), path, "features")
    f = SG.read_features(spark, path)
    read_lines = SG.paths(f, ["kode"]).select(
        "code", F.lit("line").alias("kind"), F.size("path").alias("vertices"), F.round(F.get("path", 0)["lat"], 6).alias("lat"), F.round(F.element_at("path", -1)["lon"], 6).alias("lon"))
    read_points = SG.points(f, ["kode"]).select("code", F.lit("point").alias("kind"), F.lit(1).alias("vertices"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
    return read_lines.unionByName(read_points)
