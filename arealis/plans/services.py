"""Timetable chain, station clusters and map-object classification over the given tables.

Line items play stop times (order = trip, part = stop), orders play trips and customers routes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as X
from ..operators import graph as Gr
from ..operators import timetable as TT
from . import tables as T
from .common import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

SEGMENT_ROUTE = {"AUTOMOBILE": "3", "BUILDING": "1", "FURNITURE": "109", "HOUSEHOLD": "715", "MACHINERY": "2"}
RADIUS = {"bus": 2000.0, "metro": 3000.0, "s-train": 3000.0, "rail": 3000.0, "light-rail": 3000.0}


def timetable(spark, sf):
    st = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id"))
    trips = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id"))
    routes = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("route_id"), K.lookup("c_mktsegment", SEGMENT_ROUTE).alias("route_type"))
    return st, trips, routes


def stops(spark, sf):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, " St.").when(k % 4 == 1, F.concat(F.lit(" (Bay "), (k % 7).cast("string"), F.lit(")"))).when(k % 4 == 2, " Station (North)").otherwise("")
    return T.table(spark, sf, "part").select(
        k.alias("stop_id"), F.concat("p_name", tail).alias("stop_name"),
        (F.lit(55.0) + (k * 37 % 300) / F.lit(1000.0)).alias("lat"), (F.lit(12.0) + (k * 91 % 500) / F.lit(1000.0)).alias("lon"))


CHAIN = """
rt AS (SELECT c_custkey AS route_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '3' WHEN 'BUILDING' THEN '1' WHEN 'FURNITURE' THEN '109' WHEN 'HOUSEHOLD' THEN '715' WHEN 'MACHINERY' THEN '2' END AS route_type FROM customer),
ty AS (SELECT DISTINCT l_partkey AS stop_id, route_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN rt ON o_custkey = route_id),
md AS (SELECT DISTINCT stop_id, CASE route_type WHEN '3' THEN 'bus' WHEN '1' THEN 'metro' WHEN '109' THEN 's-train' WHEN '2' THEN 'rail' END AS mode FROM ty WHERE route_type <> '715'),
stp AS (SELECT p_partkey AS stop_id, p_name AS key, p_name || CASE p_partkey % 4 WHEN 0 THEN ' St.' WHEN 1 THEN '' WHEN 2 THEN ' Station' ELSE '' END AS shown,
        55.0::DOUBLE + (p_partkey * 37 % 300) / 1000.0::DOUBLE AS lat, 12.0::DOUBLE + (p_partkey * 91 % 500) / 1000.0::DOUBLE AS lon FROM part)"""


@query(f"WITH {CHAIN} SELECT stop_id, mode FROM md")
def timetable_stop_modes(spark, sf):
    """J23, SC8, F32: stop times to trips to routes, distinct stop and mode."""
    return TT.stop_modes(TT.stop_route_types(*timetable(spark, sf)))


@query(f"WITH {CHAIN} SELECT route_type, 'flextur (demand-responsive)' AS label, count(*) AS stops FROM ty WHERE route_type = '715' GROUP BY route_type")
def timetable_excluded_stops(spark, sf):
    """F32: stops of the excluded route types counted apart."""
    return TT.excluded_stops(TT.stop_route_types(*timetable(spark, sf)))


LINKED = f"""{CHAIN}, pt AS (SELECT stop_id AS id, key, mode, shown, lat, lon, CASE WHEN mode = 'bus' THEN 2000 ELSE 3000 END AS r FROM stp JOIN md USING (stop_id)),
near AS (SELECT a.key, a.mode, a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.key = b.key AND a.mode = b.mode AND abs(a.lat - b.lat) < 0.03 AND {T.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= a.r),
reach AS (SELECT key, mode, a, b FROM near UNION SELECT reach.key, reach.mode, reach.a, near.b FROM reach JOIN near ON near.key = reach.key AND near.mode = reach.mode AND near.a = reach.b),
comp AS (SELECT key, mode, a AS id, min(b) AS component FROM reach GROUP BY ALL)"""


@query(f"WITH RECURSIVE {LINKED} SELECT id, key, mode, component FROM comp")
def station_components(spark, sf):
    """Single-linkage clusters inside name and mode; component = smallest member."""
    modes = TT.stop_modes(TT.stop_route_types(*timetable(spark, sf)))
    c = TT.stations(stops(spark, sf), modes, RADIUS, 3000.0)
    return c.select("id", "key", "mode", "component")


@query(f"""WITH RECURSIVE {LINKED}, nm AS (SELECT comp.key, comp.mode, component, shown, count(*) AS k, sum(lat) AS sy, sum(lon) AS sx FROM comp JOIN pt USING (id, key, mode) GROUP BY ALL)
SELECT key, mode, component, CAST(sum(k) AS BIGINT) AS platforms, round(sum(sy) / sum(k), 6) AS lat, round(sum(sx) / sum(k), 6) AS lon, min_by(shown, (-k, shown)) AS name FROM nm GROUP BY ALL""")
def station_points(spark, sf):
    """Centroid, platforms and most common name of every cluster."""
    modes = TT.stop_modes(TT.stop_route_types(*timetable(spark, sf)))
    return rounded(TT.station_points(TT.stations(stops(spark, sf), modes, RADIUS, 3000.0)), "lat", "lon")


@query(f"""WITH RECURSIVE {LINKED}, multi AS (SELECT stop_id FROM md GROUP BY stop_id HAVING count(*) > 1)
SELECT md.mode, count(*) AS stops_before, count(multi.stop_id) AS multi_mode_stops, max(p.n) AS points_after FROM md LEFT JOIN multi USING (stop_id)
JOIN (SELECT mode, count(DISTINCT (key, component)) AS n FROM comp GROUP BY mode) p ON p.mode = md.mode GROUP BY md.mode""")
def stops_before_and_after_clustering(spark, sf):
    """Stops and stations per mode, and stops that serve several modes."""
    modes = TT.stop_modes(TT.stop_route_types(*timetable(spark, sf)))
    return TT.stop_counts(modes, TT.station_points(TT.stations(stops(spark, sf), modes, RADIUS, 3000.0)))


@query(f"""WITH RECURSIVE {T.POINTS}, e AS (SELECT a.id AS a, b.id AS b FROM cp a JOIN cp b ON a.segment = b.segment AND abs(a.lat - b.lat) < 0.15 AND {T.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 15000),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS id, min(b) AS component FROM r GROUP BY a""")
def customer_components(spark, sf):
    """Connected components of customers of one segment within 15 km steps."""
    c = T.customer_points(spark, sf).select("id", "segment", "lat", "lon")
    return Gr.single_linkage(c, ["segment"], 15000.0).select("id", "component")


@query(f"WITH {CHAIN} SELECT stop_id, key, shown FROM stp")
def stop_name_keys(spark, sf):
    """H6: trailing brackets, station suffixes and punctuation removed from stop names."""
    s = X.with_unicode_form(stops(spark, sf), "stop_name", "nfc")
    return s.select("stop_id", X.stop_name_key(F.col("nfc")).alias("key"), X.display_name(F.col("stop_name")).alias("shown"))


OBJECTS = """
ob AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'way' ELSE 'node' END AS type, p_partkey // 2 AS id,
  CASE p_size % 4 WHEN 0 THEN 'supermarket' WHEN 1 THEN 'convenience' WHEN 2 THEN 'bakery' END AS shop,
  CASE p_size % 6 WHEN 0 THEN 'pharmacy' WHEN 1 THEN 'cafe' WHEN 2 THEN 'bar' WHEN 3 THEN 'school' END AS amenity FROM part),
cl AS (SELECT type, id, shop, amenity, CASE WHEN shop IN ('supermarket', 'convenience') THEN 'grocery' WHEN amenity = 'pharmacy' THEN 'pharmacy' WHEN amenity IN ('cafe', 'bar') THEN 'food' END AS cat,
  CASE WHEN shop IN ('supermarket', 'convenience') THEN shop WHEN amenity IN ('pharmacy', 'cafe', 'bar') THEN amenity END AS sub,
  CAST(coalesce(shop IN ('supermarket', 'convenience'), false)::INT + coalesce(amenity IN ('pharmacy', 'cafe', 'bar'), false)::INT AS INTEGER) AS n_hits FROM ob)"""


def objects(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    shop = F.when(z % 4 == 0, "supermarket").when(z % 4 == 1, "convenience").when(z % 4 == 2, "bakery")
    amenity = F.when(z % 6 == 0, "pharmacy").when(z % 6 == 1, "cafe").when(z % 6 == 2, "bar").when(z % 6 == 3, "school")
    tags = F.map_filter(F.create_map(F.lit("shop"), shop, F.lit("amenity"), amenity), lambda _k, v: v.isNotNull())
    return T.table(spark, sf, "part").select(F.when(k % 5 == 0, "way").otherwise("node").alias("type"), F.floor(k / 2).alias("id"), tags.alias("tags"))


def classified(spark, sf):
    return objects(spark, sf).withColumn("c", K.service_class(F.col("tags"))).filter(F.col("c").isNotNull()).select("type", "id", "tags", "c.cat", "c.sub", "c.n_hits")


@query(f"WITH {OBJECTS} SELECT type, id, cat, sub, n_hits FROM cl WHERE cat IS NOT NULL")
def tag_classification_with_precedence(spark, sf):
    """F20, SC9: map-object tags to category and kind, groceries before pharmacies before food."""
    return classified(spark, sf).drop("tags")


@query(f"WITH {OBJECTS} SELECT type, cat, count(*) AS n, count(*) FILTER (WHERE n_hits > 1) AS dual FROM cl WHERE cat IS NOT NULL GROUP BY ALL")
def tag_counts_with_dual_tags(spark, sf):
    """Counts per kind of object, and objects that carry two of the tags."""
    return classified(spark, sf).groupBy("type", "cat").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_hits") > 1).alias("dual"))


@query(f"WITH {OBJECTS} SELECT DISTINCT type, id FROM ob")
def objects_deduplicated(spark, sf):
    """U8: an object appears once per type and id however many responses carry it."""
    return objects(spark, sf).dropDuplicates(["type", "id"]).select("type", "id")


@query(f"""WITH {T.POINTS}, p AS (SELECT nation AS kommune, segment AS cat, CAST(id % 3 AS VARCHAR) AS sub FROM cp)
SELECT kommune, cat, sub, count(*) AS n FROM p GROUP BY ROLLUP (kommune, cat, sub)""")
def counts_rollup(spark, sf):
    """Counts per area, category and kind with all their subtotals."""
    p = T.customer_points(spark, sf).select(F.col("nation").alias("kommune"), F.col("segment").alias("cat"), (F.col("id") % 3).cast("string").alias("sub"))
    return p.rollup("kommune", "cat", "sub").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS nfc_md5 FROM documents")
def unicode_composed_form(spark, sf):
    """Whole texts in composed form; only non-ASCII spellings reach the Arrow function."""
    d = T.table(spark, sf, "documents").select("doc_id", "text")
    return X.with_unicode_form(d, "text", "nfc").select("doc_id", F.md5("nfc").alias("nfc_md5"))
