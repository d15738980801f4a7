"""Spatial joins over the derived points and nation polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import geometry as G
from ..operators import spatial as S
from . import tables as T
from .common import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

CELL = 0.05


def index(spark, sf, cell: float = CELL):
    return S.area_index(T.nation_polygons(spark, sf), cell)


@query(f"WITH {T.POINTS}, {T.EDGES}, {T.inside_sql('cp', 'hit')} SELECT cp.id, hit.code FROM cp LEFT JOIN hit USING (id)")
def point_in_polygon(spark, sf):
    """The area each point lies in, null outside all of them."""
    pts = T.customer_points(spark, sf).select("id", "lat", "lon")
    return S.locate(pts, index(spark, sf), CELL).select("id", "code")


@query(f"""WITH {T.POINTS}, {T.EDGES}, {T.inside_sql('cp', 'hit')}
SELECT hit.code, n_regionkey AS region, count(*) AS n, CAST(sum(cp.cents) AS BIGINT) AS cents FROM cp JOIN hit USING (id) JOIN nation ON CAST(hit.code AS INT) = n_nationkey GROUP BY ALL""")
def point_in_polygon_two_levels(spark, sf):
    """Nation and region polygons in turn; points outside dropped, counts and sums per pair."""
    nat = T.nation_polygons(spark, sf)
    reg = nat.select(F.col("region").alias("code"), "polygon")
    pts = T.customer_points(spark, sf).select("id", "lat", "lon", "cents")
    hit = S.locate_levels(pts, {"nation": S.area_index(nat, CELL), "region": S.area_index(reg, CELL)}, CELL)
    return hit.filter(F.col("nation").isNotNull()).groupBy(F.col("nation").alias("code"), "region").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


D_CS = T.haversine_sql("c.lat", "c.lon", "s.lat", "s.lon")
D_CS_ROUND = T.haversine_sql("c.lat", "c.lon", "s.lat", "s.lon", "6371000.0")


@query(f"""WITH {T.POINTS} SELECT c.id AS customer, s.id AS supplier, round({D_CS}, 3) AS dist FROM cp c JOIN sp s ON abs(c.lat - s.lat) < 0.2 WHERE {D_CS} <= 15000""")
def pairs_within_radius(spark, sf):
    """All customer-supplier pairs at most 15 km apart."""
    c, s = T.customer_points(spark, sf).select("id", "lat", "lon"), T.supplier_points(spark, sf).select("id", "lat", "lon")
    p = S.within_radius(c, s, 15000.0, digits=3)
    return p.select(F.col("a_id").alias("customer"), F.col("b_id").alias("supplier"), "dist")


@query(f"""WITH {T.POINTS}, p AS (SELECT c.id, s.id AS sid, CASE s.code WHEN '421' THEN 0 WHEN '422' THEN 1 END AS rk, {D_CS_ROUND} AS d FROM cp c JOIN sp s ON abs(c.lat - s.lat) < 0.3 WHERE s.code IN ('421', '422')),
q AS (SELECT *, min(rk) OVER (PARTITION BY id) AS best FROM p WHERE d <= 20000)
SELECT id AS customer, sid AS supplier, CASE WHEN rk = 0 THEN '421' ELSE 'fallback_42x' END AS match, round(d, 3) AS dist FROM q WHERE rk = best""")
def preferred_or_fallback_class(spark, sf):
    """The preferred building class within the radius, else the fallback class."""
    c = T.customer_points(spark, sf).select("id", "lat", "lon")
    s = T.supplier_points(spark, sf).select("id", "code", "lat", "lon")
    rank = F.when(F.col("code") == "421", 0).when(F.col("code") == "422", 1)
    p = S.preferred_class_within(c, s, 20000.0, "id", rank, digits=3)
    match = F.when(F.col("b_rank") == 0, "421").otherwise("fallback_42x")
    return p.select(F.col("a_id").alias("customer"), F.col("b_id").alias("supplier"), match.alias("match"), "dist")


@query(f"""WITH {T.POINTS}, p AS (SELECT c.id, s.name, sqrt(((s.lat - c.lat) * 111320) ** 2 + ((s.lon - c.lon) * (111320 * 0.57)) ** 2) AS d FROM cp c JOIN sp s ON abs(c.lat - s.lat) < 0.2),
b AS (SELECT id, min_by(name, (d, name)) AS name, min(d) AS d FROM p WHERE d < 12000 GROUP BY id)
SELECT cp.id, b.name AS nearest_name, round(b.d, 3) AS dist FROM cp LEFT JOIN b USING (id)""")
def nearest_name_within(spark, sf):
    """The closest named point under a limit, on a flat local plane; null where none is close."""
    c = T.customer_points(spark, sf).select("id", "lat", "lon")
    s = T.supplier_points(spark, sf).select("name", "lat", "lon")
    return rounded(S.nearest(c, s, 12000.0, "name", flat=True).select("id", "nearest_name", "dist"), "dist", digits=3)


@query(f"""WITH {T.POINTS} SELECT 'customer' AS origin, 'k' || CAST(id AS VARCHAR) AS id, segment AS cat, round(lat, 6) AS lat, round(lon, 6) AS lon FROM cp
UNION ALL SELECT 'supplier', 's' || CAST(id AS VARCHAR), code, round(lat, 6), round(lon, 6) FROM sp""")
def point_sources_united(spark, sf):
    """Point sources of different make in one schema."""
    c, s = T.customer_points(spark, sf), T.supplier_points(spark, sf)
    one = c.select(F.lit("customer").alias("origin"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"), F.col("segment").alias("cat"), "lat", "lon")
    two = s.select(F.lit("supplier").alias("origin"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.col("code").alias("cat"), "lat", "lon")
    return rounded(one.unionByName(two), "lat", "lon")


D_SC = T.haversine_sql("p.lat", "p.lon", "x.lat", "x.lon")
PINS = "pins AS (SELECT n_nationkey AS pin, 54.9::DOUBLE + (n_nationkey * 7 % 25) / 10.0::DOUBLE AS lat, 8.4::DOUBLE + (n_nationkey * 11 % 25) / 4.0::DOUBLE AS lon FROM nation)"
NEAR = f"""near AS (
  SELECT pin, 'customer' AS kind, CAST(x.id AS VARCHAR) AS id, x.segment AS name, {D_SC} AS dist FROM pins p JOIN cp x ON abs(p.lat - x.lat) < 0.5
  UNION ALL SELECT pin, 'supplier', CAST(x.id AS VARCHAR), x.code, {D_SC} FROM pins p JOIN sp x ON abs(p.lat - x.lat) < 0.5)"""


def around(spark, sf):
    n = F.col("n_nationkey")
    pins = T.table(spark, sf, "nation").select(
        n.alias("id"), (F.lit(54.9) + (n * 7 % 25) / F.lit(10.0)).alias("lat"), (F.lit(8.4) + (n * 11 % 25) / F.lit(4.0)).alias("lon"))
    kinds = {
        "customer": T.customer_points(spark, sf).withColumnRenamed("segment", "name"),
        "supplier": T.supplier_points(spark, sf).drop("name").withColumnRenamed("code", "name"),
    }
    return S.around_pins(pins, kinds, 30000.0)


@query(f"WITH {T.POINTS}, {PINS}, {NEAR} SELECT CAST(pin AS INTEGER) AS pin, kind, id, name, round(dist, 3) AS dist FROM near WHERE dist <= 30000")
def everything_around_pins(spark, sf):
    """Several kinds of objects within a radius of each pin."""
    return rounded(around(spark, sf), "dist", digits=3)


@query(f"WITH {T.POINTS}, {PINS}, {NEAR} SELECT CAST(pin AS INTEGER) AS pin, kind, name, count(*) AS n, round(min(dist), 3) AS nearest FROM near WHERE dist <= 30000 GROUP BY ALL")
def radius_counts_per_category(spark, sf):
    """Totals and nearest distance per category of a radius read."""
    return rounded(S.category_counts(around(spark, sf), ["pin", "kind", "name"]), "nearest", digits=3)


@query(f"""WITH {T.POINTS}, {PINS}, {NEAR}, r AS (SELECT pin, kind, id, name, dist, row_number() OVER (PARTITION BY pin, kind, name ORDER BY dist, id) AS pos FROM near WHERE dist <= 30000)
SELECT CAST(pin AS INTEGER) AS pin, kind, name, id, CAST(pos AS INTEGER) AS pos, round(dist, 3) AS dist FROM r WHERE pos <= 3""")
def three_nearest_per_category(spark, sf):
    """The three nearest of every category around every pin."""
    from ..functions import ranking as R

    top = R.top_n(around(spark, sf), ["pin", "kind", "name"], [F.col("dist"), F.col("id")], 3)
    return rounded(top, "dist", digits=3)


@query(f"""WITH {T.POINTS}, {PINS}, {NEAR} SELECT CAST(pin AS INTEGER) AS pin, kind, name, count(*) AS n, round(min(dist), 3) AS dist
FROM near WHERE dist <= 30000 GROUP BY pin, kind, name, floor(dist / 5000 + 0.5)""")
def near_duplicates_folded(spark, sf):
    """Rows of one kind and name in the same distance step become one row with a count."""
    return rounded(S.fold_near_duplicates(around(spark, sf), ["pin", "kind", "name"], 5000.0), "dist", digits=3)


@query(f"""WITH {T.POINTS}, g AS (SELECT CAST(floor(lat / 0.3) AS BIGINT) AS cy, CAST(floor(lon / 0.5) AS BIGINT) AS cx, segment, count(*) AS k, sum(lat) AS sy, sum(lon) AS sx FROM cp GROUP BY ALL)
SELECT cy, cx, CAST(sum(k) AS BIGINT) AS n, round(sum(sy) / sum(k), 6) AS lat, round(sum(sx) / sum(k), 6) AS lon, min_by(segment, (-k, segment)) AS top_cat FROM g GROUP BY ALL""")
def density_clusters(spark, sf):
    """Grid cells with count, centroid and dominant category."""
    p = T.customer_points(spark, sf).select("lat", "lon", F.col("segment").alias("cat"))
    return rounded(S.density_clusters(p, 0.3, 0.5), "lat", "lon")


# Zones per horizon: later horizons take in more nations' polygons.
HZ = "hz AS (SELECT * FROM (VALUES ('today', 0), ('2070', 1), ('2120', 2)) AS t(horizon, k))"


def zones(spark, sf):
    nat = T.nation_polygons(spark, sf).withColumn("k", F.col("code").cast("int") % 3)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(i).alias("upto")) for i, h in enumerate(("today", "2070", "2120"))]))
    return nat.select("k", "polygon", each.alias("h")).filter(F.col("k") <= F.col("h.upto")).select(F.col("h.horizon").alias("horizon"), "polygon")


EXPO = f"""{T.POINTS}, {T.EDGES}, {T.inside_sql('cp', 'hit')}, {HZ},
lvl AS (SELECT id, 'nation' AS level, CAST(nation AS VARCHAR) AS code FROM cp UNION ALL SELECT id, 'region', CAST(n_regionkey AS VARCHAR) FROM cp JOIN nation ON nation = n_nationkey),
ex AS (SELECT level, lvl.code, horizon, count(*) AS n, count(*) FILTER (WHERE CAST(hit.code AS INT) % 3 <= k) AS n_in_zone FROM lvl LEFT JOIN hit USING (id), hz GROUP BY ALL)"""


def exposed(spark, sf):
    pts = T.customer_points(spark, sf).join(T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")), "nation")
    return S.exposure(pts.select("id", "lat", "lon", "nation", "region"), zones(spark, sf), ["today", "2070", "2120"],
                      {"nation": "nation", "region": "region"}, CELL, tolerance_m=0.0)


@query(f"WITH {EXPO} SELECT level, code, horizon, n, n_in_zone, round(n_in_zone * 100 / n, 6) AS pct FROM ex")
def zone_exposure_by_level(spark, sf):
    """Units inside the zone per level and horizon, as a share of the level's own total."""
    return rounded(exposed(spark, sf), "pct")


@query(f"""WITH {EXPO}, o AS (SELECT *, lag(n_in_zone) OVER (PARTITION BY level, code ORDER BY CASE horizon WHEN 'today' THEN 0 WHEN '2070' THEN 1 ELSE 2 END) AS prev FROM ex)
SELECT level, code, horizon, n_in_zone, prev FROM o WHERE n_in_zone < prev""")
def horizon_monotone_violations(spark, sf):
    """Later horizons may not shrink; only violations are listed (none here)."""
    from ..operators import quality as Q

    order = K.lookup("horizon", {"today": 0, "2070": 1, "2120": 2})
    return Q.not_monotone(exposed(spark, sf), ["level", "code"], order, "n_in_zone").select("level", "code", "horizon", "n_in_zone", "prev")


@query(f"""WITH {T.EDGES} SELECT code, round(min(a_lat), 6) AS south, round(min(a_lon), 6) AS west, round(max(a_lat), 6) AS north, round(max(a_lon), 6) AS east FROM ed WHERE ring = 0 GROUP BY code""")
def bounding_boxes(spark, sf):
    """JG6, H16: bounding boxes from the outer rings."""
    return rounded(S.boxes(T.nation_polygons(spark, sf)), "south", "west", "north", "east")


@query(f"""WITH {T.EDGES}, bx AS (SELECT code, min(a_lat) AS s, min(a_lon) AS w, max(a_lat) AS n, max(a_lon) AS e FROM ed WHERE ring = 0 GROUP BY code), {PINS},
c AS (SELECT pin, lpad(CAST(pin AS VARCHAR), 2, '0') AS own, lat - 40000 / 110540.0::DOUBLE AS s, lon - 40000 / (cos(radians(lat)) * 111320.0::DOUBLE) AS w, lat + 40000 / 110540.0::DOUBLE AS n, lon + 40000 / (cos(radians(lat)) * 111320.0::DOUBLE) AS e FROM pins)
SELECT CAST(pin AS INTEGER) AS pin, code, code = own AS own FROM c JOIN bx ON bx.s <= c.n AND bx.n >= c.s AND bx.w <= c.e AND bx.e >= c.w
UNION SELECT CAST(pin AS INTEGER), own, true FROM c""")
def boxes_touching_circles(spark, sf):
    """Areas whose box meets a circle around a pin, the pin's own area always included."""
    n = F.col("n_nationkey")
    pins = T.table(spark, sf, "nation").select(n.alias("pin"), F.lpad(n.cast("string"), 2, "0").alias("own"),
        (F.lit(54.9) + (n * 7 % 25) / F.lit(10.0)).alias("lat"), (F.lit(8.4) + (n * 11 % 25) / F.lit(4.0)).alias("lon"))
    return S.boxes_touching_circle(S.boxes(T.nation_polygons(spark, sf)), pins, 40000.0, 0.5)


# Grid coverage by brute force: every cell centre against every polygon.
GRID = f"""{T.EDGES}, grid AS (SELECT y AS cy, x AS cx, y * 0.05::DOUBLE + 0.025::DOUBLE AS lat, x * 0.05::DOUBLE + 0.025::DOUBLE AS lon, row_number() OVER () AS id
  FROM range(1085, 1160) AS a(y), range(155, 305) AS b(x)),
gr AS (SELECT g.id, g.cy, g.cx, e.code, e.ring, sum(CASE WHEN ((e.a_lat > g.lat) <> (e.b_lat > g.lat)) AND g.lon < (e.b_lon - e.a_lon) * (g.lat - e.a_lat) / (e.b_lat - e.a_lat) + e.a_lon THEN 1 ELSE 0 END) % 2 AS odd
  FROM grid g, ed e GROUP BY ALL),
cov AS (SELECT code, cy, cx FROM gr GROUP BY ALL HAVING max(CASE WHEN ring = 0 THEN odd ELSE 0 END) = 1 AND max(CASE WHEN ring > 0 THEN odd ELSE 0 END) = 0)"""


@query(f"WITH {GRID} SELECT code, cy, cx FROM cov")
def polygon_cell_coverage(spark, sf):
    """Section 2.5: cells whose centre lies in an area, filled row by row."""
    return S.coverage(T.nation_polygons(spark, sf), CELL)


def shifted(spark, sf):
    """A second set of areas: the nation polygons moved, so that they straddle their neighbours."""
    move = lambda p: F.struct((p.lat + 0.25).alias("lat"), (p.lon + 0.6).alias("lon"))
    nat = T.nation_polygons(spark, sf)
    return nat.select("code", "name", "polygon", F.transform("polygon", lambda part: F.transform(part, lambda r: F.transform(r, move))).alias("moved"))


SHIFT = f"""{GRID}, shf AS (SELECT code, cy + 5 AS cy, cx + 12 AS cx FROM cov),
ov AS (SELECT b.code AS a, c.code AS b, count(*) AS cells FROM shf b JOIN cov c ON b.cy = c.cy AND b.cx = c.cx GROUP BY ALL)"""


def shifted_overlap(spark, sf):
    nat = S.coverage(T.nation_polygons(spark, sf), CELL)
    moved = nat.withColumns({"cy": F.col("cy") + 5, "cx": F.col("cx") + 12})
    return S.overlap(moved, nat, CELL * CELL)


@query(f"""WITH {SHIFT} SELECT a, b, cells, round(cells * 0.0025::DOUBLE, 6) AS area, round(cells / sum(cells) OVER (PARTITION BY a) * 100, 6) AS share, CAST(row_number() OVER (PARTITION BY a ORDER BY cells DESC, b) AS INTEGER) AS pos FROM ov""")
def overlap_share_dominant_first(spark, sf):
    """JG1: overlap of two area sets by cells, dominant area first."""
    from pyspark.sql import Window

    o = shifted_overlap(spark, sf)
    total = F.sum("cells").over(Window.partitionBy("a"))
    return rounded(o.withColumn("share", F.col("cells") / total * 100), "area", "share")


@query(f"""WITH {SHIFT} SELECT a, coalesce(string_agg(b, ',' ORDER BY b) FILTER (WHERE cells >= 40), '') AS members, coalesce(string_agg(b, ',' ORDER BY b) FILTER (WHERE cells < 40), '') AS marginal FROM ov GROUP BY a""")
def members_and_marginal_areas(spark, sf):
    """JG2: areas overlapped by at least a threshold are members, the rest marginal."""
    return S.members_and_marginal(shifted_overlap(spark, sf).withColumn("area", F.col("cells").cast("double")), 40.0)


@query("""SELECT 'TILE_' || CAST(n_nationkey % 7 AS VARCHAR) AS name, n_regionkey AS parent, min(lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS code,
  string_agg(lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), ' ' ORDER BY n_nationkey) AS codes, CAST(count(*) AS INTEGER) AS parts
FROM nation GROUP BY n_nationkey % 7, n_regionkey""")
def merged_same_name_areas(spark, sf):
    """JG3: areas sharing name and dominant parent merged under the lowest code."""
    nat = T.nation_polygons(spark, sf).withColumn("name", F.concat(F.lit("TILE_"), (F.col("code").cast("int") % 7).cast("string")))
    m = S.merge_same_name(nat.withColumnRenamed("region", "parent"))
    return m.select("name", "parent", "code", F.array_join("codes", " ").alias("codes"), F.size("polygon").alias("parts"))


@query(f"""WITH {T.POINTS}, c AS (SELECT CAST(floor(lat / 0.02) AS BIGINT) AS cy, CAST(floor(lon / 0.02) AS BIGINT) AS cx, max(cents) / 500000.0::DOUBLE AS depth FROM cp GROUP BY ALL),
p AS (SELECT CAST(floor(cy / 2) AS BIGINT) AS cy, CAST(floor(cx / 2) AS BIGINT) AS cx, max(depth) AS depth FROM c WHERE depth > 0 GROUP BY ALL)
SELECT CAST(CASE WHEN depth <= 0.5 THEN 1 WHEN depth <= 1 THEN 2 ELSE 3 END AS INTEGER) AS depth_class, count(*) AS cells, round(count(*) * 0.04::DOUBLE * 0.04::DOUBLE, 6) AS area FROM p GROUP BY ALL""")
def depth_cells_pooled(spark, sf):
    """JG4, F24: a depth cell table max-pooled 2 x 2, then area by depth class."""
    p = T.customer_points(spark, sf)
    cells = p.groupBy(F.floor(F.col("lat") / 0.02).alias("cy"), F.floor(F.col("lon") / 0.02).alias("cx")).agg((F.max("cents") / F.lit(500000.0)).alias("depth"))
    pooled = S.pool_cells(cells, "depth").withColumn("depth_class", K.depth_class(F.col("depth")))
    return rounded(pooled.groupBy("depth_class").agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * 0.04 * 0.04).alias("area")), "area")


@query(f"""WITH {GRID}, hz AS (SELECT * FROM (VALUES ('today', 0), ('2070', 1), ('2120', 2)) AS t(horizon, k)),
z AS (SELECT horizon, cy, cx FROM cov JOIN hz ON CAST(code AS INT) % 3 <= k),
loc AS (SELECT horizon, cov.code, count(*) AS cells FROM z JOIN cov USING (cy, cx) GROUP BY ALL)
SELECT horizon, code, cells, round(cells * 0.0025::DOUBLE, 6) AS local_area, round(sum(cells) OVER (PARTITION BY horizon) * 0.0025::DOUBLE, 6) AS national_area FROM loc""")
def zone_area_national_and_local(spark, sf):
    """JG4: zone area per horizon, nationally and cut to each area."""
    from pyspark.sql import Window

    z = S.coverage(zones(spark, sf), CELL, code="horizon").withColumnRenamed("code", "horizon")
    loc = z.join(S.coverage(T.nation_polygons(spark, sf), CELL), ["cy", "cx"]).groupBy("horizon", "code").agg(F.count(F.lit(1)).alias("cells"))
    nat = F.sum("cells").over(Window.partitionBy("horizon"))
    return rounded(loc.withColumns({"local_area": F.col("cells") * 0.0025, "national_area": nat * 0.0025}), "local_area", "national_area")
