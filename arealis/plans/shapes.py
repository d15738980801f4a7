"""Lines, borders, reprojection and other shape work over the derived geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import parsing as P
from ..operators import spatial as S
from . import spatial as base
from . import tables as T
from .common import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

CELL = 0.05
STEPS = [(0.0, 0.0), (0.3, 0.4), (0.1, 0.9)]


def _path(points):
    return F.array(*[F.struct((F.col("lat") + F.lit(a)).alias("lat"), (F.col("lon") + F.lit(b)).alias("lon")) for a, b in points])


def corridors(spark, sf):
    """A three-vertex line per supplier."""
    return T.supplier_points(spark, sf).withColumn("path", _path(STEPS)).select("id", "path", "nation", "lat", "lon")


CORRIDOR = f"""{T.POINTS}, {T.EDGES}, seg AS (SELECT id, nation, k, lat + a AS a_lat, lon + b AS a_lon, lat + c AS b_lat, lon + d AS b_lon
  FROM sp, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE), (1, 0.3::DOUBLE, 0.4::DOUBLE, 0.1::DOUBLE, 0.9::DOUBLE)) AS v(k, a, b, c, d))"""


def _turn(p, e):
    return f"sign(({e}.b_lon - {e}.a_lon) * ({p[0]} - {e}.a_lat) - ({e}.b_lat - {e}.a_lat) * ({p[1]} - {e}.a_lon))"


_S1, _S2 = _turn(("f.a_lat", "f.a_lon"), "s"), _turn(("f.b_lat", "f.b_lon"), "s")
_S3, _S4 = _turn(("s.a_lat", "s.a_lon"), "f"), _turn(("s.b_lat", "s.b_lon"), "f")
TOUCH = f"""{CORRIDOR}, {T.inside_sql('sp', 'shit')},
touch AS (SELECT DISTINCT s.id, f.code FROM seg s JOIN ed f ON {_S1} * {_S2} < 0 AND {_S3} * {_S4} < 0 UNION SELECT id, code FROM shit)"""


@query(f"WITH {TOUCH} SELECT id, code FROM touch")
def lines_touching_areas(spark, sf):
    """Lines that cross an area's border or start inside it."""
    return S.lines_touch_areas(corridors(spark, sf), T.nation_polygons(spark, sf), CELL)


@query(f"""WITH {TOUCH}, short AS (SELECT * FROM touch WHERE CAST(code AS INT) < 8)
SELECT id, code FROM short UNION ALL
SELECT id, trim(unnest(string_split('07, 11', ','))) FROM sp WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM short)""")
def lines_touching_with_override(spark, sf):
    """A hand-written list stands in where the join finds nothing."""
    lines = corridors(spark, sf).withColumn("override", F.when(F.col("id") % 2 == 0, F.lit("07, 11")))
    touch = S.lines_touch_areas(lines, T.nation_polygons(spark, sf), CELL).filter(F.col("code").cast("int") < 8)
    return S.with_override(touch, lines)


def _seg_dist(lat, lon, e, ky="110540.0::DOUBLE", lat0=None):
    kx = f"(cos(radians({lat0 or lat})) * 111320.0::DOUBLE)"
    ax, ay = f"(({e}.a_lon - {lon}) * {kx})", f"(({e}.a_lat - {lat}) * {ky})"
    dx, dy = f"(({e}.b_lon - {e}.a_lon) * {kx})", f"(({e}.b_lat - {e}.a_lat) * {ky})"
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, -({ax} * {dx} + {ay} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(({ax} + {t} * {dx}) * ({ax} + {t} * {dx}) + ({ay} + {t} * {dy}) * ({ay} + {t} * {dy}))"


NEARBY_AREAS = f"""{T.POINTS}, {T.EDGES}, {T.inside_sql('sp', 'shit')},
mid AS (SELECT code, (min(a_lat) + max(a_lat)) / 2 AS lat0 FROM ed WHERE ring = 0 GROUP BY code),
nd AS (SELECT p.id, e.code, min({_seg_dist('p.lat', 'p.lon', 'e', '111320.0::DOUBLE', 'mid.lat0')}) AS d FROM sp p JOIN ed e ON abs(p.lat - e.a_lat) < 1 JOIN mid ON mid.code = e.code GROUP BY ALL),
na AS (SELECT id, code, min(d) AS dist FROM (SELECT id, code, d FROM nd WHERE d <= 12000 UNION ALL SELECT id, code, 0 FROM shit) GROUP BY ALL)"""


def near_areas(spark, sf):
    return S.points_near_areas(T.supplier_points(spark, sf), T.nation_polygons(spark, sf), CELL, 12000.0)


@query(f"WITH {NEARBY_AREAS} SELECT id, code, round(dist, 3) AS dist FROM na")
def points_touching_or_near_areas(spark, sf):
    """Points inside an area at 0 m, and others within a radius of its border."""
    return rounded(near_areas(spark, sf), "dist", digits=3)


@query(f"""WITH {T.POINTS}, {T.EDGES}, st AS (SELECT id AS stretch, k, lat + a AS a_lat, lon + b AS a_lon, lat + c AS b_lat, lon + d AS b_lon
  FROM sp, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE), (1, 0.3::DOUBLE, 0.4::DOUBLE, 0.1::DOUBLE, 0.9::DOUBLE)) AS v(k, a, b, c, d)),
co AS (SELECT code AS id, row_number() OVER (PARTITION BY code ORDER BY a_lat, a_lon) AS seg, * FROM ed WHERE ring = 0),
ln AS (SELECT *, greatest(1, CAST(ceil(sqrt(((b_lon - a_lon) * (cos(radians((a_lat + b_lat) / 2)) * 111320.0::DOUBLE)) ** 2 + ((b_lat - a_lat) * 110540.0::DOUBLE) ** 2) / 5000) AS BIGINT)) AS n FROM co),
sm0 AS (SELECT id, a_lat, b_lat, a_lon, b_lon, n, unnest(range(0, n + 1)) AS k FROM ln),
sm AS (SELECT DISTINCT id, round(a_lat + (b_lat - a_lat) * (k / n), 9) AS lat, round(a_lon + (b_lon - a_lon) * (k / n), 9) AS lon FROM sm0),
d AS (SELECT s.id, s.lat, s.lon, e.stretch, min({_seg_dist('s.lat', 's.lon', 'e')}) AS d FROM sm s, st e GROUP BY ALL),
b AS (SELECT id, lat, lon, min_by(stretch, (d, stretch)) AS stretch FROM d WHERE d <= 20000 GROUP BY ALL),
sh AS (SELECT id, stretch, count(*) * 5000.0::DOUBLE AS shared_m FROM b GROUP BY ALL)
SELECT id, stretch, shared_m, CAST(row_number() OVER (PARTITION BY id ORDER BY shared_m DESC, stretch) AS INTEGER) AS pos FROM sh""")
def border_assigned_by_majority(spark, sf):
    """Borders sampled at a fixed step, each sample to its nearest line within a limit,
    the line with most samples first."""
    ring = F.element_at(F.element_at("polygon", 1), 1)
    closed = T.nation_polygons(spark, sf).select(F.col("code").alias("id"), F.concat(ring, F.slice(ring, 1, 1)).alias("path"))
    samples = S.sample_lines(closed, 5000.0)
    # a closed border's last sample repeats its first
    samples = samples.withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)}).groupBy("id", "lat", "lon").agg(
        F.min("seg").alias("seg"), F.min_by("k", "seg").alias("k"))
    stretches = corridors(spark, sf).select(F.col("id").alias("code"), "path")
    return S.assign_by_majority(samples, stretches, 5000.0, 20000.0, 0.2)


_AREA = "abs(sum((a_lon * kx) * (b_lat * 111320.0::DOUBLE) - (b_lon * kx) * (a_lat * 111320.0::DOUBLE))) / 2"


@query(f"""WITH {T.EDGES}, k AS (SELECT *, cos(radians(55.5::DOUBLE)) * 111320.0::DOUBLE AS kx FROM ed),
r AS (SELECT code, ring, {_AREA} AS m2 FROM k GROUP BY ALL)
SELECT code, CAST(max(CASE WHEN ring = 0 THEN 1 END) AS INTEGER) AS parts, CAST(count(*) FILTER (WHERE ring > 0 AND m2 >= 4.5e8) AS INTEGER) AS holes, round(max(CASE WHEN ring = 0 THEN m2 END) / 10000, 2) AS outer_ha FROM r
GROUP BY code HAVING max(CASE WHEN ring = 0 THEN m2 END) >= 1e9""")
def small_parts_and_holes_dropped(spark, sf):
    """JG5, H16: parts and holes below an area go, ring areas by shoelace."""
    nat = T.nation_polygons(spark, sf)
    lat0 = F.lit(55.5)
    d = nat.withColumn("p", G.drop_small_parts(F.col("polygon"), lat0, 1e9, 4.5e8)).filter(F.size("p") > 0)
    first = F.element_at("p", 1)
    return d.select("code", F.size("p").alias("parts"), (F.size(first) - 1).alias("holes"),
                    F.round(G.ring_area_m2(F.element_at(first, 1), lat0) / 10000, 2).alias("outer_ha"))


@query(f"""WITH {T.POINTS}, o AS (SELECT nation, id, lat, lon, lag(lat) OVER w AS pl, lag(lon) OVER w AS po, count(*) OVER (PARTITION BY nation) AS n FROM sp WINDOW w AS (PARTITION BY nation ORDER BY id))
SELECT nation, CAST(max(n) AS INTEGER) AS stations, round(sum(sqrt(((lon - po) * (cos(radians(56.0::DOUBLE)) * 111320.0::DOUBLE)) ** 2 + ((lat - pl) * 111320.0::DOUBLE) ** 2) / 1000), 4) AS km FROM o WHERE n >= 2 GROUP BY nation""")
def line_through_ordered_stations(spark, sf):
    """JG7, J24, H16: a line through its stations in order, its length and station count."""
    st = T.supplier_points(spark, sf).select(F.col("nation").alias("line"), F.col("id").alias("ord"), "lat", "lon")
    d = S.line_through(st)
    return d.select(F.col("line").alias("nation"), F.size("path").alias("stations"), F.round(G.path_length_km(F.col("path"), F.lit(56.0)), 4).alias("km"))


@query(f"""WITH {T.POINTS} SELECT id, round((lat + (lat + 0.3) + (lat + 0.1)) / 3, 6) AS mean_lat, round((lon + (lon + 0.4) + (lon + 0.9)) / 3, 6) AS mean_lon, round(lat + 0.3, 5) AS second_lat FROM sp""")
def way_position_and_rounding(spark, sf):
    """A way's position as the mean of its vertices, and rounded coordinates."""
    c = corridors(spark, sf)
    path = F.col("path")
    return c.select("id", F.round(G.vertex_mean(path, "lat"), 6).alias("mean_lat"), F.round(G.vertex_mean(path, "lon"), 6).alias("mean_lon"),
                    F.element_at(G.round_ring(path, 5), 2).lat.alias("second_lat"))


def _krueger_sql() -> str:
    n, k0r = G._N, G._K0 * G._RECT
    xi = "xi0" + "".join(f" + sin({2 * j}.0::DOUBLE * xi0) * cosh({2 * j}.0::DOUBLE * eta0) * {a!r}::DOUBLE" for j, a in enumerate(G._ALPHA, 1))
    eta = "eta0" + "".join(f" + cos({2 * j}.0::DOUBLE * xi0) * sinh({2 * j}.0::DOUBLE * eta0) * {a!r}::DOUBLE" for j, a in enumerate(G._ALPHA, 1))
    e = repr(G._ECC) + "::DOUBLE"
    return f"""t1 AS (SELECT id, lat, lon, sinh(atanh(sin(radians(lat))) - {e} * atanh({e} * sin(radians(lat)))) AS t, radians(lon - 9.0::DOUBLE) AS lam FROM cp),
t2 AS (SELECT id, lat, lon, atan2(t, cos(lam)) AS xi0, atanh(sin(lam) / sqrt(1 + t * t)) AS eta0 FROM t1),
t3 AS (SELECT id, lat, lon, ({eta}) * {k0r!r}::DOUBLE + 500000.0::DOUBLE AS x, ({xi}) * {k0r!r}::DOUBLE AS y FROM t2)"""


@query(f"WITH {T.POINTS}, {_krueger_sql()} SELECT id, round(x, 2) AS x, round(y, 2) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon FROM t3")
def reprojection_both_ways(spark, sf):
    """Degrees to zone-32 metres and back again."""
    c = T.customer_points(spark, sf)
    x, y = G.to_utm32(F.col("lat"), F.col("lon"))
    xy = c.select("id", x.alias("x"), y.alias("y"))
    lat, lon = G.from_utm32(F.col("x"), F.col("y"))
    return xy.select("id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"""WITH {T.POINTS}, {T.EDGES}, {T.inside_sql('sp', 'shit')},
d AS (SELECT p.id, e.code, min({_seg_dist('p.lat', 'p.lon', 'e')}) AS d FROM sp p JOIN ed e ON e.code = lpad(CAST(p.nation AS VARCHAR), 2, '0') GROUP BY ALL)
SELECT d.id, round(CASE WHEN shit.code IS NOT NULL THEN 0 ELSE d.d END, 3) AS dist FROM d LEFT JOIN shit ON shit.id = d.id AND shit.code = d.code""")
def distance_to_own_area(spark, sf):
    """Distance from a point to an area, 0 inside."""
    s = T.supplier_points(spark, sf).withColumn("code", F.lpad(F.col("nation").cast("string"), 2, "0"))
    j = s.join(T.nation_polygons(spark, sf).select("code", "polygon"), "code")
    return rounded(j.select("id", G.polygon_distance(F.col("polygon"), F.col("lat"), F.col("lon")).alias("dist")), "dist", digits=3)


@query(f"""WITH {T.POINTS}, {T.EDGES}, {T.inside_sql('sp', 'shit')}
SELECT sp.id, CASE WHEN nation % 4 <> 0 THEN coalesce(CAST(shit.code AS INT) % 3 = 0, false) END AS in_zone FROM sp LEFT JOIN shit USING (id)""")
def in_zone_or_unknown(spark, sf):
    """Inside a zone, outside, or null where no zone was loaded."""
    z = T.nation_polygons(spark, sf).filter(F.col("code").cast("int") % 3 == 0)
    hit = S.locate(T.supplier_points(spark, sf), S.area_index(z, CELL), CELL, "zone")
    loaded = F.when(F.col("nation") % 4 != 0, 1).otherwise(0)
    return hit.select("id", G.in_zone(F.col("zone").isNotNull(), loaded).alias("in_zone"))


@query(f"""WITH {T.POINTS}, {T.EDGES}, {T.inside_sql('cp', 'hit')}, u AS (
  SELECT segment AS label, 'node' AS kind, hit.code FROM cp LEFT JOIN hit USING (id))
SELECT label, kind, count(*) AS national, count(*) FILTER (WHERE code = '07') AS inside FROM u GROUP BY ALL""")
def counts_national_and_inside(spark, sf):
    """Counts nationally and inside one area."""
    one = T.nation_polygons(spark, sf).filter(F.col("code") == "07")
    hit = S.locate(T.customer_points(spark, sf), S.area_index(one, CELL), CELL, "inside")
    return hit.groupBy(F.col("segment").alias("label"), F.lit("node").alias("kind")).agg(
        F.count(F.lit(1)).alias("national"), F.count("inside").alias("inside"))


@query(f"""WITH {T.POINTS}, {T.EDGES}, {T.inside_sql('cp', 'hit')}, {T.inside_sql('sp', 'shit')},
a AS (SELECT code, count(*) AS n FROM hit GROUP BY code), b AS (SELECT code, count(*) AS n FROM shit GROUP BY code)
SELECT a.code, a.n AS first_n, coalesce(b.n, 0) AS second_n, round(CASE WHEN a.n > 0 THEN coalesce(b.n, 0) / a.n END, 6) AS ratio FROM a LEFT JOIN b ON a.code = b.code""")
def two_sources_same_area(spark, sf):
    """Counts of two sources over the same areas, with their ratio."""
    ix = base.index(spark, sf)
    count = lambda p, n: S.locate(p, ix, CELL).filter(F.col("code").isNotNull()).groupBy("code").agg(F.count(F.lit(1)).alias(n))
    j = count(T.customer_points(spark, sf), "first_n").join(count(T.supplier_points(spark, sf), "second_n"), "code", "left")
    n2 = F.coalesce("second_n", F.lit(0).cast("long"))
    return rounded(j.select("code", "first_n", n2.alias("second_n"), (n2 / F.col("first_n")).alias("ratio")), "ratio")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 > 0 THEN CAST((p_partkey * 37 % 100000) / 4 AS DOUBLE) END AS x, CASE WHEN p_partkey % 3 > 0 THEN CAST((p_partkey * 53 % 90000) / 8 AS DOUBLE) END AS y FROM part""")
def well_known_text_points(spark, sf):
    """Coordinates out of well-known text, null where there is none."""
    k = F.col("p_partkey")
    wkt = F.when(k % 3 > 0, F.concat(F.lit("POINT ("), ((k * 37 % 100000) / 4).cast("string"), F.lit(" "), ((k * 53 % 90000) / 8).cast("string"), F.lit(")"))).otherwise("POINT EMPTY")
    d = T.table(spark, sf, "part").select(k.cast("string").alias("id"), P.wkt_point(wkt).alias("p"))
    return d.select("id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
