"""Geometries of all kinds against areas, over shapes derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlay as O
from ..operators import spatial as S
from . import tables as T
from .common import registrar
from .shapes import CELL, STEPS

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

# A site is a diamond with a diamond hole, and a small triangle beside it.
RIM = [(1.0, 0.0), (0.0, 2.0), (-1.0, 0.0), (0.0, -2.0)]
HOLLOW = [(0.4, 0.0), (0.0, 0.8), (-0.4, 0.0), (0.0, -0.8)]
ISLET = [(-0.45, 0.9), (-0.4, 0.95), (-0.45, 1.0)]


def _vertices(points, scale=None):
    at = lambda base, x: F.col(base) + (F.lit(x) if scale is None else F.lit(x) * F.col(scale))
    return F.array(*[F.struct(at("clat", a).alias("lat"), at("clon", b).alias("lon")) for a, b in points])


def sites(spark, sf):
    """(id, kind, polygon, path): a point, a line or a polygon per supplier. Every fourth point stands on the corner of an area,
    every fourth polygon inside an area's hole."""
    s, n = T.supplier_points(spark, sf).select("id", "lat", "lon"), F.col("id") % 25
    base = (F.lit(54.5) + F.floor(n / 5) * F.lit(0.6), F.lit(8.0) + (n % 5) * F.lit(1.4))
    odd, corner, hole = F.col("id") % 4 == 0, (0.05, 1.35), (0.3, 0.65)
    placed = lambda i: F.when(odd & (F.col("id") % 3 == 0), base[i] + F.lit(corner[i])).when(odd & (F.col("id") % 3 == 2), base[i] + F.lit(hole[i])).otherwise(F.col(("lat", "lon")[i]))
    kind = F.when(F.col("id") % 3 == 0, "point").when(F.col("id") % 3 == 1, "line").otherwise("polygon")
    c = s.select("id", kind.alias("kind"), placed(0).alias("clat"), placed(1).alias("clon"), F.when(odd, 0.02).otherwise(F.lit(0.03) + (F.col("id") % 7) * F.lit(0.2)).alias("size"))
    polygon = F.array(F.array(_vertices(RIM, "size"), _vertices(HOLLOW, "size")), F.array(_vertices(ISLET)))
    return c.select("id", "kind", F.when(F.col("kind") == "polygon", polygon).alias("polygon"),
                    F.when(F.col("kind") == "point", _vertices([(0.0, 0.0)])).when(F.col("kind") == "line", _vertices(STEPS)).alias("path"))


def _edges(rings) -> str:
    """Rows (part, ring, a, b, c, d, scaled) of closed rings given as (part, ring, points, scaled)."""
    rows = []
    for part, ring, points, scaled in rings:
        for i, (a, b) in enumerate(points):
            c, d = points[(i + 1) % len(points)]
            rows.append(f"({part}, {ring}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {scaled})")
    return ", ".join(rows)


def _turn(lat: str, lon: str, e: str) -> str:
    return f"sign(({e}.b_lon - {e}.a_lon) * ({lat} - {e}.a_lat) - ({e}.b_lat - {e}.a_lat) * ({lon} - {e}.a_lon))"


def _on(p: str, end: str, e: str) -> str:
    lat, lon = f"{p}.{end}_lat", f"{p}.{end}_lon"
    return (f"({_turn(lat, lon, e)} = 0 AND {lat} BETWEEN least({e}.a_lat, {e}.b_lat) AND greatest({e}.a_lat, {e}.b_lat)"
            f" AND {lon} BETWEEN least({e}.a_lon, {e}.b_lon) AND greatest({e}.a_lon, {e}.b_lon))")


def _meet(e: str, f: str) -> str:
    turn = lambda p, end, x: _turn(f"{p}.{end}_lat", f"{p}.{end}_lon", x)
    return (f"(({turn(f, 'a', e)} * {turn(f, 'b', e)} < 0 AND {turn(e, 'a', f)} * {turn(e, 'b', f)} < 0)"
            f" OR {_on(f, 'a', e)} OR {_on(f, 'b', e)} OR {_on(e, 'a', f)} OR {_on(e, 'b', f)})")


def _inside(points: str, edges: str, name: str) -> str:
    """CTE (p, o): points (p, lat, lon) inside shapes given by edges (o, part, ring, ...)."""
    return f"""{name}_r AS (SELECT p.p, p.lat, p.lon, e.o, e.part, e.ring, count(*) % 2 AS odd FROM {points} p JOIN {edges} e
  ON (e.a_lat > p.lat) <> (e.b_lat > p.lat) AND p.lon < (e.b_lon - e.a_lon) * (p.lat - e.a_lat) / (e.b_lat - e.a_lat) + e.a_lon GROUP BY ALL),
{name} AS (SELECT DISTINCT p, o FROM (SELECT p, lat, lon, o, part FROM {name}_r WHERE odd = 1 GROUP BY ALL HAVING max(ring) = 0))"""


SITES = f"""{T.POINTS}, {T.EDGES},
st AS (SELECT id, CASE id % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'line' ELSE 'polygon' END AS kind,
  CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN (54.5::DOUBLE + (id % 25 // 5) * 0.6::DOUBLE) + 0.05::DOUBLE
       WHEN id % 4 = 0 AND id % 3 = 2 THEN (54.5::DOUBLE + (id % 25 // 5) * 0.6::DOUBLE) + 0.3::DOUBLE ELSE lat END AS clat,
  CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN (8.0::DOUBLE + (id % 25 % 5) * 1.4::DOUBLE) + 1.35::DOUBLE
       WHEN id % 4 = 0 AND id % 3 = 2 THEN (8.0::DOUBLE + (id % 25 % 5) * 1.4::DOUBLE) + 0.65::DOUBLE ELSE lon END AS clon,
  CASE WHEN id % 4 = 0 THEN 0.02::DOUBLE ELSE 0.03::DOUBLE + (id % 7) * 0.2::DOUBLE END AS size FROM sp),
sg AS (
  SELECT id AS o, part, ring, clat + a * CASE WHEN sc THEN size ELSE 1 END AS a_lat, clon + b * CASE WHEN sc THEN size ELSE 1 END AS a_lon,
    clat + c * CASE WHEN sc THEN size ELSE 1 END AS b_lat, clon + d * CASE WHEN sc THEN size ELSE 1 END AS b_lon
  FROM st, (VALUES {_edges([(0, 0, RIM, True), (0, 1, HOLLOW, True), (1, 0, ISLET, False)])}) AS v(part, ring, a, b, c, d, sc) WHERE kind = 'polygon'),
so AS (
  SELECT id AS o, clat + a AS a_lat, clon + b AS a_lon, clat + c AS b_lat, clon + d AS b_lon
  FROM st, (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for (a, b), (c, d) in zip(STEPS, STEPS[1:], strict=False))}) AS v(a, b, c, d) WHERE kind = 'line'
  UNION ALL SELECT id, clat, clon, clat, clon FROM st WHERE kind = 'point'),
ar AS (SELECT code AS o, 0 AS part, ring, a_lat, a_lon, b_lat, b_lon FROM ed),
spot AS (SELECT o AS p, a_lat AS lat, a_lon AS lon FROM sg UNION SELECT o, a_lat, a_lon FROM so),
mark AS (SELECT DISTINCT o AS p, a_lat AS lat, a_lon AS lon FROM ar WHERE ring = 0),
{_inside('spot', 'ar', 'within')}, {_inside('mark', 'sg', 'around')},
hit AS (
  SELECT DISTINCT s.o AS id, a.o AS code FROM (SELECT o, a_lat, a_lon, b_lat, b_lon FROM sg UNION ALL SELECT * FROM so) s JOIN ar a ON {_meet('s', 'a')}
  UNION SELECT p, o FROM within UNION SELECT o, p FROM around)"""


@query(f"WITH {SITES} SELECT st.id, kind, code FROM hit JOIN st USING (id)")
def geometries_touching_areas(spark, sf):
    """Points, lines and polygons that share a point with an area: crossing or touching borders, one inside the
    other, nothing for what stands in a hole."""
    g = sites(spark, sf)
    return O.touching(g, T.nation_polygons(spark, sf), CELL).join(g.select("id", "kind"), "id").select("id", "kind", "code")


@query(f"""WITH {SITES} SELECT id, code FROM hit
UNION ALL SELECT id, trim(unnest(string_split('07, 11', ','))) FROM st WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM hit)""")
def geometries_touching_with_override(spark, sf):
    """The hand-written list stands in for geometries of any kind that meet nothing."""
    g = sites(spark, sf).withColumn("override", F.when(F.col("id") % 2 == 0, F.lit("07, 11")))
    return S.with_override(O.touching(g, T.nation_polygons(spark, sf), CELL), g)
