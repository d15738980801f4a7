"""Areas and overlaps with a stated error, over suppliers' zones and nation polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial as S
from ..operators import strips as R
from . import tables as T
from .common import registrar, rounded
from .overlay import SITES, sites

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

MAX_ERROR = 0.02  # square degrees


def site_zones(spark, sf):
    """(code, polygon): every third supplier's zone, a rim with a hollow and an islet that may overlap the rim."""
    return sites(spark, sf).filter("kind = 'polygon'").select(F.col("id").cast("string").alias("code"), "polygon")


def _strips(edges: str, height: str, name: str) -> str:
    """CTE (o, row, lo, hi): merged spans of shapes given by edges (o, part, a_lat, a_lon, b_lat, b_lon)."""
    return f"""{name}_x AS (SELECT o, part, r AS row, (r + 0.5::DOUBLE) * h AS mid, (b_lon - a_lon) * ((r + 0.5::DOUBLE) * h - a_lat) / (b_lat - a_lat) + a_lon AS lo
  FROM (SELECT e.*, {height}.h, unnest(range(CAST(floor(least(a_lat, b_lat) / h) AS BIGINT), CAST(floor(greatest(a_lat, b_lat) / h) AS BIGINT) + 1)) AS r FROM {edges} e, {height})
  WHERE (a_lat > (r + 0.5::DOUBLE) * h) <> (b_lat > (r + 0.5::DOUBLE) * h)),
{name}_p AS (SELECT o, row, lo, lead(lo) OVER w AS hi, row_number() OVER w AS i FROM {name}_x WINDOW w AS (PARTITION BY o, part, row ORDER BY lo)),
{name}_q AS (SELECT *, max(hi) OVER (PARTITION BY o, row ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {name}_p WHERE i % 2 = 1 AND hi > lo),
{name}_k AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o, row ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM {name}_q),
{name} AS (SELECT o, row, min(lo) AS lo, max(hi) AS hi FROM {name}_k GROUP BY o, row, k)"""


def _travel(edges: str, name: str) -> str:
    return f"{name} AS (SELECT o, sum(abs(b_lon - a_lon)) AS travel FROM {edges} GROUP BY o)"


def _height(*travels: str) -> str:
    total = " + ".join(f"(SELECT max(travel) FROM {t})" for t in travels)
    return f"(SELECT pow(2.0::DOUBLE, floor(log2({2 * MAX_ERROR}::DOUBLE / ({total})))) AS h)"


PAIRS = f"""{SITES}, {_travel('sg', 'ts')}, {_travel('ar', 'ta')}, hh AS {_height('ts', 'ta')},
{_strips('sg', 'hh', 'ss')}, {_strips('ar', 'hh', 'sa')},
ov AS (SELECT CAST(s.o AS VARCHAR) AS a, n.o AS b, sum(least(s.hi, n.hi) - greatest(s.lo, n.lo)) * any_value(h) AS area, any_value(h) * (any_value(ts.travel) + any_value(ta.travel)) / 2 AS error
  FROM ss s JOIN sa n ON s.row = n.row AND s.lo < n.hi AND n.lo < s.hi JOIN ts ON ts.o = s.o JOIN ta ON ta.o = n.o, hh GROUP BY s.o, n.o)"""


def zone_overlaps(spark, sf):
    return R.overlap_within(site_zones(spark, sf), T.nation_polygons(spark, sf), MAX_ERROR)


@query(f"""WITH {PAIRS} SELECT a, b, round(area, 6) AS area, round(error, 6) AS error, CAST(row_number() OVER (PARTITION BY a ORDER BY round(area, 9) DESC, b) AS INTEGER) AS pos FROM ov""")
def overlap_within_stated_error(spark, sf):
    """JG1: overlap of every zone with every area, dominant first, each with the bound of its error."""
    return rounded(zone_overlaps(spark, sf), "area", "error")


@query(f"""WITH {PAIRS} SELECT a, coalesce(string_agg(b, ',' ORDER BY b) FILTER (WHERE area >= 0.1), '') AS members, coalesce(string_agg(b, ',' ORDER BY b) FILTER (WHERE area < 0.1), '') AS marginal FROM ov GROUP BY a""")
def members_and_marginal_within_error(spark, sf):
    """JG2: members and marginal areas of every zone by measured overlap."""
    return S.members_and_marginal(zone_overlaps(spark, sf), 0.1)


@query(f"""WITH {SITES}, {_travel('sg', 'ts')}, hh AS {_height('ts')}, {_strips('sg', 'hh', 'ss')}
SELECT CAST(ts.o AS VARCHAR) AS code, round(coalesce(area, 0), 6) AS area, round(h * travel / 2, 6) AS error
FROM ts LEFT JOIN (SELECT o, sum(hi - lo) * any_value(h) AS area FROM ss, hh GROUP BY o) z ON z.o = ts.o, hh""")
def zone_area_within_error(spark, sf):
    """JG4: area of every zone, parts that overlap counted once, with the bound of its error."""
    return rounded(R.area_within(site_zones(spark, sf), MAX_ERROR), "area", "error")
