"""The given tables as cubes, areas, points and polygons.

Regions, nations and customers/suppliers stand for three area levels. Counts and cents are
whole numbers, so sums are exact whatever their order. Coordinates are derived from keys.

Cubes are kept for the length of a query: a cube holds areas x codes x periods however large
the rows behind it are, and calculations read it more than once (newest period, windows,
denominators). A lost executor only costs the recomputation of its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Cube


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def year_quarter(ts: str) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("K"), F.quarter(ts).cast("string"))


def customer_totals(spark: SparkSession, sf: str, keys: dict[str, Column], aggs: dict[str, Column]) -> DataFrame:
    """Orders added up per customer and keys, with the customer's nation and segment.

    Adding up comes before the join: a customer with a third of all orders is folded inside
    the map tasks and joins as a handful of rows.
    """
    o = table(spark, sf, "orders").groupBy("o_custkey", *[c.alias(k) for k, c in keys.items()]).agg(*[c.alias(k) for k, c in aggs.items()])
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey)


def nation_code() -> Column:
    return F.col("c_nationkey").cast("string")


def order_cube(spark: SparkSession, sf: str) -> Cube:
    """Order counts by nation, priority and quarter; a single order is suppressed (null)."""
    per = customer_totals(spark, sf, {"prio": F.col("o_orderpriority"), "period": year_quarter("o_orderdate")}, {"k": F.count(F.lit(1))})
    n = F.sum("k")
    df = per.groupBy(nation_code().alias("area"), "prio", "period").agg(F.when(n >= 2, n.cast("double")).alias("value"))
    return Cube(df.persist(), dims=("prio",), name="ORDERS1")


# The same cube in SQL: the oracle side of ``order_cube``.
ORDER_CUBE = """
oc AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS area, o_orderpriority AS prio,
         CAST(year(o_orderdate) AS VARCHAR) || 'K' || CAST(quarter(o_orderdate) AS VARCHAR) AS period,
         CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS q,
         CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS k,
         CASE WHEN count(*) >= 2 THEN CAST(count(*) AS DOUBLE) END AS value
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY ALL)"""


def population_cube(spark: SparkSession, sf: str) -> Cube:
    """Customers with an order, by nation and quarter: one row per customer and quarter is
    left after the first step, so counting rows counts customers."""
    per = customer_totals(spark, sf, {"period": year_quarter("o_orderdate")}, {"k": F.count(F.lit(1))})
    df = per.groupBy(nation_code().alias("area"), "period").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return Cube(df.persist(), name="POP1")


POPULATION_CUBE = """
pc AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS area,
         CAST(year(o_orderdate) AS VARCHAR) || 'K' || CAST(quarter(o_orderdate) AS VARCHAR) AS period,
         CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS q,
         CAST(year(o_orderdate) AS BIGINT) AS y,
         CAST(count(DISTINCT o_custkey) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY ALL)"""


def stock_cube(spark: SparkSession, sf: str) -> Cube:
    """Line items by supplier nation, flag and shipping year: a yearly stock."""
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("flag"), F.year("l_shipdate").cast("string").alias("period")).agg(
        F.count(F.lit(1)).alias("k"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    df = li.join(s, li.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").cast("string").alias("area"), "flag", "period").agg(
        F.sum("k").cast("double").alias("value"))
    return Cube(df.persist(), dims=("flag",), name="STOCK1")


STOCK_CUBE = """
sc AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS area, l_returnflag AS flag,
         CAST(year(l_shipdate) AS VARCHAR) AS period, CAST(year(l_shipdate) AS BIGINT) AS y,
         CAST(count(*) AS DOUBLE) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY ALL)"""


def price_cube(spark: SparkSession, sf: str) -> Cube:
    """Mean asking and realised price by nation and quarter: orders of two priorities."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "UDBUD").when(F.col("o_orderpriority") == "5-LOW", "REAL")
    per = customer_totals(spark, sf, {"price": kind, "period": year_quarter("o_orderdate")}, {"s": F.sum(cents("o_totalprice")), "k": F.count(F.lit(1))})
    df = per.filter(F.col("price").isNotNull()).groupBy(nation_code().alias("area"), "period", "price").agg((F.sum("s") / F.sum("k") / 100).alias("value"))
    return Cube(df.persist(), dims=("price",), name="PRICE1")


PRICE_CUBE = """
pr AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS area,
         CAST(year(o_orderdate) AS VARCHAR) || 'K' || CAST(quarter(o_orderdate) AS VARCHAR) AS period,
         CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS q,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'UDBUD' ELSE 'REAL' END AS price,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS value
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
  GROUP BY ALL)"""


def cents(column: str) -> Column:
    """Money as whole cents."""
    return F.round(F.col(column) * 100).cast("long")


def customer_points(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
        cents("c_acctbal").alias("cents"),
        (F.lit(54.5) + (F.col("c_custkey") * 37 % 3000) / F.lit(1000.0)).alias("lat"),
        (F.lit(8.0) + (F.col("c_custkey") * 91 % 7000) / F.lit(1000.0)).alias("lon"),
    )


def supplier_points(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"),
        (F.lit(54.5) + (F.col("s_suppkey") * 53 % 3000) / F.lit(1000.0)).alias("lat"),
        (F.lit(8.0) + (F.col("s_suppkey") * 149 % 7000) / F.lit(1000.0)).alias("lon"),
        F.when(F.col("s_suppkey") % 5 == 0, "421").when(F.col("s_suppkey") % 5 < 3, "422").otherwise("900").alias("code"),
    )


POINTS = """
cp AS (
  SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment,
         CAST(round(c_acctbal * 100) AS BIGINT) AS cents,
         54.5::DOUBLE + (c_custkey * 37 % 3000) / 1000.0::DOUBLE AS lat,
         8.0::DOUBLE + (c_custkey * 91 % 7000) / 1000.0::DOUBLE AS lon
  FROM customer),
sp AS (
  SELECT s_suppkey AS id, s_nationkey AS nation, s_name AS name,
         54.5::DOUBLE + (s_suppkey * 53 % 3000) / 1000.0::DOUBLE AS lat,
         8.0::DOUBLE + (s_suppkey * 149 % 7000) / 1000.0::DOUBLE AS lon,
         CASE WHEN s_suppkey % 5 = 0 THEN '421' WHEN s_suppkey % 5 < 3 THEN '422' ELSE '900' END AS code
  FROM supplier)"""


# Nation polygons: corner offsets inside the nation's 0.6 x 1.4 degree tile, and a hole.
OUTER = [(0.02, 0.03), (0.05, 1.35), (0.31, 1.21), (0.57, 1.37), (0.55, 0.05), (0.29, 0.17)]
HOLE = [(0.2, 0.5), (0.2, 0.8), (0.4, 0.8), (0.4, 0.5)]


def nation_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """(code, name, region, polygon): one part with one hole per nation."""
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    lat0 = F.lit(54.5) + F.floor(k / 5) * F.lit(0.6)
    lon0 = F.lit(8.0) + (k % 5) * F.lit(1.4)

    def ring(points: list[tuple[float, float]]) -> Column:
        return F.array(*[F.struct((lat0 + F.lit(a)).alias("lat"), (lon0 + F.lit(b)).alias("lon")) for a, b in points])

    return n.select(
        F.lpad(k.cast("string"), 2, "0").alias("code"), F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("region"),
        F.array(F.array(ring(OUTER), ring(HOLE))).alias("polygon"),
    )


def _edge_rows() -> str:
    rows = []
    for r, pts in enumerate((OUTER, HOLE)):
        for i, (a, b) in enumerate(pts):
            c, d = pts[(i + 1) % len(pts)]
            rows.append(f"({r},{a}::DOUBLE,{b}::DOUBLE,{c}::DOUBLE,{d}::DOUBLE)")
    return ",".join(rows)


# Polygon edges, and points with the nation polygon they lie in.
EDGES = f"""
ed AS (
  SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, n_regionkey AS region, r AS ring,
         (54.5::DOUBLE + (n_nationkey // 5) * 0.6::DOUBLE) + a AS a_lat, (8.0::DOUBLE + (n_nationkey % 5) * 1.4::DOUBLE) + b AS a_lon,
         (54.5::DOUBLE + (n_nationkey // 5) * 0.6::DOUBLE) + c AS b_lat, (8.0::DOUBLE + (n_nationkey % 5) * 1.4::DOUBLE) + d AS b_lon
  FROM nation, (VALUES {_edge_rows()}) AS v(r, a, b, c, d))"""


def inside_sql(points: str, name: str) -> str:
    """CTE of (id, code): the nation polygon each point of a CTE lies in."""
    return f"""
{name}_ring AS (
  SELECT p.id, e.code, e.ring,
         sum(CASE WHEN ((e.a_lat > p.lat) <> (e.b_lat > p.lat))
                   AND p.lon < (e.b_lon - e.a_lon) * (p.lat - e.a_lat) / (e.b_lat - e.a_lat) + e.a_lon
                  THEN 1 ELSE 0 END) % 2 AS odd
  FROM {points} p, ed e GROUP BY ALL),
{name} AS (
  SELECT id, min(code) AS code FROM (
    SELECT id, code FROM {name}_ring GROUP BY id, code
    HAVING max(CASE WHEN ring = 0 THEN odd ELSE 0 END) = 1 AND max(CASE WHEN ring > 0 THEN odd ELSE 0 END) = 0)
  GROUP BY id)"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: str = "6371008.8") -> str:
    hl, ho = f"sin(radians({lat2} - {lat1}) / 2)", f"sin(radians({lon2} - {lon1}) / 2)"
    return (
        f"asin(least(1.0::DOUBLE, sqrt({hl} * {hl} + cos(radians({lat1})) * cos(radians({lat2})) * {ho} * {ho})))"
        f" * (2 * {radius}::DOUBLE)"
    )
