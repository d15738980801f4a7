"""Register lines with points, cases and links, labels of codes, totals by dimension, and checks that find something."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import geometry as G
from ..model import BUILDING_SCHEMA, CASE_SCHEMA, LINK_SCHEMA, UNIT_SCHEMA
from ..operators import quality as Q
from ..operators import registers as RG
from ..session import scratch_path
from ..sources import cubes as SC
from ..sources import registers as SR
from . import spatial as SP
from . import tables as T
from .common import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


@query(f"""WITH {T.POINTS}, b AS (SELECT CAST(id AS VARCHAR) AS building, CAST(100 + id % 50 AS VARCHAR) AS use, CASE WHEN id % 11 > 0 THEN round(lat, 4) END AS lat, CASE WHEN id % 11 > 0 THEN round(lon, 4) END AS lon FROM cp WHERE id % 9 > 0)
SELECT CAST(o_custkey AS VARCHAR) AS building, count(*) AS units, any_value(use) AS use, any_value(lat) AS lat, any_value(lon) AS lon
FROM orders LEFT JOIN b ON b.building = CAST(o_custkey AS VARCHAR) WHERE o_orderkey % 7 < 5 GROUP BY o_custkey""")
def units_with_their_buildings(spark, sf):
    """SC6, J5: register lines of units and buildings; units of unknown buildings stay, points that can't be read are null."""
    folder = scratch_path(spark, "register")
    k = F.col("o_orderkey")
    T.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("bygning"), F.lit("6").alias("status"), (k % 7 + 1).cast("string").alias("enh023Boligtype")).write.json(f"{folder}/units")
    x, y = G.to_utm32(F.col("lat"), F.col("lon"))
    wkt = F.when(F.col("id") % 11 > 0, F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))).otherwise("POINT EMPTY")
    T.customer_points(spark, sf).filter("id % 9 > 0").select(
        F.col("id").cast("string").alias("id_lokalId"), (F.col("id") % 50 + 100).cast("string").alias("byg021BygningensAnvendelse"),
        F.struct(wkt.alias("wkt"), F.lit("EPSG:25832").alias("crs")).alias("byg404Koordinat")).write.json(f"{folder}/buildings")
    b = SR.with_point(SR.read_lines(spark, f"{folder}/buildings", BUILDING_SCHEMA)).select(
        F.col("id_lokalId").alias("building"), F.col("byg021BygningensAnvendelse").alias("use"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))
    # units are added up before they meet their building
    units = RG.dwellings(SR.read_lines(spark, f"{folder}/units", UNIT_SCHEMA)).groupBy(F.col("bygning").alias("building")).agg(F.count(F.lit(1)).alias("units"))
    return RG.with_building(units, b)


@query("""WITH l AS (SELECT o_orderkey AS c, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS own, CASE WHEN o_orderkey % 3 < 2 THEN o_custkey + o_orderkey % 2 END AS obj FROM orders),
p AS (SELECT DISTINCT c, b FROM (SELECT c, own AS b FROM l UNION ALL SELECT c, obj FROM l) WHERE b IS NOT NULL AND b IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 > 0))
SELECT CAST(b AS VARCHAR) AS building, CAST(c AS VARCHAR) AS case_id, CASE WHEN o_orderstatus = 'F' THEN '6' ELSE '2' END AS status, CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS completed FROM p JOIN orders ON o_orderkey = c""")
def register_cases_and_links(spark, sf):
    """SC6, J14: case, link and building lines under their schemas; a link names its building in either of two fields."""
    folder = scratch_path(spark, "cases")
    o, k, text = T.table(spark, sf, "orders"), F.col("o_orderkey"), lambda c: c.cast("string")
    done = F.col("o_orderstatus") == "F"
    o.select(text(k).alias("id_lokalId"), F.when(done, "6").otherwise("2").alias("status"), F.when(done, text(F.to_date("o_orderdate"))).alias("sag010FuldfoerelseAfByggeri")).write.json(f"{folder}/cases")
    o.select(text(k).alias("byggesag"), F.when(k % 3 > 0, text(F.col("o_custkey"))).alias("sagsdataBygning"),
             F.when(k % 3 < 2, text(F.col("o_custkey") + k % 2)).alias("stamdataBygning")).write.json(f"{folder}/links")
    T.table(spark, sf, "customer").filter("c_custkey % 9 > 0").select(text(F.col("c_custkey")).alias("id_lokalId")).write.json(f"{folder}/buildings")
    cases = SR.read_lines(spark, f"{folder}/cases", CASE_SCHEMA).select(F.col("id_lokalId").alias("case_id"), "status", F.col("sag010FuldfoerelseAfByggeri").alias("completed"))
    links = SR.read_lines(spark, f"{folder}/links", LINK_SCHEMA).select(F.col("byggesag").alias("case_id"), F.col("sagsdataBygning").alias("own_building"), F.col("stamdataBygning").alias("object_building"))
    buildings = SR.read_lines(spark, f"{folder}/buildings", BUILDING_SCHEMA).select(F.col("id_lokalId").alias("building"))
    return RG.cases_by_building(links, cases, buildings).select("building", "case_id", "status", "completed")


@query(f"""WITH {T.ORDER_CUBE} SELECT area, period, CASE WHEN prio IN ('5-LOW', '3-MEDIUM') THEN prio ELSE 'Priority ' || prio END AS label, value FROM oc""")
def cells_with_code_labels(spark, sf):
    """The text of a code from the table's own list, the code itself where the list lacks it."""
    path = scratch_path(spark, "code-list")
    codes = T.table(spark, sf, "orders").select("o_orderpriority").distinct().filter(~F.col("o_orderpriority").isin("5-LOW", "3-MEDIUM"))
    values = F.sort_array(F.collect_list(F.struct(F.col("o_orderpriority").alias("id"), F.concat(F.lit(" Priority "), "o_orderpriority").alias("text"))))  # a code list
    doc = codes.agg(values.alias("v")).select(F.lit("ORDERS1").alias("id"), F.lit("2026-07-01T08:00").alias("updated"),
                                              F.array(F.struct(F.lit("PRIO").alias("id"), F.lit("priority").alias("text"), F.lit(True).alias("elimination"), F.col("v").alias("values"))).alias("variables"))
    doc.write.json(path)
    labelled = SC.with_labels(T.order_cube(spark, sf).cells(), SC.code_labels(spark, path), "ORDERS1", "PRIO", "prio")
    return labelled.select("area", "period", "label", "value")


@query(f"""WITH {T.ORDER_CUBE}, {T.STOCK_CUBE}
SELECT area, period, value FROM (SELECT area, period, sum(value) AS value FROM oc GROUP BY ALL) UNION ALL SELECT area, period, value FROM sc WHERE flag = 'A'""")
def cells_at_the_total_of_each_dimension(spark, sf):
    """rows at the own total code of every dimension that is present and has one."""
    o = T.order_cube(spark, sf).cells()
    parts = o.select("area", "period", F.col("prio").alias("ALDER"), F.lit("TOT").alias("KØN"), F.lit("x").alias("OTHER"), "value")
    totals = o.groupBy("area", "period").agg(F.sum("value").alias("value")).select("area", "period", F.lit("IALT").alias("ALDER"), F.lit("TOT").alias("KØN"), F.lit("x").alias("OTHER"), "value")
    halves = totals.withColumn("KØN", F.lit("M"))
    people = parts.unionByName(totals).unionByName(halves)
    homes = T.stock_cube(spark, sf).cells().select("area", "period", F.when(F.col("flag") == "A", "SUM").otherwise(F.col("flag")).alias("ANVEND"), "value")
    pick = lambda df: df.filter(K.totals_by_dimension(df.columns)).select("area", "period", "value")
    return pick(people).unionByName(pick(homes))


_SHRUNK = "CASE WHEN CAST(code AS INT) % 2 = 1 AND horizon = '2070' THEN n_in_zone // 2 ELSE n_in_zone END"


@query(f"""WITH {SP.EXPO}, s AS (SELECT level, code, horizon, {_SHRUNK} AS n_in_zone FROM ex),
o AS (SELECT *, lag(n_in_zone) OVER (PARTITION BY level, code ORDER BY CASE horizon WHEN 'today' THEN 0 WHEN '2070' THEN 1 ELSE 2 END) AS prev FROM s)
SELECT level, code, horizon, n_in_zone, prev FROM o WHERE n_in_zone < prev""")
def horizon_violations_found(spark, sf):
    """Areas whose zone shrinks at a later horizon, over exposure in which odd codes lose half of theirs in 2070."""
    lost = (F.col("code").cast("int") % 2 == 1) & (F.col("horizon") == "2070")
    d = SP.exposed(spark, sf).withColumn("n_in_zone", F.when(lost, F.floor(F.col("n_in_zone") / 2)).otherwise(F.col("n_in_zone")))
    order = K.lookup("horizon", {"today": 0, "2070": 1, "2120": 2})
    return Q.not_monotone(d, ["level", "code"], order, "n_in_zone").select("level", "code", "horizon", "n_in_zone", "prev")


@query("""WITH a AS (SELECT c_nationkey AS n, CAST(c_nationkey AS VARCHAR) AS code, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
b AS (SELECT n, code, CASE WHEN n % 5 = 2 THEN v + 1 WHEN n % 5 = 3 THEN v + 0.005::DOUBLE ELSE v END AS v FROM a WHERE n % 10 <> 4)
SELECT code, round(a.v, 4) AS a_value, round(b.v, 4) AS b_value, CASE WHEN b.v IS NULL THEN 'only_a' ELSE 'changed' END AS status FROM a LEFT JOIN b USING (code) WHERE b.v IS NULL OR abs(a.v - b.v) > 0.011::DOUBLE""")
def recomputed_figures_that_differ(spark, sf):
    """Q4: figures derived a second way that differ by more than a tolerance or are missing there; some are made to."""
    per = T.customer_totals(spark, sf, {}, {"s": F.sum(T.cents("o_totalprice")), "k": F.count(F.lit(1))})
    a = per.groupBy(F.col("c_nationkey").alias("n")).agg((F.sum("s") / F.sum("k")).alias("value")).withColumn("code", F.col("n").cast("string"))
    shift = F.when(F.col("n") % 5 == 2, 1.0).when(F.col("n") % 5 == 3, 0.005).otherwise(0.0)
    b = a.filter("n % 10 <> 4").withColumn("value", F.col("value") + shift)
    return rounded(Q.cell_diff(a, b, ["code"], tolerance=0.011), "a_value", "b_value", digits=4)
