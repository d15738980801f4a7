"""Checks bound to the given tables; every query returns the offending rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as X
from ..operators import calcs as C
from ..operators import projection as J
from ..operators import quality as Q
from ..operators import registers as G
from . import projections as PJ
from . import tables as T
from .common import VALUES, indicator_values, registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""WITH {T.ORDER_CUBE}, e AS (SELECT CAST(n_nationkey AS VARCHAR) AS area, y.y AS year, p.p AS prio FROM nation, (VALUES ('1995K1'), ('1998K2'), ('2001K3'), ('2001K4')) AS y(y), (VALUES {', '.join(f"('{p}')" for p in PRIOS)}) AS p(p))
SELECT area, year AS period, prio FROM e WHERE NOT EXISTS (SELECT 1 FROM oc WHERE oc.area = e.area AND oc.period = e.year AND oc.prio = e.prio)""")
def missing_cells(spark, sf):
    """Q1: expected area, period and code combinations that do not occur."""
    areas = T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("area"))
    want = Q.expected_grid(areas, {"period": ["1995K1", "1998K2", "2001K3", "2001K4"], "prio": PRIOS})
    return Q.missing_keys(want, T.order_cube(spark, sf).cells(), ["area", "period", "prio"])


@query(f"""WITH {VALUES}, p AS (SELECT parent AS code, period, sum(value) AS parts FROM iv WHERE level = 'customer' AND key = 'orders_n' GROUP BY ALL),
t AS (SELECT code, period, value + CASE WHEN CAST(code AS INT) % 5 = 0 THEN 3 ELSE 0 END AS total FROM iv WHERE level = 'nation' AND key = 'orders_n')
SELECT code, period, parts, total, parts - total AS gap FROM p JOIN t USING (code, period) WHERE abs(parts - total) > greatest(1, total * 0.02::DOUBLE)""")
def parts_against_published_total(spark, sf):
    """Q2, Q3: parts that miss the published total by more than the tolerance (some totals are off by 3 here)."""
    v = indicator_values(spark, sf, ("customer", "nation")).filter("key = 'orders_n'")
    parts = v.filter("level = 'customer'").select(F.col("parent").alias("code"), "period", "value")
    off = F.when(F.col("code").cast("int") % 5 == 0, 3).otherwise(0)
    tot = v.filter("level = 'nation'").select("code", "period", (F.col("value") + off).alias("value"))
    return Q.sum_mismatch(parts, tot, ["code", "period"], F.greatest(F.lit(1.0), F.col("total") * 0.02))


@query(f"""WITH {VALUES}, s AS (SELECT 'region' AS level, code, period, value FROM iv WHERE level = 'region' AND key = 'orders_n'), n AS (SELECT parent AS code, period, sum(value) AS v FROM iv WHERE level = 'nation' AND key = 'orders_n' GROUP BY ALL),
c AS (SELECT CAST(n_regionkey AS VARCHAR) AS code, period, sum(value) AS v FROM iv JOIN nation ON parent = CAST(n_nationkey AS VARCHAR) WHERE level = 'customer' AND key = 'orders_n' GROUP BY ALL)
SELECT code, period, abs(n.v - s.value) AS nation_gap, abs(c.v - s.value) AS customer_gap FROM s JOIN n USING (code, period) JOIN c USING (code, period)""")
def additivity_at_levels(spark, sf):
    """Q3: what every level's sum misses its parent by."""
    v = indicator_values(spark, sf).filter("key = 'orders_n'")
    tot = v.filter("level = 'region'").select("code", "period", "value")
    home = T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("parent"), F.col("n_regionkey").cast("string").alias("code"))
    nat = v.filter("level = 'nation'").groupBy(F.col("parent").alias("code"), "period").agg(F.sum("value").alias("n"))
    cus = v.filter("level = 'customer'").groupBy("parent", "period").agg(F.sum("value").alias("v")).join(home, "parent").groupBy("code", "period").agg(F.sum("v").alias("c"))
    j = tot.join(nat, ["code", "period"]).join(cus, ["code", "period"])
    return j.select("code", "period", F.abs(F.col("n") - F.col("value")).alias("nation_gap"), F.abs(F.col("c") - F.col("value")).alias("customer_gap"))


@query("""WITH a AS (SELECT o_custkey AS code, count(*) AS value FROM orders GROUP BY ALL), b AS (SELECT o_custkey AS code, CASE WHEN o_custkey % 100 = 7 THEN count(*) + 1 ELSE count(*) END AS value FROM orders WHERE o_custkey % 50 <> 3 GROUP BY o_custkey
  UNION ALL SELECT -c_custkey, 1 FROM customer WHERE c_custkey BETWEEN 1 AND 5)
SELECT code, a.value AS a_value, b.value AS b_value, CASE WHEN a.value IS NULL THEN 'only_b' WHEN b.value IS NULL THEN 'only_a' ELSE 'changed' END AS status FROM a FULL JOIN b USING (code) WHERE a.value IS DISTINCT FROM b.value""")
def diff_of_two_builds(spark, sf):
    """Full outer comparison of two builds, cell by cell."""
    o = T.table(spark, sf, "orders")
    k = F.col("o_custkey")
    a = o.groupBy(k.alias("code")).agg(F.count(F.lit(1)).alias("value"))
    b = o.filter(k % 50 != 3).groupBy(k.alias("code")).agg(F.count(F.lit(1)).alias("value")).withColumn("value", F.when(F.col("code") % 100 == 7, F.col("value") + 1).otherwise(F.col("value")))
    c = F.col("c_custkey")
    extra = T.table(spark, sf, "customer").filter(c.between(1, 5)).select((-c).alias("code"), F.lit(1).cast("long").alias("value"))
    return Q.cell_diff(a, b.unionByName(extra), ["code"])


@query(f"""WITH {PJ.PEOPLE}, w AS (SELECT code, max(CASE WHEN year = '1995' THEN total END) AS a, max(CASE WHEN year = '2000' THEN total END) AS b FROM fo GROUP BY code),
x AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, count(*) FILTER (WHERE year(o_orderdate) = 1995) AS a, count(*) FILTER (WHERE year(o_orderdate) = 2000) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT code, round((w.b - w.a) / w.a * 100, 6) AS a_value, round((x.b - x.a) / x.a * 100, 6) AS b_value, 'changed' AS status FROM w JOIN x USING (code) WHERE abs((w.b - w.a) / w.a - (x.b - x.a) / x.a) * 100 > 0.011::DOUBLE""")
def recomputed_by_second_expression(spark, sf):
    """Q4: a figure derived a second way must agree within 0.011 (no rows expected)."""
    a = J.outlook(PJ.folded(spark, sf), "1995", "1998", "2000").select("code", F.col("growth").alias("value"))
    y = F.year("o_orderdate")
    per = T.customer_totals(spark, sf, {}, {"x": F.count_if(y == 1995), "y": F.count_if(y == 2000)})
    n = per.groupBy(T.nation_code().alias("code")).agg(F.sum("x").alias("a"), F.sum("y").alias("b"))
    b = n.select("code", ((F.col("b") - F.col("a")) / F.col("a") * 100).alias("value"))
    return rounded(Q.cell_diff(a, b, ["code"], tolerance=0.011), "a_value", "b_value")


@query("""WITH i AS (SELECT 'k' || CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE n_nationkey < 20), f AS (SELECT 'k' || CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey % 8 = 3 THEN 'rounded up' ELSE '' END AS assumption FROM nation WHERE n_nationkey > 2)
SELECT key, CASE WHEN f.key IS NULL THEN 'no formula' WHEN i.key IS NULL THEN 'unused formula' ELSE 'assumption' END AS finding FROM i FULL JOIN f USING (key) WHERE f.key IS NULL OR i.key IS NULL OR assumption <> ''""")
def registry_formula_audit(spark, sf):
    """Q5: indicators without formula, unused formulas, and formulas resting on an assumption."""
    n = F.col("n_nationkey")
    k = F.concat(F.lit("k"), n.cast("string")).alias("key")
    nat = T.table(spark, sf, "nation")
    return Q.formula_audit(nat.filter(n < 20).select(k), nat.filter(n > 2).select(k, F.when(n % 8 == 3, "rounded up").otherwise("").alias("assumption")))


@query("""WITH kn AS (SELECT DISTINCT 'T' || CAST(o_custkey % 2 AS VARCHAR) AS "table", 'PRIO' AS var, o_orderpriority AS code FROM orders), cf AS (SELECT DISTINCT 'T' || CAST(p_partkey % 3 AS VARCHAR) AS "table", 'PRIO' AS var, CASE WHEN p_size % 3 = 0 THEN '1-URGENT' ELSE CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'LARGE' THEN 'high' WHEN 'MEDIUM' THEN 'medium' ELSE p_type END END AS code FROM part),
b AS (SELECT * FROM cf WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.code = cf.code AND kn."table" = cf."table"))
SELECT b."table", b.var, b.code, string_agg(kn.code, ',' ORDER BY kn.code) AS hints FROM b LEFT JOIN kn ON kn."table" = b."table" AND (contains(lower(kn.code), lower(b.code)) OR contains(lower(b.code), lower(kn.code))) GROUP BY ALL""")
def configured_codes_unknown(spark, sf):
    """Configured codes missing from the code list, with known codes as hints."""
    name = lambda c, n: F.concat(F.lit("T"), (F.col(c) % n).cast("string")).alias("table")
    known = T.table(spark, sf, "orders").select(name("o_custkey", 2), F.lit("PRIO").alias("var"), F.col("o_orderpriority").alias("code"))
    t = F.col("p_type")
    code = F.when(F.col("p_size") % 3 == 0, "1-URGENT").otherwise(K.lookup(t, {"ECONOMY": "low", "LARGE": "high", "MEDIUM": "medium"}, t))
    conf = T.table(spark, sf, "part").select(name("p_partkey", 3), F.lit("PRIO").alias("var"), code.alias("code"))
    return Q.unknown_codes(conf, known)


@query("SELECT CAST(c_nationkey AS VARCHAR) AS code, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) NOT BETWEEN 50 AND 70")
def counts_outside_range(spark, sf):
    """Q7: areas whose count lies outside the expected range."""
    n = T.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return Q.outside_bounds(n, "n", 50, 70)


@query("SELECT o_custkey AS code, count(DISTINCT o_orderpriority) AS parts FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderpriority) <> 5")
def groups_missing_a_part(spark, sf):
    """Q9: groups that lack one of the expected parts."""
    return Q.incomplete_groups(T.table(spark, sf, "orders").withColumnRenamed("o_custkey", "code"), ["code"], "o_orderpriority", 5)


@query("SELECT l_orderkey AS code, l_linenumber AS part, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_cells(spark, sf):
    """Q10: cells that occur more than once."""
    li = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("code"), F.col("l_linenumber").alias("part"))
    return Q.duplicate_cells(li, ["code", "part"])


@query("SELECT o_orderkey AS code, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def union_of_chunks_without_duplicates(spark, sf):
    """Chunks of one pull united; a cell in two chunks, or one the caller's own
    predicate forbids, would stop the job."""
    o = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("code"), T.cents("o_totalprice").alias("cents"))
    return Q.union_refusing_duplicates([o.filter(F.col("code") % 2 == i) for i in (0, 1)], ["code"], forbidden=F.col("code") < 0)


@query("""WITH a AS (SELECT DISTINCT o_custkey AS code FROM orders WHERE year(o_orderdate) = 1995), b AS (SELECT DISTINCT o_custkey AS code FROM orders WHERE year(o_orderdate) = 2000)
SELECT code, 'missing' AS side FROM a WHERE code NOT IN (SELECT code FROM b) UNION ALL SELECT code, 'unexpected' FROM b WHERE code NOT IN (SELECT code FROM a)""")
def keys_on_one_side(spark, sf):
    """Keys missing from or unexpected in a second build."""
    o = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("y"))
    return Q.key_difference(o.filter("y = 1995"), o.filter("y = 2000"), ["code"])


@query("""SELECT DISTINCT o_custkey AS code FROM orders WHERE year(o_orderdate) = 1995 INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 2000""")
def codes_in_all_inputs(spark, sf):
    """Codes that all inputs have."""
    o = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("y"))
    return o.filter("y = 1995").select("code").intersect(o.filter("y = 2000").select("code"))


@query("""WITH s AS (SELECT lower(n_name) || ' kommune' AS name, count(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), d AS (SELECT n_name, CAST(n_nationkey AS VARCHAR) AS code, count(*) + CASE WHEN n_nationkey % 10 = 3 THEN 2 ELSE 0 END AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name)
SELECT code, d.v AS a_value, s.value AS b_value, 'changed' AS status FROM s JOIN d ON lower(d.n_name) || ' kommune' = s.name WHERE d.v <> s.value""")
def agreement_with_published_names(spark, sf):
    """Q11: values against a published list joined by name."""
    c, n = T.table(spark, sf, "customer"), T.table(spark, sf, "nation")
    per = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name", "n_nationkey").agg(F.count(F.lit(1)).alias("value"))
    pub = per.select(F.concat(F.lower("n_name"), F.lit(" kommune")).alias("name"), "value")
    areas = n.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("area_name"))
    hit, _miss = G.by_name(pub, areas, aliases={})
    own = per.select(F.col("n_nationkey").cast("string").alias("code"), (F.col("value") + F.when(F.col("n_nationkey") % 10 == 3, 2).otherwise(0)).alias("value"))
    return Q.cell_diff(own, hit.select("code", "value"), ["code"])


@query(f"""WITH {T.POPULATION_CUBE}, a AS (SELECT area AS code, y AS year, sum(value) AS value FROM pc GROUP BY ALL)
SELECT code, CAST(year AS VARCHAR) AS year, value FROM a WHERE year IN (SELECT year FROM a GROUP BY year HAVING count(DISTINCT code) = 25)""")
def years_with_all_areas(spark, sf):
    """Q9: years in which the expected number of areas is present."""
    a = C.sum_by_area(T.population_cube(spark, sf).cells().withColumn("year", F.substring("period", 1, 4)), "area", "year").withColumnRenamed("area", "code")
    bad = Q.incomplete_groups(a, ["year"], "code", 25)
    return a.join(bad, "year", "left_anti")
