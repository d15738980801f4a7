"""Register joins and roll-ups. Line items play dwelling units, parts buildings, orders
building cases, suppliers schools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..operators import registers as G
from ..operators import rollup as U
from . import tables as T
from .common import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

USE = {"ECONOMY": "110", "LARGE": "140", "MEDIUM": "130", "PROMO": "320"}


def units(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_linenumber")
    part = T.table(spark, sf, "part").select("p_partkey", "p_type")
    sup = T.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nat = T.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    j = li.join(part, li.l_partkey == part.p_partkey, "left").join(sup, li.l_suppkey == sup.s_suppkey).join(nat, sup.s_nationkey == nat.n_nationkey)
    return j.select(
        F.col("l_partkey").alias("building"), K.lookup("l_returnflag", {"A": "1", "R": "2", "N": "3"}).alias("tenure"),
        F.when(F.col("l_quantity") != 7, F.col("l_quantity") * 3).alias("m2"), F.col("l_linenumber").alias("rooms"),
        (F.lit(1900) + F.col("l_partkey") % 130).alias("built"), K.lookup("p_type", USE).alias("use"),
        F.col("s_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), F.lit("all").alias("country"),
        F.col("l_linestatus").alias("status"),
    )


UNITS = """
un AS (SELECT l_partkey AS building, CASE l_returnflag WHEN 'A' THEN '1' WHEN 'R' THEN '2' ELSE '3' END AS tenure,
  CASE WHEN l_quantity <> 7 THEN l_quantity * 3 END AS m2, l_linenumber AS rooms, 1900 + l_partkey % 130 AS built,
  CASE p_type WHEN 'ECONOMY' THEN '110' WHEN 'LARGE' THEN '140' WHEN 'MEDIUM' THEN '130' WHEN 'PROMO' THEN '320' END AS use,
  s_nationkey AS nation, n_regionkey AS region, l_linestatus AS status
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
ul AS (SELECT 'nation' AS level, CAST(nation AS VARCHAR) AS code, * FROM un UNION ALL SELECT 'region', CAST(region AS VARCHAR), * FROM un UNION ALL SELECT 'country', 'all', * FROM un)"""


def _cnt(cond):
    return f"count(*) FILTER (WHERE {cond})"


@query(f"""WITH {UNITS}
SELECT level, code, count(*) AS n, count(DISTINCT building) AS n_bld, round({_cnt("tenure = '1'")} / count(tenure) * 100, 1) AS renters_pct,
  round({_cnt("tenure = '3'")} / count(tenure) * 100, 1) AS vacant_pct, round(sum(m2) / count(m2), 1) AS avg_m2, round({_cnt("m2 < 50")} / count(m2) * 100, 1) AS small_pct,
  round({_cnt("built >= 2010")} / count(*) * 100, 1) AS new_pct, round({_cnt("use = '140'")} / count(use) * 100, 1) AS flats_pct, round(count(*) / count(DISTINCT building), 1) AS dw_per_bld,
  concat_ws(',', {_cnt("rooms = 1")}, {_cnt("rooms = 2")}, {_cnt("rooms = 3")}, {_cnt("rooms >= 4")}) AS rooms_bins,
  concat_ws(',', {_cnt("built < 1950")}, {_cnt("built BETWEEN 1950 AND 1979")}, {_cnt("built BETWEEN 1980 AND 2009")}, {_cnt("built >= 2010")}) AS built_bins,
  concat_ws(',', {_cnt("m2 < 50")}, {_cnt("m2 >= 50 AND m2 < 80")}, {_cnt("m2 >= 80 AND m2 < 120")}, {_cnt("m2 >= 120")}) AS size_bins,
  concat_ws(',', {_cnt("use = '110'")}, {_cnt("use = '130'")}, {_cnt("use = '140'")}, {_cnt("use = '320'")}) AS type_bins
FROM ul GROUP BY level, code""")
def building_stock_profile(spark, sf):
    """Stock profile with exact distinct buildings and four histograms at three levels."""
    d = U.stock_profile(units(spark, sf), {"nation": "nation", "region": "region", "country": "country"})
    bins = {c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("rooms_bins", "built_bins", "size_bins", "type_bins")}
    return d.withColumns(bins)


@query(f"""WITH {UNITS} SELECT building, count(*) AS dwellings, round({_cnt("tenure = '1'")} / count(tenure) * 100, 0) AS rented_pct, round({_cnt("tenure = '3'")} / count(tenure) * 100, 0) AS vacant_pct,
  round(sum(m2) / count(m2), 0) AS avg_m2, {_cnt("rooms = 1")} AS rooms1, {_cnt("rooms = 2")} AS rooms2, {_cnt("rooms = 3")} AS rooms3, {_cnt("rooms >= 4")} AS rooms4, round({_cnt("m2 < 50")} / count(m2) * 100, 0) AS small_pct
FROM un GROUP BY building HAVING count(*) >= 2""")
def building_micro_profile(spark, sf):
    """One row per building with at least two dwellings."""
    return U.building_profiles(units(spark, sf))


@query(f"""WITH {UNITS}, b AS (SELECT building, min(built) AS built, min(use) AS use, count(*) AS n, {_cnt("tenure = '1'")} / count(tenure) * 100 AS rented FROM un GROUP BY building)
SELECT use, count(*) AS buildings, CAST(sum(n) AS BIGINT) AS dwellings FROM b WHERE n >= 20 AND built BETWEEN 1930 AND 2000 AND rented >= 30 GROUP BY use""")
def building_filter_totals(spark, sf):
    """buildings filtered by size, year and rented share, with totals."""
    b = units(spark, sf).groupBy("building").agg(
        F.min("built").alias("built"), F.min("use").alias("use"), F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("tenure") == "1") / F.count("tenure") * 100).alias("rented"))
    keep = (F.col("n") >= 20) & F.col("built").between(1930, 2000) & (F.col("rented") >= 30)
    return b.filter(keep).groupBy("use").agg(F.count(F.lit(1)).alias("buildings"), F.sum("n").alias("dwellings"))


@query(f"""WITH {UNITS}, big AS (SELECT building FROM un GROUP BY building HAVING count(*) >= 30)
SELECT nation, count(*) AS n FROM un WHERE building IN (SELECT building FROM big) AND status = 'O' AND tenure IN ('1', '2') GROUP BY nation""")
def units_in_large_buildings(spark, sf):
    """Semi-join to buildings with many units, current units of two types only."""
    u = units(spark, sf)
    keep = (F.col("status") == "O") & F.col("tenure").isin("1", "2")
    return u.filter(keep).join(G.large_buildings(u, 30), "building", "left_semi").groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


# --- building cases ---------------------------------------------------------------------


def cases(spark, sf):
    p = F.col("o_orderpriority")
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    later = lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyy-MM-dd")
    return T.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"), d.alias("case_date"),
        F.when(p != "5-LOW", later(30)).alias("permit"), F.when(p.isin("1-URGENT", "2-HIGH"), later(400)).alias("expected"),
        F.when(F.col("o_orderstatus") == "F", later(500)).alias("completed"), (F.col("o_custkey") % 7).cast("string").alias("developer"))


def case_links(spark, sf):
    return T.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("own_building"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey") % 50).alias("object_building"))


CASES = """
ca AS (SELECT o_orderkey AS case_id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS case_date,
  CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS permit,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN strftime(o_orderdate + INTERVAL 400 DAY, '%Y-%m-%d') END AS expected,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 500 DAY, '%Y-%m-%d') END AS completed, CAST(o_custkey % 7 AS VARCHAR) AS developer FROM orders),
lk AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS building FROM lineitem UNION SELECT DISTINCT l_orderkey, l_partkey % 50 FROM lineitem WHERE l_linenumber % 3 = 0),
bc AS (SELECT lk.building, ca.* FROM lk JOIN ca USING (case_id) WHERE lk.building IN (SELECT s_suppkey FROM supplier)),
oc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY building ORDER BY coalesce(expected, '') DESC, coalesce(permit, '') DESC, coalesce(case_date, '') DESC, case_id DESC) AS rn
  FROM bc WHERE completed IS NULL AND status <> 'P') WHERE rn = 1)"""


def building_ids(spark, sf):
    return T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("building"))


@query(f"WITH {CASES} SELECT building, count(*) AS cases, count(*) FILTER (WHERE completed IS NULL) AS not_completed FROM bc GROUP BY building")
def cases_linked_to_buildings(spark, sf):
    """Many-to-many links through either of two columns, each pair once."""
    c = G.cases_by_building(case_links(spark, sf), cases(spark, sf), building_ids(spark, sf))
    return c.groupBy("building").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("completed").isNull()).alias("not_completed"))


@query(f"WITH {CASES} SELECT building, case_id, expected, permit, case_date FROM oc")
def newest_open_case(spark, sf):
    """Newest open case per building by three dates."""
    c = G.cases_by_building(case_links(spark, sf), cases(spark, sf), building_ids(spark, sf))
    return G.open_cases(c, ["P"]).select("building", "case_id", "expected", "permit", "case_date")


PUBLIC = f"""{CASES}, pb AS (SELECT s_suppkey AS building, CASE s_suppkey % 6 WHEN 0 THEN '421' WHEN 1 THEN '441' WHEN 2 THEN '431' WHEN 3 THEN '413' WHEN 4 THEN '140' ELSE '422' END AS use,
  CASE WHEN s_suppkey % 4 = 0 THEN '6' ELSE '2' END AS status, s_nationkey AS nation, CAST(s_suppkey * 10 AS DOUBLE) AS m2, s_name AS name FROM supplier),
pc AS (SELECT pb.*, CASE WHEN use IN ('421', '422') THEN 'education' WHEN use = '441' THEN 'institutions' WHEN use = '431' THEN 'health' WHEN use = '413' THEN 'culture' END AS cat,
  CASE WHEN pb.status = '6' THEN 'existing' ELSE 'case' END AS kind, CASE WHEN pb.status <> '6' THEN coalesce(permit, case_date) END AS permit_date,
  CASE WHEN pb.status <> '6' THEN round((DATE '2001-09-01' - CAST(coalesce(permit, case_date) AS DATE)) / 365.25::DOUBLE, 1) END AS age_yrs,
  CASE WHEN pb.status <> '6' THEN coalesce(round((DATE '2001-09-01' - CAST(coalesce(permit, case_date) AS DATE)) / 365.25::DOUBLE, 1) <= 0.3, false) END AS recent,
  CASE WHEN pb.status <> '6' THEN CASE developer WHEN '1' THEN 'Private' WHEN '2' THEN 'Almennyttigt boligselskab' WHEN '3' THEN 'Kommune' WHEN '4' THEN 'Region' WHEN '5' THEN 'Stat' WHEN '6' THEN 'Andet' END END AS owner
  FROM pb LEFT JOIN oc ON oc.building = pb.building WHERE use <> '140')"""


def public_buildings(spark, sf):
    k = F.col("s_suppkey")
    use = K.lookup((k % 6).cast("string"), {"0": "421", "1": "441", "2": "431", "3": "413", "4": "140", "5": "422"})
    b = T.table(spark, sf, "supplier").select(
        k.alias("building"), use.alias("use"), F.when(k % 4 == 0, "6").otherwise("2").alias("status"),
        F.col("s_nationkey").alias("nation"), (k * 10).cast("double").alias("m2"), F.col("s_name").alias("name"))
    c = G.cases_by_building(case_links(spark, sf), cases(spark, sf), building_ids(spark, sf))
    d = G.public_building_cases(b, c, F.lit("2001-09-01").cast("date"), ["P"])
    # the fixture's dates are dense, so recency is three tenths of a year here
    recent = F.when(F.col("kind") == "case", F.coalesce(F.col("age_yrs") <= 0.3, F.lit(False)))
    return d.withColumn("recent", recent)


@query(f"WITH {PUBLIC} SELECT building, cat, kind, permit_date, age_yrs, recent, owner FROM pc")
def public_buildings_with_cases(spark, sf):
    """Category, kind, age and recency of the open case, developer label."""
    return public_buildings(spark, sf).select("building", "cat", "kind", "permit_date", "age_yrs", "recent", "owner")


@query(f"""WITH {PUBLIC}, l AS (SELECT 'nation' AS level, CAST(nation AS VARCHAR) AS code, * FROM pc UNION ALL SELECT 'country', 'all', * FROM pc)
SELECT level, code, cat, {_cnt("kind = 'existing'")} AS existing, {_cnt("kind = 'case' AND recent")} AS recent, {_cnt("kind = 'case' AND NOT recent")} AS stale,
  sum(CASE WHEN kind = 'existing' THEN m2 ELSE 0 END) AS m2_existing FROM l GROUP BY level, code, cat""")
def public_building_index(spark, sf):
    """Existing, recent and stale per category, and floor area, at two levels."""
    return U.public_index(public_buildings(spark, sf).withColumn("country", F.lit("all")), {"nation": "nation", "country": "country"})


@query(f"""WITH {PUBLIC}, l AS (SELECT 'nation' AS level, CAST(nation AS VARCHAR) AS code, * FROM pc UNION ALL SELECT 'country', 'all', * FROM pc)
SELECT level, code, building AS id, name, cat, permit_date AS permit FROM l WHERE kind = 'case' AND recent""")
def recent_cases_per_area(spark, sf):
    """The recent cases of every area as rows."""
    b = public_buildings(spark, sf).withColumns({"country": F.lit("all"), "id": F.col("building"), "permit": F.col("permit_date")})
    return U.recent_cases(b, {"nation": "nation", "country": "country"})


@query(f"""WITH {PUBLIC}, a AS (SELECT nation, sum(CASE WHEN kind = 'existing' THEN m2 ELSE 0 END) AS m2, {_cnt("kind = 'case' AND recent")} AS recent_n FROM pc GROUP BY nation),
p AS (SELECT c_nationkey AS nation, count(*) AS pop FROM customer GROUP BY ALL)
SELECT CAST(a.nation AS VARCHAR) AS code, recent_n, round(CASE WHEN pop > 0 THEN m2 / pop * 1000 END, 6) AS m2_per_1000 FROM a LEFT JOIN p ON p.nation = a.nation""")
def public_floor_area_per_1000(spark, sf):
    """Floor area per 1,000 inhabitants and the number of recent cases."""
    ix = U.public_index(public_buildings(spark, sf), {"nation": "nation"}).groupBy("code").agg(F.sum("m2_existing").alias("m2"), F.sum("recent").alias("recent_n"))
    pop = T.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("code")).agg(F.count(F.lit(1)).alias("pop"))
    return rounded(U.per_1000(ix, "m2", pop, ["code"], "m2_per_1000").drop("m2"), "m2_per_1000")


# --- addresses, names, hierarchy ---------------------------------------------------------


@query("""SELECT o_orderkey AS house_id, CASE WHEN s.c_name IS NOT NULL OR p.n_nationkey IS NOT NULL THEN
  trim(coalesce(s.c_name, '') || ' ' || CAST(o_orderkey % 90 AS VARCHAR)) || CASE WHEN p.n_nationkey IS NOT NULL THEN rtrim(', ' || lpad(CAST(p.n_nationkey AS VARCHAR), 4, '0') || ' ' || p.n_name) ELSE '' END END AS address
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) s ON s.c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 <> 0) p ON p.n_nationkey = o_orderkey % 25""")
def address_assembly(spark, sf):
    """House number to street and postal code, either possibly unknown."""
    k = F.col("o_orderkey")
    house = T.table(spark, sf, "orders").select(k.alias("house_id"), F.col("o_custkey").alias("street_id"), (k % 25).alias("postcode_id"), (k % 90).cast("string").alias("number"))
    street = T.table(spark, sf, "customer").filter(F.col("c_custkey") % 5 != 0).select(F.col("c_custkey").alias("street_id"), F.col("c_name").alias("street"))
    post = T.table(spark, sf, "nation").filter(F.col("n_nationkey") % 6 != 0).select(
        F.col("n_nationkey").cast("long").alias("postcode_id"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("postcode"), F.col("n_name").alias("town"))
    return G.addresses(house, street, post)


@query("""SELECT o_orderkey AS building, s_suppkey AS property_no FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_suppkey = c_custkey % 120""")
def property_number_chain(spark, sf):
    """Building to plot to property."""
    b = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("building"), F.col("o_custkey").alias("plot_id"))
    pl = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("plot_id"), (F.col("c_custkey") % 120).alias("property_id"))
    pr = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("property_id"), F.col("s_suppkey").alias("property_no"))
    return G.property_numbers(b, pl, pr)


@query(f"""WITH {T.POINTS} SELECT sp.id, round(CASE WHEN sp.id % 3 <> 0 THEN sp.lat ELSE cp.lat END, 6) AS lat, CASE WHEN sp.id % 3 <> 0 THEN 'own' WHEN cp.id IS NOT NULL THEN 'address' END AS origin
FROM sp LEFT JOIN cp ON cp.id = sp.id AND cp.id % 2 = 0""")
def coordinate_fallback(spark, sf):
    """Own coordinate, else the address point's, else none."""
    s = T.supplier_points(spark, sf).select("id", F.when(F.col("id") % 3 != 0, F.col("lat")).alias("own"))
    a = T.customer_points(spark, sf).filter(F.col("id") % 2 == 0).select("id", F.col("lat").alias("addr"))
    j = s.join(a, "id", "left")
    return rounded(j.select("id", G.first_known(F.col("own"), F.col("addr")).alias("lat"),
                            F.when(F.col("own").isNotNull(), "own").when(F.col("addr").isNotNull(), "address").alias("origin")), "lat")


def name_rows(spark, sf):
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 3 == 0, F.lit("  NATION_")).otherwise("Nation_"), (k % 30).cast("string"), F.when(k % 2 == 0, F.lit(" Kommune")).otherwise(""))
    return T.table(spark, sf, "supplier").select(k.alias("id"), name.alias("name"))


NAMES = "nr AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '  NATION_' ELSE 'Nation_' END || CAST(s_suppkey % 30 AS VARCHAR) || CASE WHEN s_suppkey % 2 = 0 THEN ' Kommune' ELSE '' END AS name FROM supplier), kk AS (SELECT id, name, 'nation_' || CAST(id % 30 AS VARCHAR) AS key FROM nr)"


def named_areas(spark, sf):
    return T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("area_name"))


@query(f"WITH {NAMES} SELECT id, name, code, area_name FROM (SELECT kk.id, kk.name, CAST(n_nationkey AS VARCHAR) AS code, n_name AS area_name FROM kk JOIN nation ON lower(n_name) = CASE key WHEN 'nation_27' THEN 'nation_2' ELSE key END)")
def join_by_normalised_name(spark, sf):
    """Join on normalised names with aliases."""
    hit, _miss = G.by_name(name_rows(spark, sf), named_areas(spark, sf), aliases={"nation_27": "nation_2"})
    return hit


@query(f"WITH {NAMES} SELECT id, name FROM kk WHERE key NOT IN (SELECT lower(n_name) FROM nation) AND key <> 'nation_27'")
def unmatched_names(spark, sf):
    """Names that match no area, reported rather than dropped."""
    _hit, miss = G.by_name(name_rows(spark, sf), named_areas(spark, sf), aliases={"nation_27": "nation_2"})
    return miss.select("id", "name")


CODES = "co AS (SELECT CASE WHEN c_custkey % 40 = 0 THEN '20900' WHEN c_custkey % 3 = 0 THEN '2' || lpad(CAST(c_custkey % 12 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 90 AS VARCHAR), 2, '0') WHEN c_custkey % 3 = 1 THEN '10' || CAST(c_custkey % 10 AS VARCHAR) ELSE '20' || lpad(CAST(c_custkey % 12 AS VARCHAR), 2, '0') END AS code FROM customer)"


def district_codes(spark, sf):
    k = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    code = (
        F.when(k % 40 == 0, "20900").when(k % 3 == 0, F.concat(F.lit("2"), two(k % 12), two(k % 90)))
        .when(k % 3 == 1, F.concat(F.lit("10"), (k % 10).cast("string"))).otherwise(F.concat(F.lit("20"), two(k % 12)))
    )
    return T.table(spark, sf, "customer").select(code.alias("code")).distinct()


@query(f"WITH {CODES} SELECT DISTINCT code, CASE WHEN code = '1' THEN 'city' WHEN length(code) = 5 THEN 'kvarter' WHEN code LIKE '1%' THEN 'bydel' ELSE 'lokaludvalg' END AS level FROM co")
def district_code_levels(spark, sf):
    """level of a code in a nested district system."""
    return district_codes(spark, sf).select("code", K.district_level("code").alias("level"))


@query(f"""WITH {CODES}, d AS (SELECT DISTINCT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ll, '1' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS district FROM nation WHERE n_nationkey < 11)
SELECT DISTINCT code, CASE WHEN code = '20900' THEN '2099' ELSE '20' || substr(code, 2, 2) END AS committee, CASE WHEN code = '20900' THEN '199' ELSE district END AS district
FROM co LEFT JOIN d ON d.ll = substr(code, 2, 2) WHERE length(code) = 5""")
def district_hierarchy(spark, sf):
    """Quarter to committee by the code's structure, committee to district by a mapping."""
    n = F.col("n_nationkey")
    d = T.table(spark, sf, "nation").filter(n < 11).select(F.lpad(n.cast("string"), 2, "0").alias("ll"), F.concat(F.lit("1"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0")).alias("district"))
    return G.district_parents(district_codes(spark, sf), d, {"kvarter": "20900", "lokaludvalg": "2099", "bydel": "199"})


@query("""SELECT c_custkey AS code, v.n AS value FROM customer JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL) v ON v.k = c_nationkey""")
def parent_value_on_children(spark, sf):
    """A parent's figure copied to all its children."""
    v = T.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("code")).agg(F.count(F.lit(1)).alias("value"))
    kids = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("parent"))
    return G.copied_to_children(v, kids)


# --- weighted means and merged codes -----------------------------------------------------


@query("""WITH a AS (SELECT CAST(n_nationkey AS VARCHAR) AS code, CAST(n_regionkey AS VARCHAR) AS area FROM nation),
v AS (SELECT CAST(s_nationkey AS VARCHAR) AS code, CAST(max(CAST(round(s_acctbal * 100) AS BIGINT)) AS DOUBLE) / 100 AS value FROM supplier GROUP BY ALL),
p AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, CASE WHEN c_nationkey % 5 = 4 THEN 0 ELSE count(*) END AS pop FROM customer WHERE c_nationkey % 7 <> 0 GROUP BY c_nationkey)
SELECT area, round(sum(value * CASE WHEN coalesce(pop, 0) = 0 THEN 1 ELSE pop END) / sum(CASE WHEN coalesce(pop, 0) = 0 THEN 1 ELSE pop END), 4) AS value FROM v JOIN a USING (code) LEFT JOIN p USING (code) GROUP BY area""")
def merged_codes_weighted_mean(spark, sf):
    """Population-weighted mean over the codes merged into an area; weight at least 1."""
    n = F.col("n_nationkey")
    merged = T.table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("string").alias("area")).agg(F.sort_array(F.collect_list(n.cast("string"))).alias("codes"))
    v = T.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("code")).agg((F.max(T.cents("s_acctbal")) / 100).alias("value"))
    c = F.col("c_nationkey")
    p = T.table(spark, sf, "customer").filter(c % 7 != 0).groupBy(c).agg(F.count(F.lit(1)).alias("cnt")).select(
        c.cast("string").alias("code"), F.when(c % 5 == 4, 0).otherwise(F.col("cnt")).alias("pop"))
    return rounded(U.to_merged_areas(v, U.merged_codes(merged), p, by=()), digits=4)


def schools(spark, sf):
    k = F.col("s_suppkey")
    return T.table(spark, sf, "supplier").select(
        k.alias("nr"), K.lookup((k % 4).cast("string"), {"0": "folkeskole", "1": "fri grundskole", "2": "specialskole", "3": "folkeskole"}).alias("type"),
        F.when(k % 9 != 0, k % 300 + 50).alias("pupils"), F.when(k % 5 != 0, ((k * 7 % 60) / 10 + 4)).alias("grade"), F.when(k % 7 != 0, k % 40).alias("grade_n"),
        F.when(k % 6 != 0, (k * 3 % 20) / 10 - 1).alias("socref"), F.when(k % 8 != 0, (k * 11 % 30) / 10 + 1).alias("trivsel"), (k % 120).alias("trivsel_n"),
        F.col("s_nationkey").alias("nation"))


SCHOOLS = """
sch AS (SELECT s_suppkey AS nr, CASE s_suppkey % 4 WHEN 1 THEN 'fri grundskole' WHEN 2 THEN 'specialskole' ELSE 'folkeskole' END AS type, CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey % 300 + 50 END AS pupils,
  CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey * 7 % 60) / 10 + 4 END AS grade, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 40 END AS grade_n,
  CASE WHEN s_suppkey % 6 <> 0 THEN (s_suppkey * 3 % 20) / 10 - 1 END AS socref, CASE WHEN s_suppkey % 8 <> 0 THEN (s_suppkey * 11 % 30) / 10 + 1 END AS trivsel, s_suppkey % 120 AS trivsel_n, s_nationkey AS nation FROM supplier)"""


def _wm(v, w):
    ww = f"CASE WHEN coalesce({w}, 0) > 0 THEN {w} WHEN coalesce(pupils, 0) > 0 THEN pupils ELSE 1 END"
    keep = f"type <> 'specialskole' AND {v} IS NOT NULL"
    return f"round(sum({v} * {ww}) FILTER (WHERE {keep}) / sum({ww}) FILTER (WHERE {keep}), 2)"


@query(f"""WITH {SCHOOLS}, l AS (SELECT 'nation' AS level, CAST(nation AS VARCHAR) AS code, * FROM sch UNION ALL SELECT 'country', 'all', * FROM sch),
g AS (SELECT level, code, {_cnt("type <> 'specialskole'")} AS k, count(*) AS schools_all_n, CAST(coalesce(sum(pupils) FILTER (WHERE type <> 'specialskole'), 0) AS BIGINT) AS p,
  {_wm('grade', 'grade_n')} AS grade_avg, {_wm('socref', 'grade_n')} AS socref_diff, {_wm('trivsel', 'trivsel_n')} AS trivsel, {_cnt("type <> 'specialskole' AND grade IS NOT NULL")} AS wg FROM l GROUP BY level, code)
SELECT level, code, k AS schools_n, schools_all_n, CASE WHEN p > 0 THEN p END AS pupils, grade_avg, socref_diff, trivsel, CASE WHEN k > 0 THEN round(wg * 100.0::DOUBLE / k, 1) END AS grade_share,
  CASE WHEN k > 0 AND p > 0 THEN round(p / k, 0) END AS pupils_per_school FROM g""")
def school_area_aggregates(spark, sf):
    """Three means each weighted by its own denominator, coverage share, pupils per school."""
    return U.school_areas(schools(spark, sf).withColumn("country", F.lit("all")), {"nation": "nation", "country": "country"}, ["folkeskole", "fri grundskole"])


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS school, CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) AS BIGINT) AS majority,
  CAST(sum(CASE WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') THEN 1 END) AS BIGINT) AS minority FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def origin_split(spark, sf):
    """Conditional sums per origin, unknown origin in neither."""
    kinds = {"BUILDING": "Dansk", "FURNITURE": "Indvandrer", "MACHINERY": "Efterkommer"}
    per = T.customer_totals(spark, sf, {"year": F.year("o_orderdate").cast("string")}, {"k": F.count(F.lit(1))})
    o = per.groupBy(T.nation_code().alias("school"), "year", K.lookup("c_mktsegment", kinds, F.lit("<uoplyst>")).alias("origin")).agg(F.sum("k").alias("value"))
    return U.origin_split(o)


REG = "reg AS (SELECT CAST(s_suppkey AS VARCHAR) AS nr, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey // 2 AS VARCHAR) WHEN s_suppkey % 4 = 1 THEN 'x' || CAST(s_suppkey AS VARCHAR) END AS parent FROM supplier)"


def school_register(spark, sf):
    k = F.col("s_suppkey")
    parent = F.when(k % 4 == 0, F.floor(k / 2).cast("string")).when(k % 4 == 1, F.concat(F.lit("x"), k.cast("string")))
    return T.table(spark, sf, "supplier").select(k.cast("string").alias("nr"), parent.alias("parent"))


@query(f"WITH {REG} SELECT r.nr, CASE WHEN p.nr IS NOT NULL THEN r.parent ELSE r.nr END AS institution FROM reg r LEFT JOIN reg p ON p.nr = r.parent")
def parent_institution(spark, sf):
    """Child to parent institution; an unknown parent leaves the child on its own."""
    return U.institution_of(school_register(spark, sf))


@query(f"""WITH {REG}, home AS (SELECT r.nr, CASE WHEN p.nr IS NOT NULL THEN r.parent ELSE r.nr END AS institution FROM reg r LEFT JOIN reg p ON p.nr = r.parent),
b AS (SELECT CAST(l_suppkey AS VARCHAR) AS branch, CAST(year(l_shipdate) AS VARCHAR) AS year, CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE count(*) END AS pupils, CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS ratio,
  CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE CASE WHEN sum(l_linenumber) % 2 = 0 THEN 'Ja' ELSE 'Nej' END END AS verdict FROM lineitem GROUP BY l_suppkey, year(l_shipdate))
SELECT institution AS school, year, round(sum(ratio * CASE WHEN pupils > 0 THEN pupils ELSE 1 END) / sum(CASE WHEN pupils > 0 THEN pupils ELSE 1 END), 2) AS ratio, count(*) AS branches,
  CASE WHEN count(DISTINCT nullif(trim(verdict), '')) = 1 THEN max(nullif(trim(verdict), '')) END AS verdict FROM b JOIN home ON branch = nr GROUP BY institution, year""")
def branches_to_institution(spark, sf):
    """Pupil-weighted means; the verdict only where all branches agree."""
    k = F.col("l_suppkey")
    s, n = F.sum("l_linenumber"), F.count(F.lit(1))
    b = T.table(spark, sf, "lineitem").groupBy(k, F.year("l_shipdate").cast("string").alias("year")).agg(s.alias("s"), n.alias("n")).select(
        k.cast("string").alias("branch"), "year", F.when(k % 10 == 0, 0).otherwise(F.col("n")).alias("pupils"), (F.col("s").cast("double") / F.col("n")).alias("ratio"),
        F.when(k % 3 == 0, " ").when(F.col("s") % 2 == 0, "Ja").otherwise("Nej").alias("verdict"))
    return U.to_institution(b, school_register(spark, sf))


@query(f"""WITH {T.POINTS}, l AS (SELECT c.id AS building, s.id AS school FROM cp c JOIN sp s ON abs(c.lat - s.lat) < 0.3 WHERE {T.haversine_sql('c.lat', 'c.lon', 's.lat', 's.lon')} <= 25000)
SELECT cp.id AS building, min(l.school) AS school FROM cp LEFT JOIN l ON l.building = cp.id GROUP BY cp.id""")
def first_school_wins(spark, sf):
    """The first school per building; references of an earlier build do not survive."""
    from ..operators import spatial as S

    c, s = T.customer_points(spark, sf).select("id", "lat", "lon"), T.supplier_points(spark, sf).select("id", "lat", "lon")
    # of schools at one place the first is enough
    first = s.groupBy("lat", "lon").agg(F.min("id").alias("id"))
    links = S.within_radius(c, first, 25000.0).select(F.col("a_id").alias("building"), F.col("b_id").alias("school"))
    stale = c.select(F.col("id").alias("building"), F.lit(-1).alias("school"))
    return G.refresh_reference(stale, links)


@query("""WITH s AS (SELECT s_suppkey AS nr, s_nationkey AS area, CAST(1994 + s_suppkey % 9 AS VARCHAR) AS year FROM supplier), y AS (SELECT c_nationkey AS area, CAST(year(o_orderdate) AS VARCHAR) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT s.nr, s.year, y.n AS area_value, CAST(t.n AS BIGINT) AS national_value FROM s LEFT JOIN y ON y.area = s.area AND y.year = s.year LEFT JOIN (SELECT year, sum(n) AS n FROM y GROUP BY year) t ON t.year = s.year""")
def benchmarks_of_own_year(spark, sf):
    """Area and national benchmark of the measure's own year."""
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("nr"), F.col("s_nationkey").alias("area"), (F.lit(1994) + F.col("s_suppkey") % 9).cast("string").alias("year"))
    per = T.customer_totals(spark, sf, {"year": F.year("o_orderdate").cast("string")}, {"k": F.count(F.lit(1))})
    y = per.groupBy(F.col("c_nationkey").alias("area"), "year").agg(F.sum("k").alias("value"))
    return G.with_benchmarks(s, y, y.groupBy("year").agg(F.sum("value").alias("value"))).drop("area")


@query("""WITH g AS (SELECT c_nationkey AS area, CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(count(*) AS DOUBLE) / 10 AS grade, count(DISTINCT o_custkey) AS grade_n, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
n AS (SELECT year, sum(grade * grade_n) / sum(grade_n) AS dk FROM g GROUP BY year)
SELECT area, g.year, round(sum(grade * grade_n) / sum(grade_n), 6) AS grade, round(max(dk), 6) AS national FROM g JOIN n USING (year) GROUP BY area, g.year""")
def grade_trend(spark, sf):
    """Exam-weighted mean per area and year beside the national one."""
    per = T.customer_totals(spark, sf, {"year": F.year("o_orderdate").cast("string")}, {"k": F.count(F.lit(1))})
    g = per.groupBy(F.col("c_nationkey").alias("area"), "year", "c_mktsegment").agg((F.sum("k") / 10).alias("grade"), F.count(F.lit(1)).alias("grade_n"))
    mean = U.weighted_mean(F.col("grade"), F.col("grade_n"))
    nat = g.groupBy("year").agg(mean.alias("national"))
    return rounded(g.groupBy("area", "year").agg(mean.alias("grade")).join(nat, "year"), "grade", "national")


@query("""WITH u AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS nr FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09)
SELECT CAST(s_suppkey % 4 AS VARCHAR) AS type, count(*) AS registered, count(u.nr) AS covered, count(*) - count(u.nr) AS missing FROM supplier LEFT JOIN u ON u.nr = CAST(s_suppkey AS VARCHAR) GROUP BY 1""")
def register_coverage(spark, sf):
    """Covered and missing units by type, counted from the register."""
    val = F.when((F.col("l_quantity") > 49) & (F.col("l_discount") > 0.09), F.col("l_quantity"))
    u = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("unit"), val.alias("value"))
    reg = T.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("nr"), (F.col("s_suppkey") % 4).cast("string").alias("type"))
    return U.coverage_counts(u, reg, "type")


# --- projects, climate, own properties ---------------------------------------------------

PROJECTS = """
pj AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey // 5 * 5 AS VARCHAR) ELSE '' END AS parent,
  CASE s_suppkey % 4 WHEN 0 THEN 'construction' WHEN 1 THEN 'opened' WHEN 2 THEN 'study' ELSE 'decided' END AS status, CASE WHEN s_suppkey % 3 > 0 THEN CAST(2020 + s_suppkey % 15 AS INTEGER) END AS open_year,
  CASE WHEN s_suppkey % 2 = 0 THEN 'metro' ELSE 'road' END AS type, s_nationkey AS nation FROM supplier)"""


def projects(spark, sf):
    k = F.col("s_suppkey")
    status = K.lookup((k % 4).cast("string"), {"0": "construction", "1": "opened", "2": "study", "3": "decided"})
    return T.table(spark, sf, "supplier").select(
        k.alias("id"), F.col("s_name").alias("name"), F.when(k % 5 > 0, (F.floor(k / 5) * 5).cast("string")).otherwise("").alias("parent"),
        status.alias("status"), F.when(k % 3 > 0, (k % 15 + 2020).cast("int")).alias("open_year"), F.when(k % 2 == 0, "metro").otherwise("road").alias("type"), F.col("s_nationkey").alias("nation"))


@query(f"""WITH {PROJECTS}, f AS (SELECT * FROM pj WHERE type = 'metro' AND status <> 'opened')
SELECT id, name, status, open_year FROM f ORDER BY CASE status WHEN 'construction' THEN 0 WHEN 'decided' THEN 1 WHEN 'study' THEN 2 ELSE 3 END, coalesce(open_year, 9999), name""")
def projects_filtered_in_order(spark, sf):
    """Filtered projects by status, opening year (unknown last) and name."""
    p = projects(spark, sf).filter((F.col("type") == "metro") & (F.col("status") != "opened"))
    return p.orderBy(*G.project_order()).select("id", "name", "status", "open_year")


@query(f"""WITH {PROJECTS}, k AS (SELECT parent, count(*) AS stations, count(*) FILTER (WHERE status <> 'opened') AS upcoming FROM pj WHERE parent <> '' GROUP BY parent)
SELECT id, coalesce(stations, 0) AS stations, coalesce(upcoming, 0) AS upcoming FROM pj LEFT JOIN k ON k.parent = CAST(id AS VARCHAR)""")
def stations_per_project(spark, sf):
    """Children of every project, and those not opened yet."""
    p = projects(spark, sf).withColumn("id", F.col("id").cast("string"))
    return G.stations_of(p).select(F.col("id").cast("long").alias("id"), "stations", "upcoming")


SERVING = f"""{PROJECTS}, sv AS (SELECT 'nation' AS level, CAST((nation + j) % 25 AS VARCHAR) AS code, id, status, parent <> '' AS is_station FROM pj, (VALUES (0), (1), (7)) AS t(j) WHERE j <= id % 8
  UNION SELECT 'region', CAST(((nation + j) % 25) % 5 AS VARCHAR), id, status, parent <> '' FROM pj, (VALUES (0), (1), (7)) AS t(j) WHERE j <= id % 8)"""


def serving(spark, sf):
    p = projects(spark, sf).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(7)))).filter(F.col("j") <= F.col("id") % 8)
    n = (F.col("nation") + F.col("j")) % 25
    d = U.at_levels(p.withColumns({"nation": n, "region": n % 5}), {"nation": "nation", "region": "region"})
    return d.select("level", "code", "id", "status", (F.col("parent") != "").alias("is_station")).distinct()


@query(f"WITH {SERVING} SELECT level, code, count(*) AS projects, {_cnt('''status <> 'opened' ''')} AS upcoming, {_cnt('''status <> 'opened' AND is_station''')} AS stations_planned FROM sv GROUP BY ALL")
def project_index_per_area(spark, sf):
    """Projects, upcoming ones and planned stations per area."""
    return U.project_index(serving(spark, sf))


@query(f"WITH {SERVING} SELECT id AS project, level, string_agg(code, ' ' ORDER BY code) AS codes FROM sv GROUP BY ALL")
def areas_served_by_project(spark, sf):
    """Inverse index from project to the areas it serves."""
    return G.areas_served(serving(spark, sf).withColumnRenamed("id", "project"))


@query("""SELECT CAST(code AS VARCHAR) AS code, string_agg(DISTINCT r_name, ', ' ORDER BY r_name) AS names FROM (SELECT r_name, (n_nationkey * 3 + r_regionkey) % 20 AS code FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY code""")
def risk_area_names(spark, sf):
    """Names of the risk areas that list an area as a member."""
    n, r = T.table(spark, sf, "nation"), T.table(spark, sf, "region")
    m = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("name")).agg(F.collect_list(((F.col("n_nationkey") * 3 + F.col("r_regionkey")) % 20).cast("string")).alias("codes"))
    return G.names_per_area(m)


SCENARIOS = """
cu AS (SELECT CAST(l_suppkey AS VARCHAR) AS stretch, CAST(l_linenumber % 3 AS VARCHAR) AS horizon, CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'mid' ELSE 'high' END AS scenario,
  CASE WHEN l_linestatus = 'F' THEN 50 WHEN l_quantity < 25 THEN 10 ELSE 90 END AS percentile, max(l_quantity) AS value FROM lineitem GROUP BY ALL),
bd AS (SELECT stretch, horizon, max(CASE WHEN scenario = 'mid' AND percentile = 50 THEN value END) AS value, max(CASE WHEN scenario = 'mid' AND percentile = 10 THEN value END) AS p10,
  max(CASE WHEN scenario = 'mid' AND percentile = 90 THEN value END) AS p90, max(CASE WHEN scenario = 'low' AND percentile = 50 THEN value END) AS low, max(CASE WHEN scenario = 'high' AND percentile = 50 THEN value END) AS high FROM cu GROUP BY ALL)"""


def bands(spark, sf):
    li = T.table(spark, sf, "lineitem")
    pct = F.when(F.col("l_linestatus") == "F", 50).when(F.col("l_quantity") < 25, 10).otherwise(90)
    cube = li.groupBy(F.col("l_suppkey").cast("string").alias("stretch"), (F.col("l_linenumber") % 3).cast("string").alias("horizon"),
                      K.lookup("l_returnflag", {"A": "low", "N": "mid", "R": "high"}).alias("scenario"), pct.alias("percentile")).agg(F.max("l_quantity").alias("value"))
    return G.scenario_bands(cube, "mid", "low", "high", ["stretch", "horizon"])


@query(f"WITH {SCENARIOS} SELECT * FROM bd")
def scenario_bands(spark, sf):
    """A45, F36, SC15: value, p10/p90 and outer scenarios per area and horizon."""
    return bands(spark, sf)


@query(f"""WITH {SCENARIOS}, a AS (SELECT c_custkey AS code FROM customer), co AS (SELECT c_custkey AS code, CAST(c_custkey % 140 AS VARCHAR) AS stretch FROM customer WHERE c_custkey % 3 > 0),
cl AS (SELECT o_custkey AS code, count(*) AS claims_1000 FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL), dg AS (SELECT c_custkey AS code FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT a.code, co.stretch IS NOT NULL AS coastal, co.stretch, bd.value, p10, p90, CASE WHEN co.stretch IS NULL THEN 'not coastal' WHEN bd.value IS NULL THEN 'no stretch' END AS reason, claims_1000,
  CASE WHEN claims_1000 IS NULL THEN 'not computed' END AS claims_reason, CAST(CASE WHEN dg.code IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS risk_area
FROM a LEFT JOIN co ON co.code = a.code LEFT JOIN (SELECT * FROM bd WHERE horizon = '0') bd ON bd.stretch = co.stretch LEFT JOIN cl ON cl.code = a.code LEFT JOIN dg ON dg.code = a.code""")
def climate_record_with_reasons(spark, sf):
    """Area, climate cube, claims and designation, with a reason for every missing figure."""
    c = T.table(spark, sf, "customer")
    k = F.col("c_custkey")
    coast = c.filter(k % 3 > 0).select(k.alias("code"), (k % 140).cast("string").alias("stretch"))
    claims = T.table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").groupBy(F.col("o_custkey").alias("code")).agg(F.count(F.lit(1)).alias("claims_1000"))
    return G.climate_record(c.select(k.alias("code")), coast, bands(spark, sf).filter("horizon = '0'"), claims, c.filter(F.col("c_mktsegment") == "BUILDING").select(k.alias("code")))


@query("""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 7 END AS vac, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 5 END AS notice, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 60 END AS units FROM customer),
q AS (SELECT id, (coalesce(vac, 0) + coalesce(notice, 0)) / greatest(1, CASE WHEN coalesce(units, 0) = 0 THEN 20 ELSE units END) AS pressure FROM p)
SELECT id, round(pressure, 6) AS pressure, CASE WHEN pressure > 0.12 THEN 'high' WHEN pressure > 0.06 THEN 'medium' ELSE 'low' END AS band FROM q""")
def property_pressure(spark, sf):
    """Vacant and notice over units, three bands."""
    k = F.col("c_custkey")
    v, n, u = F.when(k % 3 > 0, k % 7), F.when(k % 4 > 0, k % 5), F.when(k % 5 > 0, k % 60)
    return T.table(spark, sf, "customer").select(k.alias("id"), F.round(K.pressure(v, n, u), 6).alias("pressure"), K.pressure_band(v, n, u).alias("band"))


@query("""SELECT DISTINCT p_brand AS code, p_type AS type FROM part WHERE NOT (p_brand IN ('Brand#1', 'Brand#2')) AND regexp_matches(lpad(CAST(p_size * 25 AS VARCHAR), 3, '0'), '^[0-9]{3}$') AND p_size * 25 BETWEEN 101 AND 899 AND lpad(CAST(p_size * 25 AS VARCHAR), 3, '0') NOT LIKE '08%'""")
def municipality_codes_and_exclusions(spark, sf):
    """municipality codes only, and a list of excluded codes."""
    p = T.table(spark, sf, "part")
    code = F.lpad((F.col("p_size") * 25).cast("string"), 3, "0")
    return p.filter(K.is_municipality(code) & ~F.col("p_brand").isin("Brand#1", "Brand#2")).select(F.col("p_brand").alias("code"), F.col("p_type").alias("type")).distinct()
