"""Age folding, outlook measures, backtests, household gap and rank correlation.

Customers' orders play persons: the age is derived from the customer key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..operators import calcs as C
from ..operators import projection as J
from ..operators import quality as Q
from . import tables as T
from .common import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

AGE_SQL = "CAST(o_custkey * 7 % 101 AS INT)"
GROUP_SQL = """CASE WHEN age <= 5 THEN 'a0_5' WHEN age <= 16 THEN 'a6_16' WHEN age <= 19 THEN 'a17_19' WHEN age <= 34 THEN 'a20_34' WHEN age <= 64 THEN 'a35_64' WHEN age <= 79 THEN 'a65_79' ELSE 'a80p' END"""
PEOPLE = f"""
pp AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, CAST(year(o_orderdate) AS VARCHAR) AS year, {AGE_SQL} AS age, count(*) AS persons FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
fo AS (SELECT code, year, CAST(sum(persons) AS BIGINT) AS total, {', '.join(f"CAST(coalesce(sum(persons) FILTER (WHERE {GROUP_SQL} = '{g}'), 0) AS BIGINT) AS {g}" for g in ('a0_5', 'a6_16', 'a17_19', 'a20_34', 'a35_64', 'a65_79', 'a80p'))} FROM pp GROUP BY ALL)"""


def age_cells(spark, sf):
    """Single-year cells with zero-padded codes, an open-ended last one, and a total row."""
    per = T.customer_totals(spark, sf, {"year": F.year("o_orderdate").cast("string")}, {"k": F.count(F.lit(1))})
    age = (F.col("o_custkey") * 7 % 101).cast("int")
    by_age = per.groupBy(T.nation_code().alias("code"), "year", age.alias("a")).agg(F.sum("k").alias("persons"))
    code = F.when(F.col("a") == 100, "100-").otherwise(F.lpad(F.col("a").cast("string"), 2, "0"))
    single = by_age.select("code", "year", code.alias("age"), "persons")
    return single.unionByName(by_age.groupBy("code", "year").agg(F.sum("persons").alias("persons")).withColumn("age", F.lit("TOT")))


def folded(spark, sf):
    """Areas x years x seven groups: small whatever the persons behind it."""
    return J.fold_ages(age_cells(spark, sf)).persist()


@query(f"WITH {PEOPLE} SELECT * FROM fo")
def age_groups_folded(spark, sf):
    """Single ages to seven groups, the published total kept apart."""
    return folded(spark, sf)


@query(f"""WITH {PEOPLE}, g AS (SELECT code, year, abs(a0_5 + a6_16 + a17_19 + a20_34 + a35_64 + a65_79 + a80p - total - CASE WHEN code = '3' AND year = '1997' THEN 5 ELSE 0 END) AS gap FROM fo)
SELECT gap, code, year FROM g ORDER BY gap DESC, code DESC LIMIT 1""")
def worst_fold_gap(spark, sf):
    """The area-year whose groups are furthest from its total (one total is off by 5 here)."""
    f = folded(spark, sf)
    off = (F.col("code") == "3") & (F.col("year") == "1997")
    return J.worst_fold_gap(f.withColumn("total", F.when(off, F.col("total") + 5).otherwise(F.col("total"))))


@query(f"WITH {PEOPLE} SELECT year, CAST(sum(total) AS BIGINT) AS total, {', '.join(f'CAST(sum({g}) AS BIGINT) AS {g}' for g in ('a0_5', 'a6_16', 'a17_19', 'a20_34', 'a35_64', 'a65_79', 'a80p'))} FROM fo GROUP BY year")
def national_as_sum_of_areas(spark, sf):
    """The nation as the sum of its areas."""
    return J.national(folded(spark, sf))


_W = ", ".join(f"max(CASE WHEN year = '{y}' THEN {c} END) AS {c}_{t}" for c in ("total", "a0_5", "a6_16", "a20_34", "a80p") for t, y in (("0", "1995"), ("m", "1998"), ("1", "2000")))


def _pc(c, t="1"):
    return f"CASE WHEN {c}_0 <> 0 THEN ({c}_{t} - {c}_0) / {c}_0 * 100 END"


@query(f"""WITH {PEOPLE}, w AS (SELECT code, {_W} FROM fo GROUP BY code), n AS (SELECT (sum(a20_34_1) - sum(a20_34_0)) / sum(a20_34_0) * 100 AS r FROM w)
SELECT code, round({_pc('total')}, 6) AS growth, round({_pc('total', 'm')}, 6) AS growth_5y, round((total_m - total_0) / 3 / total_0 * 1000, 6) AS pop_rate_5y, total_1 - total_0 AS abs, round({_pc('a0_5')}, 6) AS c0_5,
  round({_pc('a6_16')}, 6) AS c6_16, round({_pc('a20_34')}, 6) AS c20_34, round({_pc('a20_34')} - (SELECT r FROM n), 6) AS c20_34_rel, a20_34_1 - a20_34_0 AS c20_34_abs, round({_pc('a80p')}, 6) AS c80p FROM w""")
def outlook_measures(spark, sf):
    """Ten outlook measures per area, the cohort against the sum of areas."""
    d = J.outlook(folded(spark, sf), "1995", "1998", "2000")
    return rounded(d, "growth", "growth_5y", "pop_rate_5y", "c0_5", "c6_16", "c20_34", "c20_34_rel", "c80p")


@query(f"""WITH {PEOPLE}, w AS (SELECT code, {_W} FROM fo GROUP BY code), n AS (SELECT (a20_34_1 - a20_34_0) / a20_34_0 * 100 AS r FROM w WHERE code = '7')
SELECT code, round({_pc('a20_34')} - (SELECT r FROM n), 6) AS c20_34_rel FROM w""")
def outlook_against_one_area(spark, sf):
    """The cohort measured against one given series instead of the sum."""
    f = folded(spark, sf)
    return rounded(J.outlook(f, "1995", "1998", "2000", f.filter("code = '7'")).select("code", "c20_34_rel"), "c20_34_rel")


STOCK = f"{T.STOCK_CUBE}, st AS (SELECT area AS code, y, sum(value) AS value FROM sc GROUP BY ALL), po AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, count(*) AS pop FROM customer GROUP BY ALL)"
NET = f"""{STOCK}, yr AS (SELECT max(y) AS base FROM st), sy AS (SELECT max(y) AS start FROM st, yr WHERE y <= base - 5),
na AS (SELECT a.code, b.value AS stock_start, a.value AS stock_end, CAST(base - start AS INTEGER) AS span_years, pop FROM st a JOIN yr ON a.y = base JOIN sy ON true JOIN st b ON b.code = a.code AND b.y = start JOIN po ON po.code = a.code)"""


def stock(spark, sf):
    s = C.sum_by_area(T.stock_cube(spark, sf).cells(), "area", "period")
    return s.select(F.col("area").alias("code"), F.col("period").alias("year"), "value")


def population(spark, sf):
    return T.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("code")).agg(F.count(F.lit(1)).alias("pop"))


@query(f"WITH {NET} SELECT *, round((stock_end - stock_start) / span_years, 6) AS per_year, round((stock_end - stock_start) / span_years / pop * 1000, 6) AS per_1000 FROM na")
def net_additions(spark, sf):
    """Stock change between the newest year and the newest one at least five years
    earlier, annualised over the real span, for areas with both years and a population."""
    return rounded(J.net_additions(stock(spark, sf), population(spark, sf)), "per_year", "per_1000")


@query(f"""WITH {NET}, s AS (SELECT sum(stock_start) AS a, sum(stock_end) AS b, max(span_years) AS n, CAST(sum(pop) AS BIGINT) AS pop FROM na)
SELECT 'all' AS code, a AS stock_start, b AS stock_end, n AS span_years, pop, round((b - a) / n, 6) AS per_year, round((b - a) / n / pop * 1000, 6) AS per_1000 FROM s""")
def net_additions_national(spark, sf):
    """The same figures for the sum of the areas."""
    return rounded(J.net_additions_national(J.net_additions(stock(spark, sf), population(spark, sf))), "per_year", "per_1000")


@query(f"WITH {STOCK} SELECT CAST(max(y) AS INTEGER) AS start, CAST(2001 - max(y) AS INTEGER) AS span FROM (SELECT DISTINCT y FROM st WHERE y NOT IN (1996, 1995)) WHERE y <= 2001 - 3")
def stock_start_year(spark, sf):
    """As-of start year, the real span kept."""
    years = stock(spark, sf).select("year").distinct().filter(~F.col("year").isin("1995", "1996"))
    return J.stock_start_year(years, 2001, 3)


MOVES = """
mv AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, year(o_orderdate) AS year, CASE WHEN o_orderpriority = '1-URGENT' THEN 'natural' ELSE 'migration' END AS kind,
  sum(CASE o_orderpriority WHEN '3-MEDIUM' THEN -1 ELSE 1 END) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY ALL),
sk AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, year(o_orderdate) AS year, count(*) AS persons FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
fl AS (SELECT code, sum(n) FILTER (WHERE kind = 'migration' AND year < 1997) AS short, sum(n) FILTER (WHERE kind = 'migration') AS ful, sum(n) AS moved FROM mv WHERE year BETWEEN 1995 AND 1999 GROUP BY code),
en AS (SELECT code, sum(persons) FILTER (WHERE year = 1995) AS p0, sum(persons) FILTER (WHERE year = 2000) AS p1 FROM sk GROUP BY code),
al AS (SELECT code, short, ful, moved, p0, p1 FROM fl JOIN en USING (code) UNION ALL SELECT 'city', sum(short), sum(ful), sum(moved), sum(p0), sum(p1) FROM fl JOIN en USING (code))"""


@query(f"""WITH {MOVES} SELECT code, CAST(short AS BIGINT) AS short, CAST(ful AS BIGINT) AS "full", round(short / p0 * 1000, 6) AS short_per_1000, round(ful / p0 * 1000, 6) AS full_per_1000,
  CAST(p1 - p0 - moved AS BIGINT) AS gap, round((p1 - p0 - moved) / p0 * 1000, 6) AS gap_per_1000, abs(p1 - p0 - moved) <= greatest(25.0::DOUBLE, p0 * 0.01::DOUBLE) AS reconciles FROM al""")
def net_migration_reconciled(spark, sf):
    """Migration over two windows, the city as the sum of parts, and the reconciliation flag."""
    o = T.customer_totals(spark, sf, {"year": F.year("o_orderdate"), "p": F.col("o_orderpriority")}, {"k": F.count(F.lit(1))})
    p, key = F.col("p"), [T.nation_code().alias("code"), F.col("year")]
    moves = o.filter(p.isin("1-URGENT", "2-HIGH", "3-MEDIUM")).groupBy(*key, F.when(p == "1-URGENT", "natural").otherwise("migration").alias("kind")).agg(
        F.sum(F.when(p == "3-MEDIUM", -F.col("k")).otherwise(F.col("k"))).alias("n"))
    st = o.groupBy(*key).agg(F.sum("k").alias("persons"))
    return rounded(J.net_migration(moves, st, 1995, 2, 2000, "city"), "short_per_1000", "full_per_1000", "gap_per_1000")


BACKTEST = """
ac AS (SELECT 'nation' AS level, 'n' || CAST(c_nationkey AS VARCHAR) AS code, c_nationkey AS k, year(o_orderdate) AS year, CAST(count(*) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
  UNION ALL SELECT 'region', 'r' || CAST(n_regionkey AS VARCHAR), n_regionkey, year(o_orderdate), CAST(count(*) AS DOUBLE) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
fc AS (SELECT year AS vintage, code, level, year + h AS year, value * (1 + h * (k % 5 - 2) / 100.0::DOUBLE) AS value, h FROM ac, (VALUES (0), (1), (3), (5)) AS t(h) WHERE year <= 1999),
gr AS (SELECT a.vintage, a.h, a.level, sum(a.value) / 1 AS t1, max(b.t0) AS t0 FROM fc a JOIN (SELECT vintage, level, sum(value) AS t0 FROM fc WHERE h = 0 GROUP BY ALL) b USING (vintage, level) GROUP BY a.vintage, a.h, a.level),
pr AS (SELECT f.vintage, f.h AS horizon, f.code, f.level, f.value AS forecast, ac.value AS actual, o.value * gr.t1 / gr.t0 AS baseline
  FROM fc f JOIN ac ON ac.code = f.code AND ac.year = f.year JOIN fc o ON o.vintage = f.vintage AND o.code = f.code AND o.h = 0 JOIN gr ON gr.vintage = f.vintage AND gr.h = f.h AND gr.level = f.level)"""


def backtest_pairs(spark, sf):
    o = T.customer_totals(spark, sf, {"year": F.year("o_orderdate")}, {"v": F.count(F.lit(1))})
    n = T.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    by_nation = o.groupBy(F.col("c_nationkey").alias("k"), "year").agg(F.sum("v").alias("v"))
    by_region = by_nation.join(n, F.col("k") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("k"), "year").agg(F.sum("v").alias("v"))
    act = by_nation.select(F.lit("nation").alias("level"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("code"), "k", "year", F.col("v").cast("double").alias("value")).unionByName(
        by_region.select(F.lit("region").alias("level"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("code"), "k", "year", F.col("v").cast("double").alias("value"))).persist()
    h = F.explode(F.array(*[F.lit(i) for i in (0, 1, 3, 5)])).alias("h")
    fc = act.filter("year <= 1999").select(F.col("year").alias("vintage"), "code", "level", "k", "value", h).select(
        "vintage", "code", "level", (F.col("vintage") + F.col("h")).alias("year"), (F.col("value") * (1 + F.col("h") * (F.col("k") % 5 - 2) / 100)).alias("value"))
    # areas x vintages x horizons, read by every score
    return J.forecast_pairs(fc, act, [0, 1, 3, 5]).persist()


@query(f"WITH {BACKTEST} SELECT CAST(vintage AS INTEGER) AS vintage, horizon, code, level, round(forecast, 6) AS forecast, actual, round(baseline, 6) AS baseline FROM pr")
def forecast_actual_pairs(spark, sf):
    """Projection cells paired with what came true, and the pro-rata baseline."""
    return rounded(backtest_pairs(spark, sf), "forecast", "baseline")


def _sc(c):
    return f"avg(abs({c} - actual) / actual * 100)"


@query(f"""WITH {BACKTEST} SELECT level, horizon, round({_sc('forecast')}, 6) AS mape, round(avg((forecast - actual) / actual * 100), 6) AS bias, round(avg(abs(forecast - actual)), 6) AS mae, count(*) AS n,
  round(median(abs(forecast - actual) / actual * 100), 6) AS medape, round({_sc('baseline')}, 6) AS baseline_mape,
  round(CASE WHEN {_sc('forecast')} > 0 AND {_sc('baseline')} > 0 THEN (1 - {_sc('forecast')} / {_sc('baseline')}) * 100 END, 4) AS skill FROM pr GROUP BY level, horizon""")
def backtest_scores_and_skill(spark, sf):
    """Error, bias, median error and skill over the baseline per level and horizon."""
    d = J.backtest_summary(backtest_pairs(spark, sf))
    return rounded(rounded(d, "mape", "bias", "mae", "medape", "baseline_mape"), "skill", digits=4)


@query(f"""WITH {BACKTEST}, l AS (SELECT * FROM pr WHERE horizon > 0),
g AS (SELECT code, round({_sc('forecast')}, 6) AS mape, round(avg((forecast - actual) / actual * 100), 6) AS bias, round(avg(abs(forecast - actual)), 6) AS mae, count(*) AS n, round(median(abs(forecast - actual) / actual * 100), 6) AS medape FROM l GROUP BY code),
w AS (SELECT code, round({_sc('forecast')}, 6) AS mape_line, count(*) FILTER (WHERE forecast > actual) AS over_line, count(*) AS n_line FROM l WHERE horizon = 3 GROUP BY code)
SELECT g.*, mape_line, coalesce(over_line, 0) AS over_line, coalesce(n_line, 0) AS n_line, coalesce(n_line, 0) >= 3 AS eligible FROM g LEFT JOIN w USING (code)""")
def backtest_per_area(spark, sf):
    """Per-area scores, over-forecast count and the eligibility of the shown line."""
    return rounded(J.backtest_areas(backtest_pairs(spark, sf), 3), "mape", "bias", "mae", "medape", "mape_line")


CUST = """
cs AS (SELECT c_custkey AS id, CAST(round(c_acctbal) AS BIGINT) AS balance, coalesce(n, 0) AS orders_n, coalesce(cents, 0) AS cents FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL) ON o_custkey = c_custkey)"""


@query(f"""WITH {CUST}, r AS (SELECT avg(i) OVER (PARTITION BY balance) AS b, avg(j) OVER (PARTITION BY orders_n) AS o, avg(k) OVER (PARTITION BY cents) AS c FROM
  (SELECT *, row_number() OVER (ORDER BY balance) AS i, row_number() OVER (ORDER BY orders_n) AS j, row_number() OVER (ORDER BY cents) AS k FROM cs))
SELECT 'balance~orders_n' AS pair, round(corr(b, o), 6) AS rho, count(*) AS n FROM r UNION ALL SELECT 'orders_n~cents', round(corr(o, c), 6), count(*) FROM r""")
def spearman_with_ties(spark, sf):
    """Rank correlation with tie-averaged ranks over all customers."""
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round("c_acctbal").cast("long").alias("balance"))
    o = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders_n"), F.sum(T.cents("o_totalprice")).alias("cents"))
    zero = F.lit(0).cast("long")
    d = c.join(o, "id", "left").withColumns({"orders_n": F.coalesce("orders_n", zero), "cents": F.coalesce("cents", zero)})
    return rounded(J.spearman(d, [("balance", "orders_n"), ("orders_n", "cents")]), "rho")


HOUSE = f"""{T.ORDER_CUBE}, {T.POPULATION_CUBE}, hn AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, year(o_orderdate) AS y, count(*) AS p, count(DISTINCT o_custkey) AS h FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
hs AS (SELECT code, y, p / h + 1 AS value FROM hn WHERE y BETWEEN 1995 AND 2000),
tr AS (SELECT code, min_by(value, y) AS f, max_by(value, y) AS base, (max_by(value, y) - min_by(value, y)) / 5 AS step FROM hs GROUP BY code HAVING count(*) = 6),
tt AS (SELECT code, base, step, base + step * 5 AS raw, greatest(least(greatest(base + step * 5, base * (1 - 0.05::DOUBLE)), base * (1 + 0.05::DOUBLE)), 1.6::DOUBLE) AS projected FROM tr)"""


def household_series(spark, sf):
    per = T.customer_totals(spark, sf, {"year": F.year("o_orderdate")}, {"k": F.count(F.lit(1))})
    o = per.groupBy(T.nation_code().alias("code"), "year").agg(F.sum("k").alias("p"), F.count(F.lit(1)).alias("h"))
    return o.filter(F.col("year").between(1995, 2000)).select("code", "year", (F.col("p") / F.col("h") + 1).alias("value"))


@query(f"WITH {HOUSE} SELECT code, round(base, 6) AS base, round(step, 6) AS step, round(projected, 6) AS projected, abs(projected - raw) > 1e-12 AS capped FROM tt")
def household_size_trend(spark, sf):
    """Trend household size with cap and floor."""
    return rounded(J.household_trend(household_series(spark, sf)), "base", "step", "projected")


GAP = f"""{HOUSE}, {STOCK}, pj AS (SELECT code, CAST(sum(p) FILTER (WHERE y = 2000) AS DOUBLE) AS p0, sum(p) FILTER (WHERE y = 2000) * 1.02::DOUBLE + 3 AS p1 FROM hn GROUP BY code),
su AS (SELECT code, (sum(value) FILTER (WHERE y = 2000) - sum(value) FILTER (WHERE y = 1995)) / 100 AS net, sum(value) FILTER (WHERE y = 2000) / 200 AS gross FROM st GROUP BY code),
gp AS (SELECT code, p1 / projected - p0 / base AS demand, (p1 - p0) / base AS demand_const, net, gross, p0, abs(projected - raw) > 1e-12 AS capped FROM tt JOIN pj USING (code) JOIN su USING (code)),
nt AS (SELECT (sum(demand) - sum(net)) / sum(p0) * 1000 AS r FROM gp)"""


@query(f"""WITH {GAP} SELECT code, round(demand, 6) AS demand, round(demand_const, 6) AS demand_const, net, gross, round(demand - net, 6) AS gap, round(demand_const - gross, 6) AS gap_const_gross,
  round((demand - net) / p0 * 1000, 6) AS gap_per_1000, round((demand - net) / p0 * 1000 - (SELECT r FROM nt), 6) AS gap_per_1000_rel, capped FROM gp""")
def housing_gap(spark, sf):
    """Households needed against dwellings added, relative to the nation."""
    trend = J.household_trend(household_series(spark, sf)).persist()
    per = T.customer_totals(spark, sf, {"year": F.year("o_orderdate")}, {"k": F.count(F.lit(1))})
    p = per.filter("year = 2000").groupBy(T.nation_code().alias("code")).agg(F.sum("k").cast("double").alias("p0"))
    p = p.withColumn("p1", F.col("p0") * 1.02 + 3)
    at = lambda y: F.sum(F.when(F.col("year") == y, F.col("value")))
    s = stock(spark, sf).groupBy("code").agg(((at("2000") - at("1995")) / 100).alias("net"), (at("2000") / 200).alias("gross"))
    d = J.housing_gap(trend, p, s)
    return rounded(d, "demand", "demand_const", "gap", "gap_const_gross", "gap_per_1000", "gap_per_1000_rel")


@query(f"""WITH {T.ORDER_CUBE}, p4 AS (SELECT DISTINCT q FROM oc ORDER BY q DESC LIMIT 4),
s AS (SELECT area, coalesce(sum(value) FILTER (WHERE prio = '1-URGENT'), 0) AS permits, coalesce(sum(value) FILTER (WHERE prio = '5-LOW'), 0) AS starts FROM oc WHERE q IN (SELECT q FROM p4) AND prio IN ('1-URGENT', '5-LOW') GROUP BY area)
SELECT area, permits, starts, permits - starts AS pipeline FROM s""")
def permit_pipeline(spark, sf):
    """Permits minus starts over the last four published quarters."""
    cells = T.order_cube(spark, sf).cells().withColumnRenamed("prio", "phase")
    return J.pipeline(cells, "1-URGENT", "5-LOW")


@query(f"""WITH {T.ORDER_CUBE}, y4 AS (SELECT y FROM (SELECT DISTINCT y, q FROM oc) GROUP BY y HAVING count(*) = 4 ORDER BY y DESC LIMIT 5)
SELECT area, round(sum(value) / 5, 6) AS value FROM oc WHERE y IN (SELECT y FROM y4) GROUP BY area""")
def mean_of_complete_years(spark, sf):
    """Years with all four quarters, the mean of the last five."""
    return rounded(J.complete_year_mean(T.order_cube(spark, sf).cells(), 5))


@query(f"""WITH {PEOPLE}, o AS (SELECT code, year, total AS value FROM fo WHERE year <= '1999'), p AS (SELECT code, year, total + 1 AS value FROM fo WHERE year >= '1997')
SELECT code, year, value, 'observed' AS kind FROM o UNION ALL SELECT code, year, value, 'projected' FROM p WHERE year >= (SELECT max(year) FROM o)""")
def observed_then_projected(spark, sf):
    """Two series with a kind, meeting at the last observed year."""
    f = folded(spark, sf)
    o = f.filter("year <= '1999'").select("code", "year", F.col("total").alias("value"))
    p = f.filter("year >= '1997'").select("code", "year", (F.col("total") + 1).alias("value"))
    return J.observed_and_projected(o, p)


@query(f"""WITH {PEOPLE} SELECT code, total + CAST(code AS BIGINT) % 3 AS projected, total AS observed, CAST(code AS BIGINT) % 3 AS gap FROM fo WHERE year = '1999'""")
def join_year_continuity(spark, sf):
    """Q8: the gap between the two series in the year they share."""
    f = folded(spark, sf)
    o = f.select("code", "year", F.col("total").alias("value"))
    p = f.select("code", "year", (F.col("total") + F.col("code").cast("long") % 3).alias("value"))
    return Q.join_gap(p, o, ["code"], "1999")


@query(f"""WITH {PEOPLE}, a AS (SELECT year, CAST(sum(total) AS BIGINT) AS v FROM fo GROUP BY year), b AS (SELECT year, CAST(sum(total) FILTER (WHERE code <> '4') AS BIGINT) AS v FROM fo GROUP BY year)
SELECT year, a.v AS first_run, b.v AS second_run, b.v - a.v AS difference, round((b.v - a.v) / a.v * 100, 6) AS difference_pct FROM a JOIN b USING (year)""")
def two_runs_side_by_side(spark, sf):
    """Q12: two runs of a figure stated beside each other, never mixed."""
    f = folded(spark, sf)
    a = f.groupBy("year").agg(F.sum("total").alias("value"))
    b = f.filter("code <> '4'").groupBy("year").agg(F.sum("total").alias("value"))
    return rounded(J.run_difference(a, b), "difference_pct")


@query("""WITH c AS (SELECT DISTINCT 'FRKM1' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS id FROM orders UNION SELECT DISTINCT 'KKFR' || CAST(year(o_orderdate) AS VARCHAR) FROM orders UNION SELECT 'KKFRBEV'),
y AS (SELECT id, CASE WHEN CAST(substr(id, 6) AS INT) < 70 THEN 2000 ELSE 1900 END + CAST(substr(id, 6) AS INT) AS year FROM c WHERE id LIKE 'FRKM1%' UNION ALL SELECT id, CAST(substr(id, 5) AS INT) FROM c WHERE regexp_matches(id, '^KKFR[0-9]{4}$'))
SELECT 'FRKM1' AS family, max_by(id, year) AS "table", CAST(max(year) AS INTEGER) AS year FROM y WHERE id LIKE 'FRKM1%' UNION ALL SELECT 'KKFR', max_by(id, year), CAST(max(year) AS INTEGER) FROM y WHERE id LIKE 'KKFR%'""")
def newest_table_vintage(spark, sf):
    """SC16: newest table of a family, with two- or four-digit years in the id."""
    o = T.table(spark, sf, "orders")
    two = o.select(F.concat(F.lit("FRKM1"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0")).alias("id"))
    four = o.select(F.explode(F.array(F.concat(F.lit("KKFR"), F.year("o_orderdate").cast("string")), F.lit("KKFRBEV"))).alias("id"))
    cat = two.unionByName(four).distinct()
    a = J.newest_vintage(cat, "FRKM1", 2).withColumn("family", F.lit("FRKM1"))
    return a.unionByName(J.newest_vintage(cat, "KKFR", 4).withColumn("family", F.lit("KKFR")))
