"""Queries over all indicators, levels and years, beside those that show one of each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import ranking as R
from ..operators import exports as E
from ..operators import peers as P
from . import exports as EX
from . import peers as PP
from . import tables as T
from .common import VALUES, indicator_values, registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

# customers and nations that publish no figures of their own for an indicator
GAPS = f"""{VALUES},
v AS (SELECT * FROM iv WHERE NOT (level = 'customer' AND ((key = 'revenue' AND CAST(code AS BIGINT) % 3 = 0) OR (key = 'orders_n' AND CAST(code AS BIGINT) % 4 = 0)))
  AND NOT (level = 'nation' AND key = 'orders_n' AND CAST(code AS BIGINT) % 5 = 0)),
own AS (SELECT DISTINCT level, code, key FROM v),
nw AS (SELECT level, code, key, max(period) AS period, max_by(value, period) AS value FROM v GROUP BY ALL),
ca AS (SELECT CAST(c_custkey AS VARCHAR) AS code, CAST(c_nationkey AS VARCHAR) AS up, CAST(n_regionkey AS VARCHAR) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey),
ks AS (SELECT DISTINCT key FROM v),
lacking AS (SELECT ca.*, ks.key FROM ca, ks WHERE (code, ks.key) NOT IN (SELECT (code, key) FROM own WHERE level = 'customer')),
got AS (SELECT l.code, l.key, coalesce(n.period, r.period) AS period, CASE WHEN n.code IS NOT NULL THEN n.value ELSE r.value END AS value, coalesce(n.code, r.code) AS inherited_from
  FROM lacking l LEFT JOIN nw n ON n.level = 'nation' AND n.code = l.up AND n.key = l.key LEFT JOIN nw r ON r.level = 'region' AND r.code = l.top AND r.key = l.key),
al AS (SELECT code, key, period, value, '' AS inherited_from FROM v WHERE level = 'customer' UNION ALL SELECT * FROM got WHERE inherited_from IS NOT NULL)"""


def with_gaps(spark, sf):
    n = F.col("code").cast("long")
    customer = (F.col("level") == "customer") & (((F.col("key") == "revenue") & (n % 3 == 0)) | ((F.col("key") == "orders_n") & (n % 4 == 0)))
    nation = (F.col("level") == "nation") & (F.col("key") == "orders_n") & (n % 5 == 0)
    return indicator_values(spark, sf).filter(~customer & ~nation)


def inherited(spark, sf):
    c, n = T.table(spark, sf, "customer"), T.table(spark, sf, "nation")
    areas = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.lit("customer").alias("level"), F.col("c_custkey").cast("string").alias("code"),
        F.col("c_nationkey").cast("string").alias("up"), F.col("n_regionkey").cast("string").alias("top"))
    return E.inherit(areas, with_gaps(spark, sf).drop("parent"), [("nation", "up"), ("region", "top")])


@query(f"WITH {GAPS} SELECT code, key, period, round(value, 4) AS value, inherited_from FROM al")
def inherited_values_all(spark, sf):
    """Own figures of every customer, indicator and year, else the newest of the nation, else of the region."""
    return rounded(inherited(spark, sf).drop("level"), digits=4)


@query(f"""WITH {GAPS}, n AS (SELECT code, key, max_by(value, period) AS value, max(inherited_from) AS inherited_from FROM al GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value DESC, CAST(code AS BIGINT)) AS pos FROM n)
SELECT key, code, round(value, 4) AS value, inherited_from, CAST(pos AS INTEGER) AS pos FROM r WHERE pos <= 40""")
def best_first_with_inherited_by_indicator(spark, sf):
    """Forty best areas of every indicator by newest figure, inherited figures ranking with own ones."""
    newest = inherited(spark, sf).groupBy("code", "key").agg(
        F.max_by("value", "period").alias("value"), F.max("inherited_from").alias("inherited_from"))
    order = [*P.best_first("higher_better", F.col("value")), F.col("code").cast("long").asc()]
    return rounded(R.top_n(newest, ["key"], order, 40), digits=4)


@query(f"""WITH {VALUES}, ent AS (SELECT DISTINCT level, code, key FROM iv WHERE level <> 'customer'), h AS (SELECT DISTINCT period AS horizon FROM iv),
w AS (SELECT ent.*, horizon, value FROM ent CROSS JOIN h LEFT JOIN iv ON iv.level = ent.level AND iv.code = ent.code AND iv.key = ent.key AND iv.period = horizon)
SELECT level || '/' || key AS pool, code, horizon, round(value, 6) AS value, round(min(value) OVER p, 6) AS lo, round(max(value) OVER p, 6) AS hi, round(median(value) OVER p, 6) AS median
FROM w WINDOW p AS (PARTITION BY level, key, horizon)""")
def horizon_range_and_median_all(spark, sf):
    """Range and median of the peers in every year, for every level and indicator."""
    v = indicator_values(spark, sf, ("nation", "region"))
    # columns of the wide form: one per year that has orders
    years = sorted(r.y for r in T.table(spark, sf, "orders").select(F.year("o_orderdate").cast("string").alias("y")).distinct().collect() if r.y)
    pool = F.concat_ws("/", "level", "key").alias("pool")
    wide = v.groupBy(pool, "code").pivot("period", years).agg(F.max("value"))
    return rounded(P.horizon_summary(wide, years, ("pool", "code")), "value", "lo", "hi", "median")


@query(f"""WITH {VALUES}, {PP.AREAS}, s AS (SELECT code, key, period, value AS fin, lag(value) OVER w AS base, lag(period) OVER w AS since FROM iv WHERE level = 'nation' WINDOW w AS (PARTITION BY code, key ORDER BY period))
SELECT s.code, key, period, round(CASE WHEN population >= 300 THEN (fin / base - 1) * 100 END, 6) AS growth, base < 1000 AS small_base, abs(fin - base) > 15 AS disagree,
  round((fin - base) / base / (CAST(period AS INT) - CAST(since AS INT)) * 100, 6) AS rate_per_year, round(fin - base, 4) AS change
FROM s JOIN ar ON ar.code = s.code WHERE base IS NOT NULL""")
def growth_guards_all_years(spark, sf):
    """Guards, flags and yearly rate of the growth between neighbouring years, for every indicator."""
    w = Window.partitionBy("code", "key").orderBy("period")  # years of one figure
    v = indicator_values(spark, sf, ("nation",)).select("code", "key", "period", F.col("value").alias("fin"))
    v = v.withColumns({"base": F.lag("fin").over(w), "since": F.lag("period").over(w)}).filter("base is not null")
    j = v.join(PP.areas(spark, sf).select("code", "population"), "code")
    b, e, years = F.col("base"), F.col("fin"), F.col("period").cast("int") - F.col("since").cast("int")
    return rounded(j.select(
        "code", "key", "period", K.guard_growth((e / b - 1) * 100, F.col("population")).alias("growth"), K.small_base(b).alias("small_base"),
        K.definitions_disagree(e, b).alias("disagree"), ((e - b) / b / years * 100).alias("rate_per_year"), F.round(e - b, 4).alias("change"),
    ), "growth", "rate_per_year")


@query(f"""WITH {VALUES}, {EX.INDICATORS}, s AS (SELECT key, period, sum(value) AS value FROM iv WHERE level = 'region' GROUP BY ALL)
SELECT 'denmark' AS level, key AS indicator, CASE key WHEN 'revenue' THEN 'Revenue' ELSE 'Orders' END AS label, CASE key WHEN 'revenue' THEN 'DKK' ELSE '' END AS unit, period,
 CASE WHEN regexp_matches(period, '^[0-9]{{4}}$') THEN 'year' END AS period_type, round(value, 4) AS value, 'DST TAB7 monthly' AS source, 'TAB7' AS table_id,
 (SELECT coalesce(nullif(url, ''), 'https://api.statbank.dk/v1/tableinfo/TAB7') FROM cat WHERE key = 'dst/TAB7') AS source_url, period AS as_of FROM s""")
def national_series_export_all(spark, sf):
    """SK8: national series of every indicator in the export's columns."""
    v = indicator_values(spark, sf, ("region",)).groupBy("key", "period").agg(F.sum("value").alias("value"))
    revenue = F.col("key") == "revenue"
    meta = v.select("key").distinct().select(
        "key", F.when(revenue, "Revenue").otherwise("Orders").alias("label"), F.when(revenue, "DKK").otherwise("").alias("unit"), F.lit("DST TAB7 monthly").alias("src"))
    cat = EX.catalogue(spark, sf).withColumn("url", F.nullif("url", F.lit("")))
    rows = E.national_rows(v, meta, cat, EX.BUILT)
    return rounded(rows.select("level", "indicator", "label", "unit", "period", "period_type", "value", "source", "table_id", "source_url", "as_of"), digits=4)
