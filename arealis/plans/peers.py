"""Ranks, percentiles, classes, deltas and lists among peers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import ranking as R
from ..functions import text as X
from ..operators import peers as P
from . import tables as T
from .common import VALUES, indicator_values, joined, registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

def direction():
    return F.when(F.col("key") == "orders_n", "lower_better").otherwise("higher_better")


POS = """
pos AS (SELECT *, rank() OVER (PARTITION BY key, level, period ORDER BY value) - 1 AS less,
               count(*) OVER (PARTITION BY key, level, period, value) AS same,
               count(*) OVER (PARTITION BY key, level, period) AS total,
               row_number() OVER (PARTITION BY key, level, period ORDER BY value) - 1 AS i FROM iv)"""


@query(f"""WITH {VALUES}, {POS}
SELECT level, code, key, period, round(value, 6) AS value,
       CASE WHEN key = 'orders_n' THEN less + 1 ELSE total - less - same + 1 END AS peer_rank, total AS peers,
       CASE WHEN total >= 5 THEN round((CASE WHEN key = 'orders_n' THEN total - less - same ELSE less END + same / 2) / total * 100, 6) END AS percentile
FROM pos""")
def peer_rank_and_percentile(spark, sf):
    """Direction-aware rank and mid-rank percentile at three levels, customers included."""
    return rounded(P.ranked(indicator_values(spark, sf).drop("parent"), direction()), "value", "percentile")


def _nr(p):
    return f"max(CASE WHEN i = least(total - 1, CAST(floor({p} * total) AS BIGINT)) THEN value END)"


@query(f"""WITH {VALUES}, {POS},
q AS (SELECT key, level, period, min(value) AS lo, max(value) AS hi, max(total) AS n, {_nr(0.2)} AS a, {_nr(0.4)} AS b, {_nr(0.6)} AS c, {_nr(0.8)} AS d FROM pos GROUP BY ALL),
k AS (SELECT *, a < hi AS ka, b > a AND b < hi AS kb, c > b AND c < hi AS kc, d > c AND d < hi AS kd FROM q)
SELECT p.level, p.code, p.key, p.period, n AS peers,
  CAST(1 + ka::INT + kb::INT + kc::INT + kd::INT AS INTEGER) AS classes,
  CAST((ka AND value > a)::INT + (kb AND value > b)::INT + (kc AND value > c)::INT + (kd AND value > d)::INT AS INTEGER) AS cls
FROM pos p JOIN k ON p.key = k.key AND p.level = k.level AND p.period = k.period""")
def quintile_classes(spark, sf):
    """Floor-index quintile breaks, repeated breaks collapsed, and every value's class."""
    v = indicator_values(spark, sf).drop("parent")
    scale = P.quantile_classes(v)
    pool = ["key", "level", "period"]
    j = v.join(scale, pool)
    return j.select("level", "code", "key", "period", F.col("n").alias("peers"), "classes",
                    P.class_of(F.col("value"), F.col("breaks")).alias("cls"))


@query(f"""WITH {VALUES}, {POS},
q AS (SELECT key, level, period, max(value) AS hi FROM pos GROUP BY ALL)
SELECT p.level, p.code, p.key, p.period,
  CAST((2 < hi AND value > 2)::INT + (4 < hi AND value > 4)::INT + (50 < hi AND value > 50)::INT AS INTEGER) AS cls,
  round(CASE WHEN (2 < hi)::INT + (4 < hi)::INT + (50 < hi)::INT > 0
    THEN ((2 < hi AND value > 2)::INT + (4 < hi AND value > 4)::INT + (50 < hi AND value > 50)::INT) / ((2 < hi)::INT + (4 < hi)::INT + (50 < hi)::INT)
    ELSE 0.5 END, 6) AS shade
FROM pos p JOIN q ON p.key = q.key AND p.level = q.level AND p.period = q.period WHERE p.key = 'orders_n'""")
def fixed_break_classes(spark, sf):
    """Fixed breaks replace the quintiles where a scale has its own meaning."""
    v = indicator_values(spark, sf).drop("parent").filter(F.col("key") == "orders_n")
    out = P.with_classes(v, P.quantile_classes(v, fixed=[2.0, 4.0, 50.0]))
    return rounded(out.select("level", "code", "key", "period", "cls", "shade"), "shade")


_CENTER = 200000.0


def _dv(p):
    return f"max(CASE WHEN i = least(total - 1, CAST(floor({p} * total) AS BIGINT)) THEN dev END)"


@query(f"""WITH {VALUES}, d AS (
  SELECT key, level, period, abs(value - {_CENTER}) AS dev, row_number() OVER (PARTITION BY key, level, period ORDER BY abs(value - {_CENTER})) - 1 AS i,
         count(*) OVER (PARTITION BY key, level, period) AS total FROM iv WHERE abs(value - {_CENTER}) > 0),
m AS (SELECT key, level, period, {_dv(0.34)} AS a, {_dv(0.67)} AS b, {_dv(0.90)} AS c FROM d GROUP BY ALL),
r AS (SELECT key, level, period, min(value) AS lo, max(value) AS hi, count(value) AS n FROM iv GROUP BY ALL),
x AS (SELECT *, list_filter([a, CASE WHEN b > a THEN b END, CASE WHEN c > b THEN c END], lambda v: v IS NOT NULL) AS mags FROM m JOIN r USING (key, level, period)),
y AS (SELECT *, list_concat(list_transform(list_reverse(mags), lambda v: {_CENTER} - v), list_transform(mags, lambda v: {_CENTER} + v)) AS br FROM x),
z AS (SELECT *, len(list_filter(br, lambda v: lo > v)) AS f, len(list_filter(br, lambda v: hi > v)) AS l, len(list_filter(br, lambda v: {_CENTER} > v)) AS cc FROM y)
SELECT key, level, period, round(lo, 6) AS lo, round(hi, 6) AS hi, n, CAST(l - f + 1 AS INTEGER) AS classes, CAST(f AS INTEGER) AS first,
  CAST(len(br) AS INTEGER) AS span, CAST(CASE WHEN {_CENTER} BETWEEN lo AND hi THEN cc - f ELSE -1 END AS INTEGER) AS mid,
  round(list_sum(br[f + 1:l]), 4) AS break_sum FROM z""")
def diverging_classes(spark, sf):
    """Breaks mirrored around a centre, empty end classes cut."""
    v = indicator_values(spark, sf).drop("parent")
    d = P.diverging_classes(v, _CENTER)
    total = F.when(F.size("breaks") > 0, F.aggregate("breaks", F.lit(0.0), lambda s, x: s + x))
    return rounded(d.withColumn("break_sum", F.round(total, 4)).drop("breaks"), "lo", "hi")


@query(f"""WITH {VALUES}, g AS (SELECT level, code, key, period, CASE WHEN key = 'orders_n' AND period = '2001' THEN NULL ELSE value END AS value FROM iv WHERE level <> 'customer')
SELECT level, code, key, round(max_by(value, period), 6) AS latest, max(period) AS latest_year FROM g WHERE value IS NOT NULL GROUP BY ALL""")
def latest_value_per_measure(spark, sf):
    """Newest non-null value and year per measure; measures may end in different years."""
    v = indicator_values(spark, sf, ("nation", "region"))
    gap = (F.col("key") == "orders_n") & (F.col("period") == "2001")
    v = v.withColumn("value", F.when(~gap, F.col("value")))
    return rounded(P.latest_per_measure(v, ["level", "code"]), "latest")


@query(f"""WITH {VALUES}, y AS (SELECT DISTINCT key, level, period FROM iv),
ax AS (SELECT *, lag(period) OVER w AS prev, first_value(period) OVER w AS start FROM y WINDOW w AS (PARTITION BY key, level ORDER BY period)),
med AS (SELECT key, level, period, median(value) AS m FROM iv GROUP BY ALL)
SELECT a.level, a.code, a.key, a.period, round(a.value, 6) AS value,
  round(CASE WHEN p.value <> 0 THEN (a.value / p.value - 1) * 100 END, 6) AS yoy,
  round(CASE WHEN ax.start <> a.period AND s.value <> 0 THEN (a.value / s.value - 1) * 100 END, 6) AS since_first,
  round(CASE WHEN med.m <> 0 THEN (a.value / med.m - 1) * 100 END, 6) AS vs_median
FROM iv a JOIN ax ON ax.key = a.key AND ax.level = a.level AND ax.period = a.period
LEFT JOIN iv p ON p.key = a.key AND p.level = a.level AND p.code = a.code AND p.period = ax.prev
LEFT JOIN iv s ON s.key = a.key AND s.level = a.level AND s.code = a.code AND s.period = ax.start
LEFT JOIN med ON med.key = a.key AND med.level = a.level AND med.period = a.period""")
def deltas_previous_first_median(spark, sf):
    """Change on the previous published year, since the first, and against the median."""
    d = P.deltas(indicator_values(spark, sf).drop("parent"), F.lit(False))
    return rounded(d, "value", "yoy", "since_first", "vs_median")


@query(f"""WITH {VALUES} SELECT level, code, key, period, round(value, 6) AS value FROM iv
WHERE level = 'region' AND CAST(period AS INT) >= (SELECT max(CAST(period AS INT)) FROM iv) - 5""")
def last_five_years(spark, sf):
    """Each series cut to five years before its newest."""
    v = indicator_values(spark, sf, ("region",)).drop("parent")
    return rounded(P.last_years(v).select("level", "code", "key", "period", "value"))


@query(f"""WITH {VALUES}, s AS (
  SELECT 'area' AS kind, key, level || ':' || code AS name, period, value FROM iv WHERE level = 'nation' AND code IN ('3', '7')
  UNION ALL SELECT 'median', key, level, period, median(value) FROM iv WHERE level = 'nation' GROUP BY ALL
  UNION ALL SELECT 'national', key, 'all', period, sum(value) FROM iv WHERE level = 'region' AND key = 'orders_n' GROUP BY ALL)
SELECT kind, key, name, period, round(value, 6) AS value, round(lag(value) OVER (PARTITION BY kind, key, name ORDER BY period), 6) AS previous FROM s""")
def chart_series_with_references(spark, sf):
    """W18, A32, SK12: chosen areas, the median of their peers and the national line."""
    v = indicator_values(spark, sf, ("nation", "region"))
    chosen = v.filter((F.col("level") == "nation") & F.col("code").isin("3", "7")).select("level", "code").distinct()
    nat = v.filter((F.col("level") == "region") & (F.col("key") == "orders_n")).groupBy("key", "period").agg(F.sum("value").alias("value"))
    return rounded(P.chart_series(v.filter(F.col("level") == "nation"), chosen, nat), "value", "previous")


@query(f"""WITH {VALUES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY key, level, period ORDER BY value DESC, code DESC) AS t,
            row_number() OVER (PARTITION BY key, level, period ORDER BY value, code) AS b FROM iv)
SELECT level, code, key, period, 'top' AS side, CAST(t AS INTEGER) AS pos, round(value, 6) AS value FROM r WHERE t <= 10
UNION ALL SELECT level, code, key, period, 'bottom', CAST(b AS INTEGER), round(value, 6) FROM r WHERE b <= 10""")
def top_and_bottom_ten(spark, sf):
    """Both ends of every ranking."""
    v = indicator_values(spark, sf)
    return rounded(P.top_and_bottom(v, 10).select("level", "code", "key", "period", "side", "pos", "value"))


@query(f"""WITH {VALUES}, v AS (
  SELECT c.code, a.value AS own, n.value AS parent FROM (SELECT DISTINCT code, parent FROM iv WHERE level = 'customer') c
  LEFT JOIN iv a ON a.level = 'customer' AND a.code = c.code AND a.key = 'revenue' AND a.period = '2001' AND CAST(c.code AS BIGINT) % 3 <> 0
  LEFT JOIN iv n ON n.level = 'nation' AND n.code = c.parent AND n.key = 'revenue' AND n.period = '2001' AND CAST(c.code AS BIGINT) % 2 = 0)
SELECT code, round(coalesce(own, parent), 6) AS value, CAST(row_number() OVER (ORDER BY coalesce(own, parent) DESC NULLS LAST, code) AS INTEGER) AS pos
FROM v ORDER BY pos LIMIT 40""")
def best_first_with_inherited(spark, sf):
    """Best first, an inherited figure taking the own one's place, first forty."""
    v = indicator_values(spark, sf)
    at = v.filter((F.col("key") == "revenue") & (F.col("period") == "2001"))
    areas = v.filter(F.col("level") == "customer").select("code", "parent").distinct()
    own = at.filter(F.col("level") == "customer").select("code", F.col("value").alias("own")).filter(F.col("code").cast("long") % 3 != 0)
    par = at.filter(F.col("level") == "nation").select(F.col("code").alias("parent"), F.col("value").alias("up"))
    j = areas.join(own, "code", "left").join(par, "parent", "left")
    j = j.withColumn("up", F.when(F.col("code").cast("long") % 2 == 0, F.col("up")))
    best = R.top_n(j, [], [*P.best_first("higher_better", F.col("own"), F.col("up")), F.col("code").asc()], 40)
    return rounded(best.select("code", F.coalesce("own", "up").alias("value"), "pos"))


AREAS = """
ar AS (SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, r_name AS region, count(c_custkey) AS population
       FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)"""


def areas(spark, sf):
    n, r = T.table(spark, sf, "nation"), T.table(spark, sf, "region")
    pop = T.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("population"))
    return n.join(r, n.n_regionkey == r.r_regionkey).join(pop, n.n_nationkey == pop.c_nationkey, "left").select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("region"),
        F.coalesce("population", F.lit(0)).alias("population"),
    )


@query(f"WITH {AREAS} SELECT code, name, region, population FROM ar WHERE population >= 50 AND region = 'ASIA' AND (contains(lower(name), 'nation_1') OR contains(code, 'nation_1'))")
def filter_area_table(spark, sf):
    """search text, region and population floor."""
    return P.filter_areas(areas(spark, sf), "NATION_1", region="ASIA", min_population=50)


@query(f"""WITH {AREAS} SELECT code, name, population, CAST(row_number() OVER (ORDER BY population DESC, code) AS INTEGER) AS pos FROM ar""")
def areas_by_population(spark, sf):
    """Areas by population, largest first."""
    return R.top_n(areas(spark, sf), [], [F.col("population").desc(), F.col("code").asc()], 200).select("code", "name", "population", "pos")


@query("""WITH r AS (SELECT p_partkey, p_name, CASE WHEN p_name = 'red widget' THEN 0 WHEN starts_with(lower(p_name), 'red widget') THEN 1 WHEN contains(lower(p_name), 'red') THEN 2 END AS m
  FROM part), s AS (SELECT p_partkey, p_name, CAST(CASE WHEN lower(p_name) = 'red' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1 WHEN contains(lower(p_name), 'red') THEN 2 END AS INTEGER) AS match FROM part)
SELECT p_partkey AS id, p_name AS name, match, CAST(row_number() OVER (ORDER BY match, p_name, p_partkey) AS INTEGER) AS pos FROM s WHERE match IS NOT NULL
ORDER BY pos LIMIT 25""")
def search_exact_prefix_contains(spark, sf):
    """exact before prefix before contained, first 25."""
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    hit = p.withColumn("match", X.match_rank("red", F.col("name"))).filter(F.col("match").isNotNull())
    return R.top_n(hit, [], [F.col("match"), F.col("name"), F.col("id")], 25)


@query("""SELECT p_partkey AS id FROM part
WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'small') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')""")
def search_all_words(spark, sf):
    """F16: every word of the query somewhere in name, brand or type."""
    p = T.table(spark, sf, "part")
    return p.filter(X.all_words("Small brand#1", F.col("p_name"), F.col("p_brand"), F.col("p_type"))).select(F.col("p_partkey").alias("id"))


@query(f"""WITH {VALUES}, f AS (SELECT a.code, b.value AS base, e.value AS fin, CAST(c.population AS BIGINT) AS population FROM ({'SELECT * FROM iv'}) a
  JOIN iv b ON b.level = a.level AND b.code = a.code AND b.key = a.key AND b.period = '1995'
  JOIN iv e ON e.level = a.level AND e.code = a.code AND e.key = a.key AND e.period = '2000'
  JOIN (SELECT c_nationkey, count(*) AS population FROM customer GROUP BY 1) c ON CAST(c.c_nationkey AS VARCHAR) = a.code
  WHERE a.level = 'nation' AND a.key = 'orders_n' AND a.period = '2000')
SELECT code, round(CASE WHEN population >= 300 THEN (fin / base - 1) * 100 END, 6) AS growth, base < 1000 AS small_base,
  abs(fin - base) > 15 AS disagree, round((fin - base) / base / 5 * 100, 6) AS rate_per_year, fin - base AS persons FROM f""")
def growth_guards_and_flags(spark, sf):
    """Growth suppressed on tiny bases, small-base and disagreement flags, yearly rate."""
    v = indicator_values(spark, sf, ("nation",)).filter(F.col("key") == "orders_n")
    wide = v.groupBy("code").agg(*[F.max(F.when(F.col("period") == y, F.col("value"))).alias(n) for n, y in (("base", "1995"), ("fin", "2000"))])
    j = wide.join(areas(spark, sf).select("code", "population"), "code").filter(F.col("base").isNotNull() & F.col("fin").isNotNull())
    b, e = F.col("base"), F.col("fin")
    return rounded(j.select(
        "code", K.guard_growth((e / b - 1) * 100, F.col("population")).alias("growth"), K.small_base(b).alias("small_base"),
        K.definitions_disagree(e, b).alias("disagree"), ((e - b) / b / 5 * 100).alias("rate_per_year"), (e - b).alias("persons"),
    ), "growth", "rate_per_year")


@query(f"""WITH {VALUES}, w AS (
  SELECT level, code, h AS horizon, max(CASE WHEN period = y THEN value END) AS value FROM iv, (VALUES ('h1', '1996'), ('h2', '1998'), ('h3', '2000')) AS t(h, y)
  WHERE key = 'revenue' AND level <> 'customer' GROUP BY ALL)
SELECT level, code, horizon, round(value, 6) AS value, round(min(value) OVER p, 6) AS lo, round(max(value) OVER p, 6) AS hi, round(median(value) OVER p, 6) AS median
FROM w WINDOW p AS (PARTITION BY level, horizon)""")
def horizon_range_and_median(spark, sf):
    """Range and median of the peers at every horizon."""
    v = indicator_values(spark, sf, ("nation", "region")).filter(F.col("key") == "revenue")
    wide = v.groupBy("level", "code").agg(*[F.max(F.when(F.col("period") == y, F.col("value"))).alias(h) for h, y in (("h1", "1996"), ("h2", "1998"), ("h3", "2000"))])
    return rounded(P.horizon_summary(wide, ["h1", "h2", "h3"]), "value", "lo", "hi", "median")


@query("""WITH ax AS (SELECT period, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS idx FROM
  (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) || 'K' || CAST(quarter(o_orderdate) AS VARCHAR) AS period FROM orders)),
b AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN CAST(1993 + n_nationkey AS VARCHAR) ELSE CAST(1993 + n_nationkey AS VARCHAR) || 'K3' END AS bk FROM nation)
SELECT bk AS "at", period, idx FROM b JOIN ax ON period = CASE WHEN contains(bk, 'K') THEN bk ELSE bk || 'K1' END""")
def series_break_markers(spark, sf):
    """Series breaks placed on the axis of quarters."""
    axis = T.table(spark, sf, "orders").select(T.year_quarter("o_orderdate").alias("period")).distinct()
    listed = axis.agg(F.array_sort(F.collect_set("period")).alias("ps")).select(F.posexplode("ps").alias("idx", "period"))
    n = F.col("n_nationkey")
    y = (n + 1993).cast("string")
    b = T.table(spark, sf, "nation").select(F.when(n % 2 == 0, y).otherwise(F.concat(y, F.lit("K3"))).alias("at"))
    return P.break_markers(b, listed)


@query("""SELECT coalesce(c.k, s.k) AS code, CASE WHEN c.k IS NOT NULL THEN 'customer' ELSE 'supplier' END AS origin, coalesce(c.n, s.n) AS n
FROM (SELECT CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS BIGINT) AS n FROM customer) c
FULL JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS k, CAST(s_nationkey AS BIGINT) AS n FROM supplier) s ON c.k = s.k""")
def union_first_list_wins(spark, sf):
    """Union by key, the finer list's entry kept where both have one."""
    c = T.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("code"), F.lit("customer").alias("origin"), F.col("c_nationkey").cast("long").alias("n"))
    s = T.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("code"), F.lit("supplier").alias("origin"), F.col("s_nationkey").cast("long").alias("n"))
    return P.priority_union([c, s], "code")


@query("""WITH h AS (SELECT c_nationkey AS n, (CASE WHEN c_acctbal < 1000 THEN 1 WHEN c_acctbal < 3000 THEN 2 WHEN c_acctbal < 6000 THEN 3 ELSE 4 END) AS b, count(*) AS cnt FROM customer GROUP BY ALL),
g AS (SELECT nation.n_nationkey AS n, n_regionkey AS r, b.b, coalesce(h.cnt, 0) AS cnt FROM nation, (VALUES (1), (2), (3), (4)) AS b(b) LEFT JOIN h ON h.n = n_nationkey AND h.b = b.b),
t AS (SELECT n, r, b, CASE WHEN sum(cnt) OVER (PARTITION BY n) > 0 THEN cnt / sum(cnt) OVER (PARTITION BY n) * 100 ELSE 0 END AS pct,
      CASE WHEN sum(cnt) OVER (PARTITION BY r) > 0 THEN sum(cnt) OVER (PARTITION BY r, b) / sum(cnt) OVER (PARTITION BY r) * 100 ELSE 0 END AS ref FROM g)
SELECT n, max(CASE WHEN b = 1 THEN round(pct, 6) END) AS p1, max(CASE WHEN b = 4 THEN round(pct, 6) END) AS p4,
  max(CASE WHEN b = 1 THEN round(ref, 6) END) AS r1, max(CASE WHEN b = 4 THEN round(ref, 6) END) AS r4 FROM t GROUP BY n""")
def histogram_percent_vs_parent(spark, sf):
    """Four-bin histograms as percentages beside the parent's."""
    c = T.table(spark, sf, "customer")
    b = K.step_class(F.col("c_acctbal"), [1000, 3000, 6000])
    hist = F.array(*[F.count_if(b == i) for i in range(4)]).alias("bal")
    per = c.groupBy("c_nationkey").agg(hist)
    n = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    zero = F.array(*[F.lit(0).cast("long")] * 4)
    own = n.join(per, n.n == per.c_nationkey, "left").select("n", "r", F.coalesce("bal", zero).alias("bal"))
    par = own.groupBy("r").agg(F.array(*[F.sum(F.col("bal")[i]) for i in range(4)]).alias("bal"))
    d = P.histogram_percentages(own, ["bal"], par, "r")
    return d.select("n", *[F.round(F.col(f"bal_{k}")[i], 6).alias(a) for a, k, i in (("p1", "pct", 0), ("p4", "pct", 3), ("r1", "ref", 0), ("r4", "ref", 3))])
