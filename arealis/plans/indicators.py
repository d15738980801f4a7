"""Indicator calculations on the order, population, stock and price cubes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import parsing as P
from ..functions import ranking as R
from ..model import IndicatorSpec
from ..operators import calcs as C
from . import tables as T
from .common import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}


query = registrar(QUERIES, ORACLES)
r6 = rounded

HIGH = ["1-URGENT", "2-HIGH"]
HIGH_SQL = "('1-URGENT', '2-HIGH')"
URGENT = {"prio": HIGH}
LATEST = "(SELECT max(q) FROM oc)"


@query(f"WITH {T.ORDER_CUBE} SELECT area, period, sum(value) AS value FROM oc WHERE value IS NOT NULL GROUP BY ALL")
def calc_sum_by_area(spark, sf):
    """A1: sum over every other dimension per area and period, suppressed cells skipped."""
    return C.sum_by_area(T.order_cube(spark, sf).cells(), "area", "period")


@query(f"""WITH {T.ORDER_CUBE} SELECT area, period, sum(value) AS value FROM oc
WHERE prio IN {HIGH_SQL} AND value IS NOT NULL AND q = {LATEST} GROUP BY ALL""")
def calc_passthrough(spark, sf):
    """A2, F1, F2: newest period, selected codes summed."""
    return C.live({"num": T.order_cube(spark, sf)}, IndicatorSpec("o", "passthrough", select=URGENT))


@query(f"""WITH {T.ORDER_CUBE}, s AS (
  SELECT area, sum(CASE WHEN prio IN {HIGH_SQL} THEN value END) AS n, sum(value) AS d, period FROM oc WHERE q = {LATEST} GROUP BY ALL)
SELECT area, period, round(n / d * 100, 6) AS value FROM s WHERE n IS NOT NULL AND d <> 0""")
def calc_share_of_total(spark, sf):
    """Share of the numerator codes in all, newest period."""
    spec = IndicatorSpec("s", "share_of_total", share={"var": "prio", "num": HIGH})
    return r6(C.live({"num": T.order_cube(spark, sf)}, spec))


@query(f"""WITH {T.ORDER_CUBE}, s AS (
  SELECT area, period, y, sum(CASE WHEN prio = '1-URGENT' THEN value END) AS n,
         sum(CASE WHEN prio IN ('1-URGENT', '5-LOW') THEN value END) AS d
  FROM oc WHERE k = (SELECT k FROM oc WHERE q = {LATEST} LIMIT 1) GROUP BY ALL)
SELECT area, CAST(y AS VARCHAR) AS year, period, round(n / d * 100, 6) AS value FROM s WHERE n IS NOT NULL AND d <> 0""")
def calc_share_history(spark, sf):
    """The share at the same sub-period of every year, filed under that year."""
    spec = IndicatorSpec("s", "share_of_total", share={"var": "prio", "num": ["1-URGENT"], "den": ["1-URGENT", "5-LOW"]})
    return r6(C.history({"num": T.order_cube(spark, sf)}, spec))


@query(f"""WITH {T.ORDER_CUBE}, s AS (SELECT area, q, period, value FROM oc WHERE prio = '3-MEDIUM' AND value <> 0)
SELECT a.area, b.period || '→' || a.period AS period, round((a.value / b.value - 1) * 100, 6) AS value
FROM s a JOIN s b ON a.area = b.area AND a.q = b.q + 4
WHERE a.q = (SELECT max(q) FROM oc WHERE prio = '3-MEDIUM')""")
def calc_yoy_pct(spark, sf):
    """Newest period against the same sub-period a year before."""
    return r6(C.live({"num": T.order_cube(spark, sf)}, IndicatorSpec("y", "yoy_pct", select={"prio": "3-MEDIUM"})))


_LAST4 = "p4 AS (SELECT DISTINCT q, period FROM oc ORDER BY q DESC LIMIT 4), lab AS (SELECT min_by(period, q) || '–' || max_by(period, q) AS label FROM p4)"


@query(f"""WITH {T.ORDER_CUBE}, {_LAST4}
SELECT area, (SELECT label FROM lab) AS period, round(avg(value), 6) AS value
FROM oc WHERE q IN (SELECT q FROM p4) AND value <> 0 GROUP BY area""")
def calc_last4q_mean(spark, sf):
    """Mean of the non-zero cells of the last four published periods."""
    return r6(C.live({"num": T.order_cube(spark, sf)}, IndicatorSpec("m", "last4q_mean")))


@query(f"""WITH {T.ORDER_CUBE}, {_LAST4}
SELECT area, (SELECT label FROM lab) AS period, sum(value) AS value
FROM oc WHERE q IN (SELECT q FROM p4) AND value IS NOT NULL GROUP BY area""")
def calc_sum4q(spark, sf):
    """Sum of the last four published periods."""
    return C.live({"num": T.order_cube(spark, sf)}, IndicatorSpec("m", "sum4q"))


@query(f"""WITH {T.ORDER_CUBE}, {T.STOCK_CUBE}, {_LAST4},
n AS (SELECT area, sum(value) AS v FROM oc WHERE q IN (SELECT q FROM p4) AND value IS NOT NULL GROUP BY area),
d AS (SELECT area, sum(value) AS d FROM sc WHERE y = (SELECT max(y) FROM oc) GROUP BY area)
SELECT area, (SELECT label FROM lab) AS period, round(v / d * 1000, 6) AS value FROM n JOIN d USING (area) WHERE d <> 0""")
def calc_sum4q_per_1000(spark, sf):
    """The four-period sum per 1,000 of the stock."""
    cubes = {"num": T.order_cube(spark, sf), "den": T.stock_cube(spark, sf)}
    return r6(C.live(cubes, IndicatorSpec("m", "sum4q_per_1000")))


@query(f"""WITH {T.ORDER_CUBE}, w AS (SELECT DISTINCT y, q, period FROM oc WHERE k <= (SELECT k FROM oc WHERE q = {LATEST} LIMIT 1)),
ends AS (SELECT y, max(q) AS e FROM w GROUP BY y),
win AS (SELECT ends.y, e, o.q, o.period FROM ends JOIN (SELECT DISTINCT q, period FROM oc) o ON o.q BETWEEN e - 3 AND e),
lab AS (SELECT y, min_by(period, q) || '–' || max_by(period, q) AS label FROM win GROUP BY y)
SELECT area, CAST(win.y AS VARCHAR) AS year, label AS period, sum(value) AS value
FROM oc JOIN win USING (q) JOIN lab ON lab.y = win.y WHERE value IS NOT NULL GROUP BY area, win.y, label""")
def calc_sum4q_history(spark, sf):
    """Trailing four-period sums by year, cut at each year's newest sub-period."""
    return C.history({"num": T.order_cube(spark, sf)}, IndicatorSpec("m", "sum4q"))


@query(f"""WITH {T.PRICE_CUBE}, p4 AS (SELECT DISTINCT q, period FROM pr ORDER BY q DESC LIMIT 4),
c AS (SELECT area, q, max(CASE WHEN price = 'UDBUD' THEN value END) AS a, max(CASE WHEN price = 'REAL' THEN value END) AS r
      FROM pr WHERE value <> 0 AND q IN (SELECT q FROM p4) GROUP BY ALL)
SELECT area, (SELECT min_by(period, q) || '–' || max_by(period, q) FROM p4) AS period, round(avg((a - r) / a * 100), 6) AS value
FROM c WHERE a IS NOT NULL AND r IS NOT NULL GROUP BY area""")
def calc_discount_pct(spark, sf):
    """A5: asking against realised price, paired per area and period."""
    spec = IndicatorSpec("d", "discount_pct", share={"var": "price", "ask": "UDBUD", "real": "REAL"})
    return r6(C.live({"num": T.price_cube(spark, sf)}, spec))


@query(f"""WITH {T.ORDER_CUBE}, {T.POPULATION_CUBE},
n AS (SELECT area, period, y, sum(value) AS v FROM oc WHERE prio IN {HIGH_SQL} AND value IS NOT NULL AND q = {LATEST} GROUP BY ALL),
d AS (SELECT area, y, max_by(value, q) AS d FROM pc GROUP BY ALL)
SELECT area, period, round(v / d * 100, 6) AS value FROM n JOIN d USING (area, y) WHERE d <> 0""")
def calc_ratio_pct(spark, sf):
    """One cube over another, both at their newest period."""
    cubes = {"num": T.order_cube(spark, sf), "den": T.population_cube(spark, sf)}
    return r6(C.live(cubes, IndicatorSpec("r", "ratio_pct", select=URGENT)))


@query(f"""WITH {T.ORDER_CUBE}, {T.STOCK_CUBE},
n AS (SELECT area, period, y, sum(value) AS v FROM oc WHERE value IS NOT NULL AND q = {LATEST} GROUP BY ALL),
d AS (SELECT area, y, sum(value) AS d FROM sc GROUP BY ALL)
SELECT area, period, round(v / d * 1000, 6) AS value FROM n JOIN d USING (area, y) WHERE d <> 0""")
def calc_per_1000_dwellings(spark, sf):
    """Newest count per 1,000 of the stock."""
    cubes = {"num": T.order_cube(spark, sf), "den": T.stock_cube(spark, sf)}
    return r6(C.live(cubes, IndicatorSpec("r", "per_1000_dwellings")))


@query(f"""WITH {T.ORDER_CUBE}, {T.POPULATION_CUBE},
n AS (SELECT area, period, y, q, sum(value) AS v FROM oc WHERE prio IN {HIGH_SQL} AND value IS NOT NULL AND k = (SELECT k FROM oc WHERE q = {LATEST} LIMIT 1) GROUP BY ALL)
SELECT n.area, CAST(n.y AS VARCHAR) AS year, n.period, round(v / d.value * 100, 6) AS value FROM n JOIN pc d ON d.area = n.area AND d.q = n.q WHERE d.value <> 0""")
def calc_ratio_history(spark, sf):
    """The ratio of every year over the denominator's newest like period up to that year."""
    cubes = {"num": T.order_cube(spark, sf), "den": T.population_cube(spark, sf)}
    return r6(C.history(cubes, IndicatorSpec("r", "ratio_pct", select=URGENT)))


@query(f"""WITH {T.STOCK_CUBE}, {T.POPULATION_CUBE}, n AS (SELECT area, period, y, sum(value) AS v FROM sc WHERE y <= 1999 GROUP BY ALL)
SELECT n.area, n.period, round(v / d.value * 100, 6) AS value FROM n JOIN pc d ON d.area = n.area AND d.period = '1999K3' WHERE n.y = 1999 AND d.value <> 0""")
def calc_ratio_own_year(spark, sf):
    """A yearly count over the population of that year although newer ones are published."""
    st = T.stock_cube(spark, sf)
    old = st.with_df(st.df.filter("period <= '1999'"))
    return r6(C.live({"num": old, "den": T.population_cube(spark, sf)}, IndicatorSpec("r", "ratio_own_year_pct")))


# --- rolling four quarters -----------------------------------------------------------

ROLLING = """
cell AS (SELECT area, q, sum(value) AS s, count(*) FILTER (WHERE value IS NULL) AS nn FROM oc GROUP BY ALL),
pub AS (SELECT DISTINCT q FROM oc),
ends AS (SELECT a.q FROM pub a JOIN pub b ON b.q BETWEEN a.q - 3 AND a.q GROUP BY a.q HAVING count(*) = 4),
roll AS (SELECT c.area, e.q, CASE WHEN count(*) = 4 AND sum(nn) = 0 THEN sum(s) END AS v
         FROM ends e JOIN cell c ON c.q BETWEEN e.q - 3 AND e.q GROUP BY ALL)"""


def qlabel(q: str) -> str:
    return f"CAST(({q}) // 4 AS VARCHAR) || 'K' || CAST(({q}) % 4 + 1 AS VARCHAR)"


WINDOW_LABEL = f"{qlabel('r.q - 3')} || '→' || {qlabel('r.q')}"

RATE_POP = f"""
dp AS (SELECT e.q, min(p.q) FILTER (WHERE p.q = e.q + 1) AS nxt, min(p.q) FILTER (WHERE p.q = e.q) AS own
       FROM ends e LEFT JOIN (SELECT DISTINCT q FROM pc) p ON p.q IN (e.q, e.q + 1) GROUP BY e.q),
rate AS (SELECT r.area, r.q, {WINDOW_LABEL} AS period,
                CASE WHEN pc.value <> 0 THEN r.v / pc.value * 1000 END AS value
         FROM roll r JOIN dp ON dp.q = r.q LEFT JOIN pc ON pc.area = r.area AND pc.q = coalesce(dp.nxt, dp.own)
         WHERE coalesce(dp.nxt, dp.own) IS NOT NULL)"""

SPEC_POP = IndicatorSpec("rate", "rolling4q_per_1000_pop", select={"prio": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, direction="lower_better")
SELECTED = T.ORDER_CUBE.replace("oc AS (", "oc0 AS (", 1) + ", oc AS (SELECT * FROM oc0 WHERE prio IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))"


@query(f"""WITH {SELECTED}, {ROLLING} SELECT r.area, {qlabel('r.q')} AS quarter, r.v AS value FROM roll r""")
def rolling4q_complete_or_null(spark, sf):
    """Four calendar quarters, null where a cell is suppressed or missing."""
    df = C.rolling_sums(C.selected(T.order_cube(spark, sf), SPEC_POP.select))
    return df.select("area", P.quarter_label("q").alias("quarter"), "value")


@query(f"""WITH {SELECTED}, {T.POPULATION_CUBE}, {ROLLING}, {RATE_POP}
SELECT area, period, round(value, 6) AS value FROM rate WHERE q = (SELECT max(q) FROM oc)""")
def rolling4q_per_1000_pop_live(spark, sf):
    """Newest rolling rate; population falls back to the window's last quarter."""
    return r6(C.live({"num": T.order_cube(spark, sf), "den": T.population_cube(spark, sf)}, SPEC_POP))


@query(f"""WITH {SELECTED}, {T.POPULATION_CUBE}, {ROLLING}, {RATE_POP}
SELECT area, {qlabel('q')} AS quarter, round(value, 6) AS value FROM rate WHERE q >= 1996 * 4""")
def rolling4q_quarterly_series(spark, sf):
    """The rolling rate at every window end from 1996K1 on."""
    cubes = {"num": T.order_cube(spark, sf), "den": T.population_cube(spark, sf)}
    return r6(C.quarterly_series(cubes, SPEC_POP, "1996K1"))


@query(f"""WITH {SELECTED}, {T.POPULATION_CUBE}, {ROLLING}, {RATE_POP}
SELECT area, CAST(q // 4 AS VARCHAR) AS year, period, round(value, 6) AS value FROM rate WHERE q % 4 = 3""")
def rolling4q_history(spark, sf):
    """Calendar years of the rolling rate."""
    cubes = {"num": T.order_cube(spark, sf), "den": T.population_cube(spark, sf)}
    return r6(C.history(cubes, SPEC_POP))


@query(f"""WITH {SELECTED}, {T.STOCK_CUBE}, {ROLLING}, sy AS (SELECT DISTINCT y FROM sc), st AS (SELECT area, y, sum(value) AS d FROM sc GROUP BY ALL),
dp AS (SELECT e.q, CASE WHEN (e.q // 4 + 1) IN (SELECT y FROM sy) THEN e.q // 4 + 1 WHEN e.q // 4 IN (SELECT y FROM sy) THEN e.q // 4 END AS y FROM ends e)
SELECT r.area, {WINDOW_LABEL} AS period, round(CASE WHEN st.d <> 0 THEN r.v / st.d * 1000 END, 6) AS value
FROM roll r JOIN dp ON dp.q = r.q LEFT JOIN st ON st.area = r.area AND st.y = dp.y WHERE dp.y IS NOT NULL""")
def rolling4q_per_1000_dwellings(spark, sf):
    """Rolling sum over the stock of the 1 January after the window, else its own year."""
    cubes = {"num": T.order_cube(spark, sf), "den": T.stock_cube(spark, sf)}
    return r6(C.series(cubes, IndicatorSpec("r", "rolling4q_per_1000_dwellings", select=SPEC_POP.select)))


@query(f"""WITH {SELECTED}, {ROLLING}
SELECT r.area, {WINDOW_LABEL} || ' vs 4Q before' AS period, round(CASE WHEN o.v <> 0 THEN (r.v / o.v - 1) * 100 END, 6) AS value
FROM roll r LEFT JOIN roll o ON o.area = r.area AND o.q = r.q - 4
WHERE r.q IN (SELECT q + 4 FROM ends)""")
def rolling4q_yoy_pct(spark, sf):
    """The rolling sum against the four quarters before."""
    return r6(C.series({"num": T.order_cube(spark, sf)}, IndicatorSpec("r", "rolling4q_yoy_pct", select=SPEC_POP.select)))


@query(f"""WITH {SELECTED}, {T.POPULATION_CUBE}, {ROLLING}, {RATE_POP},
v AS (SELECT area, period, value FROM rate WHERE value IS NOT NULL),
n AS (SELECT a.area, a.period, a.value, count(*) AS total, count(*) FILTER (WHERE b.value < a.value) AS less,
             count(*) FILTER (WHERE b.value = a.value) AS same, count(*) FILTER (WHERE b.value > a.value) AS more
      FROM v a JOIN v b ON a.period = b.period GROUP BY ALL)
SELECT area, period, round(value, 6) AS value, 1 + less AS peer_rank, total AS peers,
       CASE WHEN total >= 5 THEN round((more + same / 2) / total * 100, 6) END AS percentile FROM n""")
def peer_rank_percentile_rolling_rate(spark, sf):
    """Flagship: scan, select, rolling completeness, as-of denominator, rank and percentile."""
    cubes = {"num": T.order_cube(spark, sf), "den": T.population_cube(spark, sf)}
    s = C.series(cubes, SPEC_POP).filter(F.col("value").isNotNull()).persist()  # areas x periods, read per position step
    p = R.attach_positions(s, ["period"], "value")
    d = F.lit(SPEC_POP.direction)
    return p.select(
        "area", "period", F.round("value", 6).alias("value"), R.best_first_rank(d).alias("peer_rank"),
        F.col("n_total").alias("peers"), F.round(R.mid_rank_percentile(d), 6).alias("percentile"),
    )


# --- registry-driven builds ------------------------------------------------------------

REGISTRY = [
    IndicatorSpec("orders_n", "passthrough", level="nation"),
    IndicatorSpec("orders_k", "value_div_1000", level="nation", display_div=1000.0),
    IndicatorSpec("urgent_share", "share_of_total", level="nation", share={"var": "prio", "num": ["1-URGENT"]}),
    IndicatorSpec("orders_4q", "sum4q", level="nation"),
    IndicatorSpec("broken", "no_such_calc", level="nation"),
]


@query(f"""WITH {T.ORDER_CUBE}, {_LAST4},
cur AS (SELECT area, period, sum(value) AS v, sum(CASE WHEN prio = '1-URGENT' THEN value END) AS u FROM oc WHERE q = {LATEST} GROUP BY ALL)
SELECT 'orders_n' AS key, 'nation' AS level, area AS code, period, v AS value FROM cur WHERE v IS NOT NULL
UNION ALL SELECT 'orders_k', 'nation', area, period, round(v / 1000, 6) FROM cur WHERE v IS NOT NULL
UNION ALL SELECT 'urgent_share', 'nation', area, period, round(u / v * 100, 6) FROM cur WHERE u IS NOT NULL AND v <> 0
UNION ALL SELECT 'orders_4q', 'nation', area, (SELECT label FROM lab), sum(value) FROM oc WHERE q IN (SELECT q FROM p4) AND value IS NOT NULL GROUP BY area""")
def registry_compute_all(spark, sf):
    """All registry entries as one long table; a broken entry only warns."""
    cube = T.order_cube(spark, sf)
    out, _ = C.compute_registry({s.key: {"num": cube} for s in REGISTRY}, REGISTRY)
    return r6(out)


@query(f"""WITH {T.ORDER_CUBE} SELECT DISTINCT 'broken' AS key, area AS code, 'broken: unknown calculation no_such_calc' AS message FROM oc""")
def registry_warnings(spark, sf):
    """Q13: the entries that couldn't be computed, with the areas that go without."""
    cube = T.order_cube(spark, sf)
    _, warnings = C.compute_registry({s.key: {"num": cube} for s in REGISTRY}, REGISTRY)
    rows = [tuple(w.split(": ", 1)) for w in warnings]
    told = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(m).alias("message")) for k, m in rows]))
    return cube.cells().select("area").distinct().select("area", told.alias("w")).select(F.col("w.key").alias("key"), F.col("area").alias("code"), F.col("w.message").alias("message"))


@query(f"""WITH {T.ORDER_CUBE}, g AS (SELECT area, period, sum(value) AS v, sum(CASE WHEN prio IN {HIGH_SQL} THEN value END) AS h,
  sum(CASE WHEN prio = '1-URGENT' THEN value END) AS u FROM oc GROUP BY ALL)
SELECT area, period, 'all' AS key, v AS value FROM g WHERE v IS NOT NULL
UNION ALL SELECT area, period, 'high', h FROM g WHERE h IS NOT NULL
UNION ALL SELECT area, period, 'urgent_share', round(u / h * 100, 6) FROM g WHERE u IS NOT NULL AND h <> 0""")
def registry_single_pass(spark, sf):
    """Several indicators of one cube in a single scan and shuffle."""
    specs = [
        IndicatorSpec("all", "passthrough"), IndicatorSpec("high", "passthrough", select=URGENT),
        IndicatorSpec("urgent_share", "share_of_total", select=URGENT, share={"var": "prio", "num": ["1-URGENT"]}),
    ]
    return r6(C.many(T.order_cube(spark, sf), specs))


@query(f"""WITH {T.ORDER_CUBE}, s AS (SELECT period, q, sum(value) AS v FROM oc WHERE value IS NOT NULL GROUP BY ALL)
SELECT a.period, a.v AS value, round((a.v / b.v - 1) * 100, 6) AS yoy FROM s a LEFT JOIN s b ON b.q = a.q - 4""")
def national_series(spark, sf):
    """One series over all areas with its change on the year before."""
    return r6(C.national_series(T.order_cube(spark, sf)), "yoy")


@query(f"""WITH {T.STOCK_CUBE} SELECT area, period, value FROM sc WHERE flag = 'A'""")
def only_total_codes(spark, sf):
    """rows whose other dimensions carry total codes only (flag A plays the total here)."""
    return T.stock_cube(spark, sf).cells().filter(K.all_totals(["flag"], ["A"])).select("area", "period", "value")


@query(f"""WITH {T.POPULATION_CUBE}, p AS (SELECT DISTINCT period FROM pc WHERE period LIKE '%K1' ORDER BY period DESC LIMIT 4)
SELECT area, period, value FROM pc WHERE period IN (SELECT period FROM p)""")
def newest_january_periods(spark, sf):
    """the newest four 1-January counts a table has, read from its own periods."""
    df = T.population_cube(spark, sf).cells()
    jan = df.filter(F.endswith("period", F.lit("K1")))
    return jan.join(C.newest_periods(jan, 4), "period", "left_semi").select("area", "period", "value")


@query(f"""WITH {T.ORDER_CUBE}, {T.STOCK_CUBE} SELECT period FROM oc UNION SELECT period FROM sc""")
def union_of_periods(spark, sf):
    """U4: distinct union of the periods two cubes publish."""
    a, b = T.order_cube(spark, sf).cells(), T.stock_cube(spark, sf).cells()
    return a.select("period").union(b.select("period")).distinct()


@query(f"""WITH {T.ORDER_CUBE}, p AS (SELECT DISTINCT period, q, y, k FROM oc)
SELECT period, CAST(y AS INTEGER) AS year, 'K' AS kind, CAST(k AS INTEGER) AS sub, CAST(y * 100 + k * 3 AS INTEGER) AS sort_key,
  {qlabel('q + 1')} AS next_quarter, {qlabel('q - 4')} AS year_before,
  {qlabel('q - 3')} || '→' || period AS rolling_label, CAST(q // 4 AS INTEGER) AS filed_under FROM p""")
def period_arithmetic(spark, sf):
    """H4, H5: parts, order, shifts and labels of periods."""
    p = T.order_cube(spark, sf).cells().select("period").distinct()
    q = P.quarter_index("period")
    label = P.window_label(P.quarter_label(q - 3), F.col("period"))
    return p.select(
        "period", P.period_year("period").alias("year"), P.period_kind("period").alias("kind"),
        P.period_sub("period").alias("sub"), P.period_order("period").alias("sort_key"),
        P.shift_quarter("period", 1).alias("next_quarter"), P.shift_quarter("period", -4).alias("year_before"),
        label.alias("rolling_label"), P.label_year(label).alias("filed_under"),
    )
