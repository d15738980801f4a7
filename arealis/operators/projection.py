"""Projections: age folding, outlook measures, backtests, household gap and rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import parsing as P
from ..functions import ranking as R
from ..operators import calcs as C

GROUPS = [g for g, _lo, _hi in K.AGE_GROUPS]


def fold_ages(cells: DataFrame) -> DataFrame:
    """(code, year, total, a0_5 ...): single ages to groups; the published total stays apart.

    cells: code, year, age, persons.
    """
    g = K.age_group("age")
    return cells.withColumn("_g", g).groupBy("code", "year").agg(
        F.sum(F.when(F.col("_g").isNull(), F.col("persons"))).alias("total"),
        *[F.coalesce(F.sum(F.when(F.col("_g") == k, F.col("persons"))), F.lit(0).cast("long")).alias(k) for k in GROUPS],
    )


def worst_fold_gap(folded: DataFrame) -> DataFrame:
    """The area-year whose groups are furthest from the published total."""
    parts = sum((F.col(k) for k in GROUPS[1:]), F.col(GROUPS[0]))
    gap = F.abs(parts - F.col("total"))
    worst = F.max_by(F.struct("code", "year"), F.struct(gap, F.col("code"), F.col("year")))
    return folded.agg(F.max(gap).alias("gap"), worst.alias("w")).select("gap", F.col("w.code").alias("code"), F.col("w.year").alias("year"))


def national(folded: DataFrame) -> DataFrame:
    """The nation as the sum of its areas."""
    return folded.groupBy("year").agg(F.sum("total").alias("total"), *[F.sum(k).alias(k) for k in GROUPS])


def outlook(folded: DataFrame, first: str, mid: str, last: str, reference: DataFrame | None = None) -> DataFrame:
    """Ten outlook measures per area. ``reference`` (year, a20_34) is what the cohort change is
    measured against; the sum of the areas where none is given."""
    cols = ["total", "a0_5", "a6_16", "a20_34", "a80p"]
    at = lambda y, c: F.max(F.when(F.col("year") == y, F.col(c)))
    wide = folded.groupBy("code").agg(
        *[at(y, c).alias(f"{c}_{tag}") for c in cols for tag, y in (("0", first), ("m", mid), ("1", last))]
    )
    ref = reference if reference is not None else folded
    base = ref.agg(F.sum(F.when(F.col("year") == first, F.col("a20_34"))).alias("a"), F.sum(F.when(F.col("year") == last, F.col("a20_34"))).alias("b"))
    nation = base.select(F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.col("a") * 100)).scalar()

    def pct(c: str, tag: str = "1") -> Column:
        a, b = F.col(f"{c}_0"), F.col(f"{c}_{tag}")
        return F.when(a != 0, (b - a) / a * 100)

    years = int(mid) - int(first)
    t0 = F.col("total_0")
    return wide.select(
        "code", pct("total").alias("growth"), pct("total", "m").alias("growth_5y"),
        F.when(t0 != 0, (F.col("total_m") - t0) / years / t0 * 1000).alias("pop_rate_5y"),
        (F.col("total_1") - t0).alias("abs"), pct("a0_5").alias("c0_5"), pct("a6_16").alias("c6_16"),
        pct("a20_34").alias("c20_34"), (pct("a20_34") - nation).alias("c20_34_rel"),
        (F.col("a20_34_1") - F.col("a20_34_0")).alias("c20_34_abs"), pct("a80p").alias("c80p"),
    )


def stock_start_year(years: DataFrame, base: int, window: int = 5) -> DataFrame:
    """(start, span): newest published year at or before ``base - window`` and the real span."""
    y = F.col("year").cast("int")
    return years.agg(F.max(F.when(y <= base - window, y)).alias("start")).withColumn("span", F.lit(base) - F.col("start"))


def net_additions(stock: DataFrame, population: DataFrame, window: int = 5) -> DataFrame:
    """Yearly change in stock per 1,000 inhabitants between the newest year and the newest
    year at least ``window`` years before it, annualised over the years between them.

    stock: code, year, value; population: code, pop.
    """
    y = F.col("year").cast("int")
    base = stock.select(F.max(y)).scalar()
    start = stock.filter(y <= base - window).select(F.max(y)).scalar()
    both = stock.filter((y == base) | (y == start)).groupBy("code").agg(
        F.max_by("value", y).alias("stock_end"), F.min_by("value", y).alias("stock_start"),
        (F.max(y) - F.min(y)).alias("span_years"),
    )
    ok = both.filter(F.col("span_years") > 0).join(population, "code").filter(F.col("pop") > 0)
    per_year = (F.col("stock_end") - F.col("stock_start")) / F.col("span_years")
    return ok.select("code", "stock_start", "stock_end", "span_years", "pop", per_year.alias("per_year"), (per_year / F.col("pop") * 1000).alias("per_1000"))


def net_additions_national(areas: DataFrame) -> DataFrame:
    """The same figures for the sum of the areas."""
    s = areas.agg(*[F.sum(c).alias(c) for c in ("stock_start", "stock_end", "pop")], F.max("span_years").alias("span_years"))
    per_year = (F.col("stock_end") - F.col("stock_start")) / F.col("span_years")
    return s.select(F.lit("all").alias("code"), "stock_start", "stock_end", "span_years", "pop", per_year.alias("per_year"), (per_year / F.col("pop") * 1000).alias("per_1000"))


def net_migration(moves: DataFrame, stock: DataFrame, first: int, n_short: int, last: int, city: str,
                  tol_per_year: float = 5.0, tol_share: float = 0.01) -> DataFrame:
    """Net migration over two windows, per 1,000, and whether stock change, births minus
    deaths and migration reconcile. The city is the sum of its parts: moves between them
    cancel.

    moves: code, year, kind ('natural'/'migration'), n; stock: code, year, persons.
    """
    y, kind, n = F.col("year"), F.col("kind"), F.col("n")
    parts = moves.filter(y.between(first, last - 1)).groupBy("code").agg(
        F.sum(F.when((kind == "migration") & (y < first + n_short), n)).alias("short"),
        F.sum(F.when(kind == "migration", n)).alias("full"), F.sum(n).alias("moved"),
    )
    flows = parts.unionByName(parts.agg(*[F.sum(c).alias(c) for c in ("short", "full", "moved")]).select(F.lit(city).alias("code"), "short", "full", "moved"))
    ends = stock.groupBy("code").agg(
        F.sum(F.when(y == first, F.col("persons"))).alias("p0"), F.sum(F.when(y == last, F.col("persons"))).alias("p1"))
    ends = ends.unionByName(ends.agg(F.sum("p0").alias("p0"), F.sum("p1").alias("p1")).select(F.lit(city).alias("code"), "p0", "p1"))
    gap = F.col("p1") - F.col("p0") - F.col("moved")
    tol = F.greatest(F.lit(tol_per_year * (last - first)), F.col("p0") * tol_share)
    rate = lambda c: F.when(F.col("p0") > 0, c / F.col("p0") * 1000)
    return flows.join(ends, "code").select(
        "code", "short", "full", rate(F.col("short")).alias("short_per_1000"), rate(F.col("full")).alias("full_per_1000"),
        gap.alias("gap"), rate(gap).alias("gap_per_1000"), (F.abs(gap) <= tol).alias("reconciles"),
    )


def forecast_pairs(forecast: DataFrame, actual: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(vintage, horizon, code, level, forecast, actual, baseline): each projection cell with the
    figure that came true, and the pro-rata baseline that gives every area the total's growth.

    forecast: vintage, code, level, year, value; actual: code, year, value.
    """
    h = F.explode(F.array(*[F.lit(x) for x in horizons])).alias("horizon")
    runs = forecast.select("vintage").distinct().select("vintage", h)
    f = forecast.join(runs, "vintage").filter(F.col("year") == F.col("vintage") + F.col("horizon"))
    base = forecast.filter(F.col("year") == F.col("vintage"))
    growth = (
        f.groupBy("vintage", "horizon", "level").agg(F.sum("value").alias("_t1"))
        .join(base.groupBy("vintage", "level").agg(F.sum("value").alias("_t0")), ["vintage", "level"])
    )
    own = base.select("vintage", "code", F.col("value").alias("_own"))
    a = actual.select("code", "year", F.col("value").alias("actual")).filter(F.col("actual") != 0)
    j = f.join(a, ["code", "year"]).join(own, ["vintage", "code"]).join(growth, ["vintage", "horizon", "level"])
    return j.select("vintage", "horizon", "code", "level", F.col("value").alias("forecast"), "actual",
                    (F.col("_own") * F.col("_t1") / F.col("_t0")).alias("baseline"))


def score(pairs: DataFrame, by: Sequence[str], column: str = "forecast") -> DataFrame:
    """MAPE, bias, median and mean absolute error of a column against ``actual``."""
    diff = F.col(column) - F.col("actual")
    p = pairs.withColumns({"_pe": diff / F.col("actual") * 100, "_ape": F.abs(diff) / F.col("actual") * 100, "_ae": F.abs(diff)})
    agg = p.groupBy(*by).agg(F.avg("_ape").alias("mape"), F.avg("_pe").alias("bias"), F.avg("_ae").alias("mae"), F.count(F.lit(1)).alias("n"))
    med = R.medians(p, list(by), "_ape", "medape").drop("medape_n")
    return agg.join(med, list(by))


def backtest_summary(pairs: DataFrame, by: Sequence[str] = ("level", "horizon")) -> DataFrame:
    """Scores of the forecast, the baseline's error, and the skill of one over the other."""
    base = F.abs(F.col("baseline") - F.col("actual")) / F.col("actual") * 100
    b = pairs.groupBy(*by).agg(F.avg(base).alias("baseline_mape"))
    both = (F.col("mape") > 0) & (F.col("baseline_mape") > 0)
    return score(pairs, by).join(b, list(by)).withColumn("skill", F.when(both, (1 - F.col("mape") / F.col("baseline_mape")) * 100))


def backtest_areas(pairs: DataFrame, line_horizon: int, min_vintages: int = 3) -> DataFrame:
    """Per area over all later horizons, and the line shown for one horizon: its error, how
    many vintages were too high, and whether enough of them score."""
    later = pairs.filter(F.col("horizon") > 0)
    at = later.filter(F.col("horizon") == line_horizon)
    line = at.groupBy("code").agg(
        F.avg(F.abs(F.col("forecast") - F.col("actual")) / F.col("actual") * 100).alias("mape_line"),
        F.count_if(F.col("forecast") > F.col("actual")).alias("over_line"), F.count(F.lit(1)).alias("n_line"))
    zero = F.lit(0).cast("long")
    return score(later, ["code"]).join(line, "code", "left").withColumns({
        "over_line": F.coalesce("over_line", zero), "n_line": F.coalesce("n_line", zero),
        "eligible": F.coalesce("n_line", zero) >= min_vintages,
    })


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]], group: Sequence[str] = ()) -> DataFrame:
    """Rank correlation per pair of columns; ties take their mean rank."""
    out = None
    keys = list(group)
    for x, y in pairs:
        d = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
        rx = R.positions(d, keys, "_x").select(*keys, "_x", R.average_rank().alias("rx"))
        ry = R.positions(d, keys, "_y").select(*keys, "_y", R.average_rank().alias("ry"))
        r = d.join(rx, [*keys, "_x"]).join(ry, [*keys, "_y"]).groupBy(*keys).agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))
        r = r.select(F.lit(f"{x}~{y}").alias("pair"), *keys, "rho", "n")
        out = r if out is None else out.unionByName(r)
    return out


# Household trend limits.
PPH_CAP, PPH_FLOOR, TREND_YEARS, MID_OFFSET = 0.05, 1.6, 5, 5


def household_trend(series: DataFrame) -> DataFrame:
    """Household size carried forward by its own mean yearly change, moving at most 5 % from
    the base and never below 1.6 persons.

    series: code, year (int), value — a code needs all ``TREND_YEARS + 1`` years.
    """
    y = F.col("year")
    ends = series.groupBy("code").agg(
        F.min_by("value", y).alias("first"), F.max_by("value", y).alias("base"), F.count("value").alias("n"))
    full = ends.filter(F.col("n") == TREND_YEARS + 1)
    step = (F.col("base") - F.col("first")) / TREND_YEARS
    raw = F.col("base") + step * MID_OFFSET
    held = F.greatest(F.least(F.greatest(raw, F.col("base") * (1 - PPH_CAP)), F.col("base") * (1 + PPH_CAP)), F.lit(PPH_FLOOR))
    return full.select("code", "base", step.alias("step"), held.alias("projected"), (F.abs(held - raw) > 1e-12).alias("capped"))


def housing_gap(trend: DataFrame, projection: DataFrame, supply: DataFrame) -> DataFrame:
    """Households needed against dwellings added over five years, per 1,000 inhabitants and
    relative to the nation (the sum of the same areas).

    projection: code, p0, p1; supply: code, net, gross (five-year figures).
    """
    j = trend.join(projection, "code").join(supply, "code")
    demand = F.col("p1") / F.col("projected") - F.col("p0") / F.col("base")
    const = (F.col("p1") - F.col("p0")) / F.col("base")
    g = j.withColumns({"demand": demand, "demand_const": const}).withColumns({
        "gap": F.col("demand") - F.col("net"), "gap_const_gross": F.col("demand_const") - F.col("gross")})
    nation = g.agg(((F.sum("demand") - F.sum("net")) / F.sum("p0") * 1000).alias("r")).scalar()
    per = F.col("gap") / F.col("p0") * 1000
    return g.select("code", "demand", "demand_const", "net", "gross", "gap", "gap_const_gross", per.alias("gap_per_1000"), (per - nation).alias("gap_per_1000_rel"), "capped")


def pipeline(flows: DataFrame, permits: str, starts: str, n: int = 4) -> DataFrame:
    """Permits minus starts over the last published quarters. flows: area, period, phase, value."""
    f = flows.join(C.newest_periods(flows, n), "period", "left_semi").filter(F.col("phase").isin(permits, starts))
    zero = F.lit(0.0)
    s = f.groupBy("area").agg(
        F.coalesce(F.sum(F.when(F.col("phase") == permits, F.col("value"))), zero).alias("permits"),
        F.coalesce(F.sum(F.when(F.col("phase") == starts, F.col("value"))), zero).alias("starts"))
    return s.withColumn("pipeline", F.col("permits") - F.col("starts"))


def complete_year_mean(cells: DataFrame, last_n: int = 5) -> DataFrame:
    """Mean yearly sum over the last ``last_n`` complete years (all four quarters published); fails where there are fewer."""
    y = P.period_year("period")
    years = cells.select(y.alias("y"), "period").distinct().groupBy("y").agg(F.count(F.lit(1)).alias("q")).filter(F.col("q") == 4)
    full = years.orderBy(F.col("y").desc()).limit(last_n).select("y")
    n = full.agg(F.count(F.lit(1)).alias("_n"))  # one row
    told = F.concat(F.lit(f"fewer than {last_n} complete years: "), F.col("_n").cast("string"))
    enough = n.select(F.when(F.col("_n") == last_n, F.lit(last_n)).otherwise(F.raise_error(told).cast("int")).alias("_n"))
    return cells.withColumn("y", y).join(full, "y", "left_semi").groupBy("area").agg(F.sum("value").alias("_s")).join(
        enough, F.lit(True)).select("area", (F.col("_s") / F.col("_n")).alias("value"))


def observed_and_projected(observed: DataFrame, projected: DataFrame) -> DataFrame:
    """Two series with a kind, meeting at the last observed year and never mixed: the
    projection starts where the observations end."""
    last = observed.select(F.max("year")).scalar()
    o = observed.select("code", "year", "value", F.lit("observed").alias("kind"))
    p = projected.filter(F.col("year") >= last).select("code", "year", "value", F.lit("projected").alias("kind"))
    return o.unionByName(p)


def newest_vintage(catalogue: DataFrame, prefix: str, digits: int) -> DataFrame:
    """(table, year): the newest table of a family whose id ends in a 2- or 4-digit year."""
    n = F.nullif(F.regexp_extract("id", rf"^{prefix}(\d{{{digits}}})$", 1), F.lit("")).try_cast("int")
    year = n if digits == 4 else F.when(n < 70, n + 2000).otherwise(n + 1900)
    hits = catalogue.withColumn("year", year).filter(F.col("year").isNotNull())
    return hits.agg(F.max_by("id", "year").alias("table"), F.max("year").alias("year")).filter(F.col("year").isNotNull())


def run_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs of one figure side by side, stated and never mixed. a, b: year, value."""
    j = a.select("year", F.col("value").alias("first_run")).join(b.select("year", F.col("value").alias("second_run")), "year")
    d = F.col("second_run") - F.col("first_run")
    return j.withColumns({"difference": d, "difference_pct": F.when(F.col("first_run") != 0, d / F.col("first_run") * 100)})
