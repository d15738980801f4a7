"""Indicator calculations over cubes.

Every calculation is declared once and yields all periods in one pass; the live figure is
the newest period of that series, and a year's figure is the period that year ends on.
Cells are summed per area and period before anything else is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..model import Cube, IndicatorSpec, select_codes

# Calculations that compare like sub-periods across years.
SAME_SUB_PERIOD = {
    "passthrough", "value_div_1000", "share_of_total", "yoy_pct", "per_1000_dwellings", "ratio_pct", "ratio_own_year_pct",
}
# the newest figure of these stands over the newest denominator, whatever its year
_NEWEST_DENOMINATOR = {"ratio_pct", "per_1000_dwellings", "sum4q_per_1000"}

_ORDER = "_order"


def selected(cube: Cube, select: dict | None) -> DataFrame:
    return select_codes(cube.cells(), select)


def newest(df: DataFrame, period: str = "period") -> Column:
    """Sort key of the newest period in ``df`` as a scalar subquery."""
    return df.select(F.max(P.period_order(period))).scalar()


def newest_periods(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` periods that occur (published ones, not calendar ones)."""
    return (
        df.select("period").distinct().orderBy(P.period_order("period").desc()).limit(n)
    )


def sum_by_area(df: DataFrame, *by: str) -> DataFrame:
    """Sum over every other dimension; suppressed cells are skipped, never zero."""
    keys = by or ("area",)
    return df.filter(F.col("value").isNotNull()).groupBy(*keys).agg(F.sum("value").alias("value"))


def _nonzero(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


# --- point-in-time calculations: all periods at once ------------------------------------


def passthrough(cubes: dict[str, Cube], spec: IndicatorSpec) -> DataFrame:
    return sum_by_area(selected(cubes["num"], spec.select), "area", "period")


def share_of_total(cubes: dict[str, Cube], spec: IndicatorSpec) -> DataFrame:
    """Sum over the numerator codes divided by the sum over the denominator codes, percent."""
    if not spec.share:
        raise ValueError(f"share_of_total: {spec.key} has no share codes")
    var, num, den = spec.share["var"], spec.share["num"], spec.share.get("den")
    v = F.col("value")
    part = F.sum(F.when(F.col(var).isin(num), v))
    whole = F.sum(F.when(F.col(var).isin(den), v)) if den else F.sum(v)
    return (
        selected(cubes["num"], spec.select).groupBy("area", "period")
        .agg(part.alias("_n"), whole.alias("_d"))
        .filter(F.col("_n").isNotNull() & _nonzero(F.col("_d")))
        .select("area", "period", (F.col("_n") / F.col("_d") * 100).alias("value"))
    )


def yoy_pct(cubes: dict[str, Cube], spec: IndicatorSpec) -> DataFrame:
    """Change against the same sub-period one year before; zero or missing on either side
    gives no figure. One cell per area and period is expected."""
    cur = selected(cubes["num"], spec.select).groupBy("area", "period").agg(F.max("value").alias("value"))
    cur = cur.filter(_nonzero(F.col("value"))).withColumn(_ORDER, P.period_order("period"))
    old = cur.select(
        "area", F.col("period").alias("_p"), F.col("value").alias("_v"), (F.col(_ORDER) + 100).alias(_ORDER)
    )
    return cur.join(old, ["area", _ORDER]).select(
        "area", P.window_label(F.col("_p"), F.col("period")).alias("period"),
        ((F.col("value") / F.col("_v") - 1) * 100).alias("value"),
    )


def _with_denominator(num: DataFrame, den: DataFrame, newest_den: bool) -> DataFrame:
    """``num`` with ``_d``: the denominator at one period for all areas.

    The newest period the denominator table has, or the newest one up to the numerator's own
    year at the table's newest sub-period. Areas without a usable denominator drop out.
    """
    key = P.period_order("period")
    if newest_den:
        dated = num.withColumn("_dp", den.agg(F.max_by("period", key)).scalar())
    else:
        like = den.filter(F.pmod(key, F.lit(100)) == F.pmod(newest(den), F.lit(100)))
        listed = like.agg(F.array_sort(F.collect_set(F.struct(key.alias("k"), F.col("period").alias("p"))))).scalar()
        until = P.label_year("period") * 100 + 99
        dated = num.withColumns({"_ps": listed, "_until": until}).withColumn(
            "_dp", F.get(F.reverse(F.filter("_ps", lambda s: s.k <= F.col("_until"))), 0).p
        ).drop("_ps", "_until")
    per_area = sum_by_area(den, "area", "period").select("area", F.col("period").alias("_dp"), F.col("value").alias("_d"))
    return dated.join(per_area, ["area", "_dp"]).filter(_nonzero(F.col("_d"))).drop("_dp")


def _ratio(cubes: dict[str, Cube], spec: IndicatorSpec, num: DataFrame, factor: float, newest_den: bool) -> DataFrame:
    d = _with_denominator(num, selected(cubes["den"], spec.den_select), newest_den)
    return d.select("area", "period", (F.col("value") / F.col("_d") * factor).alias("value"))


def ratio_pct(cubes: dict[str, Cube], spec: IndicatorSpec, newest_den: bool = False) -> DataFrame:
    """One cube over another, percent; a missing or zero denominator gives no row."""
    return _ratio(cubes, spec, passthrough(cubes, spec), 100.0, newest_den)


def ratio_own_year_pct(cubes: dict[str, Cube], spec: IndicatorSpec) -> DataFrame:
    """The denominator always belongs to the numerator's own year, also for the newest figure."""
    return ratio_pct(cubes, spec)


def per_1000_dwellings(cubes: dict[str, Cube], spec: IndicatorSpec, newest_den: bool = False) -> DataFrame:
    return _ratio(cubes, spec, passthrough(cubes, spec), 1000.0, newest_den)


# --- trailing windows over published periods ---------------------------------------------


def trailing_windows(df: DataFrame, n: int = 4) -> DataFrame:
    """(period, end, label): each published period with every window it belongs to.

    The calendar bounds the list of periods whatever the cube's size, so it fits one row.
    """
    listed = df.agg(
        F.array_sort(F.collect_set(F.struct(P.period_order("period").alias("k"), "period"))).alias("ps")
    ).select("ps", F.posexplode("ps").alias("i", "e"))
    first = F.greatest(F.col("i") + 2 - n, F.lit(1))
    windows = listed.select("e", F.slice("ps", first, F.col("i") + 2 - first).alias("w"))
    return windows.select(
        F.explode("w.period").alias("period"), F.col("e.period").alias("end"),
        P.window_label(F.element_at("w", 1).period, F.col("e.period"), arrow=False).alias("label"),
    )


def _per_cell(df: DataFrame) -> DataFrame:
    """Per area and period what the window calculations need, before the ×4 fan-out."""
    v = F.col("value")
    return df.filter(v.isNotNull()).groupBy("area", "period").agg(
        F.sum(v).alias("_sum"), F.sum(F.when(v != 0, v)).alias("_nz_sum"),
        F.count_if(v != 0).alias("_nz"),
    )


def last4q_mean(cubes: dict[str, Cube], spec: IndicatorSpec) -> DataFrame:
    """Mean of the non-zero cells of the last four published periods."""
    df = selected(cubes["num"], spec.select)
    return (
        _per_cell(df).join(trailing_windows(df), "period").groupBy("area", F.col("label").alias("period"))
        .agg((F.sum("_nz_sum") / F.sum("_nz")).alias("value")).filter(F.col("value").isNotNull())
    )


def sum4q(cubes: dict[str, Cube], spec: IndicatorSpec) -> DataFrame:
    df = selected(cubes["num"], spec.select)
    return (
        _per_cell(df).join(trailing_windows(df), "period").groupBy("area", F.col("label").alias("period"))
        .agg(F.sum("_sum").alias("value"))
    )


def sum4q_per_1000(cubes: dict[str, Cube], spec: IndicatorSpec, newest_den: bool = False) -> DataFrame:
    """Four-period sum per 1,000 of the stock."""
    return _ratio(cubes, spec, sum4q(cubes, spec), 1000.0, newest_den)


def discount_pct(cubes: dict[str, Cube], spec: IndicatorSpec) -> DataFrame:
    """Asking against realised price, paired per area and period, mean over four periods."""
    var, ask, got = spec.share["var"], spec.share["ask"], spec.share["real"]
    df = cubes["num"].cells()
    cell = df.filter(_nonzero(F.col("value"))).groupBy("area", "period").agg(
        F.max(F.when(F.col(var) == ask, F.col("value"))).alias("_a"),
        F.max(F.when(F.col(var) == got, F.col("value"))).alias("_r"),
    ).filter(F.col("_a").isNotNull() & F.col("_r").isNotNull())
    return (
        cell.withColumn("_pct", (F.col("_a") - F.col("_r")) / F.col("_a") * 100)
        .join(trailing_windows(df), "period").groupBy("area", F.col("label").alias("period"))
        .agg(F.avg("_pct").alias("value"))
    )


# --- rolling four calendar quarters, complete or null ------------------------------------


def _published(df: DataFrame, what: Column) -> Column:
    """The distinct periods a table has, as one array (the calendar bounds its length)."""
    return df.agg(F.collect_set(what)).scalar()


def _has_all(have: Column, first: Column, last: Column) -> Column:
    return F.size(F.array_except(F.sequence(first, last), have)) == 0


def rolling_sums(df: DataFrame, lag_year: bool = False) -> DataFrame:
    """(area, q, value) for every quarter ``q`` that ends four published quarters.

    An area with any row in the window keeps a row; its value is null when a quarter is
    missing or a cell is suppressed. A quarter absent from the whole table ends no window.
    ``lag_year`` adds the sum of the four quarters before (``before``) in the same pass and
    asks for those to be published as well.
    """
    cell = df.withColumn("_q", P.quarter_index("period")).groupBy("area", "_q").agg(
        F.sum("value").alias("_s"), F.count_if(F.col("value").isNull()).alias("_null")
    )
    reach = 7 if lag_year else 3
    fan = cell.select("area", "_s", "_null", "_q", F.explode(F.sequence(F.col("_q"), F.col("_q") + reach)).alias("q"))
    now = F.col("q") - F.col("_q") <= 3

    def complete(part: Column) -> Column:
        ok = (F.count_if(part) == 4) & (F.sum(F.when(part, F.col("_null"))) == 0)
        return F.when(ok, F.sum(F.when(part, F.col("_s"))))

    aggs = [complete(now).alias("value"), F.count_if(now).alias("_n")]
    if lag_year:
        aggs.append(complete(~now).alias("before"))
    have = _published(df, P.quarter_index("period"))
    return (
        fan.groupBy("area", "q").agg(*aggs).filter(F.col("_n") > 0).drop("_n")
        .filter(_has_all(have, F.col("q") - reach, F.col("q")))
    )


def _rolling_label(q: Column) -> Column:
    return P.window_label(P.quarter_label(q - 3), P.quarter_label(q))


def _rolling_rate(cubes: dict[str, Cube], spec: IndicatorSpec, candidates: list[Column]) -> DataFrame:
    """Rolling sums over an as-of denominator: for each window end the first candidate
    period that the denominator table has at all, the same one for every area."""
    cur = rolling_sums(selected(cubes["num"], spec.select))
    den = selected(cubes["den"], spec.den_select)
    have = _published(den, F.col("period"))
    chosen = F.get(F.array_intersect(F.array(*candidates), have), 0)
    per_area = sum_by_area(den, "area", "period").select("area", F.col("period").alias("_dp"), F.col("value").alias("_d"))
    return (
        cur.withColumn("_dp", chosen).filter(F.col("_dp").isNotNull()).join(per_area, ["area", "_dp"], "left")
        .select(
            "area", _rolling_label(F.col("q")).alias("period"),
            F.when(_nonzero(F.col("_d")), F.col("value") / F.col("_d") * 1000).alias("value"),
        )
    )


def rolling4q_per_1000_pop(cubes: dict[str, Cube], spec: IndicatorSpec) -> DataFrame:
    """Population counts the first day of a quarter, so the end of a window is the next
    quarter's count; the window's own last quarter where that is not published yet."""
    q = F.col("q")
    return _rolling_rate(cubes, spec, [P.quarter_label(q + 1), P.quarter_label(q)])


def rolling4q_per_1000_dwellings(cubes: dict[str, Cube], spec: IndicatorSpec) -> DataFrame:
    """Stock on the 1 January after the window, else that of the window's own year."""
    y = F.floor(F.col("q") / 4)
    return _rolling_rate(cubes, spec, [(y + 1).cast("string"), y.cast("string")])


def rolling4q_yoy_pct(cubes: dict[str, Cube], spec: IndicatorSpec) -> DataFrame:
    cur = rolling_sums(selected(cubes["num"], spec.select), lag_year=True)
    return cur.select(
        "area", F.concat(_rolling_label(F.col("q")), F.lit(" vs 4Q before")).alias("period"),
        F.when(_nonzero(F.col("before")), (F.col("value") / F.col("before") - 1) * 100).alias("value"),
    )


CALCS: dict[str, Callable[..., DataFrame]] = {
    "passthrough": passthrough,
    "value_div_1000": passthrough,
    "share_of_total": share_of_total,
    "yoy_pct": yoy_pct,
    "last4q_mean": last4q_mean,
    "discount_pct": discount_pct,
    "per_1000_dwellings": per_1000_dwellings,
    "sum4q_per_1000": sum4q_per_1000,
    "sum4q": sum4q,
    "ratio_pct": ratio_pct,
    "ratio_own_year_pct": ratio_own_year_pct,
    "rolling4q_per_1000_pop": rolling4q_per_1000_pop,
    "rolling4q_per_1000_dwellings": rolling4q_per_1000_dwellings,
    "rolling4q_yoy_pct": rolling4q_yoy_pct,
}


def series(cubes: dict[str, Cube], spec: IndicatorSpec) -> DataFrame:
    """Every period of an indicator: (area, period, value)."""
    if spec.calc not in CALCS:
        raise ValueError(f"{spec.key}: unknown calculation {spec.calc}")
    return CALCS[spec.calc](cubes, spec)


def last_named(period: Column) -> Column:
    """Sort key of the last period a label names."""
    last = F.trim(F.regexp_replace(F.element_at(F.split(period, "[→–]"), -1), r"\s.*$", ""))
    return P.period_order(last)


def _needed_for_newest(cube: Cube, spec: IndicatorSpec, newest_key: Column) -> Cube:
    """The cube cut to the periods the newest figure reads, so older ones are never scanned on."""
    df = select_codes(cube.cells(), spec.select)
    key = P.period_order("period")
    if spec.calc == "yoy_pct":
        df = df.filter((key == newest_key) | (key == newest_key - 100))
    elif spec.calc in SAME_SUB_PERIOD:
        df = df.filter(key == newest_key)
    elif spec.calc.startswith("rolling4q"):
        df = df.filter(key > newest_key - (200 if spec.calc.endswith("yoy_pct") else 100))
    else:
        df = df.join(newest_periods(df, 4), "period", "left_semi")
    return Cube(df, dims=cube.dims, name=cube.name)


def live(cubes: dict[str, Cube], spec: IndicatorSpec) -> DataFrame:
    """The figure at the newest period of the selected cells; nothing where that period's
    window is incomplete, even if an older one is complete."""
    newest_key = newest(selected(cubes["num"], spec.select))
    cut = {**cubes, "num": _needed_for_newest(cubes["num"], spec, newest_key)}
    s = CALCS[spec.calc](cut, spec, newest_den=True) if spec.calc in _NEWEST_DENOMINATOR else series(cut, spec)
    return s.filter(last_named(F.col("period")) == newest_key)


def history(cubes: dict[str, Cube], spec: IndicatorSpec) -> DataFrame:
    """One figure per area and year, filed under the year its own period names.

    Point-in-time figures use the newest sub-period of every year, rolling ones the year's
    fourth quarter, and trailing ones the last published period up to the newest sub-period.
    """
    s = series(cubes, spec).withColumn("_k", last_named(F.col("period"))).withColumn("year", P.label_year("period"))
    sub = F.pmod(F.col("_k"), F.lit(100))
    if spec.calc.startswith("rolling4q"):
        s = s.filter(sub == 12)
    else:
        last_sub = F.pmod(newest(cubes["num"].cells()), F.lit(100))
        if spec.calc in SAME_SUB_PERIOD:
            s = s.filter(sub == last_sub)
        else:
            s = s.filter(sub <= last_sub)
            ends = s.groupBy("year").agg(F.max("_k").alias("_k"))
            s = s.join(ends, ["year", "_k"], "left_semi")
    return s.select("area", F.col("year").cast("string").alias("year"), "period", "value")


def quarterly_series(cubes: dict[str, Cube], spec: IndicatorSpec, start: str) -> DataFrame:
    """Rolling figures at every window end from ``start`` on: (area, quarter, value)."""
    s = series(cubes, spec).withColumn("_k", last_named(F.col("period")))
    y, sub = F.floor(F.col("_k") / 100), F.pmod(F.col("_k"), F.lit(100)) / 3
    return s.filter(F.col("_k") >= P.period_order(F.lit(start))).select(
        "area", F.concat(y.cast("string"), F.lit("K"), sub.cast("int").cast("string")).alias("quarter"), "value"
    )


def many(cube: Cube, specs: Iterable[IndicatorSpec]) -> DataFrame:
    """All pass-through and share indicators of one cube in a single scan and shuffle:
    one conditional sum per indicator, then rows per indicator."""
    specs = list(specs)
    v = F.col("value")
    aggs, shape = [], []
    for i, s in enumerate(specs):
        cond = F.lit(True)
        for dim, want in s.select.items():
            cond = cond & F.col(dim).isin(want if isinstance(want, (list, tuple)) else [want])
        if s.calc == "share_of_total":
            num = cond & F.col(s.share["var"]).isin(s.share["num"])
            den = cond & F.col(s.share["var"]).isin(s.share["den"]) if s.share.get("den") else cond
            aggs += [F.sum(F.when(num, v)).alias(f"_n{i}"), F.sum(F.when(den, v)).alias(f"_d{i}")]
            val = F.when(_nonzero(F.col(f"_d{i}")), F.col(f"_n{i}") / F.col(f"_d{i}") * 100)
        else:
            aggs.append(F.sum(F.when(cond, v)).alias(f"_n{i}"))
            val = F.col(f"_n{i}")
        shape.append(F.struct(F.lit(s.key).alias("key"), (val / s.display_div).alias("value")))
    wide = cube.cells().groupBy("area", "period").agg(*aggs)
    return (
        wide.select("area", "period", F.explode(F.array(*shape)).alias("_x"))
        .select("area", "period", F.col("_x.key").alias("key"), F.col("_x.value").alias("value"))
        .filter(F.col("value").isNotNull())
    )


def compute_registry(inputs: dict[str, dict[str, Cube]], specs: Iterable[IndicatorSpec]) -> tuple[DataFrame | None, list[str]]:
    """Live figures of all specs as one long table, with the specs that could not be
    computed as warnings rather than a failed build."""
    out, warnings = None, []
    for s in specs:
        try:
            part = live(inputs[s.key], s).select(
                F.lit(s.key).alias("key"), F.lit(s.level).alias("level"), F.col("area").alias("code"), "period",
                (F.col("value") / s.display_div).alias("value"),
            )
            part.schema  # analysis errors surface here, not at the sink
        except (KeyError, ValueError, AnalysisException) as e:  # what a wrong entry causes; anything else stops the build
            warnings.append(f"{s.key}: {e}")
            continue
        out = part if out is None else out.unionByName(part)
    return out, warnings


def national_series(cube: Cube, select: dict | None = None) -> DataFrame:
    """Sum per period over everything selected, with the change on the same sub-period a
    year before: (period, value, yoy)."""
    s = sum_by_area(selected(cube, select), "period").withColumn(_ORDER, P.period_order("period"))
    old = s.select((F.col(_ORDER) + 100).alias(_ORDER), F.col("value").alias("_v"))
    return s.join(old, _ORDER, "left").select(
        "period", "value",
        F.when(_nonzero(F.col("_v")), (F.col("value") / F.col("_v") - 1) * 100).alias("yoy"),
    )
