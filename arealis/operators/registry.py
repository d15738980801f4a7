"""The indicator registry compiled to a fixed number of passes.

However many entries a registry has, each cube is read once: one conditional aggregation folds it to what its entries
need per area and period, as numerator or denominator. What follows works on those folded cells, a family of
calculations at a time, with the entry's key as one more grouping column: points in time, changes on
the year before, trailing windows, rolling quarters, and ratios. Live figures, yearly history and quarters are filters on
one series. Snapshot kinds, which other operators produce, are unpivoted from one table a kind.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..model import Cube, IndicatorSpec
from ..session import cut_lineage
from . import calcs as C

POINT = {"passthrough", "value_div_1000", "share_of_total"}
TRAILING = {"last4q_mean", "sum4q", "discount_pct", "sum4q_per_1000"}
RATIO = {"ratio_pct": 100.0, "ratio_own_year_pct": 100.0, "per_1000_dwellings": 1000.0, "sum4q_per_1000": 1000.0}
ROLLING = {"rolling4q_per_1000_pop", "rolling4q_per_1000_dwellings", "rolling4q_yoy_pct"}
#: Kinds whose figures come ready from a snapshot of another build.
SNAPSHOT_KINDS = ["bbr", "forecast", "net_dwellings", "public_index", "infra_index", "schools", "climate", "external"]

_CELL = "key string, role string, area string, period string, n long, a double, b double, nulls long"


@dataclass(frozen=True)
class Entry:
    """A registry entry: the calculation, the cubes it reads, or the field of a snapshot kind."""

    spec: IndicatorSpec
    num: str = ""
    den: str = ""
    column: str = ""


@dataclass(frozen=True)
class Snapshot:
    """Figures of one kind: (level, code, one column per field), at one period."""

    df: DataFrame
    period: str


def _matches(select: dict) -> Column:
    cond = F.lit(True)
    for dim, want in (select or {}).items():
        cond = cond & (F.col(dim).isin(list(want)) if isinstance(want, (list, tuple, set)) else F.col(dim) == want)
    return cond


def _dimensions(entry: Entry) -> set[str]:
    share = {entry.spec.share["var"]} if entry.spec.calc in ("share_of_total", "discount_pct") else set()
    return set(entry.spec.select or {}) | share


def _measures(spec: IndicatorSpec, role: str) -> tuple[Column, Column, Column]:
    """(condition, a, b): what a cell gives an entry."""
    v = F.col("value")
    if role == "den":
        cond = _matches(spec.den_select)
        return cond, F.sum(F.when(cond, v)), F.lit(None)
    cond = _matches(spec.select)
    nonzero = F.when(cond & (v != 0), v)
    if spec.calc == "share_of_total":
        var, num, den = F.col(spec.share["var"]), spec.share["num"], spec.share.get("den")
        return cond, F.sum(F.when(cond & var.isin(num), v)), F.sum(F.when(cond & var.isin(den), v)) if den else F.sum(F.when(cond, v))
    if spec.calc == "yoy_pct":
        return cond, F.max(F.when(cond, v)), F.lit(None)
    if spec.calc == "last4q_mean":
        return cond, F.sum(nonzero), F.count(nonzero).cast("double")
    if spec.calc == "discount_pct":
        var = F.col(spec.share["var"])
        return cond, F.max(F.when(var == spec.share["ask"], nonzero)), F.max(F.when(var == spec.share["real"], nonzero))
    return cond, F.sum(F.when(cond, v)), F.lit(None)


def fold(name: str, cube: Cube, uses: Sequence[tuple[Entry, str]]) -> DataFrame:
    """One pass over a cube: (key, role, area, period, n, a, b, nulls) for all its uses, and the
    number of cells under the cube's own name."""
    aggs, rows = [], []
    for i, (entry, role) in enumerate(uses):
        cond, a, b = _measures(entry.spec, role)
        v = F.col("value")
        aggs += [F.count_if(cond).alias(f"_n{i}"), a.cast("double").alias(f"_a{i}"), b.cast("double").alias(f"_b{i}"), F.count_if(cond & v.isNull()).alias(f"_z{i}")]
        rows.append(F.struct(F.lit(entry.spec.key).alias("key"), F.lit(role).alias("role"), *[F.col(f"_{c}{i}").alias(x) for c, x in (("n", "n"), ("a", "a"), ("b", "b"), ("z", "nulls"))]))
    none = F.lit(None).cast("double")
    rows.append(F.struct(F.lit(name).alias("key"), F.lit("cube").alias("role"), F.col("_all").alias("n"), none.alias("a"), none.alias("b"), F.lit(0).cast("long").alias("nulls")))
    wide = cube.cells().groupBy("area", "period").agg(F.count(F.lit(1)).alias("_all"), *aggs)
    long = wide.select("area", "period", F.explode(F.array(*rows)).alias("x")).filter("x.n > 0")
    return long.select("x.key", "x.role", "area", "period", "x.n", "x.a", "x.b", "x.nulls")


@dataclass
class Registry:
    """Compiled entries. ``warnings`` holds (key, message) of those that can't be computed."""

    spark: SparkSession
    entries: list[Entry]
    folded: DataFrame
    snapshots: dict[str, Snapshot]
    warnings: list[tuple[str, str]] = field(default_factory=list)

    # --- facts about entries, as small tables beside the cells ---

    @cached_property
    def specs(self) -> DataFrame:
        rows = [(e.spec.key, e.spec.calc, e.spec.level, float(e.spec.display_div), e.num) for e in self.entries if e.num]
        return self.spark.createDataFrame(rows, "key string, calc string, level string, div double, cube string")

    def _of(self, role: str, calcs: set[str] | None = None) -> DataFrame:
        df = self.folded.filter(F.col("role") == role)
        keys = [e.spec.key for e in self.entries if calcs is None or e.spec.calc in calcs]
        return df.filter(F.col("key").isin(keys)).withColumn("k", P.period_order("period"))

    @cached_property
    def newest(self) -> DataFrame:
        """(key, newest): the newest period with a selected cell."""
        return self._of("num").groupBy("key").agg(F.max("k").alias("newest"))

    # --- the families ---

    def _points(self) -> DataFrame:
        d = self._of("num", POINT | set(RATIO) - TRAILING).join(self.specs, "key")
        share = F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("b") != 0), F.col("a") / F.col("b") * 100)
        value = F.when(F.col("calc") == "share_of_total", share).otherwise(F.col("a"))
        return d.select("key", "area", "period", value.alias("value")).filter("value is not null")

    def _changes(self) -> DataFrame:
        cur = self._of("num", {"yoy_pct"}).filter("a is not null and a <> 0")
        old = cur.select("key", "area", F.col("period").alias("_p"), F.col("a").alias("_v"), (F.col("k") + 100).alias("k"))
        return cur.join(old, ["key", "area", "k"]).select(
            "key", "area", P.window_label(F.col("_p"), F.col("period")).alias("period"), ((F.col("a") / F.col("_v") - 1) * 100).alias("value"))

    def _trailing(self) -> DataFrame:
        d = self._of("num", TRAILING)
        # the calendar bounds each list
        listed = d.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("k", "period"))).alias("ps"))
        ends = listed.select("key", "ps", F.posexplode("ps").alias("i", "e"))
        first = F.greatest(F.col("i") - 2, F.lit(1))
        windows = ends.select("key", "e", F.slice("ps", first, F.col("i") + 2 - first).alias("w")).select(
            "key", F.explode("w.period").alias("period"), P.window_label(F.element_at("w", 1).period, F.col("e.period"), arrow=False).alias("label"))
        calc = F.col("calc")
        pct = (F.col("a") - F.col("b")) / F.col("a") * 100
        top = F.when(calc == "discount_pct", pct).otherwise(F.col("a"))
        low = F.when(calc == "discount_pct", F.when(pct.isNotNull(), 1.0)).when(calc == "last4q_mean", F.col("b"))
        cells = d.join(self.specs, "key").select("key", "calc", "area", "period", top.alias("x"), low.alias("y")).filter("x is not null")
        s = cells.join(windows, ["key", "period"]).groupBy("key", "calc", "area", F.col("label").alias("period")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        value = F.when(calc.isin("discount_pct", "last4q_mean"), F.col("x") / F.col("y")).otherwise(F.col("x"))
        return s.select("key", "area", "period", value.alias("value")).filter("value is not null")

    def _ratios(self, num: DataFrame, newest_den: bool) -> DataFrame:
        """Figures over the denominator of one period for all areas: the newest there is, or the newest of the table's
        latest sub-period up to the figure's own year. ``ratio_own_year_pct`` always takes the latter."""
        den = self._of("den", set(RATIO))
        spans = den.groupBy("key").agg(F.max("k").alias("top"), F.array_sort(F.collect_set(F.struct("k", "period"))).alias("ps"))
        s = num.join(self.specs.filter(F.col("calc").isin(list(RATIO))), "key").join(spans, "key")
        until = P.label_year("period") * 100 + 99
        like = F.filter("ps", lambda p: (p["k"] % 100 == F.col("top") % 100) & (p["k"] <= until))
        own_year = F.get(F.reverse(like), 0)["period"]
        latest = F.element_at("ps", -1)["period"]
        chosen = F.when(F.lit(newest_den) & (F.col("calc") != "ratio_own_year_pct"), latest).otherwise(own_year)
        per_area = den.filter("a is not null and a <> 0").select("key", "area", F.col("period").alias("_dp"), F.col("a").alias("_d"))
        factor = F.create_map(*[F.lit(x) for pair in RATIO.items() for x in pair])[F.col("calc")]
        return s.withColumn("_dp", chosen).join(per_area, ["key", "area", "_dp"]).select("key", "area", "period", (F.col("value") / F.col("_d") * factor).alias("value"))

    def _rolling(self) -> DataFrame:
        cell = self._of("num", ROLLING).withColumn("_q", P.quarter_index("period")).groupBy("key", "area", "_q").agg(F.sum("a").alias("_s"), F.sum("nulls").alias("_null"))
        cell = cell.join(self.specs.select("key", "calc"), "key")
        reach = F.when(F.col("calc") == "rolling4q_yoy_pct", 7).otherwise(3)
        fan = cell.select("key", "calc", "area", "_s", "_null", "_q", F.explode(F.sequence(F.col("_q"), F.col("_q") + reach)).alias("q"))
        now = F.col("q") - F.col("_q") <= 3

        def complete(part: Column) -> Column:
            return F.when((F.count_if(part) == 4) & (F.sum(F.when(part, F.col("_null"))) == 0), F.sum(F.when(part, F.col("_s"))))

        sums = fan.groupBy("key", "calc", "area", "q").agg(complete(now).alias("value"), complete(~now).alias("before"), F.count_if(now).alias("_n")).filter("_n > 0")
        have = cell.groupBy("key").agg(F.collect_set("_q").alias("have"))
        published = F.size(F.array_except(F.sequence(F.col("q") - reach, F.col("q")), F.col("have"))) == 0
        sums = sums.join(have, "key").filter(published).drop("have", "_n")
        label = P.window_label(P.quarter_label(F.col("q") - 3), P.quarter_label("q"))
        change = sums.filter("calc = 'rolling4q_yoy_pct'").select(
            "key", "area", F.concat(label, F.lit(" vs 4Q before")).alias("period"),
            F.when(F.col("before").isNotNull() & (F.col("before") != 0), (F.col("value") / F.col("before") - 1) * 100).alias("value"))
        den = self._of("den", ROLLING)
        dens = den.groupBy("key").agg(F.collect_set("period").alias("dps"))
        year = F.floor(F.col("q") / 4)
        wanted = F.when(F.col("calc") == "rolling4q_per_1000_pop", F.array(P.quarter_label(F.col("q") + 1), P.quarter_label("q"))).otherwise(
            F.array((year + 1).cast("string"), year.cast("string")))
        per_area = den.filter("a is not null").select("key", "area", F.col("period").alias("_dp"), F.col("a").alias("_d"))
        dated = sums.filter("calc <> 'rolling4q_yoy_pct'").join(dens, "key").withColumn("_dp", F.get(F.array_intersect(wanted, F.col("dps")), 0))
        rate = dated.filter("_dp is not null").join(per_area, ["key", "area", "_dp"], "left").select(
            "key", "area", label.alias("period"), F.when(F.col("_d").isNotNull() & (F.col("_d") != 0), F.col("value") / F.col("_d") * 1000).alias("value"))
        return change.unionByName(rate)

    def series(self, newest_den: bool = False) -> DataFrame:
        """(key, area, period, value, k): every period of every entry."""
        calcs = {e.spec.calc for e in self.entries if e.num}
        points, parts = None, []
        if calcs & (POINT | set(RATIO)):
            points = self._points()
            parts.append(points.join(self._keys(POINT), "key", "left_semi"))
        trailing = self._trailing() if calcs & TRAILING else None
        if trailing is not None:
            parts.append(trailing.join(self._keys(TRAILING - set(RATIO)), "key", "left_semi"))
        if calcs & set(RATIO):
            nums = [x for x in (points, trailing) if x is not None]
            parts.append(self._ratios(reduce(DataFrame.unionByName, nums), newest_den))
        if "yoy_pct" in calcs:
            parts.append(self._changes())
        if calcs & ROLLING:
            parts.append(self._rolling())
        empty = self.spark.createDataFrame([], "key string, area string, period string, value double")
        return reduce(DataFrame.unionByName, parts, empty).withColumn("k", C.last_named(F.col("period")))

    def _keys(self, calcs: set[str]) -> DataFrame:
        return self.specs.filter(F.col("calc").isin(list(calcs))).select("key")

    # --- what the page reads ---

    def _shown(self, df: DataFrame, *cols: str) -> DataFrame:
        return df.join(self.specs, "key").select("key", "level", F.col("area").alias("code"), *cols, (F.col("value") / F.col("div")).alias("value"))

    def live(self) -> DataFrame:
        """(key, level, code, period, value): the figure at the newest selected period, snapshots included."""
        s = self.series(newest_den=True).join(self.newest, "key").filter("k = newest")
        return self._shown(s, "period").unionByName(self._snapshot_rows())

    def history(self) -> DataFrame:
        """(key, level, code, year, period, value): one figure per year, filed under the year its period names."""
        tops = self.folded.filter("role = 'cube'").groupBy(F.col("key").alias("cube")).agg(F.max(P.period_order("period")).alias("top"))
        rules = self.specs.join(tops, "cube").select("key", "calc", F.pmod("top", F.lit(100)).alias("last_sub"))
        s = self.series().withColumn("year", P.label_year("period")).join(rules, "key").withColumn("sub", F.pmod("k", F.lit(100)))
        rolling = F.col("calc").startswith("rolling4q")
        same = F.col("calc").isin(list(C.SAME_SUB_PERIOD))
        s = s.filter(F.when(rolling, F.col("sub") == 12).when(same, F.col("sub") == F.col("last_sub")).otherwise(F.col("sub") <= F.col("last_sub")))
        ends = s.groupBy("key", "year").agg(F.max("k").alias("k"))
        s = s.join(ends, ["key", "year", "k"], "left_semi")
        return self._shown(s.withColumn("year", F.col("year").cast("string")), "year", "period")

    def quarters(self, start: str) -> DataFrame:
        """(key, level, code, quarter, value): rolling figures at every window end from ``start`` on."""
        s = self.series().join(self._keys(ROLLING), "key", "left_semi").filter(F.col("k") >= P.period_order(F.lit(start)))
        quarter = F.concat(F.floor(F.col("k") / 100).cast("string"), F.lit("K"), (F.pmod("k", F.lit(100)) / 3).cast("int").cast("string"))
        return self._shown(s.withColumn("quarter", quarter), "quarter")

    def warning_rows(self) -> DataFrame:
        return self.spark.createDataFrame(self.warnings, "key string, message string")

    def report(self) -> DataFrame:
        """(key, areas, message) of every entry, broken ones too: how many areas have a live figure, and why none has."""
        figures = self.live().filter("value is not null").groupBy("key").agg(F.count(F.lit(1)).alias("areas"))
        good = self.spark.createDataFrame([(e.spec.key,) for e in self.entries], "key string")
        told = F.when(F.col("areas").isNull(), "no figure at the newest period")
        return good.join(figures, "key", "left").select("key", F.coalesce("areas", F.lit(0).cast("long")).alias("areas"), told.alias("message")).unionByName(
            self.warning_rows().select("key", F.lit(0).cast("long").alias("areas"), "message"))

    def _snapshot_rows(self) -> DataFrame:
        """All fields of a kind in one pass over its table; snapshots have no history."""
        out = self.spark.createDataFrame([], "key string, level string, code string, period string, value double")
        for kind, snap in self.snapshots.items():
            own = [e for e in self.entries if e.spec.calc == kind]
            if not own:
                continue
            rows = [F.struct(F.lit(e.spec.key).alias("key"), F.lit(e.spec.level).alias("want"), (F.col(e.column or e.spec.key).cast("double") / e.spec.display_div).alias("value")) for e in own]
            long = snap.df.select("level", "code", F.explode(F.array(*rows)).alias("x")).filter("x.value is not null and level = x.want")
            out = out.unionByName(long.select("x.key", "level", F.col("code").cast("string").alias("code"), F.lit(snap.period).alias("period"), "x.value"))
        return out


def _fault(e: Entry, cubes: dict[str, Cube], snapshots: dict[str, Snapshot]) -> str | None:
    """Why an entry can't be computed; null if it can."""
    s = e.spec
    if s.calc in SNAPSHOT_KINDS:
        if s.calc not in snapshots:
            return f"no snapshot of {s.calc}"
        column = e.column or s.key
        return None if column in snapshots[s.calc].df.columns else f"{s.calc} has no field {column}"
    if s.calc not in C.CALCS:
        return f"unknown calculation {s.calc}"
    if s.calc in ("share_of_total", "discount_pct") and not s.share:
        return f"{s.calc} has no share codes"
    needs_den = s.calc in RATIO or s.calc in ROLLING - {"rolling4q_yoy_pct"}
    for role, name, dims in (("num", e.num, _dimensions(e)), *((("den", e.den, set(s.den_select or {})),) if needs_den else ())):
        if name not in cubes:
            return f"no cube {name or '(none named)'} for {role}"
        missing = sorted(dims - set(cubes[name].dims))
        if missing:
            return f"{name} has no dimension {', '.join(missing)}"
    return None


def compile_registry(spark: SparkSession, cubes: dict[str, Cube], entries: Sequence[Entry], snapshots: dict[str, Snapshot] | None = None) -> Registry:
    """Check the entries and fold every cube they use, once each. An entry that can't be computed becomes a warning; two entries
    of one key are an error of the registry."""
    keys = [e.spec.key for e in entries]
    if len(set(keys)) < len(keys):
        raise ValueError(f"keys used twice: {sorted({k for k in keys if keys.count(k) > 1})}")
    snapshots, warnings, good = snapshots or {}, [], []
    for e in entries:
        fault = _fault(e, cubes, snapshots)
        if fault:
            warnings.append((e.spec.key, fault))
        else:
            good.append(e)
    uses: dict[str, list[tuple[Entry, str]]] = {}
    for e in good:
        if e.spec.calc in SNAPSHOT_KINDS:
            continue
        uses.setdefault(e.num, []).append((e, "num"))
        if e.spec.calc in RATIO or e.spec.calc in ROLLING - {"rolling4q_yoy_pct"}:
            uses.setdefault(e.den, []).append((e, "den"))
    # written once: every family below reads the folded cells, none reads a cube
    parts = [cut_lineage(fold(name, cubes[name], some)) for name, some in uses.items()]
    folded = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], _CELL))
    return Registry(spark, good, folded, snapshots, warnings)


def merged(values: DataFrame, members: DataFrame, level: str) -> DataFrame:
    """Figures of a level whose codes are merged into areas: the mean weighted by population, 1 where none is known.
    ``members``: (code, area, weight), one row per code."""
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    own = values.filter((F.col("level") == level) & F.col("value").isNotNull()).join(members, "code")
    keys = [c for c in values.columns if c not in ("code", "value")]
    mean = own.groupBy(*keys, "area").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value")).withColumnRenamed("area", "code")
    return values.filter(F.col("level") != level).unionByName(mean)
