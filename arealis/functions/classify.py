"""Predicates, classes and flags as column expressions, with their fixed code tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes that stand for the total of a dimension.
TOTAL_CODES = ["IALT", "TOT", "TOTAL", "000", "0", "I alt", "Total"]

# Total codes by dimension of reused pulls.
DIMENSION_TOTALS = {
    "KØN": ["TOT"], "ALDER": ["IALT"], "CIVILSTAND": ["TOT"], "HUSSTØR": ["SUM", "TOT"],
    "ANTBORNH": ["SUM", "TOT"], "ANVEND": ["SUM"], "BYGHERRE": ["SUM"],
}

# Age groups, contiguous from 0.
AGE_GROUPS = [
    ("a0_5", 0, 5), ("a6_16", 6, 16), ("a17_19", 17, 19), ("a20_34", 20, 34),
    ("a35_64", 35, 64), ("a65_79", 65, 79), ("a80p", 80, 999),
]

# Map-object tags, their category and kind, and the order between categories.
SERVICE_TAGS = [
    ("shop", "supermarket", "grocery", "supermarket"),
    ("shop", "convenience", "grocery", "convenience"),
    ("amenity", "restaurant", "food", "restaurant"),
    ("amenity", "cafe", "food", "cafe"),
    ("amenity", "bar", "food", "bar"),
    ("amenity", "fast_food", "food", "fast_food"),
    ("amenity", "pharmacy", "pharmacy", "pharmacy"),
]
SERVICE_ORDER = ["grocery", "pharmacy", "food"]

# Timetable route types and the ones left out.
ROUTE_MODES = {"1": "metro", "109": "s-train", "2": "rail", "0": "light-rail", "3": "bus", "700": "bus"}
EXCLUDED_ROUTES = {"715": "flextur (demand-responsive)", "4": "ferry"}

# Public building use codes by category, and developer codes.
PUBLIC_CATEGORY = {
    "education": ["420", "421", "422", "429"],
    "institutions": ["440", "441", "442", "443", "444", "449"],
    "health": ["430", "431", "432", "433", "439"],
    "culture": ["410", "411", "412", "413", "414", "415", "416", "419"],
}
DEVELOPER = {"1": "Private", "2": "Almennyttigt boligselskab", "3": "Kommune", "4": "Region", "5": "Stat", "6": "Andet"}

# Dwelling unit types, and the status of a current unit.
DWELLING_TYPES = ["1", "2", "3", "4", "5"]
CURRENT_STATUS = "6"

# Thresholds.
MIN_GROWTH_POPULATION = 300
SMALL_BASE = 1000
DEFINITION_GAP = 15.0
RECENT_YEARS = 3.0
KDKK_LIMIT = 10000
PROJECT_STATUS_ORDER = {"construction": 0, "decided": 1, "study": 2, "opened": 3}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(x: Column | str, table: dict[str, str | int], default: Column | None = None) -> Column:
    """Code-list classification through a literal map."""
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    hit = F.element_at(m, _c(x))
    return hit if default is None else F.coalesce(hit, default)


def all_totals(dims: Sequence[str], totals: Sequence[str] = TOTAL_CODES) -> Column:
    test = F.lit(True)
    for d in dims:
        test = test & F.col(d).isin(list(totals))
    return test


def totals_by_dimension(columns: Sequence[str], table: dict[str, list[str]] = DIMENSION_TOTALS) -> Column:
    """Only the dimensions that are present are held to their own total codes."""
    test = F.lit(True)
    for d in columns:
        if d in table:
            test = test & F.col(d).isin(table[d])
    return test


def is_municipality(code: Column | str) -> Column:
    c = _c(code)
    return c.rlike(r"^[0-9]{3}$") & c.try_cast("int").between(101, 899) & ~F.startswith(c, F.lit("08"))


def district_level(code: Column | str, city: str = "1") -> Column:
    c = _c(code)
    return (
        F.when(c == city, "city").when(F.length(c) == 5, "kvarter")
        .when(F.startswith(c, F.lit("1")), "bydel").otherwise("lokaludvalg")
    )


def age_group(code: Column | str) -> Column:
    """Age code to group; an open-ended ``100-`` belongs to the last, totals to none."""
    digits = F.regexp_replace(_c(code), "-+$", "")
    age = F.when(digits.rlike("^[0-9]+$"), digits.try_cast("int"))
    out = F.lit(None).cast("string")
    for key, lo, hi in reversed(AGE_GROUPS):
        out = F.when(age.between(lo, hi), key).otherwise(out)
    return out


def step_class(x: Column, edges: Sequence[float]) -> Column:
    """0-based class of a number: the count of edges at or below it."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(x < edges[i], i).otherwise(out)
    return F.when(x.isNotNull(), out)


def rooms_class(rooms: Column) -> Column:
    return F.when(rooms > 0, F.least(F.floor(rooms), F.lit(4)).cast("int") - 1)


def size_class(m2: Column) -> Column:
    return F.when(m2 > 0, step_class(m2, [50, 80, 120]))


def built_class(year: Column) -> Column:
    return F.when((year > 1000) & (year <= 2100), step_class(year, [1950, 1980, 2010]))


def building_type_class(use: Column) -> Column:
    known = F.coalesce(use, F.lit("")) != ""
    return F.when(
        known,
        F.when(use.isin("110", "120", "121", "122"), 0).when(use.isin("130", "131", "132"), 1)
        .when(use == "140", 2).otherwise(3),
    )


def depth_class(depth_m: Column) -> Column:
    return F.when(depth_m > 0, F.when(depth_m <= 0.5, 1).when(depth_m <= 1.0, 2).otherwise(3))


def age_years(iso: Column, today: Column) -> Column:
    """Years since an ISO date, one decimal."""
    return F.round(F.datediff(today, F.to_date(F.substring(iso, 1, 10))) / 365.25, 1)


def is_recent(permit: Column, case_date: Column, today: Column, years: float = RECENT_YEARS) -> Column:
    """Permit date, else case date, is at most ``years`` old; false when neither is known."""
    return F.coalesce(age_years(F.coalesce(permit, case_date), today) <= years, F.lit(False))


def guard_growth(value: Column, population: Column) -> Column:
    """Growth in percent means nothing on a tiny base."""
    return F.when(F.coalesce(population, F.lit(0)) >= MIN_GROWTH_POPULATION, value)


def small_base(base: Column) -> Column:
    return F.when(base.isNotNull(), base < SMALL_BASE)


def definitions_disagree(a: Column, b: Column, limit: float = DEFINITION_GAP) -> Column:
    return F.coalesce(F.abs(a - b) > limit, F.lit(False))


def period_type(period: Column, kind: Column | None = None) -> Column:
    p = F.trim(F.coalesce(period, F.lit("")))
    out = (
        F.when(p.rlike(r"^\d{4}$"), "year").when(p.rlike(r"^\d{4}K\d$"), "quarter")
        .when(p.rlike(r"^\d{4}M\d{2}$"), "month").when(p.rlike(r"\d{4}\s*/\s*\d{4}"), "school_year")
        .when(p.rlike(r"\d{4}(K\d)?\s*[-–—→]\s*\d{4}"), "window").otherwise("snapshot")
    )
    if kind is None:
        return out
    return F.when(kind.isin("horizon", "projection", "snapshot"), kind).otherwise(out)


def is_derived(fmt: Column, unit: Column, climate_kind: Column) -> Column:
    """A figure that is arithmetic on published cells rather than a cell of its own."""
    return (
        (F.coalesce(fmt, F.lit("")) == "per1000")
        | F.coalesce(unit, F.lit("")).rlike(r"per 1,000|/\s*1,000")
        | (F.coalesce(climate_kind, F.lit("")) == "service_layer")
    )


def value_type(inherited: Column, kind: Column, horizon: Column, projected: Column, derived: Column) -> Column:
    plain = F.when(derived, "derived").otherwise("actual")
    later = horizon.isNotNull() & (horizon != "") & (horizon != "today")
    return (
        F.when(F.coalesce(inherited, F.lit(False)), "inherited")
        .when(kind == "horizon", F.when(later, "projection").otherwise(plain))
        .when(F.coalesce(projected, F.lit(False)) | F.coalesce(kind == "projection", F.lit(False)), "projection")
        .otherwise(plain)
    )


def unit_text(fmt: Column, unit: Column) -> Column:
    """A figure stored in DKK says DKK, whatever the registry's short unit says."""
    plain = F.replace(F.coalesce(unit, F.lit("")), F.lit("kDKK"), F.lit("DKK"))
    fixed = F.when(plain == "", "DKK").otherwise(plain)
    return F.when(F.coalesce(fmt, F.lit("")) == "kdkk", fixed).otherwise(F.coalesce(unit, F.lit("")))


def unit_value(fmt: Column, unit: Column, value: Column) -> Column:
    thousand = (F.coalesce(fmt, F.lit("")) != "kdkk") & F.contains(F.coalesce(unit, F.lit("")), F.lit("kDKK"))
    return F.when(thousand & (F.abs(value) >= KDKK_LIMIT), value / 1000).otherwise(value)


def own_or_inherited(level: Column, own_key: Column, indicator_level: Column, has_postcode: Column) -> Column:
    """Which level a figure is read from: empty for its own, ``postnr`` or ``muni``."""
    return (
        F.when((level == "kommune") | own_key, "")
        .when(level == "postnr", F.when(indicator_level == "postnr", "").otherwise("muni"))
        .when(level == "kvarter", F.when(has_postcode & (indicator_level == "postnr"), "postnr").otherwise("muni"))
        .otherwise("")
    )


def service_class(tags: Column) -> Column:
    """Tags map to struct(cat, sub, n_hits): several matching tags count once, by category order."""
    hits = []
    for cat in SERVICE_ORDER:
        for key in ("shop", "amenity"):
            for k, v, c, s in SERVICE_TAGS:
                if c == cat and k == key:
                    hits.append((F.element_at(tags, F.lit(k)) == v, c, s))
    out, n = F.lit(None), F.lit(0)
    for test, c, s in reversed(hits):
        out = F.when(test, F.struct(F.lit(c).alias("cat"), F.lit(s).alias("sub"))).otherwise(out)
        n = n + F.coalesce(test, F.lit(False)).cast("int")
    return F.when(out.isNotNull(), F.struct(out.cat.alias("cat"), out["sub"].alias("sub"), n.alias("n_hits")))


def pressure_band(vacant: Column, notice: Column, units: Column) -> Column:
    """Vacancy pressure of a property in three bands; units default to 20."""
    p = pressure(vacant, notice, units)
    return F.when(p > 0.12, "high").when(p > 0.06, "medium").otherwise("low")


def pressure(vacant: Column, notice: Column, units: Column) -> Column:
    n = F.when(F.coalesce(units, F.lit(0)) == 0, F.lit(20)).otherwise(units)
    return (F.coalesce(vacant, F.lit(0)) + F.coalesce(notice, F.lit(0))) / F.greatest(F.lit(1), n)
