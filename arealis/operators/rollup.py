"""Roll-ups to areas: weighted means, building-stock profiles, school and public-building
aggregates. One pass serves several area levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K


def merged_codes(areas: DataFrame, code: str = "area") -> DataFrame:
    """(code, area): one row per original code of a merged area."""
    return areas.select(F.col(code).alias("area"), F.explode("codes").alias("code"))


def population_weight(pop: Column) -> Column:
    """Missing or zero population counts as one person, so a small code is never dropped."""
    return F.when(F.coalesce(pop, F.lit(0)) == 0, F.lit(1.0)).otherwise(pop)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean over rows that have a value; a missing or non-positive weight counts as 1."""
    w = F.when(F.coalesce(weight, F.lit(0)) > 0, weight).otherwise(F.lit(1.0))
    has = value.isNotNull()
    return F.sum(F.when(has, value * w)) / F.sum(F.when(has, w))


def to_merged_areas(values: DataFrame, codes: DataFrame, population: DataFrame, by: Sequence[str] = ("key", "period")) -> DataFrame:
    """Population-weighted mean of the codes that make up an area.

    values(code, value, by...), codes(code, area), population(code, pop).
    """
    j = values.filter(F.col("value").isNotNull()).join(codes, "code").join(population, "code", "left")
    w = population_weight(F.col("pop"))
    return j.groupBy("area", *by).agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"))


def at_levels(df: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Rows once per area level they belong to: adds level and code, unknown codes dropped."""
    arr = F.array(*[F.struct(F.lit(name).alias("level"), F.col(c).cast("string").alias("code")) for name, c in levels.items()])
    return df.withColumn("_a", F.explode(arr)).withColumns({"level": F.col("_a.level"), "code": F.col("_a.code")}).drop("_a").filter(
        F.col("code").isNotNull()
    )


def _pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits))


def stock_profile(units: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Building-stock profile per level and area.

    units: building, tenure ('1' rented, '2' owned, '3' vacant), m2, rooms, built, use, plus
    one column per level. Units are added up per building first, so what is repeated per level
    and shuffled again is a row per building, and distinct buildings are counted exactly by
    counting those rows.
    """
    known = F.col("tenure").isin("1", "2", "3")
    m2, year = F.col("m2"), F.col("built")
    has_m2, has_year = m2 > 0, (year > 1000) & (year <= 2100)
    typed = F.coalesce("use", F.lit("")) != ""
    sums = {
        "n": F.count(F.lit(1)), "known": F.count_if(known), "rent": F.count_if(F.col("tenure") == "1"), "vac": F.count_if(F.col("tenure") == "3"),
        "m2n": F.count_if(has_m2), "m2sum": F.sum(F.when(has_m2, m2)), "small": F.count_if(has_m2 & (m2 < 50)),
        "yearn": F.count_if(has_year), "new": F.count_if(has_year & (year >= 2010)), "typen": F.count_if(typed), "flats": F.count_if(F.col("use") == "140"),
    }
    classes = {"rooms": K.rooms_class(F.col("rooms")), "built": K.built_class(year), "size": K.size_class(m2), "type": K.building_type_class(F.col("use"))}
    # classes are worked out once per unit, then only counted
    classed = units.withColumns({f"_{k}": c for k, c in classes.items()})
    sums |= {f"{k}{i}": F.count_if(F.col(f"_{k}") == i) for k in classes for i in range(4)}
    own = classed.groupBy("building", *dict.fromkeys(levels.values())).agg(*[v.alias(f"s_{k}") for k, v in sums.items()])
    add = [F.sum(f"s_{k}").alias(f"s_{k}") for k in sums]
    per_building = at_levels(own, levels).groupBy("level", "code", "building").agg(*add)
    a = per_building.groupBy("level", "code").agg(F.count("building").alias("n_bld"), *add)
    s = lambda k: F.col(f"s_{k}")
    return a.select(
        "level", "code", s("n").alias("n"), "n_bld",
        _pct(s("rent"), s("known")).alias("renters_pct"), _pct(s("vac"), s("known")).alias("vacant_pct"),
        F.when(s("m2n") > 0, F.round(s("m2sum") / s("m2n"), 1)).alias("avg_m2"), _pct(s("small"), s("m2n")).alias("small_pct"),
        _pct(s("new"), s("yearn")).alias("new_pct"), _pct(s("flats"), s("typen")).alias("flats_pct"),
        F.when(F.col("n_bld") > 0, F.round(s("n") / F.col("n_bld"), 1)).alias("dw_per_bld"),
        *[F.array(*[s(f"{k}{i}") for i in range(4)]).alias(f"{k}_bins") for k in classes],
    )


def building_profiles(units: DataFrame, min_units: int = 2) -> DataFrame:
    """Per building with at least ``min_units`` dwellings: shares, mean size and room bins."""
    known = F.col("tenure").isin("1", "2", "3")
    has_m2 = F.col("m2") > 0
    m2n = F.count_if(has_m2)
    rooms = K.rooms_class(F.col("rooms"))
    agg = units.groupBy("building").agg(
        F.count(F.lit(1)).alias("dwellings"),
        _pct(F.count_if(F.col("tenure") == "1"), F.count_if(known), 0).alias("rented_pct"),
        _pct(F.count_if(F.col("tenure") == "3"), F.count_if(known), 0).alias("vacant_pct"),
        F.when(m2n > 0, F.round(F.sum(F.when(has_m2, F.col("m2"))) / m2n, 0)).alias("avg_m2"),
        *[F.count_if(rooms == i).alias(f"rooms{i + 1}") for i in range(4)],
        _pct(F.count_if(has_m2 & (F.col("m2") < 50)), m2n, 0).alias("small_pct"),
    )
    return agg.filter(F.col("dwellings") >= min_units)


def public_index(buildings: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Per level and area: existing and recent cases per category, floor area, stale cases.

    buildings: cat, kind ('existing'/'case'), recent, m2. The long list of recent cases stays
    rows (``recent_cases``): an area may hold any number of them.
    """
    b = at_levels(buildings, levels)
    ex, rec = F.col("kind") == "existing", (F.col("kind") == "case") & F.coalesce("recent", F.lit(False))
    return b.groupBy("level", "code", "cat").agg(
        F.count_if(ex).alias("existing"), F.count_if(rec).alias("recent"),
        F.count_if(~ex & ~rec).alias("stale"), F.sum(F.when(ex, F.coalesce("m2", F.lit(0.0))).otherwise(0.0)).alias("m2_existing"),
    )


def recent_cases(buildings: DataFrame, levels: dict[str, str]) -> DataFrame:
    """The recent cases of every area as rows; a sink sorts them by permit, newest first."""
    rec = (F.col("kind") == "case") & F.coalesce("recent", F.lit(False))
    return at_levels(buildings.filter(rec), levels).select("level", "code", "id", "name", "cat", "permit")


def school_areas(schools: DataFrame, levels: dict[str, str], types: Sequence[str]) -> DataFrame:
    """School aggregates per area. Each measure is weighted by its own denominator; schools
    outside ``types`` count only in the total.

    schools: type, pupils, grade, grade_n, socref, trivsel, trivsel_n.
    """
    s = at_levels(schools, levels)
    keep = F.col("type").isin(list(types))
    n = F.count_if(keep)

    def mean(v: str, w: str) -> Column:
        weight = F.when(F.coalesce(F.col(w), F.lit(0)) != 0, F.col(w)).otherwise(F.col("pupils"))
        return F.round(weighted_mean(F.when(keep, F.col(v)), weight), 2)

    pupils = F.sum(F.when(keep, F.coalesce("pupils", F.lit(0))))
    some = F.when(pupils > 0, pupils)
    return s.groupBy("level", "code").agg(
        n.alias("schools_n"), F.count(F.lit(1)).alias("schools_all_n"), some.alias("pupils"),
        mean("grade", "grade_n").alias("grade_avg"), mean("socref", "grade_n").alias("socref_diff"),
        mean("trivsel", "trivsel_n").alias("trivsel"),
        F.when(n > 0, F.round(F.count_if(keep & F.col("grade").isNotNull()) * 100.0 / n, 1)).alias("grade_share"),
        F.when((n > 0) & (pupils > 0), F.round(pupils / n, 0)).alias("pupils_per_school"),
    )


def origin_split(pupils: DataFrame) -> DataFrame:
    """Pupils of majority and minority origin per school and year; unknown in neither."""
    v, h = F.col("value"), F.col("origin")
    return pupils.filter(v.isNotNull()).groupBy("school", "year").agg(
        F.sum(F.when(h == "Dansk", v)).alias("majority"),
        F.sum(F.when(h.isin("Indvandrer", "Efterkommer"), v)).alias("minority"),
    )


def to_institution(branches: DataFrame, register: DataFrame) -> DataFrame:
    """Branch figures rolled up to their institution: pupil-weighted means, and the verdict
    only where all branches that have one agree.

    branches: branch, year, pupils, ratio, verdict; register: nr, parent.
    """
    home = institution_of(register)
    j = branches.join(home, branches.branch == home.nr, "left").withColumn("school", F.coalesce("institution", "branch"))
    known = register.select(F.col("nr").alias("school"))
    verdict = F.nullif(F.trim("verdict"), F.lit(""))
    return j.join(known, "school", "left_semi").groupBy("school", "year").agg(
        F.round(weighted_mean(F.col("ratio"), F.col("pupils")), 2).alias("ratio"), F.count(F.lit(1)).alias("branches"),
        F.when(F.min(verdict) == F.max(verdict), F.min(verdict)).alias("verdict"),
    )


def institution_of(register: DataFrame) -> DataFrame:
    """(nr, institution): the parent where it is itself registered, else the row's own number."""
    parents = register.select(F.col("nr").alias("parent"), F.lit(True).alias("_known"))
    return register.select("nr", "parent").join(parents, "parent", "left").select(
        "nr", F.when(F.col("_known"), F.col("parent")).otherwise(F.col("nr")).alias("institution")
    )


def project_index(serving: DataFrame) -> DataFrame:
    """Per area: projects, those not yet opened, and planned stations.

    serving: level, code, id, status, is_station.
    """
    planned = F.col("status") != "opened"
    return serving.groupBy("level", "code").agg(
        F.count(F.lit(1)).alias("projects"), F.count_if(planned).alias("upcoming"),
        F.count_if(planned & F.col("is_station")).alias("stations_planned"),
    )


def per_1000(df: DataFrame, amount: str, population: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """An amount per 1,000 inhabitants; no figure without inhabitants."""
    j = df.join(population, list(on), "left")
    return j.withColumn(name, F.when(F.col("pop") > 0, F.col(amount) / F.col("pop") * 1000)).drop("pop")


def coverage_counts(units: DataFrame, register: DataFrame, by: str) -> DataFrame:
    """Against the register, not the response: covered and missing units per type."""
    seen = units.filter(F.col("value").isNotNull()).select(F.col("unit").alias("nr")).distinct().withColumn("_seen", F.lit(1))
    return register.join(seen, "nr", "left").groupBy(by).agg(
        F.count(F.lit(1)).alias("registered"), F.count("_seen").alias("covered"),
        (F.count(F.lit(1)) - F.count("_seen")).alias("missing"),
    )
