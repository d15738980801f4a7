"""Joins of register entities: units, buildings, cases, addresses, schools and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import parsing as P
from ..functions import text as X


def dwellings(units: DataFrame, status: bool = False) -> DataFrame:
    """Units of a dwelling type, optionally the current ones only."""
    out = units.filter(F.col("enh023Boligtype").isin(K.DWELLING_TYPES))
    return out.filter(F.col("status") == K.CURRENT_STATUS) if status else out


def with_building(units: DataFrame, buildings: DataFrame, on: str = "building") -> DataFrame:
    """Units with their building's columns; units without a building stay."""
    return units.join(buildings, on, "left")


def first_known(own: Column, *others: Column) -> Column:
    """Own value, else the next source's."""
    return F.coalesce(own, *others)


def addresses(house: DataFrame, street: DataFrame, postcode: DataFrame) -> DataFrame:
    """(house, address): house number to street and postal code, either of which may be unknown."""
    j = house.join(street, "street_id", "left").join(postcode, "postcode_id", "left")
    return j.select("house_id", P.address_text(F.col("street"), F.col("number"), F.col("postcode"), F.col("town")).alias("address"))


def property_numbers(building_plot: DataFrame, plots: DataFrame, properties: DataFrame) -> DataFrame:
    """(building, property): building to plot to property."""
    return building_plot.join(plots, "plot_id").join(properties, "property_id").select("building", "property_no")


def cases_by_building(links: DataFrame, cases: DataFrame, buildings: DataFrame) -> DataFrame:
    """(building, case...): a link may name a building in either of two columns; each pair of
    building and case once, only for known buildings."""
    long = links.select("case_id", F.explode(F.array_distinct(F.array("own_building", "object_building"))).alias("building"))
    pairs = long.filter(F.col("building").isNotNull()).distinct()
    return pairs.join(cases, "case_id").join(buildings.select("building").distinct(), "building", "left_semi")


def open_cases(cases: DataFrame, closed: list[str]) -> DataFrame:
    """Newest open case per building: expected completion, then permit, then case date."""
    live = cases.filter((F.coalesce("completed", F.lit("")) == "") & ~F.coalesce("status", F.lit("")).isin(closed))
    key = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("expected", "permit", "case_date")], F.col("case_id").alias("_id"))
    cols = [c for c in live.columns if c != "building"]
    return live.groupBy("building").agg(F.max_by(F.struct(*cols), key).alias("_c")).select("building", "_c.*")


def public_building_cases(buildings: DataFrame, cases: DataFrame, today: Column, closed: list[str]) -> DataFrame:
    """Public buildings with kind, category, and age and recency of their open case."""
    cat = F.lit(None).cast("string")
    for name, codes in K.PUBLIC_CATEGORY.items():
        cat = F.when(F.col("use").isin(codes), name).otherwise(cat)
    typed = buildings.withColumn("cat", cat).filter(F.col("cat").isNotNull())
    j = typed.join(open_cases(cases, closed).drop("status"), "building", "left")
    permit = F.coalesce(F.nullif("permit", F.lit("")), F.nullif("case_date", F.lit("")))
    existing = F.col("status") == K.CURRENT_STATUS
    return j.select(
        *buildings.columns, "cat", F.when(existing, "existing").otherwise("case").alias("kind"),
        F.when(~existing, F.substring(permit, 1, 10)).alias("permit_date"),
        F.when(~existing, K.age_years(permit, today)).alias("age_yrs"),
        F.when(~existing, K.is_recent(permit, F.lit(None).cast("string"), today)).alias("recent"),
        F.when(~existing, K.lookup("developer", K.DEVELOPER)).alias("owner"),
    )


def large_buildings(units: DataFrame, n: int = 2) -> DataFrame:
    """Buildings with at least ``n`` units, as a semi-join side."""
    return units.groupBy("building").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= n).select("building")


def by_name(rows: DataFrame, areas: DataFrame, name: str = "name", aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows joined to areas by normalised name, and the rows whose name matched nothing."""

    def keyed(df: DataFrame, col: str) -> DataFrame:
        return X.with_unicode_form(df, col, "_form", "NFKC").withColumn("_key", X.area_name_key(F.col("_form"), aliases)).drop("_form")

    a = keyed(areas, "area_name").select("_key", "code", "area_name")
    r = keyed(rows, name)
    return r.join(a, "_key").drop("_key"), r.join(a, "_key", "left_anti").drop("_key")


def strict_by_name(rows: DataFrame, areas: DataFrame, name: str = "name", aliases: dict[str, str] | None = None) -> DataFrame:
    """As ``by_name``, but the job stops at the first name that matches nothing."""
    hit, miss = by_name(rows, areas, name, aliases)
    stop = F.raise_error(F.concat(F.lit("no area named "), F.col(name))).cast("string")
    bad = miss.withColumns({"code": stop, "area_name": F.lit(None).cast("string")})
    return hit.unionByName(bad)


def district_parents(codes: DataFrame, district: DataFrame, unallocated: dict[str, str]) -> DataFrame:
    """(code, committee, district): ``2LLxx`` lies in committee ``20LL``, whose district comes
    from a small mapping (ll, district); the unallocated quarter has parents of its own."""
    q = codes.filter(F.length("code") == 5).withColumn("ll", F.substring("code", 2, 2))
    free = F.col("code") == unallocated["kvarter"]
    j = q.join(district, "ll", "left")
    return j.select(
        "code", F.when(free, unallocated["lokaludvalg"]).otherwise(F.concat(F.lit("20"), "ll")).alias("committee"),
        F.when(free, unallocated["bydel"]).otherwise(F.col("district")).alias("district"),
    )


def copied_to_children(values: DataFrame, children: DataFrame) -> DataFrame:
    """A parent's figure on every child that has that parent."""
    return children.join(values.withColumnRenamed("code", "parent"), "parent").drop("parent")


def first_school_per_building(links: DataFrame) -> DataFrame:
    """(building, school): the first school wins where campuses overlap."""
    return links.groupBy("building").agg(F.min("school").alias("school"))


def refresh_reference(buildings: DataFrame, links: DataFrame) -> DataFrame:
    """Buildings with their current school; a reference of an earlier build does not survive."""
    return buildings.drop("school").join(first_school_per_building(links), "building", "left")


def with_benchmarks(schools: DataFrame, area: DataFrame, nation: DataFrame) -> DataFrame:
    """School figures beside area and national ones of the measure's own year."""
    a = area.select("area", "year", F.col("value").alias("area_value"))
    n = nation.select("year", F.col("value").alias("national_value"))
    return schools.join(a, ["area", "year"], "left").join(n, "year", "left")


def stations_of(projects: DataFrame) -> DataFrame:
    """(id, stations, upcoming): children of each project, and those not yet opened."""
    kids = projects.filter(F.coalesce("parent", F.lit("")) != "").groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("stations"), F.count_if(F.col("status") != "opened").alias("upcoming")
    )
    zero = F.lit(0).cast("long")
    return projects.join(kids, "id", "left").withColumns({"stations": F.coalesce("stations", zero), "upcoming": F.coalesce("upcoming", zero)})


def project_order() -> list[Column]:
    """Status, opening year (unknown last), name."""
    return [
        F.coalesce(K.lookup("status", K.PROJECT_STATUS_ORDER), F.lit(9)), F.coalesce("open_year", F.lit(9999)), F.col("name"),
    ]


def areas_served(serving: DataFrame) -> DataFrame:
    """(project, level, codes): inverse of the area index; codes as one text, in order.
    Bounded by the number of areas of a level."""
    return serving.groupBy("project", "level").agg(F.array_join(F.sort_array(F.collect_set("code")), " ").alias("codes"))


def names_per_area(members: DataFrame) -> DataFrame:
    """(code, names): names of the risk areas that list an area as a member."""
    each = members.select("name", F.explode("codes").alias("code"))
    return each.groupBy("code").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))


def scenario_bands(cube: DataFrame, mid: str, low: str, high: str, by: list[str]) -> DataFrame:
    """Per area and horizon: mid value, its p10/p90, and the median of the outer scenarios.

    cube: by..., scenario, percentile, value (absolute changes only).
    """

    def pick(scen: str, pct: int) -> Column:
        return F.max(F.when((F.col("scenario") == scen) & (F.col("percentile") == pct), F.col("value")))

    return cube.groupBy(*by).agg(
        pick(mid, 50).alias("value"), pick(mid, 10).alias("p10"), pick(mid, 90).alias("p90"),
        pick(low, 50).alias("low"), pick(high, 50).alias("high"),
    )


def climate_record(areas: DataFrame, coast: DataFrame, bands: DataFrame, claims: DataFrame, designated: DataFrame) -> DataFrame:
    """One row per area with every climate figure, and a reason wherever one is missing."""
    j = (
        areas.join(coast, "code", "left").join(bands, "stretch", "left").join(claims, "code", "left").join(
            designated.select("code", F.lit(1).alias("_d")), "code", "left")
    )
    reason = F.when(F.col("stretch").isNull(), "not coastal").when(F.col("value").isNull(), "no stretch")
    return j.select(
        "code", F.col("stretch").isNotNull().alias("coastal"), "stretch", "value", "p10", "p90", reason.alias("reason"),
        "claims_1000", F.when(F.col("claims_1000").isNull(), "not computed").alias("claims_reason"),
        F.coalesce("_d", F.lit(0)).alias("risk_area"),
    )
