"""Checks that return the offending rows; a caller decides whether to stop or to report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_monotone(df: DataFrame, entity: Sequence[str], order: Column, value: str) -> DataFrame:
    """Rows whose value is below the one before it in the given order."""
    w = Window.partitionBy(*entity).orderBy("_o")  # a handful of horizons per entity
    return df.withColumn("_o", order).withColumn("prev", F.lag(value).over(w)).filter(F.col(value) < F.col("prev")).drop("_o")


def missing_keys(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that do not occur."""
    return expected.select(*keys).distinct().join(actual.select(*keys).distinct(), list(keys), "left_anti")


def key_difference(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, marked ``missing`` or ``unexpected``."""
    return missing_keys(expected, actual, keys).withColumn("side", F.lit("missing")).unionByName(
        missing_keys(actual, expected, keys).withColumn("side", F.lit("unexpected"))
    )


def expected_grid(axes: DataFrame, lists: dict[str, Sequence[str]]) -> DataFrame:
    """Expected keys: every row of ``axes`` with every combination of the short literal lists."""
    for name, values in lists.items():
        axes = axes.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return axes


def sum_mismatch(parts: DataFrame, totals: DataFrame, keys: Sequence[str], tolerance: Column | float, value: str = "value") -> DataFrame:
    """Groups whose parts do not add up to the published total within the tolerance."""
    tol = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    s = parts.groupBy(*keys).agg(F.sum(value).alias("parts"))
    t = totals.select(*keys, F.col(value).alias("total"))
    return s.join(t, list(keys)).withColumn("gap", F.col("parts") - F.col("total")).filter(F.abs("gap") > tol)


def cell_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value", tolerance: float = 0.0) -> DataFrame:
    """Full outer comparison of two builds: cells that differ or exist on one side only."""
    left = a.select(*keys, F.col(value).alias("a_value"), F.lit(True).alias("in_a"))
    right = b.select(*keys, F.col(value).alias("b_value"), F.lit(True).alias("in_b"))
    j = left.join(right, list(keys), "full_outer")
    same = F.col("a_value").eqNullSafe(F.col("b_value"))
    if tolerance:
        same = same | F.coalesce(F.abs(F.col("a_value") - F.col("b_value")) <= tolerance, F.lit(False))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return j.filter(~(both & same)).select(
        *keys, "a_value", "b_value",
        F.when(both, "changed").when(F.col("in_a").isNotNull(), "only_a").otherwise("only_b").alias("status"),
    )


def duplicate_cells(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells that occur more than once (overlapping pulls)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def union_refusing_duplicates(chunks: Sequence[DataFrame], keys: Sequence[str], forbidden: Column | None = None) -> DataFrame:
    """Union of pull chunks; a cell in two chunks, or a forbidden code, stops the job.

    The check is part of the plan: the offending row raises when it is computed, so no
    separate pass over the data is needed.
    """
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    if forbidden is not None:
        ok = F.when(~forbidden, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("forbidden code in cell "), F.concat_ws("/", *keys))).cast("boolean"))
        out = out.filter(ok)
    others = [c for c in out.columns if c not in keys]
    folded = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    once = F.when(F.col("_n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("cell in more than one pull: "), F.concat_ws("/", *keys))).cast("boolean")
    )
    return folded.filter(once).drop("_n")


def incomplete_groups(df: DataFrame, keys: Sequence[str], part: str, expected: int) -> DataFrame:
    """Groups that do not have the expected number of distinct parts."""
    return df.groupBy(*keys).agg(F.countDistinct(part).alias("parts")).filter(F.col("parts") != expected)


def outside_bounds(df: DataFrame, value: str, low: Column | float, high: Column | float) -> DataFrame:
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return df.filter(~F.col(value).between(lo, hi))


def join_gap(projected: DataFrame, observed: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """Difference of two series in the year they share, per key."""
    p = projected.filter(F.col("year") == year).select(*keys, F.col("value").alias("projected"))
    o = observed.filter(F.col("year") == year).select(*keys, F.col("value").alias("observed"))
    return p.join(o, list(keys)).withColumn("gap", F.col("projected") - F.col("observed"))


def _grams(text: Column) -> Column:
    """All substrings of one to three characters, each once."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def _inside(small: DataFrame, large: DataFrame, on: list[str]) -> DataFrame:
    """(on, s, l): strings ``s`` that occur in a string ``l`` of the same group. Each looks under its rarest gram of three characters (or all
    it has) in an index of the others' grams, so only those that share it are compared."""
    index = large.select(*on, F.col("t").alias("l"), F.explode(_grams(F.col("t"))).alias("g"))
    often = index.groupBy(*on, "g").agg(F.count(F.lit(1)).alias("n"))
    widest = F.least(F.length("t"), F.lit(3))
    own = small.select(*on, F.col("t").alias("s"), F.explode(F.filter(_grams(F.col("t")), lambda g: F.length(g) == widest)).alias("g"))
    rarest = own.join(often, [*on, "g"], "left").groupBy(*on, "s").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), F.col("g"))).alias("g"))
    return rarest.join(index, [*on, "g"]).filter(F.contains("l", F.col("s"))).select(*on, "s", "l")


def unknown_codes(config: DataFrame, code_list: DataFrame) -> DataFrame:
    """Configured codes (table, var, code) that the code list lacks, with the known codes of that variable that contain
    the same text, or are contained in it, as hints. Letters' case doesn't matter; an empty code has no hints."""
    on = ["table", "var"]
    known = code_list.select(*on, "code").distinct()
    bad = config.select(*on, "code").distinct().join(known, [*on, "code"], "left_anti")
    low = lambda df: df.select(*on, F.lower("code").alias("t")).filter("t <> ''").distinct()
    wrong, right = low(bad), low(known)
    pairs = _inside(wrong, right, on).select(*on, F.col("s").alias("b"), F.col("l").alias("k")).unionByName(
        _inside(right, wrong, on).select(*on, F.col("l").alias("b"), F.col("s").alias("k"))).distinct()
    spelled = known.withColumn("k", F.lower("code")).withColumnRenamed("code", "hint")
    hints = pairs.join(spelled, [*on, "k"]).groupBy(*on, "b").agg(F.array_join(F.sort_array(F.collect_set("hint")), ",").alias("hints"))
    return bad.withColumn("b", F.lower("code")).join(hints, [*on, "b"], "left").select(*on, "code", "hints")


def formula_audit(indicators: DataFrame, formulas: DataFrame) -> DataFrame:
    """Indicators without a recorded formula, formulas without an indicator, and formulas
    that rest on an assumption."""
    j = indicators.select("key", F.lit(True).alias("used")).join(
        formulas.select("key", "assumption", F.lit(True).alias("recorded")), "key", "full_outer")
    finding = (
        F.when(F.col("recorded").isNull(), "no formula").when(F.col("used").isNull(), "unused formula")
        .when(F.coalesce("assumption", F.lit("")) != "", "assumption")
    )
    return j.select("key", finding.alias("finding")).filter(F.col("finding").isNotNull())
