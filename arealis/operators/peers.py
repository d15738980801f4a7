"""Ranks, classes, deltas and lists among peers.

Input is the long indicator table (level, code, key, period, value). A peer pool is a
(key, level, period); positions inside a pool come from ``functions.ranking``, so a pool of
any size is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking as R

POOL = ["key", "level", "period"]


def ranked(values: DataFrame, direction: Column, pool: Sequence[str] = POOL) -> DataFrame:
    """Rank ``#r of n`` and mid-rank percentile, both aware of the indicator's direction."""
    return R.attach_positions(values, pool, "value").withColumns({
        "peer_rank": R.best_first_rank(direction),
        "peers": F.col("n_total"),
        "percentile": R.mid_rank_percentile(direction),
    }).drop("n", "n_less", "n_total")


def _sorted_breaks(candidates: list[Column], keep: Column | None = None) -> Column:
    """Candidates that exceed their predecessor (the first always stays)."""
    arr = F.array(*candidates)
    return F.filter(
        arr,
        lambda b, i: b.isNotNull() & ((i == 0) | (b > F.get(arr, i - 1))) & (F.lit(True) if keep is None else b < keep),
    )


def class_of(value: Column, breaks: Column) -> Column:
    """0-based class: how many breaks lie strictly below the value."""
    return F.when(value.isNotNull(), F.size(F.filter(breaks, lambda b: value > b)))


def quantile_classes(values: DataFrame, pool: Sequence[str] = POOL, fixed: Sequence[float] | None = None) -> DataFrame:
    """Per pool: breaks (quintiles or fixed ones), class count, range. Repeated breaks and
    breaks at the maximum collapse."""
    wanted = {"lo": F.lit(0), "hi": F.col("n_total") - 1}
    wanted |= {f"q{i}": R.nearest_rank(p) for i, p in enumerate((0.2, 0.4, 0.6, 0.8))}
    at = R.value_at(values, pool, "value", wanted)
    cand = [F.lit(float(b)) for b in fixed] if fixed else [F.col(f"q{i}") for i in range(4)]
    return at.select(
        *pool, "lo", "hi", F.col("n_total").alias("n"), _sorted_breaks(cand, F.col("hi")).alias("breaks")
    ).withColumn("classes", F.size("breaks") + 1)


def with_classes(values: DataFrame, scale: DataFrame, pool: Sequence[str] = POOL) -> DataFrame:
    """Every value with its class and its shade in 0..1."""
    j = values.join(scale.select(*pool, "breaks", "classes"), list(pool))
    c = class_of(F.col("value"), F.col("breaks"))
    return j.withColumn("cls", c).withColumn(
        "shade", F.when(F.col("value").isNotNull(), F.when(F.col("classes") > 1, F.col("cls") / (F.col("classes") - 1)).otherwise(0.5))
    ).drop("breaks", "classes")


def diverging_classes(values: DataFrame, center: float, pool: Sequence[str] = POOL) -> DataFrame:
    """Per pool: breaks mirrored around a centre at the 0.34/0.67/0.90 distances, with the
    classes no value falls in cut off at both ends."""
    dev = values.withColumn("dev", F.abs(F.col("value") - center)).filter(F.col("dev") > 0)
    at = R.value_at(dev, pool, "dev", {f"m{i}": R.nearest_rank(p) for i, p in enumerate((0.34, 0.67, 0.90))})
    rng = values.filter(F.col("value").isNotNull()).groupBy(*pool).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n")
    )
    mags = _sorted_breaks([F.col(f"m{i}") for i in range(3)])
    both = at.join(rng, list(pool)).withColumn("mags", mags).withColumn(
        "all",
        F.concat(F.transform(F.reverse("mags"), lambda m: F.lit(center) - m), F.transform("mags", lambda m: F.lit(center) + m)),
    )
    first, last = class_of(F.col("lo"), F.col("all")), class_of(F.col("hi"), F.col("all"))
    mid = F.when(F.lit(center).between(F.col("lo"), F.col("hi")), class_of(F.lit(float(center)), F.col("all")) - first).otherwise(-1)
    return both.select(
        *pool, "lo", "hi", "n", F.slice("all", first + 1, last - first).alias("breaks"),
        (last - first + 1).alias("classes"), first.alias("first"), F.size("all").alias("span"), mid.alias("mid"),
    )


def latest_per_measure(values: DataFrame, entity: Sequence[str], year: str = "period") -> DataFrame:
    """Newest non-null value and its year, per measure: measures may end in different years."""
    v = F.col("value").isNotNull()
    return values.filter(v).groupBy(*entity, "key").agg(
        F.max_by("value", year).alias("latest"), F.max(year).alias("latest_year")
    )


def change(before: Column, after: Column, is_share: Column) -> Column:
    """Percentage points between shares, percent between levels; null on a zero base."""
    return F.when(is_share, after - before).when(before != 0, (after / before - 1) * 100)


def deltas(values: DataFrame, is_share: Column, entity: Sequence[str] = ("level", "code")) -> DataFrame:
    """Change on the pool's previous published year, since its first, and against the median."""
    keys = ["key", "level"]
    years = values.filter(F.col("value").isNotNull()).select(*keys, "period").distinct()
    w = Window.partitionBy(*keys).orderBy("period")  # bounded by the number of years
    axis = years.select(*keys, "period", F.lag("period").over(w).alias("prev"), F.first("period").over(w).alias("start"))
    med = R.medians(values, POOL, "value")
    own = values.select(*entity, "key", F.col("period").alias("_p"), F.col("value").alias("_v"))
    j = values.join(axis, [*keys, "period"]).join(med.select(*POOL, "median"), POOL, "left")
    for when, name in (("prev", "_prev"), ("start", "_start")):
        part = own.select(*entity, "key", F.col("_p").alias(when), F.col("_v").alias(name))
        j = j.join(part, [*entity, "key", when], "left")
    return j.select(
        *dict.fromkeys([*entity, "level"]), "key", "period", "value",
        change(F.col("_prev"), F.col("value"), is_share).alias("yoy"),
        F.when(F.col("start") != F.col("period"), change(F.col("_start"), F.col("value"), is_share)).alias("since_first"),
        change(F.col("median"), F.col("value"), is_share).alias("vs_median"),
    )


def last_years(values: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` years up to each series' newest."""
    newest = values.groupBy("key").agg(F.max(F.col("period").cast("int")).alias("_max"))
    return values.join(newest, "key").filter(F.col("period").cast("int") >= F.col("_max") - n).drop("_max")


def chart_series(values: DataFrame, chosen: DataFrame, national: DataFrame) -> DataFrame:
    """Own lines of the chosen areas, the median of their peers and the national line, each
    point with the previous one."""
    own = values.join(chosen.select("level", "code"), ["level", "code"], "left_semi").select(
        F.lit("area").alias("kind"), "key", F.concat_ws(":", "level", "code").alias("name"), "period", "value")
    pools = chosen.select("level").distinct()
    med = R.medians(values.join(pools, "level", "left_semi"), POOL, "value").select(
        F.lit("median").alias("kind"), "key", F.col("level").alias("name"), "period", F.col("median").alias("value"))
    nat = national.select(F.lit("national").alias("kind"), "key", F.lit("all").alias("name"), "period", "value")
    w = Window.partitionBy("kind", "key", "name").orderBy("period")  # one line: bounded by its periods
    return own.unionByName(med).unionByName(nat).withColumn("previous", F.lag("value").over(w))


def top_and_bottom(values: DataFrame, n: int, pool: Sequence[str] = POOL) -> DataFrame:
    """Both ends of a ranking."""
    some = values.filter(F.col("value").isNotNull())
    top = R.top_n(some, pool, [F.col("value").desc(), F.col("code").desc()], n).withColumn("side", F.lit("top"))
    low = R.top_n(some, pool, [F.col("value").asc(), F.col("code").asc()], n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def best_first(direction: str, value: Column, *fallback: Column) -> list[Column]:
    """Sort order of an area table: best first by direction, areas without a figure last;
    an inherited figure may take the own one's place."""
    v = F.coalesce(value, *fallback) if fallback else value
    return [v.asc_nulls_last() if direction == "lower_better" else v.desc_nulls_last()]


def filter_areas(areas: DataFrame, text: str = "", region: str | None = None, min_population: int = 0,
                 names: Sequence[str] = ("name",)) -> DataFrame:
    """Search text in any name column or the code, region, and a population floor."""
    out = areas.filter(F.coalesce("population", F.lit(0)) >= min_population)
    if region is not None:
        out = out.filter(F.col("region") == region)
    q = text.lower()
    if q:
        test = F.contains("code", F.lit(q))
        for n in names:
            test = test | F.coalesce(F.contains(F.lower(n), F.lit(q)), F.lit(False))
        out = out.filter(test)
    return out


def horizon_summary(values: DataFrame, horizons: Sequence[str], entity: Sequence[str] = ("level", "code")) -> DataFrame:
    """Wide horizon columns to rows, with range and median of the peers at every horizon."""
    long = values.unpivot(list(entity), list(horizons), "horizon", "value")
    pool = [entity[0], "horizon"]
    rng = long.groupBy(*pool).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return long.join(rng, pool).join(R.medians(long, pool, "value").drop("median_n"), pool, "left")


def break_markers(breaks: DataFrame, axis: DataFrame) -> DataFrame:
    """Series breaks on an axis of periods: the period itself, or its year, or that year's
    first quarter on a quarterly axis."""
    quarterly = axis.select(F.col("period"), F.col("idx"), F.contains("period", F.lit("K")).alias("_q"))
    at = breaks.dropDuplicates(["at"])
    on_quarters = at.select("at", F.when(F.contains("at", F.lit("K")), F.col("at")).otherwise(F.concat("at", F.lit("K1"))).alias("period"), F.lit(True).alias("_q"))
    on_years = at.select("at", F.substring("at", 1, 4).alias("period"), F.lit(False).alias("_q"))
    return on_quarters.unionByName(on_years).join(quarterly, ["period", "_q"]).select("at", "period", "idx")


def priority_union(lists: Sequence[DataFrame], key: str) -> DataFrame:
    """Union by key where the first list that has a key wins."""
    out = None
    for i, df in enumerate(lists):
        part = df.withColumn("_prio", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    others = [c for c in out.columns if c != key]
    best = out.groupBy(key).agg(F.min_by(F.struct(*others), "_prio").alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in others if c != "_prio"])


def histogram_percentages(hist: DataFrame, columns: Sequence[str], parent: DataFrame, on: str) -> DataFrame:
    """Four-bin histograms as percentages beside the parent area's own."""

    def pct(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
        return F.transform(c, lambda v: F.when(total > 0, v / total * 100).otherwise(0.0))

    ref = parent.select(on, *[pct(F.col(c)).alias(f"{c}_ref") for c in columns])
    return hist.join(ref, on, "left").withColumns({f"{c}_pct": pct(F.col(c)) for c in columns})
