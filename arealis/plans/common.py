"""Shared bits of the plan modules: registration, rounding, and the long indicator table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as T


def registrar(queries: dict, oracles: dict) -> Callable:
    """``@query(sql)`` puts the decorated function into the module's dictionaries."""

    def query(sql: str | None = None):
        def add(fn):
            queries[fn.__name__] = fn
            if sql is not None:
                oracles[fn.__name__] = sql
            return fn

        return add

    return query


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in (cols or ("value",))})


def joined(arr: Column, digits: int = 6) -> Column:
    """An array of doubles as text, for comparison across engines."""
    return F.concat_ws("|", F.transform(arr, lambda v: F.format_number(v, digits)))


def indicator_values(spark: SparkSession, sf: str, levels: Sequence[str] = ("customer", "nation", "region")) -> DataFrame:
    """(level, code, parent, key, period, value): yearly revenue and order count at three levels.

    The customer-year sums are the only pass over the orders; the coarser levels add them up.
    """
    n = T.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    by_customer = T.customer_totals(
        spark, sf, {"period": F.year("o_orderdate").cast("string")}, {"cents": F.sum(T.cents("o_totalprice")), "cnt": F.count(F.lit(1))}
    ).select(F.col("o_custkey").alias("c"), F.col("c_nationkey").alias("n"), "period", "cents", "cnt")
    by_nation = by_customer.groupBy("n", "period").agg(F.sum("cents").alias("cents"), F.sum("cnt").alias("cnt"))
    by_nation = by_nation.join(n, F.col("n") == F.col("n_nationkey"))
    by_region = by_nation.groupBy("n_regionkey", "period").agg(F.sum("cents").alias("cents"), F.sum("cnt").alias("cnt"))
    parts = {
        "customer": by_customer.select(F.lit("customer").alias("level"), F.col("c").cast("string").alias("code"),
                                       F.col("n").cast("string").alias("parent"), "period", "cents", "cnt"),
        "nation": by_nation.select(F.lit("nation").alias("level"), F.col("n").cast("string").alias("code"),
                                   F.col("n_regionkey").cast("string").alias("parent"), "period", "cents", "cnt"),
        "region": by_region.select(F.lit("region").alias("level"), F.col("n_regionkey").cast("string").alias("code"),
                                   F.lit("all").alias("parent"), "period", "cents", "cnt"),
    }
    out = None
    for lv in levels:
        out = parts[lv] if out is None else out.unionByName(parts[lv])
    both = F.array(
        F.struct(F.lit("revenue").alias("key"), (F.col("cents") / 100).alias("value")),
        F.struct(F.lit("orders_n").alias("key"), F.col("cnt").cast("double").alias("value")),
    )
    return out.select("level", "code", "parent", "period", F.explode(both).alias("x")).select(
        "level", "code", "parent", F.col("x.key").alias("key"), "period", F.col("x.value").alias("value")
    )


VALUES = """
cy AS (SELECT o_custkey AS c, c_nationkey AS n, CAST(year(o_orderdate) AS VARCHAR) AS period,
              sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, count(*) AS cnt
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
lv AS (
  SELECT 'customer' AS level, CAST(c AS VARCHAR) AS code, CAST(n AS VARCHAR) AS parent, period, cents, cnt FROM cy
  UNION ALL SELECT 'nation', CAST(n AS VARCHAR), CAST(n_regionkey AS VARCHAR), period, sum(cents), sum(cnt)
    FROM cy JOIN nation ON n = n_nationkey GROUP BY n, n_regionkey, period
  UNION ALL SELECT 'region', CAST(n_regionkey AS VARCHAR), 'all', period, sum(cents), sum(cnt)
    FROM cy JOIN nation ON n = n_nationkey GROUP BY n_regionkey, period),
iv AS (
  SELECT level, code, parent, 'revenue' AS key, period, CAST(cents AS DOUBLE) / 100 AS value FROM lv
  UNION ALL SELECT level, code, parent, 'orders_n', period, CAST(cnt AS DOUBLE) FROM lv)"""
