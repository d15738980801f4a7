"""Statistical cubes from semicolon files, their snapshots, and code lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..model import CODE_LIST_SCHEMA, Cube

# Variables that carry the area code of a table.
AREA_VARIABLES = ["OMRÅDE", "BOPOMR", "REGION", "KOMMUNE", "KOMMUNEDK", "OMR20", "PNR20", "SOGN", "BYER", "OMRKK"]
PERIOD, VALUE = "TID", "INDHOLD"


def read_raw(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All-text rows with clean header names, trimmed cells and the snapshot date and file."""
    df = (
        spark.read.option("sep", ";").option("header", True).option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .csv(list(path) if not isinstance(path, str) else path)
    )
    named = [F.trim(F.col(f"`{c}`")).alias(c.replace("\ufeff", "").strip()) for c in df.columns]
    file = F.col("_metadata.file_name")
    return df.select(*named, F.regexp_extract(file, r"(\d{4}-\d{2}-\d{2})\.[^.]*$", 1).alias("snapshot_date"))


def area_variable(columns: Sequence[str]) -> str | None:
    return next((c for c in columns if c in AREA_VARIABLES), None)


def as_cube(raw: DataFrame, name: str = "") -> Cube:
    """Number parsing and code normalisation; every other column is a dimension."""
    area = area_variable(raw.columns)
    if area is None:
        raise ValueError(f"{name}: no area variable among {raw.columns}")
    upper = {c.upper(): c for c in raw.columns}
    period, value = upper[PERIOD], upper[VALUE]
    dims = [c for c in raw.columns if c not in (area, period, value, "snapshot_date")]
    df = raw.select(
        P.area_code(area, area).alias("area"), F.col(period).alias("period"), P.cube_number(value).alias("value"),
        *[F.col(c) for c in dims], "snapshot_date",
    )
    return Cube(df, dims=tuple(dims), name=name)


def read_cube(spark: SparkSession, path: str | Sequence[str], name: str = "") -> Cube:
    return as_cube(newest_snapshot(read_raw(spark, path)), name)


def newest_snapshot(df: DataFrame) -> DataFrame:
    """Rows of the newest date; all files of that date belong to one pull."""
    return df.filter(F.col("snapshot_date") == df.select(F.max("snapshot_date")).scalar())


def newest_covering(df: DataFrame, required: dict[str, Sequence[str]]) -> DataFrame:
    """Rows of the newest snapshot that has all required codes of the given columns."""
    # only the required codes are gathered, so a set holds no more than was asked for
    have = df.groupBy("snapshot_date").agg(
        *[F.size(F.collect_set(F.when(F.col(c).isin(list(v)), F.col(c)))).alias(f"_{i}") for i, (c, v) in enumerate(required.items())]
    )
    test = F.lit(True)
    for i, v in enumerate(required.values()):
        test = test & (F.col(f"_{i}") == len(set(v)))
    return df.filter(F.col("snapshot_date") == have.filter(test).select(F.max("snapshot_date")).scalar())


def code_labels(spark: SparkSession, path: str) -> DataFrame:
    """(table, updated, var, elimination, code, text) from code-list documents."""
    doc = spark.read.schema(CODE_LIST_SCHEMA).option("multiLine", True).json(path)
    var = doc.select(F.col("id").alias("table"), F.substring("updated", 1, 10).alias("updated"), F.explode("variables").alias("v"))
    return var.select("table", "updated", F.col("v.id").alias("var"), F.col("v.elimination").alias("elimination"), F.posexplode("v.values").alias("pos", "x")).select(
        "table", "updated", "var", "elimination", "pos", F.col("x.id").alias("code"), F.trim("x.text").alias("text"))


def with_labels(df: DataFrame, labels: DataFrame, table: str, var: str, code: str, name: str = "label") -> DataFrame:
    """Text of a code; the code itself where the list lacks it."""
    l = labels.filter((F.col("table") == table) & (F.col("var") == var)).select(F.col("code").alias("_c"), F.col("text").alias("_t"))
    return df.join(l, F.col(code) == F.col("_c"), "left").withColumn(name, F.coalesce("_t", F.col(code))).drop("_c", "_t")


def area_variable_of(labels: DataFrame) -> DataFrame:
    """(table, area_var) out of the code lists themselves."""
    return labels.filter(F.col("var").isin(AREA_VARIABLES)).groupBy("table").agg(F.min("var").alias("area_var"))
