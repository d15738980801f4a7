"""The catalogue of cached pulls: which files belong to which pull, read off their names before any is opened.

A pull is a file, or a folder of part files, named ``<database>_<table or pull>[_<chunk>]_<date>.csv``. The listing is Spark's own
(names and lengths only, so any file system that Spark reads will do); just the files of the chosen pull are read. All
chunks of one date are one pull.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cubes

# The file-name rule, and the database that a name stands for when none is given.
PULL_NAME = r"([^/]+)_(\d{4}-\d{2}-\d{2})\.csv(?:/[^/]*)?$"
DEFAULT_DATABASE = "dst"


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, date, bytes) of every file under a folder that is named as a pull."""
    # only names and lengths are asked for, so contents stay unread
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    stem, date = F.regexp_extract("path", PULL_NAME, 1), F.regexp_extract("path", PULL_NAME, 2)
    return listed.select("path", stem.alias("stem"), date.alias("date"), F.col("length").alias("bytes")).filter("date <> ''")


def of_table(files: DataFrame, table: str, db: str = "", pull: str | None = None, chunks: str = "") -> DataFrame:
    """Files of one table or named pull. A chunk's name goes on with what ``chunks`` matches, for example a range of
    years; a table whose name merely starts alike isn't taken."""
    name = re.escape(f"{db or DEFAULT_DATABASE}_{pull or table}")
    return files.filter(F.col("stem").rlike(f"^{name}(_(?:{chunks}))?$" if chunks else f"^{name}$"))


def dates(files: DataFrame) -> list[str]:
    """Dates of the pulls, newest first: as many as there have been pulls."""
    return [r.date for r in files.select("date").distinct().orderBy(F.desc("date")).toLocalIterator()]


def paths(files: DataFrame, date: str) -> list[str]:
    """The files of one pull; its reader needs their names on the driver as any list of paths does."""
    return [r.path for r in files.filter(F.col("date") == date).select("path").orderBy("path").toLocalIterator()]


def read_pull(spark: SparkSession, files: DataFrame, date: str) -> DataFrame:
    """All rows of one pull, with its date."""
    return cubes.read_raw(spark, paths(files, date)).withColumn("snapshot_date", F.lit(date))


def newest(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Rows of the newest pull. No other pull is opened."""
    found = files.select(F.max("date").alias("d")).first().d
    if found is None:
        raise LookupError("no pull of this name")
    return read_pull(spark, files, found)


def covers(df: DataFrame, codes: dict[str, Sequence[str]], at_least: dict[str, int] | None = None) -> bool:
    """Whether rows hold every required code of their columns, and so many different ones of others. One pass; a set
    holds no more than what was asked for."""
    if not set(codes) | set(at_least or {}) <= set(df.columns):
        return False
    tests = [F.size(F.collect_set(F.when(F.col(c).isin(list(v)), F.col(c)))) == len(set(v)) for c, v in codes.items()]
    tests += [F.count_distinct(F.col(c)) >= n for c, n in (at_least or {}).items()]
    row = df.agg(*[t.alias(f"t{i}") for i, t in enumerate(tests)]).first() if tests else ()
    return all(row)


def walk(spark: SparkSession, files: DataFrame) -> Iterator[tuple[str, DataFrame]]:
    """(date, rows) of the pulls, newest first; a pull is opened when it is asked for."""
    for d in dates(files):
        yield d, read_pull(spark, files, d)


def newest_covering(spark: SparkSession, files: DataFrame, codes: dict[str, Sequence[str]], at_least: dict[str, int] | None = None) -> DataFrame:
    """Rows of the newest pull that covers what is needed. Pulls older than that one are never opened."""
    for _, df in walk(spark, files):
        if covers(df, codes, at_least):
            return df
    raise LookupError("no pull covers what is needed")


def preferring(spark: SparkSession, sources: Sequence[DataFrame], codes: dict[str, Sequence[str]], at_least: dict[str, int] | None = None) -> DataFrame:
    """The newest pull of the first source, if it covers what is needed, else that of the next: a shared pull is
    preferred to one of one's own."""
    for files in sources:
        known = dates(files)
        if known:
            df = read_pull(spark, files, known[0])
            if covers(df, codes, at_least):
                return df
    raise LookupError("no source covers what is needed")
