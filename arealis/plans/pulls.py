"""Pulls chosen by their file names, over dated files that Spark writes from the order cube."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import cubes as SC
from ..sources import pulls as SP
from . import tables as T
from .common import registrar
from .scans import cube_rows

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

YEARS = r"\d{4}-\d{4}"


def write_pulls(spark, sf) -> str:
    """A folder of pulls: a whole one, a later one without a priority, the newest in two chunks that lack some years, and
    pulls of other tables and databases with later dates."""
    folder, rows = scratch_path(spark, "cached"), cube_rows(spark, sf).persist()
    year = F.substring("TID", 1, 4)
    pulls = {
        "dst_ORDERS1_2026-04-01": rows, "dst_ORDERS1_2026-05-01": rows.filter("PRIO <> '5-LOW'"),
        "dst_ORDERS1_1996-1998_2026-06-01": rows.filter(year.between("1996", "1998")), "dst_ORDERS1_1999-2001_2026-06-01": rows.filter(year.between("1999", "2001")),
        "dst_ORDERS1_dist_2026-06-15": rows.filter(year == "1995"), "dst_ORDERS10_2026-07-01": rows.filter(year == "1996"), "s20_ORDERS1_2026-08-01": rows.filter(year == "1997"),
    }
    for name, part in pulls.items():
        part.coalesce(4).write.option("sep", ";").option("header", True).csv(f"{folder}/{name}.csv")
    rows.unpersist()
    return folder


def _cells(df):
    return SC.as_cube(df, "ORDERS1").df.select("area", F.col("PRIO").alias("prio"), "period", "value", F.col("snapshot_date").alias("pulled"))


@query(f"WITH {T.ORDER_CUBE} SELECT area, prio, period, value, '2026-06-01' AS pulled FROM oc WHERE y BETWEEN 1996 AND 2001")
def newest_pull_by_file_name(spark, sf):
    """SC2, SC3: all chunks of the newest pull, told by their names; no other file is opened."""
    files = SP.of_table(SP.catalogue(spark, write_pulls(spark, sf)), "ORDERS1", chunks=YEARS)
    return _cells(SP.newest(spark, files))


@query(f"WITH {T.ORDER_CUBE} SELECT area, prio, period, value, '2026-04-01' AS pulled FROM oc")
def newest_pull_covering_by_file_name(spark, sf):
    """SC4: pulls are walked from the newest on until one holds the codes and periods needed."""
    files = SP.of_table(SP.catalogue(spark, write_pulls(spark, sf)), "ORDERS1", chunks=YEARS)
    return _cells(SP.newest_covering(spark, files, {"PRIO": ["1-URGENT", "5-LOW"]}, {"TID": 26}))


@query(f"""WITH {T.ORDER_CUBE} SELECT area, prio, period, value, '2026-06-01' AS pulled FROM oc WHERE y BETWEEN 1996 AND 2001""")
def shared_pull_preferred(spark, sf):
    """SC4: a shared pull is taken where it covers what is needed, else one's own."""
    all_files = SP.catalogue(spark, write_pulls(spark, sf))
    own = SP.of_table(all_files, "ORDERS1", chunks=YEARS)
    shared = SP.of_table(all_files, "ORDERS1", pull="ORDERS1_dist")
    return _cells(SP.preferring(spark, [shared, own], {"TID": ["1996K1"], "PRIO": ["5-LOW"]}))


@query("""SELECT * FROM (VALUES ('dst_ORDERS1', '2026-04-01'), ('dst_ORDERS1', '2026-05-01'), ('dst_ORDERS1_1996-1998', '2026-06-01'),
  ('dst_ORDERS1_1999-2001', '2026-06-01'), ('dst_ORDERS1_dist', '2026-06-15'), ('dst_ORDERS10', '2026-07-01'), ('s20_ORDERS1', '2026-08-01')) AS v(stem, date)""")
def pull_catalogue(spark, sf):
    """SC2: the pulls of a folder, from a listing alone."""
    return SP.catalogue(spark, write_pulls(spark, sf)).select("stem", "date").distinct()
