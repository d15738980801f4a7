"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PICKED = [
    "calc_share_of_total", "calc_sum4q_history", "rolling4q_per_1000_pop_live", "registry_single_pass", "peer_rank_and_percentile", "quintile_classes",
    "diverging_classes", "point_in_polygon", "nearest_name_within", "lines_touching_areas", "overlap_share_dominant_first", "timetable_stop_modes",
    "geometries_touching_areas", "registry_compiled_history", "building_stock_profile", "newest_open_case", "age_groups_folded", "outlook_measures", "source_cascade", "diff_of_two_builds", "text_as_export_cells", "cube_file_scan",
    "overlap_within_stated_error", "inherited_values_all", "station_components",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # corpus operators are registered where their folder is present, and only there
    corpus = [n for n in entry.queries() if n.startswith("op") and n[2:3].isdigit()]
    assert bool(corpus) == os.path.isdir(os.path.join(os.path.dirname(entry.__file__), "arealis", "llm"))


def test_entry(spark):
    assert entry.entry(spark).columns == ["area", "period", "value", "peer_rank", "peers", "percentile"]


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    want, cols = cur.fetchall(), [d[0] for d in cur.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want, cols)
