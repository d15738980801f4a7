"""Work that is large behind few bytes is dealt out over tasks."""

import math

from pyspark.sql import functions as F

from arealis.model import AREA_COLUMNS
from arealis.operators import exports as E
from arealis.operators import nearest as N
from arealis.operators import spatial as S
from arealis.operators import strips as R
from arealis.sources import point_files as PF


def tasks_of(df) -> int:
    return sum(n > 0 for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def test_pins_of_one_area_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(E, "PINS_PER_TASK", 20, raising=False)
    pins = spark.createDataFrame([(f"p{max(i, 1)}", 55.0, 9.0, "nation", "7") for i in range(201)], "property_label string, lat double, lon double, level string, code string")
    fixed = {"level": "nation", "code": "7"}
    rows = spark.createDataFrame([tuple(fixed.get(c, f"{c}{i}") for c in AREA_COLUMNS) for i in range(3)], ", ".join(f"{c} string" for c in AREA_COLUMNS))
    out = E.property_rows(rows, pins)
    assert out.count() == 201 * 3 and out.distinct().count() == 200 * 3
    assert tasks_of(out) > 1


def test_point_files_many_by_a_task(spark, tmp_path):
    d = spark.range(2000).select(F.lit("0101").alias("kommune"), F.lit("food").alias("cat"), F.lit("x").alias("sub"), F.format_string("n%04d", "id").alias("name"), F.lit(55.0).alias("lat"), F.lit(9.0).alias("lon"))
    path = f"{tmp_path}/points"
    PF.write_even(d, path, rows_per_file=10)
    per = PF.read_files(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("lo"), F.max("name").alias("hi")).orderBy("file").collect()
    assert sum(r.n for r in per) == 2000 and max(r.n for r in per) == 10
    assert all(a.hi < b.lo for a, b in zip(per, per[1:], strict=False))
    assert len({r.file.split("part-")[1][:5] for r in per}) <= 2


def test_crossings_of_few_edges_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_TASK", 100, raising=False)
    square = [[[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]]]
    d = spark.createDataFrame([("a", square)], "code string, polygon array<array<array<struct<lat:double,lon:double>>>>")
    rows = R.spans(d, F.lit(2.0**-9))
    assert rows.count() == 512 and rows.agg(F.sum((F.col("hi") - F.col("lo")) * F.col("height"))).first()[0] == 1.0
    assert tasks_of(rows) > 1


def test_pairs_of_one_crowded_cell_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS_PER_TASK", 500, raising=False)
    monkeypatch.setattr(S, "COPIES", 3, raising=False)
    rows = [(i, 55.0 + i % 20 / 1000, 9.0) for i in range(100)]
    pts = spark.createDataFrame(rows, "id int, lat double, lon double")
    out = S.within_radius(pts, pts, 600.0)
    want = sorted((i, j) for i, x, _ in rows for j, y, _ in rows if abs(x - y) < 0.0054)
    assert sorted((r.a_id, r.b_id) for r in out.collect()) == want
    assert tasks_of(out) > 1


def most_tasks(spark, group: str, run) -> int:
    """Tasks of the stage that has most, of what ``run`` does."""
    spark.sparkContext.setJobGroup(group, group)
    run()
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    return max(s.numTasks for j in jobs for s in map(tracker.getStageInfo, j.stageIds) if s)


def test_search_of_nearest_points_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    monkeypatch.setattr(N, "ROWS_PER_TASK", 100, raising=False)
    pts = [("a", i, 55.0 + i * i % 97 / 1000, 9.0 + i * 31 % 89 / 1000) for i in range(120)]
    pins = [(i, 55.0 + i * 7 % 91 / 1000 + 0.0003, 9.0 + i * 13 % 83 / 1000 + 0.0007) for i in range(60)]
    points = spark.createDataFrame(pts, "cat string, id long, lat double, lon double")
    places = spark.createDataFrame(pins, "pin long, lat double, lon double")
    got = []
    assert most_tasks(spark, "nearest points", lambda: got.extend(N.nearest_points(places, points, 1).collect())) > 8
    flat = lambda p, q: math.hypot(p[1] - q[2], (p[2] - q[3]) * math.cos(math.radians(55.05)))
    assert len(got) == 60 and all(flat(p, pts[r.id]) < min(flat(p, q) for q in pts) + 1e-5 for r in got for p in [pins[r.pin]])


def test_search_of_nearest_lines_and_areas_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    monkeypatch.setattr(N, "ROWS_PER_TASK", 100, raising=False)
    line = lambda i: [(55.0 + i / 1000, 9.0), (55.0 + i / 1000, 9.1)]
    square = [[[(56.0, 9.0), (56.0, 9.1), (56.1, 9.1), (56.1, 9.0)]]]
    point = "struct<lat:double,lon:double>"
    shapes = spark.createDataFrame([("line", i, None, line(i)) for i in range(100)] + [("area", 0, square, None)], f"cat string, id long, polygon array<array<array<{point}>>>, path array<{point}>")
    places = spark.createDataFrame([(i, 55.0003 + i / 1000, 9.05) for i in range(60)] + [(60, 56.05, 9.05)], "pin long, lat double, lon double")
    got = []
    assert most_tasks(spark, "nearest shapes", lambda: got.extend(N.nearest_shapes(places, shapes, 1, 0.05).collect())) > 8
    assert sorted((r.pin, r.id) for r in got if r.cat == "line") == [*((i, i) for i in range(60)), (60, 99)]
    assert {r.pin for r in got if r.cat == "area"} == set(range(61)) and [r.dist for r in got if r.cat == "area" and r.pin == 60] == [0.0]
