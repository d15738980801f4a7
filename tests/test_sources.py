"""Scans and sinks on small files."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from arealis.model import AREA_COLUMNS
from arealis.operators import quality as Q
from arealis.operators import registers as G
from arealis.operators import rollup as U
from arealis.sources import cubes, geometry, registers, sinks


def test_cube_snapshots(spark, tmp_path):
    head = "\ufeffOMRÅDE; ALDER ;TID;INDHOLD\n"
    (tmp_path / "dst_T_2026-01-01.csv").write_text(head + "0101;TOT;2026K1;1 000,5\n", encoding="utf-8")
    (tmp_path / "dst_T_2026-02-01.csv").write_text(head + "101;TOT;2026K2;..\n 147 ;TOT;2026K2; 7\n", encoding="utf-8")
    cube = cubes.read_cube(spark, f"{tmp_path}/dst_T_20*.csv", "T")
    assert cube.dims == ("ALDER",)
    assert sorted((r.area, r.period, r.value) for r in cube.cells().collect() if r.value) == [("147", "2026K2", 7.0)]
    assert cube.cells().count() == 2
    raw = cubes.read_raw(spark, f"{tmp_path}/dst_T_20*.csv")
    old = cubes.as_cube(cubes.newest_covering(raw, {"TID": ["2026K1"]}))
    assert [(r.area, r.value) for r in old.cells().collect()] == [("101", 1000.5)]
    assert cubes.as_cube(cubes.newest_covering(raw, {"TID": ["1999K1"]})).df.count() == 0


def test_code_lists(spark, tmp_path):
    doc = {"id": "T", "text": "x", "updated": "2026-07-01T08:00", "variables": [{"id": "OMRÅDE", "text": "area", "elimination": True, "values": [{"id": "101", "text": " København "}]}]}
    p = tmp_path / "m.json"
    p.write_text(json.dumps(doc, indent=1), encoding="utf-8")
    lab = cubes.code_labels(spark, str(p))
    assert [(r.table, r.var, r.code, r.text, r.updated) for r in lab.collect()] == [("T", "OMRÅDE", "101", "København", "2026-07-01")]
    assert [r.area_var for r in cubes.area_variable_of(lab).collect()] == ["OMRÅDE"]
    df = spark.createDataFrame([("101",), ("999",)], "c string")
    assert {r.c: r.label for r in cubes.with_labels(df, lab, "T", "OMRÅDE", "c").collect()} == {"101": "København", "999": "999"}


def test_geojson(spark, tmp_path):
    ring = [[12.0, 55.0], [12.1, 55.0], [12.1, 55.1], [12.0, 55.0]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"kode": "0101", "navn": "A"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"kode": "0147", "navn": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}},
        {"type": "Feature", "properties": {"kode": "p"}, "geometry": {"type": "MultiPoint", "coordinates": [[12.0, 55.0], [12.5, 55.5]]}},
        {"type": "Feature", "properties": {"kode": "l"}, "geometry": {"type": "LineString", "coordinates": [[12.0, 55.0], [12.5, 55.5]]}},
        {"type": "Feature", "properties": {"kode": "n"}, "geometry": None}]}
    p = tmp_path / "g.geojson"
    p.write_text(json.dumps(doc, indent=1), encoding="utf-8")
    f = geometry.read_features(spark, str(p))
    got = {r.code: r.polygon for r in geometry.polygons(f, ["kode"]).collect()}
    assert [len(part) for part in got["0147"]] == [1, 2] and len(got["0101"][0][0]) == 3
    assert (got["0101"][0][0][0].lat, got["0101"][0][0][0].lon) == (55.0, 12.0)
    assert geometry.points(f, ["kode"]).count() == 2 and geometry.paths(f, ["kode"]).first().path[1].lat == 55.5
    assert {r.kind: r.n for r in geometry.kinds(f).collect()}["MultiPoint"] == 1


def test_map_objects(spark, tmp_path):
    doc = {"elements": [
        {"type": "node", "id": 1, "lat": 55.0, "lon": 12.0, "tags": {"shop": "supermarket", "name": " X ", "brand": "Y"}},
        {"type": "node", "id": 1, "lat": 55.0, "lon": 12.0, "tags": {"shop": "supermarket"}},
        {"type": "way", "id": 1, "geometry": [{"lat": 55.0, "lon": 12.0}, {"lat": 56.0, "lon": 13.0}], "tags": {"amenity": "bar", "name": "https://x.dk/wms"}},
        {"type": "way", "id": 2, "center": {"lat": 55.2, "lon": 12.2}, "tags": {"amenity": "school", "name": "S"}},
        {"type": "relation", "id": 3, "tags": {"amenity": "bar"}}]}
    p = tmp_path / "o.json"
    p.write_text(json.dumps(doc, indent=1), encoding="utf-8")
    objs = registers.map_objects(spark, str(p))
    assert objs.count() == 3
    svc = {r.osm: r for r in registers.services(objs).collect()}
    assert set(svc) == {"n1", "w1"} and (svc["w1"].lat, svc["w1"].lon) == (55.5, 12.5)
    assert [r.name for r in registers.named_facilities(objs).collect() if r.amenity] == ["S"]


def test_small_reference_files(spark, tmp_path):
    (tmp_path / "kv.csv").write_text("kommune;value;name\n0101;7,5;A\n0147;n/a;B\n", encoding="utf-8")
    assert [(r.code, r.value) for r in registers.key_value_csv(spark, str(tmp_path / "kv.csv")).collect()] == [("101", 7.5)]
    (tmp_path / "p.txt").write_text("# c | 1\nA | 1.637\nHele landet | 1.200\nB | 0\n\n", encoding="utf-8")
    areas, whole = registers.piped_lines(spark.read.text(str(tmp_path / "p.txt")))
    assert [(r.name, r.value) for r in areas.collect()] == [("A", 1637.0)] and whole.first().value == 1200.0
    (tmp_path / "t.csv").write_text("\ufeffkomnavn\tv\nA\t1\n\t\n", encoding="utf-8")
    assert [r.komnavn for r in registers.sniffed_csv(spark, str(tmp_path / "t.csv"), ["v"]).collect()] == ["A"]
    with pytest.raises(ValueError):
        registers.sniffed_csv(spark, str(tmp_path / "t.csv"), ["missing"])


def test_point_files_are_replaced_whole(spark, tmp_path):
    p = str(tmp_path / "pts")
    df = spark.createDataFrame([("101", "food", "bar", "b", 55.1234567, 12.0), ("147", "food", "bar", "a", 55.0, 12.0)], "kommune string, cat string, sub string, name string, lat double, lon double")
    sinks.write_points(df, p)
    sinks.write_points(df.filter("kommune = '101'"), p, salts=3)
    back = spark.read.json(p).collect()
    assert [(r.lat, r.kommune) for r in back] == [(55.12346, 101)]


def test_export_file(spark, tmp_path):
    row = {c: "x;y\n z" for c in AREA_COLUMNS} | {"value": 2.0}
    df = spark.createDataFrame([tuple(row[c] for c in AREA_COLUMNS)], ", ".join(f"{c} {'double' if c == 'value' else 'string'}" for c in AREA_COLUMNS))
    sinks.write_export(df.coalesce(1), str(tmp_path / "e"), AREA_COLUMNS)
    text = next((tmp_path / "e").glob("part-*.csv")).read_text(encoding="utf-8")
    head, line = text.splitlines()
    assert head.startswith("\ufefflevel;code;name") and line.split(";")[0] == "x,y z" and line.split(";")[AREA_COLUMNS.index("value")] == "2"


def test_duplicate_cells_stop_the_union(spark):
    a = spark.createDataFrame([("1", 5)], "code string, n int")
    assert Q.union_refusing_duplicates([a, a.withColumn("code", F.lit("2"))], ["code"]).count() == 2
    with pytest.raises(PySparkException, match="more than one pull"):
        Q.union_refusing_duplicates([a, a], ["code"]).collect()
    with pytest.raises(PySparkException, match="forbidden"):
        Q.union_refusing_duplicates([a], ["code"], forbidden=F.col("code") == "1").collect()


def test_strict_name_join_stops(spark):
    areas = spark.createDataFrame([("1", "Århus")], "code string, area_name string")
    ok = spark.createDataFrame([(1, "Aarhus Kommune")], "id int, name string")
    assert G.strict_by_name(ok, areas).first().code == "1"
    with pytest.raises(PySparkException, match="no area named"):
        G.strict_by_name(ok.withColumn("name", F.lit("Nowhere")), areas).collect()


def test_weights(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0), (None, 9.0), (7.0, None)], "v double, w double")
    assert df.agg(U.weighted_mean(F.col("v"), F.col("w"))).first()[0] == pytest.approx((1 + 8 + 7) / 4)
