"""Large documents cut into elements, at any split."""

import json
import random

import pytest

from arealis.sources import documents as D
from arealis.sources import geometry as SG
from arealis.sources import registers as SR


def _value(rng, depth):
    r = rng.random()
    if depth and r < 0.3:
        return {rng.choice(["a", "elements", "b\"", "}{"]): _value(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    if depth and r < 0.5:
        return [_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, None, True, "x}y", "{\"", "\\", "\\\\\"}", "é}", "[", "elements\":[{", ""])


@pytest.mark.parametrize("indent", [None, 1])
def test_elements(spark, monkeypatch, tmp_path, indent):
    monkeypatch.setattr(D, "SLICE", 64)
    rng = random.Random(15)
    want = []
    for f in range(3):
        els = [{"id": f"{f}-{i}", "v": _value(rng, 3), "w": _value(rng, 2)} for i in range(rng.choice([0, 150, 400]) if f else 300)]
        doc = {"crs": {"properties": {"elements": [{"no": 1}]}}, "other": [{"no": 2}], "elements": els, "after": [{"no": 3}, {"no": 4}], "end": {"elements": {"x": {"no": 5}}}}
        (tmp_path / f"d{f}.json").write_text(json.dumps(doc, ensure_ascii=bool(f), indent=indent) + ("\n" if f else ""), encoding="utf-8")
        want += els
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scan = D._sliced(spark, str(tmp_path))
        assert scan.rdd.getNumPartitions() > 20  # one document is many tasks
        got = [json.loads(r.text) for r in D.elements(spark, str(tmp_path), "elements").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    key = lambda e: e["id"]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert D.elements(spark, str(tmp_path), "missing").count() == 0


def test_objects_and_features(spark, tmp_path):
    els = [
        {"type": "node", "id": 1, "lat": 55.5, "lon": 12.5, "tags": {"shop": "kiosk"}}, {"type": "node", "id": 1, "lat": 55.5, "lon": 12.5, "tags": {"shop": "kiosk"}},
        {"type": "way", "id": 1, "center": {"lat": 56.0, "lon": 10.0}, "tags": {"name": "a } b"}}, {"type": "way", "id": 2, "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 3.0, "lon": 4.0}]},
        {"type": "relation", "id": 3, "tags": {"x": "y"}}]
    (tmp_path / "o.json").write_text(json.dumps({"version": 0.6, "elements": els}))
    got = {(r.type, r.id): (r.lat, r.lon, r.tags) for r in SR.map_objects(spark, str(tmp_path / "o.json")).collect()}
    assert got == {("node", 1): (55.5, 12.5, {"shop": "kiosk"}), ("way", 1): (56.0, 10.0, {"name": "a } b"}), ("way", 2): (2.0, 3.0, None)}
    feats = [
        {"type": "Feature", "properties": {"kode": "1"}, "geometry": {"type": "LineString", "coordinates": [[10, 55], [11, 56]]}},
        {"type": "Feature", "properties": {"kode": "2"}, "geometry": {"type": "MultiPoint", "coordinates": [[10, 55], [11, 56]]}},
        {"type": "Feature", "properties": {"kode": "3"}, "geometry": None}]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": feats}))
    read = SG.read_features(spark, str(tmp_path / "f.geojson"))
    assert read.count() == 3
    assert [(r.code, r.part, [(p.lat, p.lon) for p in r.path]) for r in SG.paths(read, ["kode"]).collect()] == [("1", 0, [(55.0, 10.0), (56.0, 11.0)])]
    assert sorted((r.code, r.lat) for r in SG.points(read, ["kode"]).collect()) == [("2", 55.0), ("2", 56.0)]
