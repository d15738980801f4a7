"""The compiled registry against the calculations one by one, and how often it reads its cubes."""

import random

import pytest
from pyspark.sql import functions as F

from arealis.model import Cube, IndicatorSpec
from arealis.operators import calcs as C
from arealis.operators import registry as R


def _cube(spark, name, rows, counter=None):
    df = spark.createDataFrame(rows, "area string, dim string, period string, value double").repartition(3)
    if counter is not None:
        def count(batches):
            for b in batches:
                counter.add(b.num_rows)
                yield b

        df = df.mapInArrow(count, df.schema)
    return Cube(df, dims=("dim",), name=name)


def _rows(seed, quarters, gaps=True):
    rng = random.Random(seed)
    out = []
    for area in ("1", "2", "3", "4"):
        for y in range(2015, 2020):
            for q in range(1, 5):
                if gaps and (area == "3" and (y, q) == (2018, 2) or (y, q) == (2016, 3) or (y, q) > (2019, 2)):
                    continue
                for d in ("A", "B", "C"):
                    if rng.random() < 0.9:
                        period = f"{y}K{q}" if quarters else str(y)
                        out.append((area, d, period, rng.choice([None, 0.0, 1.0, 5.0, 7.5, 12.0]) if rng.random() < 0.3 else float(rng.randint(1, 90))))
    return out if quarters else list({r[:3]: r for r in out}.values())


ENTRIES = [
    R.Entry(IndicatorSpec("p", "passthrough", select={"dim": ["A", "B"]}), "Q"),
    R.Entry(IndicatorSpec("p1000", "value_div_1000", display_div=1000.0), "Q"),
    R.Entry(IndicatorSpec("sh", "share_of_total", share={"var": "dim", "num": ["A"], "den": ["A", "C"]}), "Q"),
    R.Entry(IndicatorSpec("yoy", "yoy_pct", select={"dim": "B"}), "Q"),
    R.Entry(IndicatorSpec("mean", "last4q_mean"), "Q"),
    R.Entry(IndicatorSpec("sum", "sum4q", select={"dim": ["C"]}), "Q"),
    R.Entry(IndicatorSpec("disc", "discount_pct", share={"var": "dim", "ask": "A", "real": "B"}), "Q"),
    R.Entry(IndicatorSpec("ratio", "ratio_pct", select={"dim": "A"}, den_select={"dim": "C"}), "Q", "POP"),
    R.Entry(IndicatorSpec("own", "ratio_own_year_pct", select={"dim": "A"}), "Y", "POP"),
    R.Entry(IndicatorSpec("per", "per_1000_dwellings"), "Q", "Y"),
    R.Entry(IndicatorSpec("s1000", "sum4q_per_1000"), "Q", "Y"),
    R.Entry(IndicatorSpec("rp", "rolling4q_per_1000_pop", select={"dim": "A"}), "Q", "POP"),
    R.Entry(IndicatorSpec("rd", "rolling4q_per_1000_dwellings"), "Q", "Y"),
    R.Entry(IndicatorSpec("ry", "rolling4q_yoy_pct", select={"dim": ["A", "C"]}), "Q"),
    R.Entry(IndicatorSpec("rolled", "rolling4q_per_1000_pop"), "FULL", "POP"),
]


@pytest.fixture(scope="module")
def cubes(spark):
    return {"Q": _cube(spark, "Q", _rows(1, True)), "POP": _cube(spark, "POP", _rows(2, True)), "Y": _cube(spark, "Y", _rows(3, False)), "FULL": _cube(spark, "FULL", _rows(4, True, False))}


def _same(got, want):
    key = lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, float) else round(x, 9)) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("what", ["live", "history", "quarters"])
def test_like_one_by_one(spark, cubes, what):
    reg = R.compile_registry(spark, cubes, ENTRIES)
    assert not reg.warnings
    got = {"live": reg.live, "history": reg.history, "quarters": lambda: reg.quarters("2017K1")}[what]().collect()
    assert got
    for e in ENTRIES:
        own = {"num": cubes[e.num], **({"den": cubes[e.den]} if e.den else {})}
        if what == "quarters":
            if not e.spec.calc.startswith("rolling4q"):
                assert not [r for r in got if r.key == e.spec.key]
                continue
            want = C.quarterly_series(own, e.spec, "2017K1")
        else:
            want = getattr(C, what)(own, e.spec)
        cols = [c for c in want.columns if c != "area"]
        want = [(r.area, *[r[c] / e.spec.display_div if c == "value" and r[c] is not None else r[c] for c in cols]) for r in want.collect()]
        _same([(r.code, *[r[c] for c in cols]) for r in got if r.key == e.spec.key], want)


def test_each_cube_is_read_once(spark):
    rows = {"Q": _rows(1, True), "POP": _rows(2, True), "Y": _rows(3, False), "FULL": _rows(4, True, False)}
    seen = {k: spark.sparkContext.accumulator(0) for k in rows}
    reg = R.compile_registry(spark, {k: _cube(spark, k, v, seen[k]) for k, v in rows.items()}, ENTRIES)
    for df in (reg.live(), reg.history(), reg.quarters("2016K1")):
        df.count()
    assert {k: a.value for k, a in seen.items()} == {k: len(v) for k, v in rows.items()}


def test_warnings_and_snapshots(spark, cubes):
    snap = spark.createDataFrame([("kommune", 101, 5.0, None), ("kommune", 147, None, 2.0), ("postnr", 1000, 7.0, 1.0)], "level string, code int, old double, share double")
    entries = [
        *ENTRIES[:1], R.Entry(IndicatorSpec("none", "no_such"), "Q"), R.Entry(IndicatorSpec("nocube", "passthrough"), "GONE"), R.Entry(IndicatorSpec("nodim", "passthrough", select={"x": "1"}), "Q"),
        R.Entry(IndicatorSpec("noden", "ratio_pct"), "Q"), R.Entry(IndicatorSpec("noshare", "share_of_total"), "Q"),
        *[R.Entry(IndicatorSpec(f"k_{k}", k, level="kommune"), column="old") for k in R.SNAPSHOT_KINDS],
        R.Entry(IndicatorSpec("post", "bbr", level="postnr", display_div=2.0), column="old"), R.Entry(IndicatorSpec("gone", "bbr"), column="gone"),
    ]
    reg = R.compile_registry(spark, cubes, entries, {k: R.Snapshot(snap, f"{k} 2026") for k in R.SNAPSHOT_KINDS[:-1]})
    assert {k for k, _ in reg.warnings} == {"none", "nocube", "nodim", "noden", "noshare", "gone", "k_external"}
    assert reg.warning_rows().count() == 7
    live = {(r.key, r.code): (r.period, r.value) for r in reg.live().collect() if r.key != "p"}
    assert live == {**{(f"k_{k}", "101"): (f"{k} 2026", 5.0) for k in R.SNAPSHOT_KINDS[:-1]}, ("post", "1000"): ("bbr 2026", 3.5)}
    assert {r.key for r in reg.history().collect()} == {"p"}
    with pytest.raises(ValueError, match="used twice"):
        R.compile_registry(spark, cubes, ENTRIES + ENTRIES[:1])
    assert R.compile_registry(spark, {}, []).live().count() == 0


def test_merged_codes(spark):
    values = spark.createDataFrame([("k", "postnr", "1", 2.0), ("k", "postnr", "2", 4.0), ("k", "postnr", "3", 9.0), ("k", "kommune", "1", 1.0)], "key string, level string, code string, value double")
    members = spark.createDataFrame([("1", "a", 300.0), ("2", "a", 100.0), ("3", "b", 0.0)], "code string, area string, weight double")
    assert sorted(map(tuple, R.merged(values, members, "postnr").collect())) == [("k", "kommune", "1", 1.0), ("k", "postnr", "a", 2.5), ("k", "postnr", "b", 9.0)]
