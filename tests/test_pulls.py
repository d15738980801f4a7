"""Which files a pull's reader opens."""

import os
import re

import pytest

from arealis.sources import pulls as SP


def _write(folder, name, rows, header="OMRÅDE;ALDER;TID;INDHOLD"):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write("\n".join([header, *rows]) + "\n")


@pytest.fixture
def folder(tmp_path):
    f = str(tmp_path)
    _write(f, "dst_T1_2024-01-05.csv", ["101;A;2023K1;1", "101;B;2023K1;2", "101;A;2023K2;3"])
    _write(f, "dst_T1_2008-2009_2024-02-01.csv", ["101;A;2009K1;4"])
    _write(f, "dst_T1_2010-2023_2024-02-01.csv", ["101;A;2023K1;5"])
    _write(f, "dst_T1_2024-03-01.csv", ["101;B;2023K4;6"])
    _write(f, "dst_T10_2025-01-01.csv", ["101;A;2024K1;7"])
    _write(f, "s20_T1_2025-02-01.csv", ["101;A;2024K1;8"])
    _write(f, "dst_T1.meta.json", ["{}"])
    os.mkdir(f"{f}/dst_T2_2024-05-05.csv")
    _write(f"{f}/dst_T2_2024-05-05.csv", "part-0.csv", ["147;A;2024K1;9"])
    return f


def _opened(df):
    return {re.search(r"(\w+-?[\d\w]*_\d{4}-\d{2}-\d{2})\.csv", p).group(1) for p in df.inputFiles()}


def test_names(spark, folder):
    files = SP.catalogue(spark, folder)
    assert sorted((r.stem, r.date) for r in files.collect()) == [
        ("dst_T1", "2024-01-05"), ("dst_T1", "2024-03-01"), ("dst_T10", "2025-01-01"), ("dst_T1_2008-2009", "2024-02-01"), ("dst_T1_2010-2023", "2024-02-01"),
        ("dst_T2", "2024-05-05"), ("s20_T1", "2025-02-01")]
    assert SP.dates(SP.of_table(files, "T1")) == ["2024-03-01", "2024-01-05"]
    assert SP.dates(SP.of_table(files, "T1", chunks=r"\d{4}-\d{4}")) == ["2024-03-01", "2024-02-01", "2024-01-05"]


def test_only_the_chosen_pull_is_opened(spark, folder):
    files = SP.of_table(SP.catalogue(spark, folder), "T1", chunks=r"\d{4}-\d{4}")
    new = SP.newest(spark, files)
    assert _opened(new) == {"dst_T1_2024-03-01"} and [r.INDHOLD for r in new.collect()] == ["6"]
    chunked = SP.newest_covering(spark, files, {"TID": ["2009K1", "2023K1"]})
    assert len(chunked.inputFiles()) == 2 and sorted(r.INDHOLD for r in chunked.collect()) == ["4", "5"]
    # an unreadable older pull does no harm as long as a newer one covers
    os.chmod(f"{folder}/dst_T1_2024-01-05.csv", 0)
    assert SP.newest_covering(spark, files, {"TID": ["2009K1"]}).count() == 2
    os.chmod(f"{folder}/dst_T1_2024-01-05.csv", 0o644)
    both = SP.newest_covering(spark, files, {"ALDER": ["A", "B"]}, {"TID": 2})
    assert {r.snapshot_date for r in both.collect()} == {"2024-01-05"}
    assert SP.newest(spark, SP.of_table(SP.catalogue(spark, folder), "T2")).count() == 1


def test_nothing_covers(spark, folder):
    files = SP.catalogue(spark, folder)
    for need in ({"TID": ["1999K1"]}, {"KØN": ["M"]}):
        with pytest.raises(LookupError):
            SP.newest_covering(spark, SP.of_table(files, "T1"), need)
    with pytest.raises(LookupError):
        SP.newest(spark, SP.of_table(files, "T9"))
    shared, own = SP.of_table(files, "T10"), SP.of_table(files, "T1")
    assert {r.snapshot_date for r in SP.preferring(spark, [shared, own], {"ALDER": ["B"]}).collect()} == {"2024-03-01"}
    assert {r.snapshot_date for r in SP.preferring(spark, [shared, own], {"ALDER": ["A"]}).collect()} == {"2025-01-01"}
