"""Line dedup and the n-gram join against brute force."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from arealis.llm import disclosure, host_rules, line_dedup, ngram_join, shingles  # noqa: E402


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_bit_parallel_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(200):
        a = "".join(rng.choice("abé ") for _ in range(rng.randint(0, 12)))
        rows.append((a, brute.edited(rng, a, rng.randint(0, 4), "abcé ")))
    df = spark.createDataFrame(rows, "x string, y string").coalesce(2)
    x, y = F.col("x"), F.col("y")
    for r in df.select("x", "y", line_dedup.banded_distance(x, y, edits).alias("d"), line_dedup.within(x, y, edits).alias("w")).collect():
        want = brute.edit_distance(r.x, r.y)
        assert r.d == min(want, edits + 1) and r.w == (want <= edits)


def _line_docs():
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefé ") for _ in range(rng.randint(6, 20))).strip() for _ in range(12)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            r, b = rng.random(), rng.choice(base)
            lines.append(b if r < 0.3 else brute.edited(rng, b, rng.randint(1, 3), "abcé ") if r < 0.8 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 12))))
        docs.append((d, "\n".join(lines)))
    return [*docs, (100, None), (101, ""), (None, "abcabc\nabcabc")]


@pytest.mark.parametrize(("crowd", "edits"), [(24, 1), (2, 1), (2, 2)])
def test_line_dedup(spark, monkeypatch, crowd, edits):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    docs = _line_docs()
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), edits, 6).collect()}
    assert got == brute.dedup_lines(docs, edits, 6)


def test_line_filter_keeps_columns(spark):
    line = "a line that is long enough"
    rows = [(1, line, "en", 26, 5), (2, line, None, 26, 6), (3, f"other words here, on their own\n{line}", "en", 57, 7), (1, line, "en", 26, 5), (4, None, None, None, None), (5, "x" * 100_000, "en", 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string, n_chars long, pos int")
    got = line_dedup.line_filter(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, line, "en", 26, 5), (1, line, "en", 26, 5), (3, "other words here, on their own", "en", 30, 7), (4, None, None, None, None), (5, "x" * 100_000, "en", 9, 1)], key=str)
    assert line_dedup.line_filter(docs.limit(0)).count() == 0


def test_shingle_sets():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "B", "cc", "é", "x\ty"]) for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", "w" * 3_000_000 + " a b", "a b c " * 400_000]
    for k in (1, 3, 5):
        sets = [shingles.shingle_set(w, k) for w in shingles.word_hashes([t.encode() for t in texts])]
        assert [len(s) for s in sets] == [len(brute.shingles(t, k)) for t in texts]
        assert all((np.diff(s.astype(object)) > 0).all() for s in sets[:50] if len(s) > 1)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for percent in (90, 80):
        for n in (5, 12, 40, 200, 900):
            for _ in range(60):
                a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                b = a.copy()
                change = int(rng.integers(0, n // 8 + 2))
                b[rng.choice(n, min(change, n), replace=False)] = rng.integers(0, 1 << 63, min(change, n), dtype=np.uint64)
                a, b = np.unique(a), np.unique(b[: n - int(rng.integers(0, 2))])
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and len(a) != both:
                    assert len(np.intersect1d(ngram_join.set_keys(a, percent), ngram_join.set_keys(b, percent)))


@pytest.mark.parametrize(("k", "percent", "tile"), [(3, 90, 1024), (5, 80, 4)])
def test_ngram_classes(spark, monkeypatch, k, percent, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 20, 60, 150, 400]))]
        for _ in range(rng.randint(1, 10)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(w) if rng.random() < 0.9 else "  ".join(w).upper()))
    n = len(docs)
    docs += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "A b")]
    df = spark.createDataFrame([*docs, (None, docs[0][1])], "doc_id long, text string").repartition(4)
    rows = ngram_join.classes(df, k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == brute.jaccard_classes(docs, k, percent)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


def test_keep_one(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(3, text, 1), (1, text.upper(), 2), (2, text + " more", 3), (4, "something else entirely", 4), (5, None, 5), (5, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.node) for r in got.collect()) == [(1, 2), (4, 4), (5, 5), (5, 5)]
    assert ngram_join.classes(docs.limit(0)).count() == 0


def test_clashing_names(spark):
    line = "a line that is long enough"
    names = ["n_lines", "n_equal", "n_near", "_d", "_t", "_e", "_n", "_gone", "_id", "_host", "_key", "_s", "_m", "N_Lines_"]
    rows = [(1, line, "s"), (2, line, "s"), (3, None, None), (4, "mail a@b.dk " * 3, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    kept = {
        "lines": line_dedup.line_filter(docs), "near": ngram_join.keep_one(docs), "rules": host_rules.quality_filter(docs), "personal": disclosure.sanitise(docs),
    }
    for name, df in kept.items():
        assert df.columns == docs.columns, name
        assert all(r[n] == i for r in df.collect() for i, n in enumerate(names)), name
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, *line_dedup.count_names(docs)]
    assert line_dedup.count_names(docs)[0].lower() not in {c.lower() for c in docs.columns}
