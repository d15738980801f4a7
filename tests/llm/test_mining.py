"""Hard negatives, collocations and SuperMinHash against brute force."""

import math
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from arealis.llm import collocations, hard_negatives, superminhash  # noqa: E402


def _score(a, b):
    return sum(int(math.floor(256 * x)) * int(math.floor(256 * y)) for x, y in zip(a, b, strict=True))


def _mined(rows):
    rows = [r for r in set((i, lab, None if v is None else tuple(v)) for i, lab, v in rows) if None not in r and all(x is not None and math.isfinite(x) for x in r[2])]
    out = set()
    for i, lab, v in rows:
        if i % 50:
            continue
        met = [(j, m, _score(v, w)) for j, m, w in rows if j != i and len(w) == len(v)]
        for p, _, ps in sorted((x for x in met if x[1] == lab), key=lambda x: (-x[2], x[0]))[:5]:
            far = sorted((x for x in met if x[1] != lab and 50 * ps <= 100 * x[2] <= 95 * ps), key=lambda x: (-x[2], x[0]))[:3]
            out.update((i, p, k, j, ps, s) for k, (j, _, s) in enumerate(far, 1))
    return out


@pytest.mark.parametrize(("dim", "least"), [(64, 512), (5, 20), (100, 50)])
def test_hard_negatives(spark, monkeypatch, dim, least):
    monkeypatch.setattr(hard_negatives, "LEAST", least)
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((600, dim))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[100:300] = x[rng.integers(0, 4, 200) * 50]  # ties: a third of the rows are copies of a few
    rows = [(i, int(rng.integers(0, 3)), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [rows[50], (700, None, rows[0][2]), (750, 1, None), (800, 1, [None] * dim), (850, 1, [float("nan")] * dim), (900, 1, [float("inf")] + [0.0] * (dim - 1)),
             (1000, 1, [0.0] * dim), (1050, 2, []), (1051, 2, []), (1052, 1, []), (1100, 1, [1.0, 0.5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, key string").repartition(3)
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == _mined(rows)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    null_id = spark.createDataFrame([(None, 1, [1.0])], df.drop("key").schema)
    assert hard_negatives.mine(null_id, F.col("vec_id") % 50 == 0).count() == 0


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(5)
    for dim in (3, 64, 130):
        x = np.floor(256 * rng.standard_normal((300, dim)) * rng.choice([0, 0.1, 1, 30], (300, 1)))
        codes, facts = hard_negatives.encode(x)
        held = hard_negatives._Rows(np.arange(300), np.zeros(300, np.int64), x.astype(np.int64), codes, facts)
        for q in x[:20]:
            true, wide = x @ q, []

            def keep(low, high):
                assert (low <= true).all() and (true <= high).all()  # noqa: B023
                wide.append(float((high - low).mean()))  # noqa: B023
                return np.ones(len(low), bool)

            held.survivors(np.arange(300), hard_negatives._Asker(q), keep)
            assert all(a >= b for a, b in zip(wide, wide[1:], strict=False)) and (wide[0] < 1 or wide[-1] < 0.5 * wide[0])


def test_filter_leaves_few():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    held = hard_negatives._Rows(np.arange(4000), np.arange(4000) % 2, x.astype(np.int64), *hard_negatives.encode(x))
    scored = []
    exact = held.scores
    held.scores = lambda at, q: scored.append(len(at)) or exact(at, q)
    for i in range(0, 4000, 400):
        best = held.positives(i, i % 2, x[i].astype(np.int64), 5)
        held.negatives(i, i % 2, x[i].astype(np.int64), [s for _, s in best], (50, 95), 3)
    assert max(scored) < 1000


def _phrases(docs, top, least):
    import re

    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                f[lang].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, own in f.items():
        cand = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in cand.items():
            if any(len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h))) and 100 * b >= 80 * a for h, b in cand.items()):
                continue
            score, k = min((2000000 * a // (own[g[:k]] + own[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations(spark, top):
    rng = random.Random(7)
    words = ["The", "new", "york", "é", "\x00b", "city x", "of", "Á", "a-b"]
    fixed = ["new york city of the", "of the", "the the the"]
    docs = []
    for _ in range(250):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 8))]
        docs.append((rng.choice(["en", None, "und", "da"]), rng.choice(["  ", ". ", "\t", " ,\n"]).join(parts)))
    docs += docs[:60] + [("en", None), (None, ""), ("da", " .,\n "), ("xx", "only once"), ("en", "the " * 50_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "lang string, text string, a int").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, top=top).collect())
    assert got == _phrases(docs, top, 30) and got
    assert collocations.collocations(df.limit(0)).count() == 0


@pytest.mark.parametrize(("every", "longest"), [(48, 2048), (2, 2048), (48, 5)])
def test_chunks_hold_each_start_once(monkeypatch, every, longest):
    monkeypatch.setattr(collocations, "EVERY", every)
    monkeypatch.setattr(collocations, "LONGEST", longest)
    rng = random.Random(8)
    text = " ".join(rng.choice(["a", "bb", "c", "dd.", "e", "fff"]) for _ in range(3000)).encode()
    starts = collocations._Starts()
    got, want = Counter(), Counter()
    for chunk, own in collocations.chunks(text, starts):
        w = chunk.split(b" ")
        got.update(tuple(w[i:i + 4]) for i in range(own) if i + 4 <= len(w) and b"." not in w[i:i + 4])
    for piece in text.split(b"."):
        w = piece.split()
        want.update(tuple(w[i:i + 4]) for i in range(len(w) - 3))
    assert got == want


def _plain_superminhash(s):
    """The element-by-element form of the signature, with the operator's own draws."""
    m = superminhash.REGISTERS
    lowest = [None] * m
    for e in s:
        p = list(range(m))
        for j in range(m):
            draw = int(superminhash.mix(np.array([(int(e) + 0x9E3779B97F4A7C15 * (j + 1)) % (1 << 64)], np.uint64))[0])
            k = j + ((draw >> 48) * (m - j) >> 16)
            p[j], p[k] = p[k], p[j]
            bid = (j << 48) | (draw & ((1 << 48) - 1))
            lowest[p[j]] = bid if lowest[p[j]] is None else min(lowest[p[j]], bid)
    return superminhash.mix(np.array(lowest, np.uint64)) >> np.uint64(48)


def test_signatures():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 7, 40, 300)]
    for s, got in zip(sets, superminhash.signatures(sets), strict=True):
        assert (got == _plain_superminhash(s)).all()
    errors = []
    for _ in range(300):
        a = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        b = np.concatenate((a[:88], rng.integers(0, 1 << 63, 12, dtype=np.uint64)))
        x, y = superminhash.signatures([np.unique(a), np.unique(b)])
        errors.append(superminhash.agreement(x, y) / superminhash.REGISTERS - 88 / 112)
    plain = (88 / 112 * (1 - 88 / 112) / superminhash.REGISTERS) ** 0.5
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.95 * plain  # less than independent hashes would give


@pytest.mark.parametrize("tile", [1024, 5])
def test_superminhash_classes(spark, monkeypatch, tile):
    monkeypatch.setattr(superminhash, "TILE", tile)
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 9, 20, 60, 150, 400]))]
        for _ in range(rng.randint(1, 16)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(w) if rng.random() < 0.9 else " \n".join(w).upper()))
    n = len(docs)
    docs += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "A b")]
    rows = [*docs, (None, docs[0][1]), docs[3], docs[3]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, sig int").repartition(4)
    got = superminhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute.jaccard_classes(docs, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert superminhash.near_duplicates(df.limit(0)).count() == 0


def test_ids_that_repeat_and_long_texts(spark):
    long = " ".join(f"w{i % 7919}" for i in range(200_000))
    df = spark.createDataFrame([(5, long), (4, long + " more"), (5, "other words that are here"), (6, "other words that are here")], "doc_id long, text string")
    got = superminhash.near_duplicates(df).collect()
    assert len(got) == 4 and len({r.component_id for r in got if r.doc_id == 5}) == 1
