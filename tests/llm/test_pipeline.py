"""The pipeline's stages and the registered queries."""

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).parents[2]))
sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def _text(rng, n):
    return "\n".join(" ".join(f"w{rng.integers(0, 5000)}" for _ in range(15)) for _ in range(n // 15))


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(1)
    clean = [_text(rng, 120) for _ in range(6)]
    item = " ".join(f"q{i}" for i in range(40))
    near = clean[0].replace("w1", "v1", 1)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [*enumerate(clean), (10, near), (11, "too short"), (12, _text(rng, 90) + " " + item), (13, passage + "\n" + _text(rng, 90)), (14, passage + "\n" + _text(rng, 90)), (15, None), (16, "again again " * 40)]
    docs = pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows], "lang": ["en"] * len(rows), "source": [None] * len(rows), "n_chars": [len(t or "") for _, t in rows]},
                    schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]))
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1]), "text": pa.array([item])}), tmp_path / "benchmark.parquet")
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r.text for r in df.collect()})
    assert set(kept[0]) == {0, 1, 2, 3, 4, 5, 10, 12, 13, 14}
    assert kept[1] == {d: t for d, t in brute.dedup_lines([(d, t) for d, t in rows if d in kept[0]], 1, 20).items() if t}
    assert set(kept[2]) == {d for d, (_, c) in brute.jaccard_classes(list(kept[1].items()), 5, 80).items() if d == c}
    assert set(kept[3]) == set(kept[2]) - {12} and {0, 1, 2, 3, 4, 5} <= set(kept[3])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept[3])


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} == {x[: x.index("_") + 1] for x in names if x.startswith("op") and x[2].isdigit()}
