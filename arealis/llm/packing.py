"""Best-fit packing of token sequences.

A document is its token ids and a closing 0. One longer than ``size`` is cut into pieces of
``size``; where that leaves a rest, the rest is the first piece. All pieces are packed whole
into sequences of at most ``size`` tokens.

Bulk-synchronous best fit, longest documents first. A superstep takes all documents of one length:

* the open gaps lie sorted in runs (equal gap, consecutive sequence numbers), the documents
  of the length in order of their rank;
* a successor sweep goes through the gaps from the smallest that fits upwards;
* documents that want the same gap are settled by rank: the first gap takes the lowest ranks;
* gaps shrink, the next sweep sees them, and documents that found none open new sequences.

Documents of one length are interchangeable, so the supersteps need only how many there are of each:
a table of at most ``size`` rows however large the corpus, from one count. What they decide is
a table of rank ranges, bounded by ``size`` as well, in which every document finds its own place
through its rank by binary search, in parallel. Ranks are counted per length and salt, with as
many salts as keep a hot length's groups below ``RANKED`` rows.

Defined cases: a null or empty text is the single token 0; repeated rows are packed each for
itself; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash
from .tokens import text_encoder, vocabulary_path

SIZE = 2048
RANKED = 100_000


def cuts(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    rest = n % size
    head = [(0, rest)] if rest else []
    return head + [(s, size) for s in range(rest, n, size)]


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, vocabulary: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, with ``ids`` if asked for."""
    path = vocabulary or vocabulary_path()
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    names = [f.name for f in fields] + ["ids"] * with_ids
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(encode(part.column(1).to_pylist())):
                    raw += b"\0\0\0\0"
                    for k, (s, n) in enumerate(cuts(len(raw) // 4, size)):
                        own = raw[4 * s : 4 * (s + n)]
                        row.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                cols = [part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(cut, schema)


def supersteps(counts: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """Place ``counts[length]`` documents of each length; returns the rank ranges and the number of sequences.

    A row of the ranges is (length, first rank, first sequence, documents per sequence, offset
    of the first): rank r goes to sequence ``first + (r - rank) // per`` at ``offset + (r - rank)
    % per * length``. Rows are sorted by length and rank.
    """
    gaps: list[int] = []  # open gap sizes, sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first sequence, sequences)
    placed: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(gaps, gap)
            runs.setdefault(gap, []).append((first, n))

    def fill(length: int, rank: int, left: int, gap: int, first: int, n: int) -> int:
        """Put ``left`` documents from ``rank`` on into a run of gaps; returns how many fitted."""
        per = gap // length
        took = min(left, n * per)
        placed.append((length, rank, first, per, size - gap))
        full, part = divmod(took, per)
        leave(gap - per * length, first, full)
        if part:
            leave(gap - part * length, first + full, 1)
        leave(gap, first + full + (part > 0), n - full - (part > 0))
        return took

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        at = bisect_left(gaps, length)
        for gap in gaps[at:]:
            if not left:
                break
            own = runs.pop(gap)
            gaps.remove(gap)
            while own and left:
                first, n = own.pop()
                took = fill(length, rank, left, gap, first, n)
                rank, left = rank + took, left - took
            for first, n in own:
                leave(gap, first, n)
        if left:
            n = -(-left // (size // length))
            fill(length, rank, left, size, opened, n)
            opened += n
    placed.sort()
    return np.array(placed, np.int64).reshape(-1, 5), opened


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a stored table of pieces (``doc_id, piece, length, ids_crc32``, ...)."""
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    ranges, _ = supersteps(counts, size)
    salts = max(1, -(-max(counts.values(), default=0) // RANKED))
    # how many of a length come in the salts before: lengths x salts, bounded by size and rows / RANKED
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    per = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = per.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_salt"])
    # the table of rank ranges: bounded by ``size``, whatever the rows
    table = cut.sparkSession.sparkContext.broadcast(ranges)

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def find(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        t, shift = table.value, 1 << 44
        at = np.searchsorted(t[:, 0] * shift + t[:, 1], length.to_numpy() * shift + rank.to_numpy(), side="right") - 1
        over = rank.to_numpy() - t[at, 1]
        return pd.DataFrame({"sequence_id": t[at, 2] + over // t[at, 3], "offset": t[at, 4] + over % t[at, 3] * length.to_numpy()})

    found = ranked.withColumn("_at", find(F.col("length"), F.col("_rank") + F.col("_before")))
    return found.select(*cut.columns, "_at.sequence_id", "_at.offset")


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``): one row per piece.

    Texts are encoded once; the pieces are stored in the shared folder before they are counted.
    """
    cut = pieces(docs, doc_id=doc_id, text=text, size=size, vocabulary=vocabulary, with_ids=with_ids)
    return place(stash(cut, "pieces"), size)
