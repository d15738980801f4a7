"""Large JSON documents cut into the elements of one of their arrays, so that one file is many tasks.

``{"elements": [{...}, {...}], ...}`` on a single line can't be split by a line reader. Here a text scan that ends records at every
``}`` splits the file at any place, and what a task reads becomes slices of about ``SLICE`` bytes. A slice can't know whether it begins
inside a string or how deep, so it states what it changes for either case; running sums over the slices (not their contents)
then give every slice its start. With that, each slice is cut on its own: whole elements leave as they are, and the ends of
those that go over slices are put together. No task reads a whole document and the driver reads none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

SLICE = 1 << 20
_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord("{"), ord("[")]] = True
_CLOSE[[ord("}"), ord("]")]] = True


def _quotes(b: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that no backslash escapes."""
    at = np.arange(len(b))
    plain = np.maximum.accumulate(np.where(b != ord("\\"), at, -1))  # the last byte that is no backslash
    run = at - 1 - np.concatenate(([-1], plain[:-1]))
    return (b == ord('"')) & (run % 2 == 0)


def _marks(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which bytes lie inside a string if the slice begins outside one, change of depth at every byte)."""
    inside = np.cumsum(_quotes(b)) % 2 == 1
    return inside, _OPEN[b].astype(np.int8) - _CLOSE[b].astype(np.int8)


def summary(data: bytes) -> tuple[int, int, int]:
    """(parity of its quotes, change of depth if it begins outside a string, and if it begins inside one)."""
    b = np.frombuffer(data, np.uint8)
    inside, step = _marks(b)
    return int(_quotes(b).sum() % 2), int(step[~inside].sum()), int(step[inside].sum())


def cut(data: bytes, in_string: bool, depth: int, key: str) -> tuple[bool | None, list[tuple[str, bool | None, bytes]]]:
    """(whether the last container opened below the root is the wanted array, null if none is opened here; pieces).

    A piece is (role, wanted, text): ``whole``, or ``tail``, ``middle`` and ``head`` of an element that begins, goes on or ends here.
    ``wanted`` is null where the container was opened before this slice.
    """
    b = np.frombuffer(data, np.uint8)
    inside, step = _marks(b)
    inside = ~inside if in_string else inside
    at = np.flatnonzero((step != 0) & ~inside)
    level = depth + np.cumsum(step[at])
    opens = step[at] > 0
    containers = at[opens & (level == 2)]
    named = re.compile(rb'"' + re.escape(key.encode()) + rb'"\s*:\s*$')
    wanted = [b[i] == ord("[") and bool(named.search(data, max(0, i - len(key) - 64), i)) for i in containers.tolist()]
    holder = lambda i: (lambda k: wanted[k] if k >= 0 else None)(int(np.searchsorted(containers, i)) - 1)
    first, last = at[opens & (level == 3)], at[~opens & (level == 2)] + 1
    pieces: list[tuple[str, bool | None, bytes]] = []
    if depth > 2:  # an element is open at the start
        if not len(last):
            return (wanted[-1] if wanted else None), [("middle", None, data)]
        pieces.append(("head", None, data[: last[0]]))
        last = last[1:]
    for i, start in enumerate(first.tolist()):
        if i < len(last):
            pieces.append(("whole", holder(start), data[start : last[i]]))
        else:
            pieces.append(("tail", holder(start), data[start:]))
    return (wanted[-1] if wanted else None), pieces


def _sliced(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, data, parity, outside, inside): slices with what each changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "seq", "data", "parity", "outside", "inside"]
        now, seq, held, size = None, 0, [], 0

        def row() -> pa.RecordBatch:
            data = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, seq, data, *summary(data))], names)

        for b in batches:
            for file, block, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if (file, block) != now:
                    if held:
                        yield row()
                    now, seq, held, size = (file, block), 0, [], 0
                held += [text, b"}"]
                size += len(text) + 1
                if size >= SLICE:
                    yield row()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield row()

    text = spark.read.option("lineSep", "}").text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    return text.mapInArrow(run, "file string, block long, seq long, data binary, parity long, outside long, inside long")


def elements(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, text): the objects in the top-level array ``key`` of every document (one a file), as JSON text."""
    stored = scratch_path(spark, "slices")
    _sliced(spark, path).write.parquet(stored)
    slices = spark.read.parquet(stored)
    place = ["file", "block", "seq"]
    # a row a slice, without its content
    order = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)
    begun = slices.select(*place, "parity", "outside", "inside").withColumn("in_string", F.coalesce(F.sum("parity").over(order), F.lit(0)) % 2 == 1)
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    begun = begun.withColumn("depth", F.coalesce(F.sum(change).over(order), F.lit(0))).select(*place, "in_string", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, block, seq, data, in_string, depth in zip(*(c.to_pylist() for c in b.columns), strict=True):
                last, pieces = cut(data, in_string, depth, key)
                pieces = pieces or [(None, None, None)]
                n = len(pieces)
                cols = [[file] * n, [block] * n, [seq] * n, list(range(n)), [last] * n, [p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].cast(pa.string())], ["file", "block", "seq", "i", "last", "role", "wanted", "text"])

    found = scratch_path(spark, "pieces")
    joined = slices.select(*place, "data").join(begun, place)
    joined.mapInArrow(run, "file string, block long, seq long, i long, last boolean, role string, wanted boolean, text string").write.parquet(found)
    pieces = spark.read.parquet(found)
    holder = pieces.filter("i = 0").select(*place, F.last("last", ignorenulls=True).over(order).alias("prior"))
    known = pieces.filter("role is not null").join(holder, place).withColumn("wanted", F.coalesce("wanted", "prior"))
    whole = known.filter("role = 'whole' and wanted").select("file", "text")
    # at most two of a slice: those that go over its ends
    ends = known.filter("role <> 'whole'").select(*place, "i", "role", "wanted", "text")
    so_far = Window.partitionBy("file").orderBy("block", "seq", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.when(F.col("role") == "tail", F.struct("block", "seq", "i"))
    keyed = ends.select(*place, "i", "role", "wanted", F.last(start, ignorenulls=True).over(so_far).alias("start")).join(ends.select(*place, "i", "text"), [*place, "i"])
    parts = keyed.groupBy("file", "start").agg(F.max_by("wanted", F.col("role") == "tail").alias("wanted"), F.sort_array(F.collect_list(F.struct(*place[1:], "i", "text"))).alias("p"))
    spanning = parts.filter("wanted").select("file", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return whole.unionByName(spanning)
