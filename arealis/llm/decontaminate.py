"""Benchmark decontamination with one Aho-Corasick automaton.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased: digits,
ASCII letters and everything beyond ASCII. A window is ``width`` consecutive words of an
item; an item with fewer words, but not none, is one window. A document word inside any
occurrence of a window is *hit*.

The windows of all items are the patterns of one automaton, written with a space before and
after every word so that a pattern can only meet whole words. A document is normalised the
same way, scanned once from its first to its last character, and every occurrence is mapped
back through the word starts to word numbers and to code points of the original text.

Defined cases: a null text has no words and is never contaminated; items without words have
no windows; an item without an id hits like any other but is not listed; equal windows of several items count for each of them; repeated rows and null ids
give one result row each; an empty benchmark hits nothing. Only the id and text columns are
read, so further columns of any name do no harm.

An automaton over ``MAX_CHARS`` pattern characters is what each Python worker holds at most. The
benchmark's size is measured; a larger one is cut into blocks of windows, and every document meets
the automata of all blocks in turn, so nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 13
MAX_CHARS = 8_000_000
RULE = 20  # contaminated when RULE * hit words >= words

#: Bytes of words, lower-cased; every other byte becomes a space. Words hold all bytes from 0x80.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return (text or b"").translate(_WORD_BYTES).split()


def windows(text: bytes | None, width: int = WIDTH) -> set[bytes]:
    """Distinct windows of an item, each with a space on either side."""
    w = words(text)
    if not w:
        return set()
    return {b" " + b" ".join(w[i : i + width]) + b" " for i in range(max(1, len(w) - width + 1))}


def automaton(patterns: list[tuple[bytes, list[str]]]):
    """The automaton over windows; each carries its number of words and its items."""
    import ahocorasick

    if not patterns:
        patterns = [(b"\n", [])]  # no word holds a line break, so this never occurs
    made = ahocorasick.Automaton()
    for p, items in patterns:
        made.add_word(p.decode("latin-1"), (p.count(b" ") - 1, items))
    made.make_automaton()
    return made


def scan(text: bytes | None, machine) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(number of words, merged hit ranges of word numbers, items whose windows occur)."""
    w = words(text)
    if not w:
        return 0, [], set()
    found = list(machine.iter((b" " + b" ".join(w) + b" ").decode("latin-1")))
    if not found:
        return len(w), [], set()
    # the space after word k stands at stops[k]
    stops = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    last = np.searchsorted(stops, [end for end, _ in found])
    spans = [(int(k) - n + 1, int(k) + 1) for k, (_, (n, _)) in zip(last, found, strict=True)]
    return len(w), _merge(spans), {i for _, (_, own) in found for i in own}


def original_offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point ranges of the original text for ranges of word numbers."""
    flat = np.frombuffer(text.translate(_WORD_BYTES), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], flat.view(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(points[starts[a]]), int(points[stops[b - 1]])) for a, b in ranges]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _pattern_blocks(benchmark: DataFrame, item_id: str, item_text: str, width: int, max_chars: int) -> Iterator[list]:
    """The benchmark's distinct windows with their items (none for null ids, which ``collect_set`` drops), in blocks of at most ``max_chars``
    characters on average; only one block is on the driver at a time."""

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(p, None if i is None else str(i)) for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)
                   for p in windows(t, width)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["p", "item"])

    pats = (
        benchmark.select(F.col(item_id), F.col(item_text)).mapInArrow(item_windows, "p binary, item string")
        .groupBy("p").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    chars = pats.agg(F.sum(F.length("p"))).first()[0] or 0
    n = -(-chars // max_chars)
    for k in range(n):
        part = pats.filter(F.pmod(F.xxhash64("p"), F.lit(n)) == k) if n > 1 else pats
        yield sorted((bytes(r["p"]), list(r["items"])) for r in part.collect())


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items`` (ids as strings, sorted) and
    ``spans`` (start and end in code points of the original text, end exclusive)."""
    id_type = docs.schema[doc_id].dataType
    pair = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items, spans = T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", pair)
    through = T.StructType([*found.schema.fields, spans, items])
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), items, spans])
    parts = list(_pattern_blocks(benchmark, item_id, item_text, width, max_chars)) or [[]]
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        found = found.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(part), k == 0, last), out if last else through)
    return found


def _searcher(patterns, first: bool, last: bool):  # noqa: ANN001, ANN202
    """The pass of one block. It takes (doc_id, text), or with the word ranges and items that the
    blocks before have found; the last one returns the results without the text."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(patterns.value)
        for b in batches:
            n, hit, spans, items = [], [], [], []
            for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                total, ranges, own = scan(t, machine)
                if not first:
                    ranges = _merge(ranges + [(x["start"], x["end"]) for x in b.column(2)[i].as_py()])
                    own |= set(b.column(3)[i].as_py())
                n.append(total)
                hit.append(sum(y - x for x, y in ranges))
                spans.append([{"start": x, "end": y} for x, y in (original_offsets(t, ranges) if last and ranges else ranges)])
                items.append(sorted(own))
            ids, at = pa.array(items, pa.list_(pa.string())), pa.array(spans, _RANGES)
            if last:
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), ids, at]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "items", "spans"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), at, ids], ["doc_id", "text", "spans", "items"])

    return search


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """The contamination rule: some hit, and at least a twentieth of the words."""
    return (F.col(n_hit) > 0) & (RULE * F.col(n_hit) >= F.col(n_words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", width: int = WIDTH, max_chars: int = MAX_CHARS) -> DataFrame:
    """Documents that aren't contaminated, with all their columns; rows are filtered in the
    pass that reads them, so nothing is shuffled."""
    schema, marked = docs.schema, "_hits"
    while marked in docs.columns:
        marked += "_"
    at = docs.columns.index(text)
    found = docs.withColumn(marked, F.array().cast("array<struct<start:bigint,end:bigint>>"))
    parts = list(_pattern_blocks(benchmark, "item_id", "text", width, max_chars))
    for k, part in enumerate(parts):
        found = found.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(part), at, k == len(parts) - 1), found.schema)
    return found.select(*[F.col(f"`{c}`") for c in schema.names])


def _filter(patterns, at: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(patterns.value)
        for b in batches:
            keep, spans = [], []
            for t, before in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                total, ranges, _ = scan(t, machine)
                ranges = _merge(ranges + [(x["start"], x["end"]) for x in before]) if before else ranges
                hit = sum(y - x for x, y in ranges)
                keep.append(not (last and hit > 0 and RULE * hit >= total))
                spans.append([{"start": x, "end": y} for x, y in ranges])
            cols = [*b.columns[:-1], pa.array(spans, _RANGES)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array(keep, pa.bool_()))

    return run


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the contamination contract, one row per document."""
    found = contamination(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )

