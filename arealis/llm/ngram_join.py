"""N-gram Jaccard join: which documents share nearly all their word shingles.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A document's set is its distinct shingles of ``k`` words
(the whole sequence if it has fewer, nothing without words). Documents link when
``100 * intersection >= percent * union``; a class is what links connect. No link is lost:

1. **Equal sets** are folded first, by 128 bits over the set, with partial aggregation; one
   representative (the smallest id) stands for them from here on.
2. **Size-banded keys.** Two linked sets of at most ``s`` shingles differ in at most ``d = 2 s (100 - percent) /
   (100 + percent)`` of them. A band of sizes cuts the space of hashes into ``d + c`` segments, so at
   least ``c`` segments of two linked sets are equal; a set's keys are hashes of its segments. ``c`` is so large that
   a set has ``c`` empty segments hardly ever; one that has uses its empty segments as keys too. Smaller sets that
   can link into the next bands have keys there as well.
3. **Tiles.** Sets that share a key, in blocks of at most ``TILE``, are compared by hashed bitmaps: each bit that one bitmap has and
   the other lacks stands for a shingle that isn't shared, which bounds the intersection from above. A tile keeps a spanning
   forest of the pairs that the bound leaves, never the pairs themselves.
4. **Exact check.** What the forests connect is compared by wider bitmaps and then by intersection of the
   sorted arrays, again in tiles, skipping pairs that are connected already. The links found are a spanning forest of the classes.

Defined cases: null and empty texts have empty sets, linked with nothing, and are their own component; a null id is linked
with nothing and has a null component; rows that repeat an id are one node. Only ids and texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import free_names, may_be_among, stash
from .shingles import mix, shingle_set, word_hashes

RATIO = 1.25  # of the ends of a band
TILE = 1024  # sets in a tile, of
TILE_SHINGLES = 4_000_000  # shingles in all
KEYS_A_TASK = 2_000_000
KEYS_A_ROW = 250_000  # keys that a task gathers before it deals them out
CHUNK = 400  # texts hashed at a time

_U = np.uint64


@lru_cache(maxsize=4)
def bands(percent: int) -> list[tuple[int, int, int]]:
    """(smallest size, segments, spare segments) of every band; bands whose sets can only be equal have none."""
    out, low = [], 1
    while low < 1 << 31:
        high = max(low, math.ceil(low * RATIO) - 1)
        differ = 2 * high * (100 - percent) // (100 + percent)
        if differ:
            spare, least = 1, low * percent / 100
            for _ in range(20):
                empty = (differ + spare) * math.exp(-least / (differ + spare))
                spare = max(spare, math.ceil(empty + 4 * math.sqrt(empty)) + 1)
            out.append((low, differ + spare, spare))
        else:
            out.append((low, 0, 0))
        low = high + 1
    return out


def set_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a sorted set in every band where it may meet a partner."""
    n, out, table = len(s), [], bands(percent)
    lows = [b[0] for b in table]
    own = int(np.searchsorted(lows, n, "right")) - 1
    while own < len(table) and (table[own][0] <= n or 100 * n >= percent * table[own][0]):
        low, parts, spare = table[own]
        own += 1
        if not parts:
            continue
        segment = (s >> _U(32)) * _U(parts) >> _U(32)
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        held = segment[first]
        total = mix(np.add.reduceat(mix(s ^ _U(0xA5A5A5A5A5A5A5A5)), first) + np.diff(np.append(first, n)).astype(_U))
        if parts - len(held) >= spare:
            gone = np.setdiff1d(np.arange(parts, dtype=_U), held)
            held, total = np.concatenate((held, gone)), np.concatenate((total, np.zeros(len(gone), _U)))
        out.append(mix(total + mix(held + _U(low << 24))))
    return np.concatenate(out) if out else np.empty(0, _U)


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) in small groups."""
    raw = b.column(1).cast(pa.binary())
    for at in range(0, b.num_rows, CHUNK):
        yield at, [t or b"" for t in raw.slice(at, CHUNK).to_pylist()]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, d1, d2``: size of each document's set and 128 bits that name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d1, d2 = [], [], []
            for _, texts in _texts(b):
                for w in word_hashes(texts):
                    s = shingle_set(w, k)
                    n.append(len(s))
                    d1.append(int(mix(s).sum(dtype=_U).astype(np.int64)))
                    d2.append(int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, d1, d2))], ["doc_id", "n", "d1", "d2"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint")


def _shared_keys(docs: DataFrame, k: int, percent: int, tasks: int) -> DataFrame:
    """``bucket, doc_id``: sets of documents that share a key; buckets of the same documents come once a task."""

    def dealt_out(keys: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        """A row for each task: the keys that it gets and whose they are."""
        key = np.concatenate(keys)
        doc = np.repeat(np.array(ids, np.int64), [len(x) for x in keys])
        to = (key >> _U(32)) * _U(tasks) >> _U(32)
        order = np.argsort(to, kind="stable")
        key, doc, to = key[order], doc[order], to[order]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        packed = [[x.tobytes() for x in np.split(y, first[1:])] for y in (doc, key)]
        return pa.RecordBatch.from_arrays([pa.array(to[first].astype(np.int32)), *(pa.array(x, pa.binary()) for x in packed)], ["part", "docs", "keys"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()  # copies inside a task give their keys once
        held, whose, size = [], [], 0
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, texts in _texts(b):
                for i, w in enumerate(word_hashes(texts)):
                    s = shingle_set(w, k)
                    name = (len(s), int(mix(s).sum(dtype=_U)))
                    if not len(s) or name in met:
                        continue
                    if len(met) < 200_000:
                        met.add(name)
                    own = set_keys(s, percent)
                    if len(own):
                        held.append(own), whose.append(ids[at + i])
                        size += len(own)
                if size > KEYS_A_ROW:
                    yield dealt_out(held, whose)
                    held, whose, size = [], [], 0
        if size:
            yield dealt_out(held, whose)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, key = [], []
        for b in batches:
            owner += [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            key += [np.frombuffer(x, _U) for x in b.column(2).to_pylist()]
        if not key:
            return
        key_, doc = np.concatenate(key), np.concatenate(owner)
        order = np.lexsort((doc, key_))
        key_, doc = key_[order], doc[order]
        again = np.concatenate(([False], (key_[1:] == key_[:-1]) & (doc[1:] == doc[:-1])))
        key_, doc = key_[~again], doc[~again]
        first = np.flatnonzero(np.concatenate(([True], key_[1:] != key_[:-1])))
        size = np.diff(np.append(first, len(key_)))
        name = np.add.reduceat(mix(doc.astype(_U)), first) if len(first) else np.empty(0, _U)
        pick = np.flatnonzero(size > 1)
        pick = pick[np.unique(name[pick], return_index=True)[1]]
        for some in np.array_split(pick, max(1, int(size[pick].sum()) // 50_000)):
            rows = np.concatenate([np.arange(first[i], first[i] + size[i]) for i in some]) if len(some) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name[some], size[some]).astype(np.int64)), pa.array(doc[rows])], ["bucket", "doc_id"])

    dealt = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return dealt.mapInArrow(keys, "part int, docs binary, keys binary").repartitionById(tasks, "part").mapInArrow(meet, "bucket bigint, doc_id bigint")


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Hashed bitmap of a set: ``bits`` (a power of two, 64 at least) in 64-bit words."""
    at = s & _U(bits - 1)
    out = np.zeros(bits, np.uint8)
    out[at] = 1
    return np.packbits(out).view(_U)


def _fold(words: np.ndarray, to: int) -> np.ndarray:
    """A bitmap of ``to`` words from a longer one."""
    return np.bitwise_or.reduce(words.reshape(-1, to), axis=0)


def _width(n: int, load: int = 1) -> int:
    return 1 << max(6, (max(n, 1) * load - 1).bit_length())


def upper_bounds(maps: np.ndarray, sizes: np.ndarray, i: int) -> np.ndarray:
    """Upper bounds of the intersections of set ``i`` with the sets before it."""
    a, b = maps[i], maps[:i]
    lacks = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
    extra = np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
    return np.minimum(sizes[i] - lacks, sizes[:i] - extra)


class _Forest:
    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: int, b: int) -> None:
        x, y = self.root[a], self.root[b]
        self.root[self.root == max(x, y)] = min(x, y)


def _tile(ids: np.ndarray, sizes: np.ndarray, maps: np.ndarray, percent: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Spanning forest (smaller id, larger id) of the pairs that may link; with ``sets``, of those that do."""
    order = np.lexsort((ids, sizes))
    ids, sizes, maps = ids[order], sizes[order], maps[order]
    forest, out = _Forest(len(ids)), []
    for i in range(1, len(ids)):
        low = int(np.searchsorted(sizes[:i] * 100, percent * sizes[i]))
        if low == i:
            continue
        bound = upper_bounds(maps[low : i + 1], sizes[low : i + 1], i - low)
        close = low + np.flatnonzero(100 * bound >= percent * (sizes[low:i] + sizes[i] - bound))
        # the likeliest first: one link makes the rest of its class unnecessary
        for j in close[np.argsort(-bound[close - low], kind="stable")].tolist():
            if forest.root[i] == forest.root[j]:
                continue
            if sets is not None:
                a, b = sets[order[i]], sets[order[j]]
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                both = int((a[at] == b).sum())
                if 100 * both < percent * (len(a) + len(b) - both):
                    continue
            forest.join(i, j)
            out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return [(a, b) for a, b in out if a != b]


def _tiled(members: DataFrame, group: str) -> DataFrame:
    """Rows (group, node, ...) with ``a, b``: the tile, a pair of blocks of the group's members. Smaller groups are one tile."""
    per = members.groupBy(group).agg(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES).alias("_n"))
    both = members.join(per, group).withColumn("_blocks", F.when(F.col("_n") <= 1, 1).otherwise(F.ceil(2 * F.col("_n"))).cast("int"))
    both = both.withColumn("_own", F.pmod(F.xxhash64("node", "n"), F.col("_blocks")).cast("int"))
    other = both.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return other.withColumns({"a": F.least("_own", "_other"), "b": F.greatest("_own", "_other")}).drop("_n", "_blocks", "_own", "_other")


def _may_link(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of nodes that connect what may link inside each bucket. ``members``: (bucket, node, n, bits)."""

    def run(table: pa.Table) -> pa.Table:
        ids, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        raw = [np.frombuffer(x, _U) for x in table.column("bits").to_pylist()]
        width = min(len(x) for x in raw)
        return _pairs(_tile(ids, n, np.stack([_fold(x, width) for x in raw]), percent))

    return _tiled(members, "bucket").groupBy("bucket", "a", "b").applyInArrow(run, "a bigint, b bigint")


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _links(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b``: pairs of nodes that connect what links inside each group. ``members``: (g, node, n)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _texts(b):
                raw = pa.array([shingle_set(w, k).tobytes() for w in word_hashes(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, CHUNK), raw, *(b.column(i).slice(at, CHUNK) for i in (2, 3, 4))], ["node", "hashes", "g", "a", "b"])

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, _U) for x in table.column("hashes").to_pylist()]
        n = np.array([len(s) for s in sets])
        width = _width(int(n.max()), 4)
        return _pairs(_tile(table.column("node").to_numpy(), n, np.stack([bitmap(s, width) for s in sets]), percent, sets))

    held = _held(docs, _tiled(members, "g").select("node", "g", "a", "b")).select("node", "text", "g", "a", "b")
    return held.mapInArrow(hashes, "node bigint, hashes binary, g bigint, a int, b int").groupBy("g", "a", "b").applyInArrow(run, "a bigint, b bigint")


def _held(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted nodes. Both sides grow with the corpus, so they are merged at every size."""
    source = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("node"), "text")
    near = may_be_among(source, F.xxhash64("node"), wanted.select(F.xxhash64("node").alias("x")).distinct(), "x")
    return near.join(wanted.hint("merge"), "node")


def _bitmaps(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``node, n, bits`` of the wanted nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _texts(b):
                sets = [shingle_set(w, k) for w in word_hashes(texts)]
                bits = [bitmap(s, _width(len(s))).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, CHUNK), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits, pa.binary())], ["node", "n", "bits"])

    return _held(docs, wanted).select("node", "text").mapInArrow(run, "node bigint, n bigint, bits binary").filter("n > 0")


def classes(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs``."""
    spark = docs.sparkSession
    named = stash(signatures(docs, k), "signatures")
    full = named.filter("n > 0 and doc_id is not null")
    reps = full.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"))
    folded = full.join(reps, ["n", "d1", "d2"]).select("doc_id", "node").distinct()
    size = full.agg(F.sum("n")).first()[0] or 0
    # keys follow from the sizes: so many a shingle, times the bands that a set may be in
    share = 2 * (100 - percent) / (100 + percent) * (1 + math.log(100 / percent) / math.log(RATIO))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * share / KEYS_A_TASK))
    met = stash(_shared_keys(docs.select("doc_id", "text"), k, percent, tasks).distinct(), "buckets")
    alike = met.join(folded, "doc_id").select("bucket", "node").distinct()
    several = alike.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket")
    alike = stash(alike.join(several, "bucket", "left_semi"), "alike")
    maps = stash(_bitmaps(docs, alike.select("node").distinct(), k), "bitmaps")
    may = stash(_may_link(alike.join(maps, "node"), percent).distinct(), "may-link")
    nodes = lambda e: e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    groups = components(nodes(may), may).select(F.col("id").alias("node"), F.col("component").alias("g"))
    sizes = maps.groupBy("node").agg(F.max("n").alias("n"))
    members = stash(groups.join(sizes, "node"), "groups")
    links = stash(_links(docs, members, k, percent).distinct(), "links")
    found = components(nodes(links), links).select(F.col("id").alias("node"), F.col("component").alias("c"))
    by_node = folded.groupBy("doc_id").agg(F.min("node").alias("node"))
    known = by_node.join(found, "node", "left").select(F.col("doc_id").alias("_d"), F.coalesce("c", "node").alias("_c"))
    return named.join(known, F.col("doc_id") == F.col("_d"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("_c", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The document of the smallest id of every class, with all columns."""
    gone = free_names(docs.columns, "_gone")[0]
    extra = classes(docs, k, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(extra, docs["doc_id"] == F.col(gone), "left_anti")
