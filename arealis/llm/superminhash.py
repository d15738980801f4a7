"""Near duplicates by SuperMinHash signatures.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A document's set is its distinct shingles of ``k`` words
(the whole sequence if it has fewer, nothing without words); documents link when ``100 * intersection >= percent * union``.

1. **Signatures.** Every element ranks all registers by a permutation of its own and bids ``rank + fraction``; a register
   keeps the lowest bid. The bids of an element are correlated through its permutation: no register sees two equal ranks of one
   element, which lowers the variance of the estimate. Bids of rank ``j`` lie below those of ``j + 1``, so ranks are
   dealt with one after another for all elements at once and a document stops early, as soon as all its registers are taken.
2. **Banding.** Equal sets are folded first. A band is ``ROWS`` registers of 16 bits, exactly one 64-bit key; sets that share a key
   are candidates. With similarity 0.8, ``BANDS`` bands miss a pair with a probability below 1e-7, less above that.
3. **Verification**, representatives first: a set is compared, on full sets, with the smallest id of the bucket that its signature
   agrees with most; union-find groups what links. Buckets that are still apart go on, and only pairs from different groups in them: as
   tiles of at most ``TILE`` sets on either side, first by agreement of signatures (``SURE`` standard deviations below the
   similarity asked for; chance below 1e-8), then on full sets inside what that connects. A tile yields a spanning
   forest, never its pairs. A bucket's largest group is never compared with itself, so copies cost one comparison each.

Defined cases: null and empty texts have empty sets, linked with nothing, and are their own component; a null id is linked
with nothing, has a null component and is kept; of rows that share an id with different texts, the text with the largest hash is the
one compared, and all rows get its component. Only ids and texts are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import may_be_among, stash
from .shingles import mix, shingle_set, word_hashes

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
SURE = 6.0
TILE = 1024
TILE_SHINGLES = 4_000_000
CHUNK = 200  # texts at a time

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures (set, register) as 16-bit digests of the lowest bids; those of empty sets mean nothing."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate([*sets, np.empty(0, _U)])
    lowest = np.full((len(sets), REGISTERS), _NONE, _U)
    ranks = np.zeros((0, REGISTERS), np.uint8)
    for j in range(REGISTERS):
        # one draw gives the place that the permutation swaps here and the fraction of the bid
        draw = mix(element + _U((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        swap = j + ((draw >> _U(48)) * _U(REGISTERS - j) >> _U(16)).astype(np.int64)
        if j:
            rows = np.arange(len(element))
            register = ranks[rows, swap]
            ranks[rows, swap] = ranks[rows, j]
        else:
            register = swap
        np.minimum.at(lowest, (owner, register), _U(j << 48) | (draw & _U(0xFFFFFFFFFFFF)))
        left = (lowest == _NONE).any(axis=1)[owner]
        if not left.any():
            break
        if j:
            element, owner, ranks = element[left], owner[left], ranks[left]
        else:
            element, owner, first = element[left], owner[left], swap[left]
            ranks = np.tile(np.arange(REGISTERS, dtype=np.uint8), (len(element), 1))
            ranks[np.arange(len(element)), first] = 0
    return (mix(lowest) >> _U(48)).astype(np.uint16)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many registers agree; an estimate of the Jaccard similarity when divided by their number."""
    return (a == b).sum(axis=-1)


def _agreeing(percent: int) -> float:
    """Registers that have to agree for a pair to be looked at."""
    p = percent / 100
    return REGISTERS * p - SURE * (REGISTERS * p * (1 - p)) ** 0.5


def _sets(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets of the second column's texts) in small groups."""
    raw = b.column(1).cast(pa.binary())
    for at in range(0, b.num_rows, CHUNK):
        yield at, [shingle_set(w, k) for w in word_hashes([t or b"" for t in raw.slice(at, CHUNK).to_pylist()])]


def signed(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, t, n, d1, d2, sig``: hash of the text, size of the document's set, 128 bits that name it, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, sets in _sets(b, k):
                total = lambda salt: pa.array([int(mix(s ^ _U(salt)).sum(dtype=_U).astype(np.int64)) for s in sets], pa.int64())  # noqa: B023, E731
                sig = pa.array([x.tobytes() for x in signatures(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, CHUNK), b.column(2).slice(at, CHUNK), pa.array([len(s) for s in sets], pa.int64()), total(0), total(0x5851F42D4C957F2D), sig],
                    ["doc_id", "t", "n", "d1", "d2", "sig"])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    return given.mapInArrow(run, "doc_id bigint, t bigint, n bigint, d1 bigint, d2 bigint, sig binary")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node, t, ...) with the nodes' texts. Both sides grow with the corpus, so they are merged at every size."""
    source = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("node"), F.xxhash64("text").alias("t"), "text")
    near = may_be_among(source, F.xxhash64("node"), wanted.select(F.xxhash64("node").alias("x")).distinct(), "x")
    return near.join(wanted.hint("merge"), ["node", "t"])


def _first_links(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b``: which of the pairs (node, t, rep, rep_t) link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, _U)
        for b in batches:
            found = []
            ids, reps, theirs = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).cast(pa.binary())
            for at, sets in _sets(b, k):
                for i, s in enumerate(sets, at):
                    if reps[i] != last:  # rows come by representative
                        last, held = reps[i], next(shingle_set(w, k) for w in word_hashes([theirs[i].as_py() or b""]))
                    if _linked(s, held, percent):
                        found.append((last, ids[i]))
            yield _pair_batch(found)

    own = _texts(docs, pairs.select("node", "t", "rep"))
    both = _texts(docs, pairs.select(F.col("rep").alias("node"), F.col("rep_t").alias("t")).distinct()).select(F.col("node").alias("rep"), F.col("text").alias("theirs"))
    joined = own.join(both.hint("merge"), "rep").select("node", "text", "rep", "theirs")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _forest(table: pa.Table, percent: int, go) -> list[tuple[int, int]]:  # noqa: ANN001
    """Links that join groups of a tile's members (node, c, n, sig, minor). Each member outside the largest group meets those of other
    groups whose signatures agree, the likeliest first, where ``go(i, j)`` says yes."""
    ids, group, n, minor = (table.column(x).to_numpy(zero_copy_only=False) for x in ("node", "c", "n", "minor"))
    sig = np.stack([np.frombuffer(x, np.uint16) for x in table.column("sig").to_pylist()])
    root, least, out = np.unique(group, return_inverse=True)[1], _agreeing(percent), []
    for i in np.flatnonzero(minor):
        others = np.flatnonzero((root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        same = agreement(sig[others], sig[i])
        near = np.flatnonzero(same >= least)
        for j in others[near[np.argsort(-same[near], kind="stable")]]:
            if root[i] != root[j] and go(i, j):
                root[root == root[j]] = root[i]
                out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def _tiled(members: DataFrame, key: str) -> DataFrame:
    """Members (key, node, n, c) of the keys that hold several groups ``c``, dealt to tiles: ``tile`` beside ``key``, and
    whether a member is outside the key's largest group, ``minor``. Blocks of such members meet each other and the blocks of the largest."""
    per = members.groupBy(key, "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    load = lambda m, s: F.ceil(F.greatest(m / TILE, s / TILE_SHINGLES)).cast("int")
    # largest first, the smallest name on a tie
    facts = per.groupBy(key).agg(
        F.max(F.struct("m", (-F.col("c")).alias("c"), "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("groups"))
    plan = facts.filter("groups > 1").select(
        key, (-F.col("top.c")).alias("major"), (load(F.col("m"), F.col("s")) <= 1).alias("single"),
        load(F.col("top.m"), F.col("top.s")).alias("majors"), load(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("minors"))
    both = members.join(plan, key).withColumn("minor", F.col("c") != F.col("major"))
    both = both.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int"))
    name = lambda kind, a, b: F.concat_ws("/", F.lit(kind), a, b)
    among = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda o: name("0", F.least("block", o), F.greatest("block", o)))
    against = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda o: name("1", F.col("block"), o))
    met = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda o: name("1", o, F.col("block")))
    tiles = F.when(F.col("single"), F.array(F.lit("0/0/0"))).when(F.col("minor"), F.concat(among, against)).otherwise(met)
    return both.withColumn("tile", F.explode(tiles)).drop("block", "major", "single", "majors", "minors")


def _may_link(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs that join groups inside a bucket if signatures are right. ``members``: (bucket, node, n, c, sig)."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_pair_batch(_forest(table, percent, lambda i, j: True))])

    return _tiled(members, "bucket").groupBy("bucket", "tile").applyInArrow(run, "a bigint, b bigint")


def _links(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b``: links on full sets that join groups inside each class ``g``. ``members``: (g, node, t, n, c, sig)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, sets in _sets(b, k):
                raw = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, CHUNK), raw, *(b.column(i).slice(at, CHUNK) for i in range(2, b.num_columns))], ["node", "hashes", *b.schema.names[2:]])

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, _U) for x in table.column("hashes").to_pylist()]
        return pa.Table.from_batches([_pair_batch(_forest(table, percent, lambda i, j: _linked(sets[i], sets[j], percent)))])

    held = _texts(docs, _tiled(members, "g")).select("node", "text", "g", "n", "c", "sig", "minor", "tile")
    full = held.mapInArrow(hashes, "node bigint, hashes binary, g bigint, n bigint, c bigint, sig binary, minor boolean, tile string")
    return full.groupBy("g", "tile").applyInArrow(run, "a bigint, b bigint")


def _grouped(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``node`` and the smallest node that it is linked with."""
    return components(nodes.select(F.col("node").alias("id")), links).select(F.col("id").alias("node"), F.col("component").alias(name))


def classes(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    named = stash(signed(docs, k), "signatures")
    own = F.struct("t", "n", "d1", "d2", "sig")
    full = named.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.max(own).alias("s")).select("doc_id", "s.*")
    # equal sets are one node: the one of the smallest id
    folded = full.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "t", "sig")).alias("s"))
    sets = stash(folded.select("n", "d1", "d2", F.col("s.doc_id").alias("node"), "s.t", "s.sig"), "sets")
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.substring("sig", 1 + 2 * ROWS * i, 2 * ROWS).alias("key")) for i in range(BANDS)])
    band = sets.select("node", F.explode(keys).alias("e")).select("node", F.xxhash64("e.band", "e.key").alias("key"))
    # buckets of the same sets are one, named by them
    bucket = band.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.expr("bit_xor(xxhash64(node))").alias("bucket"), F.min("node").alias("rep")).filter("m > 1")
    met = stash(band.join(bucket, "key").select("bucket", "node", "rep").distinct(), "buckets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("t").alias(f"{x}_t"), F.col("sig").alias(f"{x}_sig"))
    asked = met.filter("node <> rep").select("node", "rep").distinct().join(side("node"), "node").join(side("rep"), "rep")
    # registers that agree; two bytes each
    digest = lambda x, i: F.substring(f"{x}_sig", 2 * i + 1, F.lit(2))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(REGISTERS - 1)), lambda i: digest("node", i) == digest("rep", i)))
    likely = asked.withColumn("same", same).filter(F.col("same") >= _agreeing(percent))
    nearest = F.max_by(F.struct("rep", "rep_t"), F.struct("same", -F.col("rep")))
    best = likely.groupBy("node", F.col("node_t").alias("t")).agg(nearest.alias("r")).select("node", "t", "r.*")
    links = stash(_first_links(docs, stash(best, "nearest"), k, percent), "first-links")
    nodes = met.select("node").distinct()
    groups = stash(_grouped(nodes, links, "c"), "groups")
    facts = sets.select("node", "t", "n", "sig").join(groups, "node")
    may = _may_link(met.select("bucket", "node").join(facts, "node"), percent).distinct()
    wider = _grouped(nodes, stash(may.unionByName(links), "may-link"), "g")
    more = stash(_links(docs, stash(wider.join(facts, "node"), "wider"), k, percent).distinct(), "links")
    found = _grouped(nodes, links.unionByName(more), "o")
    placed = sets.select("n", "d1", "d2", "node").join(found, "node", "left")
    known = full.join(placed, ["n", "d1", "d2"]).select(F.col("doc_id").alias("_d"), F.coalesce("o", "node").alias("_c"))
    return named.join(known, F.col("doc_id") == F.col("_d"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("_c", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: a document is kept if it is the smallest id of its component."""
    return classes(docs, k, percent).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
