"""Hard negatives for contrastive training: rotated one-bit codes bound every score, integers decide.

An anchor's positives are the rows of its own label with the highest scores; a positive's hard negatives are the highest
scores of other labels inside a band of the positive's score. Scores are inner products of integer vectors.

1. **Codes.** A vector is turned by a random rotation and each component keeps its sign: one bit. Stored beside the code
   are the norm of what was coded and its alignment with its code (their cosine), which give the code its best length;
   what is left is coded again under the next rotation, ``STAGES`` times in all. Each stage leaves about 0.6 of the norm.
2. **Estimates.** An anchor's rotated components become ``PLANES``-bit integers, cut into bit planes. Popcounts of
   plane AND code sum to the inner product with the codes so far. Its error is bounded without any chance: rounding by the
   sum of what was rounded off, the vector's residual by Cauchy-Schwarz against the part of the anchor across the last code.
3. **Filter.** Stage by stage, a row goes once its interval can't reach the best k lower bounds (positives) or can't
   meet a positive's band above its best certain rows (negatives). Whoever is left is scored exactly, in integers.

Rows are dealt to blocks of at most ``BLOCK`` on average; a task holds the codes of one block and anchors stream past it, so
memory depends on neither the number of anchors nor that of labels. A block yields at most k rows an anchor (or an
anchor and positive), never pairs.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part, nor do rows without an id.
Rows equal in id, label and vector count once; rows that share an id but differ count each, and never as partners of each
other. Vectors of different length don't meet; an empty vector scores 0 with another. Ties go to the smaller id. Components
are floored after scaling; scores of 2**56 and more raise an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

STAGES = 6
PLANES = 6
BLOCK = 131_072  # rows in a block, at most on average
LEAST = 512  # rows that make a block of their own worthwhile
LIMIT = 1 << 56

_U = np.uint64
_CODED = "key long, vec_id long, label int, dim int, ints binary, codes binary, facts binary"


@lru_cache(maxsize=8)
def rotations(dim: int) -> list[np.ndarray]:
    """``STAGES`` random rotations, the same in every task."""
    rng = np.random.default_rng([20240611, dim])
    return [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(STAGES)]


def _bits(set_: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(set_, axis=1)
    width = -(-max(packed.shape[1], 1) // 8) * 8
    out = np.zeros((len(packed), width), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(_U)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes: row, stage, word), (facts: row, 2 * STAGES + 1): norms of what each stage codes and of the last
    residual, then alignments."""
    n, dim = x.shape
    left, codes, norms, aligned = x, [], [], []
    for turn in rotations(dim) if dim else ():
        z = left @ turn.T
        plus = z >= 0
        norm = np.sqrt((left * left).sum(axis=1))
        length = np.abs(z).sum(axis=1) / np.sqrt(dim)  # of the projection on the code
        codes.append(_bits(plus))
        norms.append(norm)
        aligned.append(np.divide(length, norm, out=np.zeros(n), where=norm > 0))
        left = left - (np.where(plus, 1.0, -1.0) * (length / np.sqrt(dim))[:, None]) @ turn
    if not dim:
        return np.zeros((n, STAGES, 1), _U), np.zeros((n, 2 * STAGES + 1))
    norms.append(np.sqrt((left * left).sum(axis=1)))
    return np.stack(codes, axis=1), np.stack(norms + aligned, axis=1)


class _Asker:
    """An anchor's rotated components in bit planes."""

    def __init__(self, q: np.ndarray) -> None:
        self.dim, self.norm = len(q), float(np.sqrt(q @ q))
        self.planes, self.step, self.off = [], [], []
        half = (1 << (PLANES - 1)) - 1
        for turn in rotations(self.dim) if self.dim else ():
            z = turn @ q
            step = float(np.abs(z).max()) / half or 1.0
            near = np.rint(z / step)
            raised = near.astype(np.int64) + half + 1
            self.planes.append([(1 << b, _bits((raised >> b & 1 == 1)[None, :])[0]) for b in range(PLANES)])
            self.step.append(step)
            self.off.append(float(np.abs(z - step * near).sum()))

    def product(self, stage: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of the rounded anchor with the signs of a stage, from popcounts."""
        total = -(1 << (PLANES - 1)) * (2 * np.bitwise_count(codes).sum(axis=1, dtype=np.int64) - self.dim)
        for weight, plane in self.planes[stage]:
            total += weight * (2 * np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) - int(np.bitwise_count(plane).sum()))
        return total


class _Rows:
    """The rows of a block that have one length, sorted by label."""

    def __init__(self, ids, labels, ints, codes, facts) -> None:  # noqa: ANN001
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.ints = ids[order], labels[order], ints[order]
        self.codes, self.facts = codes[order], facts[order]
        self.most = max(-int(ints.min()), int(ints.max())) if ints.size else 0
        self.plain = ints.astype(np.float64)[order]

    def survivors(self, at: np.ndarray, asker: _Asker, keep) -> np.ndarray:  # noqa: ANN001
        """Rows of ``at`` that ``keep(lower, upper)`` leaves after the last stage."""
        if not asker.dim:
            return at
        root = np.sqrt(asker.dim)
        norms, aligned = self.facts[:, : STAGES + 1], self.facts[:, STAGES + 1 :]
        guess, doubt = np.zeros(len(at)), np.zeros(len(at))
        low, high = np.full(len(at), -np.inf), np.full(len(at), np.inf)
        for s in range(STAGES):
            if not len(at):
                return at
            along = asker.step[s] * asker.product(s, self.codes[at, s])
            weight = aligned[at, s] * norms[at, s] / root
            guess, doubt = guess + weight * along, doubt + weight * asker.off[s]
            sure = np.maximum(np.abs(along) - asker.off[s], 0) / root
            across = np.sqrt(np.maximum(asker.norm**2 - sure * sure, 0))
            slack = doubt + norms[at, s + 1] * across + 1e-9 * (asker.norm * norms[at, 0] + 1)
            low, high = np.maximum(low, guess - slack), np.minimum(high, guess + slack)
            left = keep(low, high)
            at, guess, doubt, low, high = at[left], guess[left], doubt[left], low[left], high[left]
        return at

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact integer scores."""
        bound = self.most * int(np.abs(q).max(initial=0)) * max(len(q), 1)
        if bound < 1 << 53:
            return (self.plain[at] @ q.astype(np.float64)).astype(np.int64)
        if bound < LIMIT:
            return self.ints[at] @ q
        exact = self.ints[at].astype(object) @ q.astype(object)
        if len(exact) and max(abs(x) for x in exact) >= LIMIT:
            raise OverflowError("scores of 2**56 and more are not supported")
        return exact.astype(np.int64)

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((self.ids[at], -scores))[:k]

    def positives(self, anchor: int, label: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        a, b = np.searchsorted(self.labels, [label, label + 1])
        at = np.arange(a, b)
        at = at[self.ids[at] != anchor]

        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return high >= np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else np.ones(len(low), bool)

        at = self.survivors(at, _Asker(q.astype(np.float64)), keep)
        scores = self.scores(at, q)
        return [(int(self.ids[at[i]]), int(scores[i])) for i in self.best(at, scores, k)]

    def negatives(self, anchor: int, label: int, q: np.ndarray, bars: list[int], band: tuple[int, int], k: int) -> list[list[tuple[int, int]]]:
        """The best ``k`` rows in the band of each positive's score."""
        at = np.flatnonzero((self.labels != label) & (self.ids != anchor))
        wide = [(band[0] * p / 100, band[1] * p / 100) for p in bars if p >= 0]

        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            stay = np.zeros(len(low), bool)
            for a, b in wide:
                floor = a
                certain = low[(low >= a + 1e-6) & (high <= b - 1e-6)]
                if len(certain) >= k:
                    floor = max(floor, np.partition(certain, len(certain) - k)[len(certain) - k])
                stay |= (high >= floor - 1e-6) & (low <= b + 1e-6)
            return stay

        at = self.survivors(at, _Asker(q.astype(np.float64)), keep)
        scores, out = self.scores(at, q), []
        for p in bars:
            fit = np.flatnonzero((band[0] * p <= 100 * scores) & (100 * scores <= band[1] * p))
            out.append([(int(self.ids[at[fit[i]]]), int(scores[fit[i]])) for i in self.best(at[fit], scores[fit], k)])
        return out


def coded(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows that take part, once each, as integers with codes. ``vectors``: (vec_id, label, embedding)."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    real = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~odd)
    # equal rows fall on the same key; -0.0 floors to the same integer as 0.0
    keyed = real.withColumn("x", F.transform("x", lambda v: F.floor(v * scale).cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate(([0], np.cumsum(size)))
            if len(flat) and np.abs(flat).max() >= 2.0**53:
                raise OverflowError("components of 2**53 and more are not supported")
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                x = np.stack([flat[start[r] : start[r + 1]] for r in rows])
                codes, facts = encode(x)
                narrow = x.astype(np.int32 if np.abs(x).max(initial=0) < 2.0**31 else np.int64)
                raw = [pa.array([v.tobytes() for v in part], pa.binary()) for part in (narrow, codes, facts)]
                take = lambda i: b.column(i).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [take(3), take(0), take(1), pa.array(np.full(len(rows), dim, np.int32)), *raw], ["key", "vec_id", "label", "dim", "ints", "codes", "facts"])

    named = keyed.select("vec_id", "label", "x", F.xxhash64("vec_id", "label", "x").alias("key"))
    return named.mapInArrow(run, _CODED).dropDuplicates(["vec_id", "label", "ints"])


def _read(b: pa.RecordBatch) -> list[tuple]:
    """(key, id, label, integers, codes, facts, positives) of every row."""
    cols = {n: b.column(n).to_pylist() for n in ("key", "vec_id", "label", "dim", "ints", "codes", "facts", "bars")}
    out = []
    for key, i, label, dim, ints, codes, facts, bars in zip(*cols.values(), strict=True):
        kind = np.int32 if len(ints) == 4 * dim else np.int64
        out.append((key, i, label, np.frombuffer(ints, kind).astype(np.int64), codes, facts, bars))
    return out


def _held(rows: list[tuple]) -> dict[int, _Rows]:
    """Rows by length."""
    by: dict[int, list[tuple]] = {}
    for r in rows:
        by.setdefault(len(r[3]), []).append(r)
    out = {}
    for dim, some in by.items():
        codes = np.stack([np.frombuffer(r[4], _U).reshape(STAGES, -1) for r in some])
        facts = np.stack([np.frombuffer(r[5], np.float64) for r in some])
        out[dim] = _Rows(np.array([r[1] for r in some]), np.array([r[2] for r in some], np.int64), np.stack([r[3] for r in some]), codes, facts)
    return out


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, ask, schema: str) -> DataFrame:  # noqa: ANN001
    """``ask(rows, anchor)`` for every block and every anchor. Within a task a block's rows come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        now, gathered, held = None, [], {}
        for b in batches:
            found = []
            place, kind = b.column("block").to_pylist(), b.column("asks").to_pylist()
            for at, asks, row in zip(place, kind, _read(b), strict=True):
                if at != now:
                    now, gathered, held = at, [], {}
                if not asks:
                    gathered.append(row)
                    continue
                if gathered:
                    held, gathered = _held(gathered), []
                if len(row[3]) in held:
                    found += ask(held[len(row[3])], row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names)

    place = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    own = rows.select(place.alias("block"), F.lit(False).alias("asks"), "*", F.lit(None).cast("array<bigint>").alias("bars"))
    ask_all = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))
    both = own.unionByName(ask_all).repartitionById(blocks, "block").sortWithinPartitions("block", "asks")
    return both.mapInArrow(run, schema)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. ``vectors``: (vec_id, label,
    embedding); ``is_anchor`` is a condition on ``vec_id``; ``band`` is in per cent of the positive's score."""
    spark = vectors.sparkSession
    rows = stash(coded(vectors, scale), "coded")
    n = rows.count()
    blocks = max(-(-n // BLOCK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST)), 1)
    anchors = rows.filter(is_anchor)

    def ask_positives(held: _Rows, row: tuple) -> list[tuple]:
        key, i, label, q, *_ = row
        return [(key, i, p, s) for p, s in held.positives(i, label, q, positives)]

    def ask_negatives(held: _Rows, row: tuple) -> list[tuple]:
        key, i, label, q, _, _, bars = row
        met = held.negatives(i, label, q, bars, band, negatives)
        return [(key, j, m, s) for j, some in enumerate(met, 1) for m, s in some]

    none = anchors.withColumn("bars", F.lit(None).cast("array<bigint>"))
    near = _met(rows, none, blocks, ask_positives, "key long, anchor_id long, positive_id long, positive_score long")
    by_score = Window.partitionBy("key", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= positives)
    near = stash(near, "positives")
    # as many entries as an anchor has positives
    bars = near.groupBy("key", F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    asking = anchors.join(bars, ["key", "vec_id"]).withColumn("bars", F.col("p.positive_score")).drop("p")
    far = _met(rows, asking, blocks, ask_negatives, "key long, place long, negative_id long, negative_score long")
    best = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return far.join(near, ["key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
