"""Phrase collocations counted over a prefix-free parse.

Texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``, A-Z lower-cased; a missing language is ``und``.

1. **Parse.** A text is a row of words with a stop between its pieces. A word whose hash is a multiple of ``EVERY`` starts a chunk; a
   chunk runs on for ``MOST - 1`` words into what follows it. Where a chunk starts depends on that word alone, so a passage that
   repeats anywhere falls into the same chunks, and the corpus becomes a dictionary of distinct chunks with frequencies.
   A chunk of ``LONGEST`` words ends there, which bounds what a task holds and changes no count.
2. **Counts.** N-grams are counted inside distinct chunks, weighted by the chunk's frequency. An n-gram belongs to the chunk in whose
   own words it starts; the words that a chunk shares with the next give it room but start nothing, so each occurrence counts once.
3. **Only what can pass.** A phrase is at most as frequent as its parts. An n-gram is brought forward only if both its (n-1)-grams may be
   frequent, asked of a bitmap of at most ``MAX_BITS`` bits (it lets some others through, never loses one); the counts
   themselves are by the phrase's words and exact. No count, chunk or phrase is capped.
4. **Scores** use decimals, which hold the products. Spark counts, joins and ranks; Python only cuts texts and chunks.

Defined cases: null and empty texts have no words; repeated rows count each; very long texts are many chunks; ids and other columns are not read. Languages without a candidate have no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BITS, stash
from .shingles import mix

MOST = 4  # words of a phrase
LEAST = 30  # occurrences of a candidate
EVERY = 48  # one word in so many starts a chunk
LONGEST = 2048  # words of a chunk's own
HELD = 40_000  # chunks that a task gathers before it hands them on
ROWS = 2000  # chunks whose n-grams are counted at a time
KNOWN = 500_000  # words whose hash a task remembers
SALTS = 64

_U = np.uint64
#: The characters that end a piece.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_STOP = b"."  # every full stop ends a piece, so no word is one
_CUT = bytes.maketrans(_ENDS, _STOP * len(_ENDS))
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], _U)


class _Starts(dict):
    """Whether a word starts a chunk."""

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = out = word != _STOP and xxhash.xxh32_intdigest(word) % EVERY == 0
        return out


def chunks(text: bytes, starts: _Starts) -> Iterator[tuple[bytes, int]]:
    """(words and stops joined by spaces, how many of them are its own) of every chunk of a text."""
    # bytes are split at ASCII white space, of which only spaces and tabs are left
    words = text.lower().translate(_CUT).replace(_STOP, b" . ").split()
    at = [0, *(i for i, w in enumerate(words) if starts[w] and i), len(words)]
    for a, b in zip(at, at[1:], strict=False):
        for c in range(a, b, LONGEST):
            d = min(b, c + LONGEST)
            yield b" ".join(words[c : d + MOST - 1]), d - c


def dictionary(docs: DataFrame) -> DataFrame:
    """``lang, chunk, own, times``: distinct chunks with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, held = _Starts(), Counter()

        def handed_on() -> pa.RecordBatch:
            keys = list(held)
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()).cast(pa.string()),
                    pa.array([k[2] for k in keys], pa.int32()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, ["lang", "chunk", "own", "times"])

        for b in batches:
            size = 0
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                raw = text.as_py() or b""
                size += len(raw)
                held.update((lang, c, own) for c, own in chunks(raw, starts))
                if len(held) > HELD or size > 1 << 26:
                    yield handed_on()
                    size = 0
        if held:
            yield handed_on()

    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter("text is not null")
    cut = given.mapInArrow(run, "lang string, chunk string, own int, times long")
    return cut.groupBy("lang", "chunk", "own").agg(F.sum("times").alias("times"))


def _word_hashes(flat: pa.Array) -> np.ndarray:
    coded = flat.dictionary_encode()
    return np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], _U)[coded.indices.to_numpy()]


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word, as far as there are words."""
    rows = max(len(h) - n + 1, 0)
    total = np.full(rows, n, _U)
    for j in range(n):
        total += mix(h[j : j + rows]) * _PLACE[j]
    return mix(total)


def _tongues(langs: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in langs.to_pylist()], _U)


def _marks(frequent: DataFrame, size: int) -> tuple[int, np.ndarray] | None:
    """(bits, bitmap) of frequent phrases of ``size`` words; none if there are none. It grows with them up to ``MAX_BITS`` bits."""
    n = frequent.count()
    if not n:
        return None
    bits = 1 << min(MAX_BITS.bit_length() - 1, max(16, (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _word_hashes(pc.split_pattern(b.column(1), " ").flatten())
            p = mix(_grams(own, size)[::size] + _tongues(b.column(0))) % _U(bits)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64) + 1)], ["p"])

    spots = frequent.select("lang", "phrase").mapInArrow(run, "p long")
    parts = spots.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out, width = np.zeros(bits // 8, np.uint8), 4096
    for r in parts.toLocalIterator():  # pieces of 4 KB of a bitmap of bounded size
        out[(r.k - 1) * width : r.k * width] |= np.frombuffer(r.bits, np.uint8)[: bits // 8]
    return bits, out


def counted(parse: DataFrame, n: int, marks: tuple[int, np.ndarray] | None) -> DataFrame:
    """``lang, phrase, a`` of the n-grams both of whose (n-1)-grams are marked."""
    spark = parse.sparkSession
    bits, sent = (marks[0], spark.sparkContext.broadcast(marks[1])) if marks else (0, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part.slice(i, ROWS) for part in batches for i in range(0, part.num_rows, ROWS)):
            lists = pc.split_pattern(b.column(1), " ")
            flat, size = lists.flatten(), pc.list_value_length(lists).to_numpy()
            row = np.repeat(np.arange(b.num_rows), size)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            own = b.column(2).to_numpy()
            stops = np.concatenate(([0], np.cumsum(pc.equal(flat, ".").to_numpy(zero_copy_only=False))))
            at = np.flatnonzero((place < own[row]) & (place + n <= size[row]))
            at = at[stops[at] == stops[at + n]]
            if marks and len(at):
                tongue, held = _tongues(b.column(0)), sent.value

                def marked(h: np.ndarray) -> np.ndarray:
                    p = (mix(h + tongue[row[at]]) % _U(bits)).astype(np.int64)
                    return held[p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1

                grams = _grams(_word_hashes(flat), n - 1)
                at = at[marked(grams[at]) & marked(grams[at + 1])]
            if not len(at):
                continue
            words = [flat.take(pa.array(at + j)) for j in range(n)]
            phrase = pc.binary_join_element_wise(*words, " ") if n > 1 else words[0]
            table = pa.table({"lang": b.column(0).take(pa.array(row[at])), "phrase": phrase, "times": b.column(3).take(pa.array(row[at]))})
            yield from table.group_by(["lang", "phrase"]).aggregate([("times", "sum")]).rename_columns(["lang", "phrase", "a"]).combine_chunks().to_batches()

    return parse.mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _parts(size: int) -> list:
    """Expressions of the (first k words, rest) of a phrase of ``size`` words."""
    words = F.split("phrase", " ")
    return [F.struct(F.lit(k).alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("first"), F.array_join(F.slice(words, k + 1, size - k), " ").alias("rest"))
            for k in range(1, size)]


def _scored(levels: dict[int, DataFrame]) -> DataFrame:
    """``lang, phrase, size, a, k, l, r, score``: candidates with the cut of the lowest score."""
    cuts = None
    for size in range(2, MOST + 1):
        own = levels[size].select("lang", "phrase", "a", F.lit(size).alias("size"), F.explode(F.array(*_parts(size))).alias("c"))
        cuts = own if cuts is None else cuts.unionByName(own)
    known = levels[1]
    for size in range(2, MOST):
        known = known.unionByName(levels[size])
    known = known.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    side = lambda field, name: known.select("lang", F.col("part").alias(field), F.col("f").alias(name))
    flat = cuts.select("lang", "phrase", "a", "size", "c.k", "c.first", "c.rest")
    both = flat.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    best = both.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("size").alias("size"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return best.select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score")


def _inside(levels: dict[int, DataFrame]) -> DataFrame:
    """``lang, phrase, above``: the largest frequency of a longer candidate that has the phrase inside."""
    out = None
    for size in range(3, MOST + 1):
        words = F.split("phrase", " ")
        spans = [F.array_join(F.slice(words, i, n), " ") for n in range(2, size) for i in range(1, size - n + 2)]
        own = levels[size].select("lang", F.explode(F.array(*spans)).alias("phrase"), "a")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("lang", "phrase").agg(F.max("a").alias("above"))


def collocations(docs: DataFrame, top: int = 2000, least: int = LEAST, inside_percent: int = 80) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``top`` phrases of every language."""
    parse = stash(dictionary(docs), "parse")
    words = stash(counted(parse, 1, None), "words")
    total = words.groupBy("lang").agg(F.sum("a").alias("n"))
    levels, marks = {1: stash(words.filter(F.col("a") >= least), "grams")}, None
    for n in range(2, MOST + 1):
        marks = _marks(levels[n - 1], n - 1)
        grams = counted(parse, n, marks).filter(F.col("a") >= least) if marks else levels[n - 1]
        levels[n] = stash(grams, "grams")
    big = lambda c: F.col(c).cast("decimal(20,0)")
    left = _scored(levels).join(_inside(levels), ["lang", "phrase"], "left").filter(
        F.col("above").isNull() | (100 * big("above") < inside_percent * big("a")))
    # first within salted parts of a language, so that no task sorts all of a large one
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("s", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "s"], ["lang"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return salted.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
