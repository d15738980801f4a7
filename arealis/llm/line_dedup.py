"""Line deduplication with a segment-partition edit join.

Lines are the ``\\n``-split parts of a text without white space at either end; those of fewer
than ``min_chars`` characters are never touched. Of equal lines the first occurrence (smallest document id, then
place) stays. A line that lies within ``max_edits`` insertions, deletions or replacements of an earlier line
goes as well, in all its occurrences.

Within ``max_edits`` edits of ``max_edits + 1`` segments one stays whole, so it is a substring of the other line:

* a line puts its segments into an index under (number, length, substring);
* it probes the indexes of its own and up to ``max_edits`` smaller lengths, at those places alone where
  a match can belong to an alignment (the left and right remainders bound the shift);
* lines that meet under a key are candidates. Where more than ``CROWD`` lines share a key, the shared
  segment is cut out and what remains is split and probed again, as often as needed: distinct lines part
  quickly, and no crowded key is ever paired off. For one edit, rests of at most ``SHORT``
  characters meet under what is left without one place: those who do are all within one edit of each other, so
  each need only meet the earliest. For more edits, rests too short to split are paired;
* candidates lose their common start and end and the middles are compared by a bit-parallel
  edit distance inside a band of ``2 * max_edits + 1`` diagonals held in one word.

Everything is DataFrame operations. Equal lines are folded in the map tasks before any shuffle, so a line that a third of
the corpus repeats is one row per task. Texts cross the network once, when the decisions meet their
documents, and candidate lines once more.

Defined cases: a null text has no lines and stays null; a null id has no place in the order, so such rows stay as
they are and count for nothing; rows that repeat an id with the same text are one document; with
another text they are told apart. Long lines need no special care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, may_be_among, stash

MAX_EDITS = 1
MIN_CHARS = 20
CROWD = 24
SHORT = 6
ROUNDS = 40  # a rest halves in each round, so this many are never needed

_TRIM = " \t\r\x0b\x0c"


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``d, t`` (the document), ``pos``, ``line``, its length ``chars`` and two hashes, for lines long enough."""
    cut = docs.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    line = cut.select("d", "t", "pos", F.btrim("raw", F.lit(_TRIM)).alias("line")).withColumn("chars", F.length("line"))
    return line.filter(F.col("chars") >= min_chars).select(
        "*", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _plan(edits: int) -> list[tuple[int, int, int]]:
    """(characters fewer, segment, shift) of every entry of a string; those of its own length without shift are indexed."""
    return [(less, i, shift) for less in range(edits + 1) for i in range(1, edits + 2)
            for shift in range(max(1 - i, less - (edits + 1 - i)), min(i - 1, less + edits + 1 - i) + 1)]


def _entries(s: Column, n: Column, edits: int, rests: bool) -> list[Column]:
    """Entries of a string of ``n`` characters in the order of the plan: keys of its segments for the index and for probing, null
    where it is too short; with ``rests`` structs (key, indexed, rest), with what remains without the segment."""
    parts = edits + 1

    def entry(less: int, i: int, shift: int) -> Column:
        size = n - less
        short = F.floor(size / parts).cast("int")
        even = parts - (size - short * parts)  # the segments after these are longer by one
        length = short + F.when(i > even, 1).otherwise(0)
        at = 1 + (i - 1) * short + F.greatest(F.lit(0), i - 1 - even) + shift
        key = F.xxhash64(F.lit(i), size, F.substring(s, at, length))
        if rests:
            rest = F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + length, n))
            key = F.struct(key.alias("key"), F.lit(less == 0 and shift == 0).alias("indexed"), rest.alias("rest"))
        return F.when((size >= parts) & (at >= 1) & (at + length <= n + 1), key)

    # one expression per entry: code is generated for it, as it isn't for a function over an array
    return [entry(*p) for p in _plan(edits)]


def _exploded(df: DataFrame, text: str, edits: int) -> DataFrame:
    """``df`` (with the length as ``chars``) with an entry ``e`` of its text a row."""
    return df.withColumn("e", F.explode(F.array(*_entries(F.col(text), F.col("chars"), edits, True)))).filter("e is not null")


def _met(entries: DataFrame) -> DataFrame:
    """Entries (key, h, indexed, ...) of keys that several lines share, with their number ``n``."""
    whole = Window.partitionBy("key")
    counted = entries.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("any", F.max("indexed").over(whole))
    return counted.filter((F.col("n") > 1) & F.col("any")).drop("any")


def _paired(met: DataFrame) -> DataFrame:
    """Candidate pairs of keys that few lines share."""
    few = met.filter(F.col("n") <= CROWD)
    a = few.filter("indexed").select("key", F.col("h").alias("a"))
    b = few.select("key", F.col("h").alias("b"))
    pairs = a.join(b, "key").filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _short_rests(level: DataFrame, edits: int) -> DataFrame:
    """Candidate pairs of entries (key, h, first, rest) with short rests."""
    if edits > 1:
        one = level.select("key", F.col("h").alias("a"))
        return one.join(level.select("key", F.col("h").alias("b")), "key").filter("a < b").select("a", "b")
    n = F.length("rest")
    without = F.transform(F.sequence(F.lit(1), n), lambda p: F.struct(
        p.alias("p"), F.concat(F.substring("rest", F.lit(1), p - 1), F.substring("rest", p + 1, n)).alias("s")))
    as_is = F.transform(F.sequence(F.lit(1), n + 1), lambda p: F.struct(p.alias("p"), F.col("rest").alias("s")))
    spots = level.select("key", "h", "first", F.explode(F.when(n > 0, F.concat(without, as_is)).otherwise(as_is)).alias("e"))
    met = Window.partitionBy("key", "e.p", "e.s")
    star = spots.select("h", F.min_by("h", "first").over(met).alias("b")).filter("h <> b")
    return star.select(F.least("h", "b").alias("a"), F.greatest("h", "b").alias("b"))


def _candidates(met: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Candidate pairs ``a < b`` of line hashes; crowded keys are split until none is left."""
    pairs = _paired(met)
    crowd = met.filter(F.col("n") > CROWD).select("key", "h")
    if crowd.isEmpty():
        return pairs.distinct()
    # the rest of each crowded entry; what doesn't share its key is dropped by the join
    entry = _exploded(texts.select("h", "first", "line", F.length("line").alias("chars")), "line", edits)
    level = entry.select("h", "first", F.col("e.key").alias("key"), F.col("e.rest").alias("rest"))
    level = stash(level.join(crowd.distinct(), ["key", "h"], "left_semi"), "crowd")
    short = SHORT if edits == 1 else 2 * edits
    for _ in range(ROUNDS):
        pairs = pairs.unionByName(_short_rests(level.filter(F.length("rest") <= short), edits))
        # a short rest may still meet a longer one
        split = _exploded(level.filter(F.length("rest") > short - edits).withColumn("chars", F.length("rest")), "rest", edits)
        deeper = split.select(F.xxhash64("key", "e.key").alias("key"), "h", "first", F.col("e.indexed").alias("indexed"), F.col("e.rest").alias("rest"))
        met = stash(_met(deeper), "crowd")
        pairs = pairs.unionByName(_paired(met))
        level = met.filter(F.col("n") > CROWD).select("key", "h", "first", "rest").distinct()
        if level.isEmpty():
            return pairs.distinct()
    raise RuntimeError("a crowded key did not split")


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings, or ``edits + 1`` if it is larger.

    One bit per diagonal of the band: ``vp`` and ``vn`` say where the distance grows or falls down a
    column, and the distance along the diagonal that ends in the last cell only ever grows, by one at every column
    whose bit of ``d0`` is unset. A string pair that passes ``edits`` stops being computed.
    """
    word = (1 << (2 * edits + 1)) - 1
    start_vp = sum(1 << k for k in range(edits, 2 * edits + 1))
    swap = F.length(a) < F.length(b)
    long, short = F.split(F.when(swap, b).otherwise(a), ""), F.split(F.when(swap, a).otherwise(b), "")
    over = F.abs(F.length(a) - F.length(b))
    big = lambda x: F.lit(x).cast("bigint")

    def run(both: Column) -> Column:
        def column(state: Column, c: Column) -> Column:
            j = state["j"]
            same = F.lit(0).cast("bigint")
            for k in range(2 * edits + 1):
                same = same + F.when(F.get(both["long"], j - edits + k) == c, big(1 << k)).otherwise(big(0))

            def cell(pm: Column) -> Column:
                d0 = ((pm.bitwiseAND(state["vp"]) + state["vp"]).bitwiseXOR(state["vp"])).bitwiseOR(pm).bitwiseOR(state["vn"]).bitwiseAND(big(word))

                def after(d0: Column) -> Column:
                    hp = state["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(state["vp"])))
                    hn = d0.bitwiseAND(state["vp"])
                    down = F.shiftright(d0, 1)
                    # the bit of the last cell's diagonal: shifted there by the difference of lengths
                    bit = big(1)
                    for over in range(1, edits + 1):
                        bit = F.when(both["over"] == over, big(1 << over)).otherwise(bit)
                    miss = F.when(d0.bitwiseAND(F.shiftleft(bit, edits)) == 0, 1).otherwise(0)
                    return F.struct(
                        (j + 1).alias("j"), hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(big(word)).alias("vp"),
                        down.bitwiseAND(hp).bitwiseAND(big(word)).alias("vn"), (state["dist"] + miss).alias("dist"))

                return _let(d0, after)

            return F.when(state["dist"] > edits, state).otherwise(_let(same, cell))

        start = F.struct(F.lit(0).alias("j"), big(start_vp).alias("vp"), big(word & ~start_vp).alias("vn"), both["over"].alias("dist"))
        return F.aggregate(both["short"], start, column)["dist"]

    measured = _let(F.struct(long.alias("long"), short.alias("short"), over.alias("over")), run)
    return F.when(over > edits, edits + 1).when(F.length(a) * F.length(b) == 0, over).otherwise(F.least(measured, F.lit(edits + 1)))


def _common_start(x: Column, y: Column, n: Column) -> Column:
    """How many characters two strings share at their start, ``n`` at most: by halving steps."""
    grow = lambda k, far: F.when((k + far <= n) & (F.substring(x, k + 1, far) == F.substring(y, k + 1, far)), k + far).otherwise(k)
    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(29, -1, -1)]), F.lit(0), grow)


def _cut_start(p: Column) -> Column:
    """A pair (x, y) without its common start, both reversed."""
    k = _common_start(p["x"], p["y"], F.least(F.length(p["x"]), F.length(p["y"])))
    rest = lambda c, k: F.reverse(F.substring(c, k + 1, F.length(c)))
    return _let(k, lambda k: F.struct(rest(p["x"], k).alias("x"), rest(p["y"], k).alias("y")))


def within(x: Column, y: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits. Their common start and end are cut off first. All is one
    expression, so that no step is computed again for each of its uses."""
    def middle(p: Column) -> Column:
        # either end takes an edit, unless they are the same character
        fair = F.least(F.length(p["x"]), F.length(p["y"])) < 2 if edits < 2 else F.lit(True)
        return F.when(fair, banded_distance(p["x"], p["y"], edits) <= edits).otherwise(False)

    return _let(F.struct(x.alias("x"), y.alias("y")), lambda p: _let(_cut_start(p), lambda q: _let(_cut_start(q), middle)))


def near_lines(docs: DataFrame, firsts: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h, h2`` of every line that lies within ``max_edits`` of an earlier one. ``firsts``: (h, h2, first, keys)."""
    entry = firsts.select("h", F.posexplode("keys").alias("i", "key")).filter("key is not null")
    indexed = [i for i, (less, _, shift) in enumerate(_plan(max_edits)) if less == 0 and shift == 0]
    entry = entry.groupBy("key", "h").agg(F.max(F.col("i").isin(indexed)).alias("indexed"))
    met = stash(_met(entry), "met")
    wanted = firsts.join(met.select("h").distinct(), "h", "left_semi")
    owner = wanted.select(F.col("first.d").alias("d"), F.col("first.t").alias("t"), F.col("first.pos").alias("pos"), "h", "h2", "first")
    held = may_be_among(_lines(docs, min_chars), F.col("h"), owner, "h").select("d", "t", "pos", "line")
    lines = held.join(owner, ["d", "t", "pos"]).dropDuplicates(["h", "h2"])
    texts = stash(lines.select("h", "h2", "first", "line"), "texts")
    pairs = _candidates(met, texts, max_edits)
    side = lambda tag, text: texts.select(F.col("h").alias(tag), F.struct("first", "h", "h2").alias(f"o{tag}"), F.col("line").alias(text))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    near = F.abs(F.length("x") - F.length("y")) <= max_edits
    linked = both.filter(near & within(F.col("x"), F.col("y"), max_edits))
    return linked.select(F.greatest("oa", "ob").alias("o")).select("o.h", "o.h2").distinct()


def decisions(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``d, t, equal, near``: places of the lines that go, by document; ``equal`` repeats an earlier
    line, ``near`` lies within ``max_edits`` of one."""
    # texts are split and hashed once; what follows reads places and hashes
    keys = F.array(*_entries(F.col("line"), F.col("chars"), max_edits, False))
    lines = stash(_lines(docs, min_chars).select("d", "t", "pos", "h", "h2", keys.alias("keys")), "lines")
    groups = lines.groupBy("h", "h2").agg(F.min(F.struct("d", "t", "pos")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"))
    groups = stash(groups, "line-groups")
    near = near_lines(docs, groups, max_edits, min_chars).withColumn("near", F.lit(True))
    marked = stash(groups.drop("keys").join(near, ["h", "h2"], "left").withColumn("near", F.coalesce("near", F.lit(False))).filter("n > 1 or near"), "marked")
    where = may_be_among(lines.select("d", "t", "pos", "h", "h2"), F.col("h"), marked, "h").join(marked.select("h", "h2", "first", "near"), ["h", "h2"])
    goes = where.filter("near or first <> struct(d, t, pos)")
    own = F.struct("pos", "near")
    return goes.groupBy("d", "t").agg(F.collect_set(own).alias("gone")).select(
        "d", "t", F.transform(F.filter("gone", lambda x: ~x["near"]), lambda x: x["pos"]).alias("equal"),
        F.transform(F.filter("gone", lambda x: x["near"]), lambda x: x["pos"]).alias("near"))


def count_names(docs: DataFrame) -> list[str]:
    """Names of the counts that ``dedup_lines`` adds."""
    return free_names(docs.columns, "n_lines", "n_equal", "n_near")


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` with ``text`` rid of its repeated lines, and ``n_lines, n_equal, n_near``
    (lines, and those that went) as last columns; a count whose name is taken gets an underscore behind it."""
    _d, _t, _e, _n = free_names(docs.columns, "_d", "_t", "_e", "_n")
    gone = decisions(docs.select("doc_id", "text"), max_edits, min_chars).select(
        F.col("d").alias(_d), F.col("t").alias(_t), F.col("equal").alias(_e), F.col("near").alias(_n))
    both = docs.join(gone, (docs["doc_id"] == F.col(_d)) & (F.xxhash64(docs["text"]) == F.col(_t)), "left")
    cut = F.split(docs["text"], "\n")
    drop = F.array_union(_e, _n)
    kept = F.array_join(F.filter(cut, lambda _, i: ~F.array_contains(drop, i)), "\n")
    many = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    total = [F.when(docs["text"].isNull(), 0).otherwise(F.size(cut)), F.when(F.col(_e).isNull(), 0).otherwise(many(_e)), F.when(F.col(_n).isNull(), 0).otherwise(many(_n))]
    counts = [c.cast("long").alias(n) for c, n in zip(total, count_names(docs), strict=True)]
    text = F.when(F.col(_d).isNull(), docs["text"]).otherwise(kept).alias("text")
    return both.select(*[text if c == "text" else docs[c] for c in docs.columns], *counts)


def line_filter(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents without their repeated lines, all columns kept and ``n_chars`` brought up to date. A document
    that had text and has none left, all of it standing elsewhere, goes."""
    names = docs.columns
    done = dedup_lines(docs, max_edits, min_chars)
    _, equal, near = count_names(docs)
    changed = F.col(equal) + F.col(near) > 0
    left = done.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*names)
