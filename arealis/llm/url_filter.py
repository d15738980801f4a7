"""URL filters over a sorted digest array.

Rules (``host/path`` with a verdict) and listed entries (a domain, or a domain with the
start of a path, that is blocked where no rule speaks) lie in one file: 64-bit xxhash keys in
sorted order, the whole strings behind them, and what each entry means. Spark broadcasts its
bytes; a worker spools them once into an unnamed temporary file and memory-maps that, so only
the pages that a search touches are in memory. A url asks for every suffix of its host with every start of its path that has the length of some entry's path;
a batch's keys are looked up by one vectorised binary search, and a key that is found counts only if the
stored string equals the asked one.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to
``?``, ``#`` or the end. A null url or one without ``://`` has an empty host and path. A rule fits
its host and all subdomains if the path starts with the rule's. The longest rule wins (of equally long
ones that with the longer host; of a rule given with both verdicts, block). Without a rule, a listed entry
blocks and everything else is allowed.

Defined cases: repeated urls and null ids give one row each; no entries allow everything; entries that are
null are left out.

The array is built on the driver up to ``MAX_ENTRIES`` entries, which are counted first. Beyond
that, the same lookups run as a join on key and string, split over the cluster, with the same results.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower

MAX_ENTRIES = 1_000_000
ALLOW, BLOCK, LISTED = 1, 2, 4  # bits of an entry's meaning


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The two parts of a url that rules look at."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", 2)
    return F.when(has, ascii_lower(rest)).otherwise(""), F.when(has, path).otherwise("")


def split_entry(text: str) -> tuple[str, str]:
    host, slash, path = text.partition("/")
    return host, slash + path


def array_bytes(entries: list[tuple[str, int]]) -> bytes:
    """The file's content: count, keys, string offsets, meanings, strings."""
    made = sorted((xxhash.xxh64_intdigest(t), t.encode(), m) for t, m in entries)
    keys = np.array([k for k, _, _ in made], np.uint64)
    ends = np.cumsum([0] + [len(t) for _, t, _ in made]).astype(np.int64)
    head = np.array([len(made)], np.int64).tobytes() + keys.tobytes() + ends.tobytes() + np.array([m for _, _, m in made], np.uint8).tobytes()
    return head + b"".join(t for _, t, _ in made)


_mapped: dict[str, DigestArray] = {}  # of this worker process, by name


class DigestArray:
    """A memory-mapped file of ``array_bytes``."""

    def __init__(self, content: bytes) -> None:
        with tempfile.TemporaryFile() as f:  # has no name; goes with the mapping
            f.write(content)
            f.flush()
            raw = np.memmap(f, np.uint8, "r")
        n = int(raw[:8].view(np.int64)[0])
        self.keys = raw[8 : 8 + 8 * n].view(np.uint64)
        self.ends = raw[8 + 8 * n : 16 + 16 * n].view(np.int64)
        self.means = raw[16 + 16 * n : 16 + 17 * n]
        self.text = raw[16 + 17 * n :]

    @classmethod
    def named(cls, name: str, content) -> DigestArray:  # noqa: ANN001
        """The array of a broadcast, mapped once by each worker process."""
        if name not in _mapped:
            _mapped.clear()
            _mapped[name] = cls(content.value)
        return _mapped[name]

    def lookup(self, asked: list[str]) -> list[int]:
        """The meaning of each string, 0 where there is no such entry."""
        out = [0] * len(asked)
        if not len(self.keys) or not asked:
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, asked), np.uint64, len(asked))
        first = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == keys)
        for i in hit.tolist():
            k, want = int(first[i]), asked[i].encode()
            while k < len(self.keys) and self.keys[k] == keys[i]:  # strings that share a key lie together
                if self.text[self.ends[k] : self.ends[k + 1]].tobytes() == want:
                    out[i] = int(self.means[k])
                    break
                k += 1
        return out


def asked_strings(host: str, path: str, lengths: list[int], longest: int) -> list[str]:
    """Every suffix of the host at a label, of at most ``longest`` characters, with every start of the path that has one of the lengths."""
    heads = [path[:n] for n in lengths if n <= len(path)]
    out, end = [], len(host)
    while end >= 0:
        start = host.rfind(".", 0, end) + 1
        if len(host) - start > longest:
            break
        out += [host[start:] + h for h in heads]
        end = start - 1
    return out


def entries_of(rules: DataFrame, listed: DataFrame | None) -> DataFrame:
    """``text, means``: one row per distinct entry of ``rules`` (rule, verdict) and ``listed`` (entry)."""
    r = rules.select(F.col("rule").alias("text"), F.when(F.col("verdict") == "block", BLOCK).otherwise(ALLOW).alias("m"))
    if listed is not None:
        r = r.unionByName(listed.select(F.col("entry").alias("text"), F.lit(LISTED).alias("m")))
    return r.filter("text is not null").groupBy("text").agg(F.bit_or("m").alias("means"))


def _verdict(rule: str | None, means: int, listed: bool) -> str:
    return ("block" if means & BLOCK else "allow") if rule is not None else "block" if listed else "allow"


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, *, page_id: str = "page_id", url: str = "url",
                max_entries: int = MAX_ENTRIES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    spark = pages.sparkSession
    entries = entries_of(rules, listed)
    host, path = host_and_path(F.col(url))
    cut = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    shape = entries.select(F.length("text") - F.length(F.substring_index("text", "/", 1)))
    lengths = sorted(r[0] for r in shape.distinct().collect())  # at most one per length that a path can have
    of = F.substring_index("text", "/", 1)
    # no entry fits by a suffix longer than the longest entry's host
    longest, most = entries.agg(F.coalesce(F.max(F.length(of)), F.lit(0)), F.coalesce(F.max(F.size(F.split(of, r"\."))), F.lit(1))).first()
    if entries.count() > max_entries:
        return _by_join(cut, entries, lengths, longest, most)
    made = [(r["text"], r["means"]) for r in entries.collect()]
    content, name = spark.sparkContext.broadcast(array_bytes(made)), uuid.uuid4().hex
    schema = T.StructType([cut.schema["page_id"], *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray.named(name, content)
        for b in batches:
            asked: list[str] = []
            owner: list[int] = []
            for i, (h, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                own = asked_strings(h, p, lengths, longest)
                asked += own
                owner += [i] * len(own)
            best: list[tuple[int, int, str | None, int]] = [(-1, -1, None, 0)] * b.num_rows
            listed_ = [False] * b.num_rows
            for i, text, m in zip(owner, asked, array.lookup(asked), strict=True):
                if m & LISTED:
                    listed_[i] = True
                if m & (ALLOW | BLOCK):
                    best[i] = max(best[i], (len(text), len(split_entry(text)[0]), text, m), key=lambda x: x[:2])
            rule = [x[2] for x in best]
            verdict = [_verdict(x[2], x[3], y) for x, y in zip(best, listed_, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             ["page_id", "host", "path", "rule", "verdict"])

    return cut.mapInArrow(judge, schema)


def _by_join(cut: DataFrame, entries: DataFrame, lengths: list[int], longest_host: int, most_labels: int) -> DataFrame:
    """The lookups as a join, for more entries than a worker should map. Distinct (host, start of
    path) pairs ask, so a hot host asks once for each of its paths' starts."""
    labels = F.split("host", r"\.")
    longest = max(lengths, default=0)
    starts = cut.select("host", F.substring("path", 1, longest).alias("start")).distinct()
    asks = starts.select(
        "host", "start", F.explode(F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most_labels + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("s"),
    ).filter(F.length("s") <= longest_host).select("host", "start", "s", F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)])).alias("n")).filter(F.col("n") <= F.length("start"))
    asks = asks.select("host", "start", F.length("s").alias("hl"), F.concat("s", F.expr("substring(start, 1, n)")).alias("text"))
    keyed = entries.withColumn("k", F.xxhash64("text"))
    found = asks.withColumn("k", F.xxhash64("text")).join(keyed, ["k", "text"])
    rule = F.max(F.when(F.col("means").bitwiseAND(ALLOW | BLOCK) > 0, F.struct(F.length("text").alias("l"), "hl", "text", "means")))
    best = found.groupBy("host", "start").agg(rule.alias("r"), F.max(F.col("means").bitwiseAND(LISTED) > 0).alias("listed"))
    best = best.withColumnsRenamed({"host": "_h", "start": "_s"})
    both = cut.join(best, (F.col("host") == F.col("_h")) & (F.substring("path", 1, longest) == F.col("_s")), "left")
    verdict = F.when(F.col("r").isNotNull(), F.when(F.col("r.means").bitwiseAND(BLOCK) > 0, "block").otherwise("allow")).otherwise(
        F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", F.col("r.text").alias("rule"), verdict.alias("verdict"))
