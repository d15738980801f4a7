"""Quality rules with verdicts on hosts.

Per document, over its whole text (null: no words):

* words ``[^\\x20\\x09-\\x0D]+``, ``word_chars`` (code points in words), ``n_symbols``,
  ``n_dup_lines`` (lines with a word that equal an earlier line) and ``n_repeat_words`` (words
  inside three-word windows that occur at least twice in the text, the first one included);
* base rule: fewer than 50 words, or more than half of the words repeated;
* soft rules: symbols above a tenth of the word characters, duplicate lines above three
  tenths of the lines with a word, or mean word length outside 2 to 15.

Per host (the source of a document; null is one host of its own) the failures of any rule are
counted. The rate of a host with few documents says little, so it is shrunk towards the rates of all
hosts: a beta prior is fitted to them by the method of moments (weighted by documents), and
the host's posterior mean is its rate. A host whose posterior rate passes ``host_limit`` is
held to the soft rules as well; elsewhere only the base rule removes a document. So a clean
document is never removed for its host's sake.

Counts are integers summed before any shuffle, a host is one row of the host table, and the host
table meets the documents in an equi-join that Spark may broadcast once it has measured it. A
hot host is a key of a join that Spark splits. Repeated rows count as often as they appear. An
empty input has no hosts and gives no rows. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_names, stash

MIN_WORDS = 50
HOST_LIMIT = 0.5
PRIOR_FLOOR = 2.0  # least weight of the prior, in documents

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def document_metrics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``doc_id, host``, ``key`` (a hash of the text, null like empty) and the counts of every document."""
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = raw.select(
        "doc_id", "host", F.xxhash64("t").alias("key"),
        F.filter(F.split("t", SPACE + "+"), lambda x: x != "").alias("w"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("t", SPACE + "+", "")).alias("word_chars"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    ).withColumn("n", F.size("w"))
    at = lambda i: F.get(F.col("w"), i)
    hashed = split.select(
        "doc_id", "host", "key", "n", "n_symbols", "word_chars", F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.col("n") > 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
        .otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # only texts with a repeated window pay for the sort
    again = F.size("h") > F.size(F.array_distinct("h"))
    ordered = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    marked = hashed.select(
        "doc_id", "host", "key", "n", "n_symbols", "word_chars", "n_lines", "n_dup_lines",
        F.when(again, ordered).alias("s"))
    same = lambda i: F.get(F.col("s"), i)["h"]
    places = F.filter("s", lambda x, i: (F.coalesce(same(i - 1) == x["h"], F.lit(False)) | F.coalesce(same(i + 1) == x["h"], F.lit(False))))
    covered = marked.withColumn("p", F.sort_array(F.transform(places, lambda x: x["i"])))
    # each window adds the words that the window before it has not reached
    gain = lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(F.col("p"), i - 1)))
    total = F.aggregate(F.transform("p", gain), F.lit(0), lambda a, x: a + x)
    as_long = lambda c: F.col(c).cast("long").alias(c)
    return covered.select(
        "doc_id", "host", "key", F.col("n").cast("long").alias("n_words"), as_long("word_chars"), as_long("n_symbols"), as_long("n_dup_lines"),
        F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"), as_long("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failed() -> Column:
    return (
        (10 * F.col("n_symbols") > F.col("word_chars"))
        | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
        | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))
    )


def host_verdicts(metrics: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """``host, n_docs, n_failed, rate`` (posterior mean under the fitted beta prior) and ``strict``."""
    per = metrics.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((base_failed() | soft_failed()).cast("long")).alias("n_failed"))
    per = per.withColumn("r", F.col("n_failed") / F.col("n_docs"))
    # moments of the hosts' rates; the spread that sampling alone causes is taken off
    moments = per.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("docs"),
        F.sum(F.col("n_docs") * F.col("r") * F.col("r")).alias("square"))
    seen = F.col("square") / F.col("docs") - F.col("mean") * F.col("mean")
    by_chance = F.col("mean") * (1 - F.col("mean")) * F.col("hosts") / F.col("docs")
    spread = F.greatest(seen - by_chance, F.lit(1e-6))
    prior = moments.select(
        "mean", F.greatest(F.lit(PRIOR_FLOOR), F.col("mean") * (1 - F.col("mean")) / spread - 1).alias("weight"))
    return per.join(F.broadcast(prior), how="inner", on=F.lit(True)).select(  # one row
        "host", "n_docs", "n_failed",
        ((F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))).alias("rate"),
    ).withColumn("strict", F.col("rate") > host_limit)


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``soft_failed``, the ``host``, its ``rate``, ``kept`` and the text's ``key``."""
    metrics = stash(document_metrics(docs, doc_id=doc_id, text=text, host=host), "host-rules")
    verdict = host_verdicts(metrics, host_limit).select(F.col("host").alias("_host"), "rate", "strict")
    both = metrics.join(verdict, F.col("host").eqNullSafe(F.col("_host")), "left")
    return both.select(
        "doc_id", *METRICS, base_failed().alias("base_failed"), soft_failed().alias("soft_failed"), F.col("host").alias("host"), "rate",
        (~base_failed() & ~(F.col("strict") & soft_failed())).alias("kept"), "key")


def quality_filter(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Rows that are kept, with all their columns. A row is judged by its own text and host: others that share its
    id, or have none either, neither take it along nor save it."""
    names = free_names(docs.columns, "_id", "_host", "_key")
    rejected = judge(docs, host_limit=host_limit).filter(~F.col("kept")).select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "host", "key"), names, strict=True)]).distinct()
    own_id, own_host, own_key = (F.col(n) for n in names)
    same = (docs["doc_id"].eqNullSafe(own_id) & docs["source"].cast("string").eqNullSafe(own_host)
            & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == own_key))
    return docs.join(rejected, same, "left_anti")
