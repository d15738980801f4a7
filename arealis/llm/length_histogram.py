"""Token counts through an exact histogram of lengths.

Documents are encoded whole and counted by their number of tokens (a null text has none). The
histogram's suffix sums then answer every question about a context limit without another
look at the corpus: how many documents exceed it, how many tokens all hold, how many are left when
each document is cut to the limit, and quantiles.

The histogram has one row per length that occurs. Running sums are taken inside blocks of
``BLOCK`` lengths and over the blocks' totals, so no task holds more than a block and the
list of blocks. Repeated rows count each; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import text_encoder, vocabulary_path

BLOCK = 1024


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every document."""
    path = vocabulary or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n = [len(x) // 4 for x in encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(count, f"doc_id {kind}, n_tokens bigint")


def histogram(counts: DataFrame) -> DataFrame:
    """``n_tokens, n_docs``: how many documents have each length."""
    return counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def with_suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """The histogram with, for each length taken as the limit: ``docs_longer`` and ``tokens_longer``
    (documents above it and their tokens), ``docs_up_to``, ``total_tokens``, ``truncated_tokens``
    (every document cut to the limit) and ``share_up_to`` (of documents)."""
    cell = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / block).alias("_b"), (F.col("n_tokens") * F.col("n_docs")).alias("_t"))
    per = cell.groupBy("_b").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    later = Window.orderBy(F.desc("_b"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "_b", (F.sum("_bd").over(later) - F.col("_bd")).alias("_d_after"), (F.sum("_bt").over(later) - F.col("_bt")).alias("_t_after"),
        F.sum("_bd").over(everything).alias("_d_all"), F.sum("_bt").over(everything).alias("_t_all"))
    inside = Window.partitionBy("_b").orderBy(F.desc("n_tokens"))
    longer = cell.join(per, "_b").select(
        "n_tokens", "n_docs", "_d_all", "_t_all",
        (F.sum("n_docs").over(inside) - F.col("n_docs") + F.col("_d_after")).alias("docs_longer"),
        (F.sum("_t").over(inside) - F.col("_t") + F.col("_t_after")).alias("tokens_longer"))
    return longer.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer", (F.col("_d_all") - F.col("docs_longer")).alias("docs_up_to"),
        F.col("_t_all").alias("total_tokens"),
        (F.col("_t_all") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("_d_all") - F.col("docs_longer")) / F.col("_d_all")).alias("share_up_to"))


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``limit, docs_longer, truncated_tokens`` for any limits, lengths that occur or not.

    Between two lengths the number of longer documents stays and the truncated total grows by
    it, so the answer follows from the next length below.
    """
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit bigint")
    first = sums.agg(F.max(F.col("docs_longer") + F.col("docs_up_to")).alias("all"))
    near = asked.join(first, F.lit(True))  # one row
    below = near.join(sums, F.col("n_tokens") <= F.col("limit"), "left").groupBy("limit", "all").agg(
        F.max(F.struct("n_tokens", "docs_longer", "truncated_tokens")).alias("s"))
    return below.select(
        "limit", F.coalesce("s.docs_longer", "all").alias("docs_longer"),
        F.coalesce(F.col("s.truncated_tokens") + (F.col("limit") - F.col("s.n_tokens")) * F.col("s.docs_longer"), F.col("limit") * F.col("all")).alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share, n_tokens``: the smallest length that at least this share of the documents does not exceed."""
    picks = [F.min(F.when(F.col("share_up_to") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    row = sums.agg(*picks)
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])).alias("x")).select("x.*")
