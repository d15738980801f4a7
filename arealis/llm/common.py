"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

SPACE = r"[\x20\x09-\x0D]"  # the six ASCII white-space characters
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    What follows starts from files that every executor can read, so a lost executor costs
    only its running tasks, and a table that is read twice is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as set it apart from the columns of a table (in any case of letters)."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def slices(rows: Iterable, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items."""
    part: list = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


MAX_BITS = 1 << 29


def may_be_among(df: DataFrame, value: Column, keys: DataFrame, key: str) -> DataFrame:
    """``df`` without most rows whose ``value`` (a 64-bit hash) isn't among ``keys``; none that is gets lost.

    The keys become bits of a bitmap with sixteen bits a key, at most ``MAX_BITS`` (64 MB) of
    them: that is the bound on what is broadcast. It only thins out the rows ahead of an exact join.
    """
    n = keys.count()
    bits = 1 << min(MAX_BITS.bit_length() - 1, max(16, (16 * n).bit_length()))
    place = lambda c: F.pmod(c, F.lit(bits))
    marked = keys.select(place(F.col(key)).alias("_p"))
    maps = marked.groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    asked = df.withColumn("_p", place(value)).withColumn("_bucket", F.bitmap_bucket_number("_p"))
    met = asked.join(F.broadcast(maps), "_bucket")
    at = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8 + 1).cast("int"))
    return met.filter(byte.bitwiseAND(bit) != 0).drop("_p", "_bucket", "_bits")
