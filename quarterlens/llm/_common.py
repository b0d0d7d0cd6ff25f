"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word is a run of characters that are neither a space nor \t..\r.
BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: A table is broadcast only after a count has shown that it has at most this many rows.
BROADCAST_ROWS = 200_000


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words(text: Column) -> Column:
    """Words of a text; a missing text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint behind a check of the counted rows; a plain join beyond it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def exclusive_prefix(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence,
                     value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its key, in (bucket, order).

    A key may hold any share of all rows: its rows are spread over buckets that
    follow the order.  Totals per (key, bucket) are aggregated on the map side
    and summed over the buckets of a key; only rows of one (key, bucket) meet in
    one task.  ``df`` is read twice, so it should be a written table.
    """
    keys = list(keys)
    df = df.withColumn("__bucket", bucket).withColumn("__value", value)
    before = Window.unboundedPreceding, -1
    totals = df.groupBy(*keys, "__bucket").agg(F.sum("__value").alias("__total"))
    across = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(*before)
    offsets = totals.select(*keys, "__bucket",
                            F.coalesce(F.sum("__total").over(across), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(*before)
    df = df.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return (df.join(offsets, [*keys, "__bucket"])
            .withColumn(out, (F.col("__offset") + F.col("__inside")).cast("long"))
            .drop("__bucket", "__value", "__offset", "__inside"))


def hash_bucket(h: Column, bits: int) -> Column:
    """The top ``bits`` of a 64-bit hash, as an unsigned number."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def bucket_bits(rows: int, per_bucket: int = 100_000, least: int = 1) -> int:
    """Bits so that ``rows`` fall into at least ``least`` buckets of about ``per_bucket`` rows."""
    return min(40, max(0, (max(least, -(-rows // per_bucket)) - 1).bit_length()))
