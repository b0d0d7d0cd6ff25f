"""Sharding by a two-pass external shuffle [native].

Pass 1 scatters whole records uniformly into memory-sized buckets by a seeded
hash of the record.  Pass 2 takes each bucket as one array in memory, applies
a Fisher-Yates shuffle to it (``shuffle(array, seed)``) and writes it.  The
buckets laid end to end are one random order of all records; it is cut into
shards whose record counts differ by one at most.

Defined results: a null text counts as no bytes; null ids and null columns
are part of the hashed record like any value; rows equal in every column are
interchangeable, and so many of them that they would fill a bucket are counted
and dealt to buckets in stretches; empty input gives no rows; extra columns, whatever their
names, travel inside ``record``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.materialize import cut
from ._common import shuffle_partitions, small

BUCKET_BYTES = 64 << 20


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (a missing one has none) plus one separator."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")


def _heavy(docs: DataFrame, seed: int, bucket_bytes: int, text: str) -> tuple[DataFrame, int]:
    """(key, stretch) of records that occur more than once and take over a quarter of a bucket together.

    There are at most four of them per bucket; ``stretch`` is how many of their rows make a sixteenth of one.
    """
    found = docs.groupBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns]).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(record_bytes(F.col(text))).alias("bytes"))
    found = cut(found.where((F.col("n") > 1) & (F.col("bytes") * 4 > bucket_bytes)).select(
        "key", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * bucket_bytes / (F.col("bytes") * 16)))
        .alias("stretch")))
    return found, found.count()


def _stretches(keyed: DataFrame, seed: int) -> DataFrame:
    """The same records as often, each stretch of a record's rows under a key of its own.

    Equal rows are counted, on the map side first, and only their numbers are
    dealt out again, so no task holds all rows of a record.
    """
    counted = keyed.groupBy("key", "r", "stretch").agg(F.count(F.lit(1)).alias("n"))
    last = F.expr("(n - 1) div stretch")
    cuts = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("nth"))
    rows = F.least(F.col("stretch"), F.col("n") - F.col("nth") * F.col("stretch"))
    salted = cuts.select(F.xxhash64(F.lit(seed), "key", "nth").alias("key"), "r", rows.alias("rows"))
    return (salted.repartition(F.col("key"))
            .select("key", "r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select("key", "r"))


def external_shuffle(docs: DataFrame, seed: int = 11, bucket_bytes: int = BUCKET_BYTES,
                     text: str = "text") -> tuple[DataFrame, int, int]:
    """(written table (bucket, position, record), its buckets, its records).

    ``bucket_bytes`` bounds the expected size of a bucket; there are at least
    as many buckets as shuffle partitions, so that every core has work.
    """
    spark = docs.sparkSession
    n, size = docs.agg(F.count(F.lit(1)), F.sum(record_bytes(F.col(text)))).first()
    buckets = max(-(-(size or 0) // bucket_bytes), shuffle_partitions(spark), 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    record = F.struct(*columns)
    keyed = docs.select(F.xxhash64(F.lit(seed), *columns).alias("key"),
                        F.struct(F.xxhash64(F.lit(seed + 1), record).alias("h"), record.alias("record")).alias("r"))
    heavy, n_heavy = _heavy(docs, seed, bucket_bytes, text)
    if n_heavy:
        listed = small(heavy, n_heavy)
        keyed = keyed.join(listed, "key", "left_anti").unionByName(
            _stretches(keyed.join(listed.select("key", "stretch"), "key"), seed))
    scattered = keyed.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "r")
    # A bucket is a partition of its own, and its records are sorted first: a retried task
    # shuffles the same way.
    gathered = (scattered.repartitionById(buckets, "bucket").groupBy("bucket")
                .agg(F.sort_array(F.collect_list("r")).alias("rs")))
    shuffled = gathered.select("bucket", F.posexplode(F.shuffle(F.col("rs"), F.lit(seed + 2)))
                               .alias("position", "r"))
    return cut(shuffled.select("bucket", "position", F.col("r.record").alias("record"))), buckets, n


def shard(docs: DataFrame, n_shards: int, seed: int = 11, bucket_bytes: int = BUCKET_BYTES,
          text: str = "text") -> DataFrame:
    """(shard, slot, record): random shards with counts at most one apart, slots without gaps."""
    written, buckets, n = external_shuffle(docs, seed, bucket_bytes, text)
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (written.groupBy("bucket").count()
               .select("bucket", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("offset")))
    at = (F.col("offset") + F.col("position")).cast("long")
    placed = written.join(small(offsets, buckets), "bucket").select(at.alias("at"), "record")
    placed = placed.withColumn("shard", F.expr(f"(at * {n_shards}L) div {max(n, 1)}L"))
    first = F.expr(f"(shard * {max(n, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return placed.select(F.col("shard").cast("int").alias("shard"),
                         (F.col("at") - first).cast("long").alias("slot"), "record")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; the slot says each record's place in it."""
    sharded.write.partitionBy("shard").mode("error").parquet(path)
