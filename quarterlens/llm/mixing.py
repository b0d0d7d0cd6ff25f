"""Mixing sources to target weights by a low-discrepancy schedule [native].

Each source's documents, in the order of a seeded hash, form one stream of
words that is cut into equal blocks.  A schedule of slots decides whose block
comes next: slot i maps the golden-ratio point frac(i * phi) through the
cumulative weights, so that any stretch of the schedule holds the sources in
proportion.  Slots are ranked per source; rank r takes block r of the stream,
starting over at its end, until the source's target is met (the last block is
cut at the target).

Defined results: weights 1, 2, 3 repeat over the sources by code point, null
last; a null or blank text has size 0 and is never taken; a null source is a
source of its own; rows equal in every column are interchangeable; empty
input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.materialize import cut
from ._common import bucket_bits, exclusive_prefix, hash_bucket, small, word_count

PHI = 0.6180339887498949  # fractional part of the golden ratio
BLOCK_WORDS = 1024
MIN_SLOTS = 64            # blocks that a target has at least (fewer words: one word each)
MAX_REPEATS = 3           # times a document is taken at most
SLOT_CHUNK = 1 << 16
GRID = 1 << 12


def row_hash(docs: DataFrame, seed: int):
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns])


def source_targets(sized: DataFrame, block_words: int = BLOCK_WORDS, min_slots: int = MIN_SLOTS,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: weight, size, target, whole words to take, block size and slots.

    All sources share the total by weight; a target stops at ``max_repeats``
    times the size and the excess goes to the others by weight.  Sorted by
    cap / weight, the capped sources are a prefix, so running sums solve it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("source_id", F.row_number().over(by_name))
         .withColumn("weight", (F.lit(1) + F.pmod(F.col("source_id") - 1, F.lit(3))).cast("double"))
         .withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size")))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_id")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / open_weight)
    s = s.withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    final = F.min_by(F.when(F.col("free"), F.col("level")),
                     F.when(F.col("free"), F.col("cap") / F.col("weight"))).over(everything)
    s = s.withColumn("target", F.when(F.col("free"), final * F.col("weight")).otherwise(F.col("cap")))
    s = s.withColumn("want", F.floor(F.col("target") + F.lit(0.5)).cast("long"))
    s = s.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr(
        f"want div {min_slots}L"))).cast("long"))
    s = s.withColumn("blocks", F.expr("(source_size + block - 1) div block"))
    slots = F.when(F.col("source_size") > 0, F.expr(
        "(want div if(source_size > 0, source_size, 1L)) * blocks"
        " + ((want % if(source_size > 0, source_size, 1L)) + block - 1) div block")).otherwise(F.lit(0))
    return s.select("source", "source_id", "source_size", "target", "want", "block", "blocks",
                    slots.cast("long").alias("slots"))


def schedule(sources: DataFrame, n_sources: int) -> DataFrame:
    """(slot, source_id, rank): the low-discrepancy order in which sources give blocks."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("slots")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "slot long, source_id int, rank long")
    # A source may lag behind its share by a few slots; the surplus lets it catch up, and
    # ranks beyond a source's own number of slots are not used.  What is short then follows at the end.
    n = total + total * 8 // MIN_SLOTS + 16
    order = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    spans = (sources.where(F.col("slots") > 0)
             .withColumn("hi_n", F.sum("slots").over(order))
             .select("source_id", "slots",
                     ((F.col("hi_n") - F.col("slots")) / F.lit(float(total))).alias("lo"),
                     F.when(F.col("hi_n") == total, F.lit(2.0))
                     .otherwise(F.col("hi_n") / F.lit(float(total))).alias("hi"))
             .withColumn("cell", F.explode(F.sequence(
                 F.floor(F.col("lo") * GRID),
                 F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1).cast("long"))))))
    # The golden-ratio point in two exact-enough halves, so that large slot numbers keep their digits.
    step = (PHI * (1 << 24)) % 1.0
    point = (F.shiftright("slot", 24) * F.lit(step)) % F.lit(1.0) + (
        F.col("slot").bitwiseAND(F.lit((1 << 24) - 1)) * F.lit(PHI)) % F.lit(1.0)
    slots = spark.range(1, n + 1).select(F.col("id").alias("slot"))
    slots = slots.withColumn("u", point % F.lit(1.0)).withColumn("cell", F.floor(F.col("u") * GRID))
    picked = slots.join(small(spans, GRID + n_sources), "cell").where(
        (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "source_id", "slots")
    ranked = exclusive_prefix(picked, ["source_id"], F.shiftright("slot", SLOT_CHUNK.bit_length() - 1),
                              ["slot"], F.lit(1), "rank")
    ranked = cut(ranked.where(F.col("rank") < F.col("slots")).select("slot", "source_id", "rank"))
    have = ranked.groupBy("source_id").agg(F.count(F.lit(1)).alias("have"))
    short = (sources.where(F.col("slots") > 0).join(have, "source_id", "left").fillna(0, ["have"])
             .where(F.col("have") < F.col("slots"))
             .select("source_id", "have", F.explode(F.expr("sequence(have, slots - 1)")).alias("rank")))
    # Number the missing slots so that the sources take turns.
    rest = short.select((F.lit(n + 1) + (F.col("rank") - F.col("have")) * n_sources + F.col("source_id")).alias("slot"),
                        "source_id", "rank")
    return ranked.unionByName(rest)


class Mix:
    """The mix of a table of documents.

    ``stream``: one row per document with its size, source figures and the
    word at which it starts in its source's stream.  ``segments``: the mix
    itself, one row per slot and document that the slot's block touches, with
    the words taken (``words``, from word ``start`` of the document on).
    """

    def __init__(self, docs: DataFrame, seed: int = 5, block_words: int = BLOCK_WORDS):
        sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                row_hash(docs, seed).alias("row_hash")))
        self.sources = cut(source_targets(sized, block_words))
        n_sources, rows = self.sources.count(), sized.count()
        keyed = sized.join(small(self.sources, n_sources),
                           sized["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        bits = bucket_bits(rows, least=64)
        self.stream = cut(exclusive_prefix(
            keyed, ["source_id"], hash_bucket(F.col("row_hash"), bits), ["row_hash", "doc_id"],
            F.col("size"), "first"))
        self.segments = self._segments(schedule(self.sources, n_sources), n_sources)

    def _segments(self, slots: DataFrame, n_sources: int) -> DataFrame:
        takes = slots.join(small(self.sources, n_sources), "source_id").select(
            "slot", "source_id", F.expr("rank % blocks").alias("block_no"),
            F.expr("want - (rank div blocks) * source_size - (rank % blocks) * block").alias("left"))
        parts = (self.stream.where(F.col("size") > 0)
                 .withColumn("block_no", F.explode(F.expr(
                     "sequence(first div block, (first + size - 1) div block)")))
                 .select("source_id", "block_no", "doc_id", "first",
                         F.greatest(F.col("first"), F.col("block_no") * F.col("block")).alias("from"),
                         F.least(F.col("first") + F.col("size"),
                                 (F.col("block_no") + 1) * F.col("block")).alias("to"),
                         (F.col("block_no") * F.col("block")).alias("origin")))
        joined = parts.join(takes, ["source_id", "block_no"])
        taken = F.least(F.col("to"), F.col("origin") + F.col("left")) - F.col("from")
        return joined.select("slot", "source_id", "doc_id", "first",
                             (F.col("from") - F.col("first")).alias("start"),
                             taken.alias("words")).where(F.col("words") > 0)

    def taken(self) -> DataFrame:
        """Per document row: size, source figures and the words taken, repeats counted."""
        # A document of words is known by its source and the word at which it starts.
        sums = self.segments.groupBy("source_id", "first").agg(F.sum("words").alias("taken"))
        key = F.when(F.col("size") > 0, F.col("first"))
        return (self.stream.withColumn("key", key)
                .join(sums.withColumnRenamed("first", "key"), ["source_id", "key"], "left")
                .select("doc_id", "row_hash", "source", "size", "source_size", "target",
                        F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, seed: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (words taken / size, rounded).

    A source's stream is taken whole a number of times and then up to one
    place, so at most one document per source is rounded.
    """
    columns = docs.columns
    taken = Mix(docs, seed, block_words).taken()
    same = Window.partitionBy("row_hash").orderBy("row_hash")
    copies = (taken.withColumn("nth", F.row_number().over(same))
              .select("row_hash", "nth", F.floor(
                  F.col("taken") / F.greatest("size", F.lit(1)) + F.lit(0.5)).cast("int").alias("copies"))
              .where(F.col("copies") > 0))
    packed = docs.select(row_hash(docs, seed).alias("row_hash"),
                         F.struct(*[F.col(f"`{c}`") for c in columns]).alias("record"))
    packed = packed.withColumn("nth", F.row_number().over(same))
    return (packed.join(copies, ["row_hash", "nth"])
            .select("record", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
            .select("record.*"))
