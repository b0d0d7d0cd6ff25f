"""Kendall tau-b (A19, third method), exact and distributed, without Python.

For one column pair, with n0 = n(n-1)/2, n1 / n2 the pairs tied in x / y and
n3 the pairs tied in both:

    S   = concordant - discordant = 2 C - (n0 - n1) + (n2 - n3)
    tau = S / sqrt((n0 - n1) (n0 - n2))

where C counts ordered pairs with x_i < x_j and y_i < y_j, the only
two-dimensional count.  It is split over a dyadic tree on the x positions: two
different positions part at exactly one level, where they lie in the left and
the right half of the same node.  At each (level, node) the weight of left
entries with a smaller y is counted for every right entry, by a window over
stretches of the y order and a second one over the stretches' totals, so
neither a frequent value nor the top node meets whole in one task.

All column pairs of a matrix run in the same jobs (a ``pair`` group column).
Work and shuffle are O(n log n) rows, aggregated before they move.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.materialize import cut
from ..functions.ranking import value_positions

COUNT = "decimal(19,0)"  # products of two counts fit decimal(38,0)
STRETCH_BITS = 16        # y positions in one window of a node


def dyadic_entries(coded: DataFrame, levels: int) -> DataFrame:
    """(pair, level, node, yc, lw, rw): weight in the left and the right half of each node, per y position."""
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    rows = coded.select("pair", "xc", "yc", "w", level.alias("level"))
    left = F.expr("shiftright(xc, level) & 1L") == 0
    return (rows.groupBy("pair", "level", F.expr("shiftright(xc, level + 1)").alias("node"), "yc")
            .agg(F.sum(F.when(left, F.col("w")).otherwise(0)).alias("lw"),
                 F.sum(F.when(left, 0).otherwise(F.col("w"))).alias("rw")))


def ascending_pairs(coded: DataFrame, levels: int, stretch_bits: int = STRETCH_BITS) -> DataFrame:
    """(pair, c): ordered pairs with smaller x and smaller y, of weighted (xc, yc) positions."""
    node = ["pair", "level", "node"]
    before = Window.unboundedPreceding, -1
    exact = lambda a, b: F.sum(F.col(a).cast(COUNT) * F.col(b).cast(COUNT))
    cells = dyadic_entries(coded, levels).withColumn("stretch", F.shiftright("yc", stretch_bits))
    inner = Window.partitionBy(*node, "stretch").orderBy("yc").rowsBetween(*before)
    totals = (cells.withColumn("below", F.coalesce(F.sum("lw").over(inner), F.lit(0)))
              .groupBy(*node, "stretch")
              .agg(F.sum("lw").alias("lw"), F.sum("rw").alias("rw"), exact("rw", "below").alias("c_in")))
    across = Window.partitionBy(*node).orderBy("stretch").rowsBetween(*before)
    totals = totals.withColumn("below", F.coalesce(F.sum("lw").over(across), F.lit(0)))
    return totals.groupBy("pair").agg((F.sum("c_in") + exact("rw", "below")).alias("c"))


def tau_b(long: DataFrame, stretch_bits: int = STRETCH_BITS) -> DataFrame:
    """tau-b per ``pair`` of a (pair, x, y) table with complete rows -> (pair, tau)."""
    pairs = cut(long.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w")))
    # Twice the number of pairs among w equal things, summed without a 64-bit cap.
    tied = lambda c: F.sum(F.col(c).cast(COUNT) * (F.col(c) - F.lit(1)).cast(COUNT))
    tx = pairs.groupBy("pair", "x").agg(F.sum("w").alias("t")).groupBy("pair").agg(tied("t").alias("n1"))
    ty = pairs.groupBy("pair", "y").agg(F.sum("w").alias("t")).groupBy("pair").agg(tied("t").alias("n2"))
    tot = cut(pairs.groupBy("pair").agg(F.sum("w").alias("n"), tied("w").alias("n3")))
    n = tot.agg(F.max("n")).first()[0] or 0
    levels = max(1, (n - 1).bit_length())  # positions are below n
    place = lambda c: value_positions(pairs, c, ["pair"], weight="w").select(
        "pair", c, F.col("before").alias(f"{c}c"))
    coded = pairs.join(place("x"), ["pair", "x"]).join(place("y"), ["pair", "y"]).select("pair", "xc", "yc", "w")
    c = ascending_pairs(coded, levels, stretch_bits)
    out = tot.join(tx, "pair").join(ty, "pair").join(c, "pair", "left")
    n0 = F.col("n").cast(COUNT) * (F.col("n") - F.lit(1)).cast(COUNT)
    left_x, left_y = n0 - F.col("n1"), n0 - F.col("n2")
    twice_s = F.lit(4) * F.coalesce(F.col("c"), F.lit(0)) - left_x + (F.col("n2") - F.col("n3"))
    den = F.sqrt(left_x.cast("double") * left_y.cast("double"))
    return out.select("pair", F.when(den > 0, twice_s.cast("double") / den).alias("tau"))


def kendall_matrix(clean: DataFrame, vals: Sequence[str], names: Sequence[str], digits: int = 3) -> DataFrame:
    """Square tau-b matrix (rows ``variable``) of already clean columns."""
    k = len(vals)
    combos = [(a, b) for a in range(k) for b in range(a + 1, k)]
    long = clean.select(F.inline(F.array(*[
        F.struct(F.lit(i).cast("long").alias("pair"), F.col(vals[a]).alias("x"), F.col(vals[b]).alias("y"))
        for i, (a, b) in enumerate(combos)])))
    taus = tau_b(long)
    wide = taus.agg(*[F.max(F.when(F.col("pair") == i, F.col("tau"))).alias(f"_t{i}")
                      for i in range(len(combos))])
    index = {pair: i for i, pair in enumerate(combos)}

    def cell(a, b):
        if a == b:
            return F.lit(1.0)
        t = F.col(f"_t{index[(min(a, b), max(a, b))]}")
        return F.bround(F.when(t.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t))), digits)

    rows = F.array(*[F.struct(F.lit(names[a]).alias("variable"), *[cell(a, b).alias(names[b]) for b in range(k)])
                     for a in range(k)])
    return wide.select(F.inline(rows))
