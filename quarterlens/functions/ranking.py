"""Exact ranks and quantiles without a single-task global sort.

A global ``rank() OVER (ORDER BY x)`` or an exact ``percentile(x)`` puts every
row (or every distinct value) through one task.  Here the work is spread:

1. ``groupBy(value)`` -> distinct values with their counts (partial
   aggregation, so a value held by a third of all rows is one row);
2. approximate quantiles of the *distinct* values cut them into buckets of
   similar size (a bounded array per group, broadcast);
3. a window partitioned by bucket gives the count of smaller values inside
   the bucket; bucket totals (one row per bucket) give the offset of each
   bucket, again through a window over a bounded table.

The result is exact: bucket boundaries only decide how the work is split,
never the answer.  ``before`` is the number of rows with a strictly smaller
value, so min-rank = before + 1 and average rank = before + (count + 1) / 2.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialize import cut

APPROX_ACCURACY = 10000


def _bucket_count(df: DataFrame, buckets: int | None) -> int:
    if buckets is not None:
        return max(1, int(buckets))
    try:
        return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # pragma: no cover
        return 8


def value_positions(df: DataFrame, value: str, groups: Sequence[str] = (),
                    buckets: int | None = None, materialize: bool = True,
                    weight: str | None = None) -> DataFrame:
    """Distinct non-missing values per group with ``count``, ``before`` and group size ``n``.

    With ``weight`` the counts are sums of that column (``before`` = total
    weight of strictly smaller values).  The distinct-value table feeds three
    branches (bounds, in-bucket window, bucket totals), so it is checkpointed
    once unless ``materialize=False``.
    """
    groups = list(groups)
    v = F.col(value)
    cnt = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    d = df.where(v.isNotNull()).groupBy(*groups, value).agg(cnt.alias("count"))
    if materialize:
        d = cut(d)
    p = _bucket_count(df, buckets)
    if p > 1:
        probs = [i / p for i in range(1, p)]
        bounds = d.groupBy(*groups).agg(
            F.percentile_approx(value, probs, APPROX_ACCURACY).alias("_bounds"))
        d = (d.join(F.broadcast(bounds), groups, "inner") if groups
             else d.crossJoin(F.broadcast(bounds)))
        d = d.withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < v))).drop("_bounds")
    else:
        d = d.withColumn("_bucket", F.lit(0))
    inner = (Window.partitionBy(*groups, "_bucket").orderBy(value)
             .rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_before_in", F.coalesce(F.sum("count").over(inner), F.lit(0)))
    totals = d.groupBy(*groups, "_bucket").agg(F.sum("count").alias("_bucket_n"))
    across = Window.partitionBy(*groups).orderBy("_bucket")
    totals = totals.withColumns({
        "_offset": F.coalesce(F.sum("_bucket_n").over(across.rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0)),
        "n": F.sum("_bucket_n").over(Window.partitionBy(*groups)),
    }).drop("_bucket_n")
    d = d.join(F.broadcast(totals), [*groups, "_bucket"], "inner")
    return d.select(*groups, value, "count",
                    (F.col("_offset") + F.col("_before_in")).cast("long").alias("before"),
                    F.col("n").cast("long").alias("n"))


def value_ranks(df: DataFrame, value: str, groups: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Rows of ``df`` with a value, and per group ``_before`` (rows with a smaller one), ``_same`` (with this one), ``_n``.

    Ranks are carried to the rows, not joined back by value: rows are sorted
    into ranges by (groups, value, row number), so a value that many rows have
    spreads over several ranges.  Runs of equal values are counted inside their
    range; a range's first and last run may go on in its neighbours, and these,
    two per range, are put together in a table of one row per range.
    """
    groups = list(groups)
    keys = [*groups, "_v"]
    n = partitions or _bucket_count(df, None)
    rows = cut(df.where(F.col(value).isNotNull()).withColumns(
        {"_v": F.col(value) + F.lit(0.0), "_tie": F.monotonically_increasing_id()}))  # -0.0 + 0.0 is 0.0
    spread = (rows.repartitionByRange(n, *keys, "_tie").sortWithinPartitions(*keys, "_tie")
              .drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    run = F.struct(*keys)
    inside = Window.partitionBy("_range", *keys)
    rows = cut(spread).withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    rows = rows.withColumns({"_first": F.min("_at").over(inside), "_run": F.count(F.lit(1)).over(inside)})
    up = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_range").agg(
        F.min(run).alias("low"), F.max(run).alias("high"), F.count(F.lit(1)).alias("size"),
        F.max(F.when(F.col("_at") == 0, F.col("_run"))).alias("low_run"), F.max("_first").alias("high_first")).withColumn(
        "start", F.coalesce(F.sum("size").over(up), F.lit(0)))
    ends = ranges.select("_range", F.inline(F.array(
        F.struct(F.lit(False).alias("is_high"), F.col("low").alias("run"), F.col("start").alias("place"),
                 F.col("low_run").alias("many")),
        F.struct(F.lit(True).alias("is_high"), F.col("high").alias("run"), (F.col("start") + F.col("high_first")).alias("place"),
                 # a range of one run has it at both ends; it counts once
                 F.when(F.col("low") == F.col("high"), F.lit(0).cast("long"))
                 .otherwise(F.col("size") - F.col("high_first")).alias("many")))))
    whole = Window.partitionBy("run")
    ends = ends.withColumns({"place": F.min("place").over(whole), "many": F.sum("many").over(whole)})
    of = lambda high, c: F.max(F.when(F.col("is_high") == F.lit(high), F.col(c)))
    ends = ends.groupBy("_range").agg(*[of(h, c).alias(f"_{c}_{'high' if h else 'low'}")
                                        for h in (False, True) for c in ("run", "place", "many")])
    ends = ends.join(ranges.select("_range", "start"), "_range")  # one row per range
    rows = rows.join(F.broadcast(ends), "_range")

    def pick(c: str, inner):
        return F.when(run == F.col("_run_low"), F.col(f"_{c}_low")).when(run == F.col("_run_high"), F.col(f"_{c}_high")).otherwise(inner)

    rows = rows.select(*df.columns, pick("place", F.col("start") + F.col("_first")).alias("_place"),
                       pick("many", F.col("_run")).alias("_same"))
    per_group = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_begin"))
    rows = rows.join(per_group, groups) if groups else rows.crossJoin(F.broadcast(per_group))
    return rows.select(*df.columns, (F.col("_place") - F.col("_begin")).alias("_before"), "_same", "_n")


def _with_rank(df: DataFrame, value: str, rank: Column, out: str, groups: Sequence[str], buckets: int | None) -> DataFrame:
    """Ranked rows, and the rows without a value, which don't take part and don't move."""
    ranked = value_ranks(df, value, groups, buckets).select(*df.columns, rank.alias(out))
    return ranked.union(df.where(F.col(value).isNull()).select("*", F.lit(None).cast("double").alias(out)))


def min_rank_pct(df: DataFrame, value: str, out: str, scale: float = 1.0,
                 groups: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """``rank(method='min', pct=True) * scale`` over non-missing values; NULL stays NULL."""
    rank = ((F.col("_before") + F.lit(1)).cast("double") / F.col("_n").cast("double")) * F.lit(float(scale))
    return _with_rank(df, value, rank, out, groups, buckets)


def average_rank(df: DataFrame, value: str, out: str, groups: Sequence[str] = (),
                 buckets: int | None = None) -> DataFrame:
    """Average rank of ties (1-based), as used by Spearman correlation."""
    rank = F.col("_before").cast("double") + (F.col("_same").cast("double") + F.lit(1.0)) / F.lit(2.0)
    return _with_rank(df, value, rank, out, groups, buckets)


def sorted_positions(df: DataFrame, order: Sequence[Column], out: str = "position",
                     partitions: int | None = None) -> DataFrame:
    """``df`` with each row's place (long, from 0) in the order ``order`` over the whole table.

    Sample sort: rows go to ranges of the order (bounds from a sample), each
    range is sorted in its task and numbered, and the sizes of the ranges, one
    row each, give what lies before them.  One shuffle, nothing is joined on a
    value.  Equal keys meet in one range: end ``order`` with a column that tells
    rows apart where a key can be frequent.  ``df`` is read twice (sample and
    sort), so it should be a written table.
    """
    n = partitions or _bucket_count(df, None)
    spread = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))  # range number << 33 | place in the range
    rows = cut(spread).withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(offsets), "_range").select(*df.columns, place.alias(out))


def lerp(a, b, t):
    """Linear interpolation the way NumPy does it (stable for t >= 0.5)."""
    return F.when(t >= F.lit(0.5), b - (b - a) * (F.lit(1.0) - t)).otherwise(a + (b - a) * t)


def quantiles_long(df: DataFrame, value: str, probs: Sequence[float],
                   groups: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group: rows (groups..., p, q).

    For each probability only the (at most two) distinct values that hold the
    positions floor(h) and floor(h)+1, h = (n-1)p, are kept, so the final
    aggregate sees at most two rows per (group, p).
    """
    groups = list(groups)
    pos = value_positions(df, value, groups, buckets)
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    return _interpolated(_at_quantiles(pos.select("*", ps), value, groups), groups)


def _at_quantiles(pos: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """(groups, p, _t, _a, _b) of value positions with their ``p``: the two values around position (n-1)p."""
    h = (F.col("n") - F.lit(1)).cast("double") * F.col("p")
    lo = F.floor(h)
    hi = F.least(lo + F.lit(1), F.col("n") - F.lit(1))
    start, end = F.col("before"), F.col("before") + F.col("count") - F.lit(1)
    covers_lo = (start <= lo) & (lo <= end)
    covers_hi = (start <= hi) & (hi <= end)
    picked = pos.where(covers_lo | covers_hi).select(
        *groups, "p", (h - lo).alias("_t"),
        F.when(covers_lo, F.col(value)).alias("_a"),
        F.when(covers_hi, F.col(value)).alias("_b"))
    return picked.groupBy(*groups, "p").agg(F.max("_t").alias("_t"), F.max("_a").alias("_a"),
                                            F.max("_b").alias("_b"))


def _interpolated(found: DataFrame, groups: Sequence[str]) -> DataFrame:
    return found.select(*groups, "p", lerp(F.col("_a"), F.col("_b"), F.col("_t")).alias("q"))


BRACKET = 5.0 / APPROX_ACCURACY  # share of the rows on either side of a quantile that are looked at


def quantiles_bracketed(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str]) -> DataFrame:
    """``quantiles_long`` for many rows in few groups: only the rows near a quantile move.

    Approximate quantiles a little below and above each ``p`` bracket it; one
    pass counts the rows under each bracket, and the values inside it are
    ranked.  The result is exact: where a bracket should miss its position,
    ``quantiles_long`` takes over.  ``df`` is read three times, so it should
    follow from a written table without a shuffle.
    """
    groups, v = list(groups), F.col(value)
    d = df.where(v.isNotNull())
    ends = sorted({e for p in probs for e in (p - BRACKET, p + BRACKET) if 0.0 < e < 1.0}) or [0.5]
    sizes = cut(d.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"),
                                       F.percentile_approx(value, ends, APPROX_ACCURACY).alias("_e")))
    bound = lambda e: F.col("_e")[ends.index(e)]
    under = [v < bound(p - BRACKET) if p - BRACKET in ends else F.lit(False) for p in probs]
    over = [v > bound(p + BRACKET) if p + BRACKET in ends else F.lit(False) for p in probs]
    rows = d.join(F.broadcast(sizes), groups)  # one row per group
    below = rows.groupBy(*groups).agg(F.array(*[F.count(F.when(u, 1)) for u in under]).alias("_below"))
    inside = [~u & ~o for u, o in zip(under, over)]
    near = rows.where(reduce(lambda x, y: x | y, inside)).select(*groups, value, "n", F.explode(F.array_compact(
        F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(inside)]))).alias("_k"))
    counted = near.groupBy(*groups, "n", "_k", value).agg(F.count(F.lit(1)).alias("count"))
    up = Window.partitionBy(*groups, "_k").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("count").over(up), F.lit(0)))
    ps = F.array(*[F.lit(float(p)) for p in probs])
    pos = counted.join(F.broadcast(below), groups).select(
        *groups, value, "n", "count", ps[F.col("_k")].alias("p"),
        (F.col("_below")[F.col("_k")] + F.col("_before")).alias("before"))
    found = cut(_at_quantiles(pos, value, groups))
    if found.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).count() < sizes.count() * len(set(probs)):
        return quantiles_long(df, value, probs, groups)
    return _interpolated(found, groups)


def quantiles_wide(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                   names: Sequence[str], buckets: int | None = None) -> DataFrame:
    """One row: ``{name}_{column}`` = exact quantile ``p`` of ``column`` for each pair.

    The columns are stacked into (column, value) form so one distributed pass
    serves all of them.
    """
    stacked = stack_columns(df, columns)
    q = quantiles_long(stacked, "value", probs, ["column"], buckets)
    aggs = []
    for c in columns:
        for p, name in zip(probs, names):
            aggs.append(F.max(F.when((F.col("column") == F.lit(c)) & (F.col("p") == F.lit(float(p))),
                                     F.col("q"))).alias(f"{name}_{c}"))
    return q.agg(*aggs)


def stack_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep..., column, value) of several double columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                      for c in columns])
    return df.select(*keep, F.inline(pairs))
