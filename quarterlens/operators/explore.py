"""Exploratory statistics.

Every function is one aggregate job over a summary table.  Totals are one-row
aggregates cross-joined back (a broadcast of exactly one row), never a
``sum() over ()`` window, which would pull every row into one task.  Medians,
percentile trims and Spearman ranks use the distributed exact helpers of
``functions.ranking``.  Means, deviations and correlations are built from
decimal sums so the answer does not depend on partitioning.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.ranking import average_rank, quantiles_long, stack_columns

STAT_DECIMAL = "decimal(38,12)"


def _exact_total(c) -> F.Column:
    return F.sum(X.col(c).cast(STAT_DECIMAL))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct values per listed column (unknown columns skipped)."""
    cols = [c for c in columns if c in df.columns]
    return df.agg(*[F.count_distinct(c).alias(f"{c}_distinct") for c in cols])


def _long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value) with every listed column's value as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    return df.select(*keep, F.inline(pairs))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each column (missing values not counted)."""
    return (_long_values(df, columns).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))


def customers_by(df: DataFrame, columns: Sequence[str], customer: str = "customer") -> DataFrame:
    """Distinct customers per value of each column."""
    return (_long_values(df, columns, [customer]).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count_distinct(customer).alias("n_customers")))


def nos_share(df: DataFrame, columns: Sequence[str], measure: str = "nos_excl_NIT") -> DataFrame:
    """Share (%) of the measure per value of each column."""
    per = (_long_values(df, columns, [measure]).where(F.col("value").isNotNull())
           .groupBy("column", "value").agg(X.exact_sum(measure).alias("_sum")))
    totals = per.groupBy("column").agg(X.exact_sum("_sum").alias("_total"))
    return (per.join(F.broadcast(totals), "column")
            .select("column", "value", X.no_nan(X.ieee_div("_sum", "_total") * F.lit(100.0)).alias("nos_pct")))


def nos_table(df: DataFrame, columns: Sequence[str], measure: str = "nos_excl_NIT",
              customer: str = "customer") -> DataFrame:
    """Customers, customer %, measure % per value, 1 decimal.

    As in the reference, the customer % denominator is the sum of the
    per-value distinct counts (a customer in two values counts twice).
    """
    per = (_long_values(df, columns, [measure, customer]).where(F.col("value").isNotNull())
           .groupBy("column", "value").agg(X.exact_sum(measure).alias("_sum"),
                                           F.count_distinct(customer).alias("n_customers")))
    totals = per.groupBy("column").agg(X.exact_sum("_sum").alias("_total"),
                                      F.sum("n_customers").alias("_cust_total"))
    j = per.join(F.broadcast(totals), "column")
    return j.select(
        "column", "value", "n_customers",
        F.bround(X.no_nan(X.ieee_div("n_customers", "_cust_total") * F.lit(100.0)), 1).alias("customers_pct"),
        F.bround(X.no_nan(X.ieee_div("_sum", "_total") * F.lit(100.0)), 1).alias("nos_pct"),
    )


def customer_shares(df: DataFrame, measure: str = "nos_excl_NIT", customer: str = "customer") -> DataFrame:
    """Share (%) of the measure per customer (input of A20, A21)."""
    per = df.groupBy(customer).agg(X.exact_sum(measure).alias("_sum"))
    total = per.agg(X.exact_sum("_sum").alias("_total"))
    return per.crossJoin(F.broadcast(total)).select(
        customer, X.no_nan(X.ieee_div("_sum", "_total") * F.lit(100.0)).alias("nos_pct"))


# fixed values: NOS-share bands of the client distribution (left-closed)
SHARE_BINS = [0, 2.5, 5, 7.5, 10, 12.5, 15, 17.5, 20, 22.5, 25, 30, 100]
SHARE_LABELS = ['0-2.5%', '2.5-5%', '5-7.5%', '7.5-10%', '10-12.5%', '12.5-15%',
                '15-17.5%', '17.5-20%', '20-22.5%', '22.5-25%', '25-30%', '30%+']


def bin_index(x, edges: Sequence[float], right: bool = False) -> F.Column:
    """Index of the half-open bin holding x (NULL outside the edges)."""
    x = X.col(x)
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = float(edges[i]), float(edges[i + 1])
        cond = (x > lo) & (x <= hi) if right else (x >= lo) & (x < hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def share_bands(df: DataFrame, bins: Sequence[float] = SHARE_BINS,
                labels: Sequence[str] = SHARE_LABELS, measure: str = "nos_excl_NIT",
                customer: str = "customer") -> DataFrame:
    """Customers per NOS-share band; empty bands kept with 0."""
    shares = customer_shares(df, measure, customer)
    counted = (shares.select(bin_index("nos_pct", bins).alias("band"))
               .where(F.col("band").isNotNull()).groupBy("band").agg(F.count(F.lit(1)).alias("n_customers")))
    dim = df.sparkSession.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "band int, label string")
    return (dim.join(F.broadcast(counted), "band", "left")
            .select("band", "label", F.coalesce("n_customers", F.lit(0)).cast("long").alias("n_customers")))


def top_customers(df: DataFrame, n: int = 10, measure: str = "nos_excl_NIT",
                  customer: str = "customer") -> DataFrame:
    """The n customers with the largest share (ties by customer)."""
    return customer_shares(df, measure, customer).orderBy(F.desc("nos_pct"), F.asc(customer)).limit(n)


def _finite_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    long = stack_columns(df, columns, keep)
    return long.withColumn("value", X.finite("value"))


def trim_percentiles(long: DataFrame, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """P17 on long form: keep lower <= value <= upper quantile within each column."""
    q = quantiles_long(long, "value", [lower, upper], ["column"])
    bounds = q.groupBy("column").agg(
        F.max(F.when(F.col("p") == F.lit(float(lower)), F.col("q"))).alias("_lo"),
        F.max(F.when(F.col("p") == F.lit(float(upper)), F.col("q"))).alias("_hi"))
    return (long.join(F.broadcast(bounds), "column")
            .where((F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi")))
            .drop("_lo", "_hi"))


def descriptive(df: DataFrame, columns: Sequence[str], remove_outliers: bool = False) -> DataFrame:
    """Mean, median, sample std, min, max (2 decimals), count used, original count."""
    cols = [c for c in columns if c in df.columns]
    raw = stack_columns(df, cols)
    original = raw.groupBy("column").agg(F.count("value").alias("count_original"))
    long = raw.withColumn("value", X.finite("value")).where(F.col("value").isNotNull())
    if remove_outliers:
        long = trim_percentiles(long)
    first = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), _exact_total("value").alias("_total"),
        F.min("value").alias("_min"), F.max("value").alias("_max"))
    first = first.withColumn("_mean", X.ieee_div(F.col("_total").cast("double"), F.col("count")))
    dev = (long.join(F.broadcast(first.select("column", "_mean")), "column")
           .groupBy("column").agg(_exact_total((F.col("value") - F.col("_mean"))
                                               * (F.col("value") - F.col("_mean"))).alias("_ss")))
    med = quantiles_long(long, "value", [0.5], ["column"]).select("column", F.col("q").alias("_median"))
    out = first.join(dev, "column").join(med, "column")
    std = F.when(F.col("count") > 1,
                 F.sqrt(X.ieee_div(F.col("_ss").cast("double"), F.col("count") - F.lit(1))))
    stats = out.select(
        F.col("column").alias("variable"),
        F.bround("_mean", 2).alias("mean"), F.bround("_median", 2).alias("median"),
        F.bround(std, 2).alias("std"), F.bround("_min", 2).alias("min"), F.bround("_max", 2).alias("max"),
        F.col("count").cast("long").alias("count"))
    return original.withColumnRenamed("column", "variable").join(stats, "variable", "left").select(
        "variable", "mean", "median", "std", "min", "max",
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.col("count_original").cast("long").alias("count_original"))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every listed column is a finite number."""
    out = df.select("*", *[X.finite(X.to_number(c)).alias(f"_v_{c}") for c in columns])
    return out.where(X.all_not_null([f"_v_{c}" for c in columns]))


def _pearson_matrix(df: DataFrame, cols: Sequence[str], names: Sequence[str], digits: int = 3) -> DataFrame:
    """Pearson matrix of already clean columns ``cols`` reported under ``names``."""
    means = df.agg(*[X.ieee_div(_exact_total(c).cast("double"), F.count(F.lit(1))).alias(f"_m{i}")
                     for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(means))
    centred = [F.col(c) - F.col(f"_m{i}") for i, c in enumerate(cols)]
    sums = {}
    aggs = []
    for a in range(len(cols)):
        for b in range(a, len(cols)):
            name = f"_s{a}_{b}"
            sums[(a, b)] = sums[(b, a)] = name
            aggs.append(_exact_total(centred[a] * centred[b]).cast("double").alias(name))
    s = j.agg(*aggs)

    def corr(a, b):
        num = F.col(sums[(a, b)])
        den = F.sqrt(F.col(sums[(a, a)]) * F.col(sums[(b, b)]))
        r = F.when(den > 0, num / den)
        return F.bround(X.clip(r, -1.0, 1.0), digits)

    rows = F.array(*[
        F.struct(F.lit(names[a]).alias("variable"), *[corr(a, b).alias(names[b]) for b in range(len(cols))])
        for a in range(len(cols))])
    return s.select(F.inline(rows))


def correlation(df: DataFrame, columns: Sequence[str], method: str = "pearson",
                keys: Sequence[str] = ()) -> DataFrame:
    """Correlation matrix over complete-case rows, 3 decimals.

    Zero variance gives NULL (no error).  Spearman = Pearson on average ranks
    computed per column by the distributed exact rank; ``keys`` must
    identify a row.
    """
    cols = [c for c in columns if c in df.columns]
    if len(cols) < 2:
        raise ValueError("at least two columns are needed")
    clean = complete_cases(df, cols)
    vals = [f"_v_{c}" for c in cols]
    if method == "pearson":
        return _pearson_matrix(clean, vals, cols)
    if method == "spearman":
        if not keys:
            raise ValueError("spearman needs row keys")
        long = stack_columns(clean.select(*keys, *vals), vals, keys)
        ranked = average_rank(long, "value", "rank", ["column"])
        wide = ranked.groupBy(*keys).pivot("column", vals).agg(F.first("rank"))
        return _pearson_matrix(wide, vals, cols)
    if method == "kendall":
        from .kendall import kendall_matrix
        return kendall_matrix(clean, vals, cols)
    raise ValueError(f"unsupported method {method}")


def histogram_feed(df: DataFrame, columns: Sequence[str], bins: int = 30, trim: bool = True) -> DataFrame:
    """Equal-width histogram per column after the P17 trim (all bins, empty ones 0)."""
    cols = [c for c in columns if c in df.columns]
    long = _finite_long(df, cols).where(F.col("value").isNotNull())
    if trim:
        long = trim_percentiles(long)
    rng = long.groupBy("column").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    j = long.join(F.broadcast(rng), "column")
    width = F.col("_hi") - F.col("_lo")
    idx = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("_lo"))
                                                            * (F.lit(float(bins)) / width)).cast("int"))
                 ).otherwise(F.lit(0))
    counted = j.groupBy("column", idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    dim = rng.crossJoin(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")))
    return (dim.join(counted, ["column", "bin"], "left")
            .select("column", "bin",
                    (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / F.lit(float(bins))).alias("bin_lo"),
                    (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin") + 1) / F.lit(float(bins))).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))
