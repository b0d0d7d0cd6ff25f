"""Merge and transform (E2): J1-J4, A3-A7, P10-P12, P20.

Joins are plain equi-joins: Spark (with AQE) picks broadcast when the runtime
size of a master table is under ``spark.sql.autoBroadcastJoinThreshold`` and a
shuffle join otherwise, and splits a skewed customer / product key with the
AQE skew-join rule.
"""

from __future__ import annotations

from functools import cached_property
from typing import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.materialize import cut
from ..sources import schemas as S

MEASURES = S.REPORT_MEASURES
FINAL_GROUP_KEYS = [
    "optima_id", "optima_name", "channel", "team", "time_id",
    "corporate_item_gtin", "corporate_product_name", "corporate_brand_name",
    "corporate_category_name", "corporate_sub_sector_name",
]
# The same groups, with a key for the product texts, and with what P11 and J4 make of the keys: rows that
# are dealt by QUARTER_SPREAD lie in one place for A6 and for A7.
SLIM_GROUP_KEYS = ["optima_id", "optima_name", "customer", "channel", "team", "time_id", "quarter",
                   "product_key", "product_variant", "category_smo"]
QUARTER_SPREAD = ["customer", "quarter", "category_smo"]
PRODUCT_ATTRS = ["corporate_item_gtin", "corporate_product_name", "corporate_brand_name",
                 "corporate_category_name", "corporate_sub_sector_name"]


def merge_customers(report: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report left-join customer master on cust_id; split by country present.

    The master is unique on (cust_id, country), so a customer listed in two
    countries fans out into two rows, as in the reference.
    """
    joined = report.join(customers, "cust_id", "left")
    has_country = F.col("cust_country_name").isNotNull()
    return joined.where(has_country), joined.where(F.col("cust_country_name").isNull())


def merge_products(matched: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Left-join product master on prod_id; split by gtin present (fans out per gtin)."""
    joined = matched.join(products, "prod_id", "left")
    has_gtin = F.col("corporate_item_gtin").isNotNull()
    return joined.where(has_gtin), joined.where(F.col("corporate_item_gtin").isNull())


def with_product_key(products: DataFrame) -> DataFrame:
    """The master with ``product_key`` and ``product_variant``, which stand for its attributes beside the gtin.

    The key is the smallest prod_id with the same attributes; the variant tells
    rows of one key apart, as those of a product with several gtins.
    """
    rows = products.where(F.col("corporate_item_gtin").isNotNull())
    rows = rows.withColumn("product_key", F.min("prod_id").over(Window.partitionBy(*PRODUCT_ATTRS)))
    w = Window.partitionBy("product_key").orderBy(*PRODUCT_ATTRS)
    return rows.withColumn("product_variant", F.dense_rank().over(w))


def missing_channel_team(df: DataFrame) -> DataFrame:
    """A3: GIV per (cust, optima, name, channel, team, month), groups lacking channel or team."""
    keys = ["cust_id", "optima_id", "optima_name", "channel", "team", "time_id"]
    g = df.groupBy(*keys).agg(X.exact_sum("giv_lc").alias("giv_lc"))
    return g.where(F.col("channel").isNull() | F.col("team").isNull())


def fill_channel_team(df: DataFrame, value: str = "OTHERS") -> DataFrame:
    """P10."""
    return df.fillna({"channel": value, "team": value})


def best_channel_team(df: DataFrame) -> DataFrame:
    """A4: per optima, the (channel, team) with the largest GIV; ties -> first by (channel, team).

    The window runs on the already aggregated (optima, channel, team) table.
    """
    g = (df.where(F.col("optima_id").isNotNull())
           .groupBy("optima_id", "channel", "team")
           .agg(X.exact_sum("giv_lc").alias("giv_lc")))
    w = Window.partitionBy("optima_id").orderBy(F.desc("giv_lc"), F.asc_nulls_first("channel"),
                                               F.asc_nulls_first("team"))
    return (g.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
             .select("optima_id", F.col("channel").alias("best_channel"),
                     F.col("team").alias("best_team")))


def assign_best_channel_team(df: DataFrame) -> DataFrame:
    """Overwrite channel/team with the optima's best pair (NULL optima -> NULL)."""
    best = best_channel_team(df)
    out = df.join(best, "optima_id", "left")
    return (out.withColumn("channel", F.col("best_channel"))
               .withColumn("team", F.col("best_team"))
               .drop("best_channel", "best_team"))


def name_quality(df: DataFrame) -> DataFrame:
    """A5: optima ids with more than one (non-missing) name.

    Counts per (optima, name, cust, channel, team) first, in one pass over the
    rows; the lists are built from distinct values only.
    """
    base = df.where(F.col("optima_id").isNotNull())
    combos = cut(base.groupBy("optima_id", "optima_name", "cust_id", "channel", "team")
                 .agg(F.count(F.lit(1)).alias("n")))
    # Lists are made for the ids with several names only.
    several = (combos.groupBy("optima_id").agg(F.count_distinct("optima_name").alias("n_names"),
                                               F.sum("n").alias("n_rows")).where(F.col("n_names") > 1))

    def joined(c, sep):
        return F.array_join(F.sort_array(F.collect_set(c)), sep)

    per = combos.join(several.select("optima_id"), "optima_id", "left_semi").groupBy("optima_id").agg(
        joined("optima_name", " | ").alias("names"),
        F.count_distinct("cust_id").alias("n_cust_ids"),
        joined("cust_id", ", ").alias("cust_ids"),
        F.collect_set("channel").alias("_ch"),
        F.collect_set("team").alias("_tm"),
    )
    return per.join(several, "optima_id", "inner").select(
        "optima_id", "n_names", "names", "n_cust_ids", "cust_ids", "n_rows",
        F.when(F.size("_ch") == 0, F.lit("N/A")).otherwise(F.array_join(F.sort_array("_ch"), ", ")).alias("channels"),
        F.when(F.size("_tm") == 0, F.lit("N/A")).otherwise(F.array_join(F.sort_array("_tm"), ", ")).alias("teams"),
    )


def missing_product(df: DataFrame) -> DataFrame:
    """P20: rows lacking any product attribute."""
    return df.where(X.any_null(PRODUCT_ATTRS))


def _pick_best(totals: DataFrame) -> DataFrame:
    w = Window.partitionBy("optima_id").orderBy(F.desc("giv_lc"), F.asc_nulls_first("channel"),
                                               F.asc_nulls_first("team"))
    return (totals.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .select("optima_id", F.col("channel").alias("best_channel"), F.col("team").alias("best_team")))


def best_pairs(filled: DataFrame) -> DataFrame:
    """A4 on the limbs of one measure."""
    return _pick_best(X.exact_sums(filled.where(F.col("optima_id").isNotNull()), ["optima_id", "channel", "team"],
                                   ["giv_lc"]))


def with_best_pair(customers: DataFrame, best: DataFrame) -> DataFrame:
    """J3 on the master: each customer takes its optima's best (channel, team); NULL optima -> NULL."""
    out = customers.drop("channel", "team").join(best, "optima_id", "left")
    return out.withColumnsRenamed({"best_channel": "channel", "best_team": "team"})


def assigned_aggregation(filled: DataFrame, assign: Callable[[DataFrame], DataFrame] | None = None,
                         keys: Sequence[str] = tuple(FINAL_GROUP_KEYS), spread: Sequence[str] = ()) -> DataFrame:
    """A4 + J3 + A6 over the joined fact rows, without a table in between.

    Channel and team are a function of the optima after J3.  ``assign`` takes
    the best pairs and returns the fact rows with them (``MergeResult`` puts
    them on the customer master, so no fact row moves for J3); by default the
    best pairs are joined to the A6 groups.  The A4 totals read one measure,
    the A6 groups what their reader takes, so a filter on months or a choice
    of measures reaches the scan of the facts.  ``keys`` are the columns of the
    groups: the same groups may be told apart by ``with_product_key``.

    Few fact rows share a group, and the sums of a group are several times as
    wide as a row: with ``spread``, some of the keys, the rows themselves go
    where their group is summed.
    """
    best = best_pairs(filled)
    if assign is not None:
        rows = assign(best)
        return X.exact_sums(rows.repartition(*spread) if spread else rows, keys, MEASURES)
    a_keys = [k for k in keys if k not in ("channel", "team")]
    out = X.exact_sums(filled, a_keys, MEASURES).join(best, "optima_id", "left")
    return out.select(*[F.col(f"best_{k}").alias(k) if k in ("channel", "team") else F.col(k)
                        for k in keys], *MEASURES)


def product_aggregation(rows: DataFrame, products: DataFrame,
                        keys: Sequence[str] = tuple(FINAL_GROUP_KEYS)) -> DataFrame:
    """J2 + A6 over fact rows that have their customers.

    The rows go to their product, and are summed there.  That is all for
    attributes that the master has once: the totals of a product then take
    them.  Rows of attributes that several master rows share (the same shuffle,
    read again) go on to where the group is summed.
    """
    rows = rows.where(F.col("prod_id").isNotNull()).repartition("prod_id")
    products = products.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*PRODUCT_ATTRS)))
    by_product = X.exact_sums(rows, [*[k for k in keys if k not in PRODUCT_ATTRS], "prod_id"], MEASURES)
    once = merge_products(by_product, products.where(F.col("_rows") == 1))[0]
    shared = merge_products(rows, products.where(F.col("_rows") > 1))[0].repartition(*keys)
    return once.select(*keys, *MEASURES).unionByName(X.exact_sums(shared, keys, MEASURES))


def add_group_labels(df: DataFrame) -> DataFrame:
    """P11, what follows from the keys alone: customer label and quarter."""
    return df.withColumns({
        "customer": F.concat(F.coalesce(F.col("optima_id"), F.lit("nan")), F.lit(" - "),
                             F.coalesce(F.col("optima_name"), F.lit("nan"))),
        "quarter": X.quarter_start(X.month_id_to_date("time_id")),
    })


def add_net_measures(df: DataFrame) -> DataFrame:
    """P11, the rest: NOS/NSRD excluding NIT, month date, fiscal year."""
    return df.withColumns({
        "nos_excl_NIT": F.col("nos_lc") + F.col("nit_lc"),
        "nsrd_excl_nit": F.col("nsrd_total_lc") - F.col("nit_lc"),
        "time_id": X.month_id_to_date("time_id"),
    }).withColumn("fiscal_year", X.fiscal_year("time_id"))


def add_calculated_columns(df: DataFrame) -> DataFrame:
    """Customer label, NOS/NSRD excluding NIT, month date, fiscal year, quarter."""
    return add_net_measures(add_group_labels(df))


def add_category_smo(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Attach category_smo by category (left join; adaptive execution picks the strategy)."""
    d = dictionary.select("corporate_category_name", "category_smo")
    return df.join(d, "corporate_category_name", "left")


def unmapped_categories(df: DataFrame) -> DataFrame:
    """Rows that found no category_smo (they vanish at A7); surfaced as counts."""
    return (df.where(F.col("category_smo").isNull())
              .groupBy("corporate_category_name").agg(F.count(F.lit(1)).alias("n_rows")))


def quarterly_format(df: DataFrame, keys=tuple(S.QUARTER_KEYS)) -> DataFrame:
    """A7 + P12: drop rows with any missing key, sum 9 measures, keys first then A-Z."""
    renamed = df.withColumnsRenamed({k: v for k, v in S.QUARTER_MEASURE_RENAMES.items() if k != v})
    measures = list(S.QUARTER_MEASURE_RENAMES.values())
    keys = list(keys)
    g = X.exact_sums(renamed.where(X.all_not_null(keys)), keys, measures)
    return g.select(*keys, *sorted(measures))


class MergeResult:
    """E2 outputs, each made when it is first read.

    The joined fact rows are written once if ``keep_rows`` says that several
    tables will read them.  Otherwise the tables join the products first: the
    A4 totals then collapse per customer before they move, and the rows that a
    table drops for their product do not meet the customers.  The aggregated
    table joins them last, and sums its rows where they meet.
    """

    def __init__(self, report: DataFrame, customers: DataFrame, products: DataFrame,
                 dictionary: DataFrame, keep_rows: bool = False):
        self._cust_matched, self.customer_unmatched = merge_customers(report, customers)
        self._matched, self.product_unmatched = merge_products(self._cust_matched, products)
        self._dictionary = dictionary
        self._report, self._customers, self._products = report, customers, products
        self._kept = keep_rows
        if keep_rows:
            self._matched = self._rows

    @cached_property
    def _rows(self) -> DataFrame:
        return cut(self._matched)

    @cached_property
    def _filled(self) -> DataFrame:
        return fill_channel_team(merge_customers(merge_products(self._report, self._products)[0], self._customers)[0])

    @cached_property
    def aggregated(self) -> DataFrame:
        if self._kept:
            return assigned_aggregation(fill_channel_team(self._matched))
        customers = with_best_pair(self._customers, best_pairs(self._filled))
        return product_aggregation(merge_customers(self._report, customers)[0], self._products)

    @cached_property
    def enriched(self) -> DataFrame:
        return add_category_smo(add_calculated_columns(self.aggregated), self._dictionary)

    @cached_property
    def quarterly(self) -> DataFrame:
        """A7, not written: what its reader leaves out (quarters, measures) is not aggregated."""
        if self._kept:
            return quarterly_format(self.enriched)
        # J4 on the master: products without category_smo, which A7 drops, do not meet the customers.
        products = add_category_smo(with_product_key(self._products), self._dictionary)
        rows = merge_products(self._report, products)[0]
        slim = assigned_aggregation(self._filled, lambda best: add_group_labels(merge_customers(
            rows, with_best_pair(self._customers, best))[0]), SLIM_GROUP_KEYS, QUARTER_SPREAD)
        return quarterly_format(add_net_measures(slim))

    @cached_property
    def final(self) -> DataFrame:
        """A7 for several readers: it never goes back to the report."""
        return self.quarterly if self._kept else cut(self.quarterly)

    @cached_property
    def assigned(self) -> DataFrame:
        """J3's rows, not written: A4 reads one measure, and what a side table leaves out does not move."""
        if self._kept:
            return assign_best_channel_team(fill_channel_team(self._matched))
        rows = merge_products(self._report, self._products)[0]
        best = best_channel_team(fill_channel_team(merge_customers(rows, self._customers)[0]))
        out = merge_customers(rows, with_best_pair(self._customers, best))[0]
        return out.select("optima_id", *[c for c in self._matched.columns if c != "optima_id"])

    @cached_property
    def missing_channel_team(self) -> DataFrame:
        return missing_channel_team(self._matched)

    @cached_property
    def missing_product(self) -> DataFrame:
        return missing_product(self.assigned)

    @cached_property
    def name_quality_before(self) -> DataFrame:
        return name_quality(self._cust_matched)

    @cached_property
    def name_quality_after(self) -> DataFrame:
        return name_quality(self.assigned)


def data_merge(report: DataFrame, customers: DataFrame, products: DataFrame,
               dictionary: DataFrame, keep_rows: bool = False) -> MergeResult:
    """The whole merge chain with named side outputs."""
    return MergeResult(report, customers, products, dictionary, keep_rows)
