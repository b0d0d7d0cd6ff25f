"""Landing tables derived from the TPC-H-like test tables.

The engine's own inputs are a monthly sales report and two master tables.
The test tables carry no such files, so this adapter derives them with plain
DataFrame expressions (a lineitem x orders join and two master projections),
planting the dirty rows the pipeline has to cope with.  The modulus rules
below are fixed values shared with the DuckDB oracle in ``plans.oracle``.

Fixed values (planted data-quality cases):
  report   cust_id 'Dummy'||key when o_custkey % 41 = 0, key + 1000000000 when % 43 = 0
  report   prod_id key + 1000000000 when l_partkey % 37 = 0
  customer NULL country % 47, NULL channel % 17, NULL team % 19,
           NULL optima % 53, second optima name (' B') % 59,
           a second, sparser master row % 61
  product  second gtin row % 29, NULL brand % 31
  dictionary: sorted category ranks 1-5 -> 'SMO ' || ((rank + 1) div 2); rank 6 unmapped
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import ROW_ORDER


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one test table (the read-only scan plan is reused per session)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def _key_text(k, offset_when=None):
    txt = k.cast("string")
    if offset_when is not None:
        txt = F.when(offset_when, (k + F.lit(1000000000)).cast("string")).otherwise(txt)
    return txt


def report_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sales report lines (raw names) from lineitem joined to orders."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    ck, pk, price = F.col("o_custkey"), F.col("l_partkey"), F.col("l_extendedprice")
    returned = F.col("l_returnflag") == F.lit("R")
    nsrd_total = price * F.col("l_tax")
    sd_total = price * F.col("l_discount")
    vol_nit = F.when(returned, F.lit(1.0)).otherwise(F.lit(0.0))
    return j.select(
        F.date_format("l_shipdate", "yyyyMM").alias("time_id"),
        F.when(ck % 41 == 0, F.concat(F.lit("Dummy"), ck.cast("string")))
         .otherwise(_key_text(ck, ck % 43 == 0)).alias("corp_cust_id"),
        _key_text(pk, pk % 37 == 0).alias("prod_id"),
        (price * (F.lit(1.0) + F.col("l_tax"))).alias("giv_lc"),
        price.alias("gs_lc"),
        F.when(returned, F.lit(-0.01) * price).otherwise(F.lit(0.0)).alias("nit_lc"),
        (price * (F.lit(1.0) - F.col("l_discount"))).alias("nos_lc"),
        (F.lit(0.5) * nsrd_total).alias("nsrd_manual_input_lc"),
        (F.lit(0.3) * nsrd_total).alias("nsrd_sap_lc"),
        (F.lit(0.2) * nsrd_total).alias("nsrd_tie_out_lc"),
        nsrd_total.alias("nsrd_total_lc"),
        (F.lit(0.5) * sd_total).alias("sd_live_rates_lc"),
        (F.lit(0.3) * sd_total).alias("sd_manual_input_lc"),
        sd_total.alias("sd_total_lc"),
        (F.lit(0.2) * sd_total).alias("sd_tpr_lc"),
        F.col("l_quantity").alias("volume_excl_nit_su"),
        vol_nit.alias("volume_nit_su"),
        (F.col("l_quantity") + vol_nit).alias("volume_su"),
    )


def customer_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer master rows (raw names) with a stable file-order column."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    base = (c.join(n, c.c_nationkey == n.n_nationkey, "inner")
             .join(r, n.n_regionkey == r.r_regionkey, "inner"))
    ck = F.col("c_custkey")
    optima = ck - ck % 4
    no_optima = ck % 53 == 0
    null_str = F.lit(None).cast("string")
    first = base.select(
        ck.cast("string").alias("corp_cust_898_lvl_9_id"),
        F.when(ck % 47 == 0, null_str).otherwise(F.upper("n_name")).alias("cust_country_name"),
        F.when(ck % 17 == 0, null_str).otherwise(F.col("c_mktsegment")).alias("la_cust_channel_name"),
        F.lower("c_mktsegment").alias("la_cust_sub_channel_name"),
        F.when(ck % 19 == 0, null_str).otherwise(F.col("r_name")).alias("la_cust_team_name"),
        F.lower("n_name").alias("la_cust_sub_team_name"),
        F.when(no_optima, null_str).otherwise(optima.cast("string"))
         .alias("la_local_cnosgc_reporting_customer_optima_id"),
        F.when(no_optima, null_str).otherwise(
            F.concat(F.lit("Optima "), optima.cast("string"),
                     F.when(ck % 59 == 0, F.lit(" B")).otherwise(F.lit(""))))
         .alias("la_local_cnosgc_reporting_customer_name"),
        (ck * 2).alias(ROW_ORDER),
    )
    second = base.where(ck % 61 == 0).select(
        ck.cast("string").alias("corp_cust_898_lvl_9_id"),
        F.when(ck % 47 == 0, null_str).otherwise(F.upper("n_name")).alias("cust_country_name"),
        null_str.alias("la_cust_channel_name"),
        null_str.alias("la_cust_sub_channel_name"),
        F.lit("Second team").alias("la_cust_team_name"),
        null_str.alias("la_cust_sub_team_name"),
        null_str.alias("la_local_cnosgc_reporting_customer_optima_id"),
        null_str.alias("la_local_cnosgc_reporting_customer_name"),
        (ck * 2 + 1).alias(ROW_ORDER),
    )
    return first.unionByName(second)


def product_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product master rows (raw names); some products carry a second gtin."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    pk = F.col("p_partkey")

    def rows(copy: int, src: DataFrame) -> DataFrame:
        gtin = F.concat(F.lit("G"), pk.cast("string"))
        if copy:
            gtin = F.concat(gtin, F.lit("-2"))
        return src.select(
            pk.cast("string").alias("corporate_fpc"),
            gtin.alias("corporate_item_gtin"),
            F.col("p_name").alias("corporate_product_name"),
            F.when(pk % 31 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand"))
             .alias("corporate_brand_name"),
            F.col("p_type").alias("corporate_category_name"),
            F.concat(F.lit("SS"), (F.col("p_size") % 4).cast("string")).alias("corporate_sub_sector_name"),
            (pk * 2 + copy).alias(ROW_ORDER),
        )

    return rows(0, p).unionByName(rows(1, p.where(pk % 29 == 0)))


def category_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category dictionary derived from the distinct part types.

    The window runs over the distinct categories only (a handful of rows).
    """
    types = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("corporate_category_name")).distinct()
    ranked = types.withColumn("_rank", F.dense_rank().over(Window.orderBy("corporate_category_name")))
    return ranked.where(F.col("_rank") <= 5).select(
        "corporate_category_name",
        F.concat(F.lit("SMO "), ((F.col("_rank") + 1) / 2).cast("int").cast("string")).alias("category_smo"),
    )
