"""Column contracts of the three landing sources and the category dictionary.

Fixed values: the raw column names of the monthly sales report, the
customer master and the product master, and the model vocabulary they are
renamed to.  They must equal the names used by the landing files.
"""

from pyspark.sql import types as T

# --- fixed values: monthly sales report -----------------------------------
REPORT_ID_COLUMNS = ["time_id", "corp_cust_id", "prod_id"]
REPORT_MEASURES = [
    "giv_lc", "gs_lc", "nit_lc", "nos_lc",
    "nsrd_manual_input_lc", "nsrd_sap_lc", "nsrd_tie_out_lc", "nsrd_total_lc",
    "sd_live_rates_lc", "sd_manual_input_lc", "sd_total_lc", "sd_tpr_lc",
    "volume_excl_nit_su", "volume_nit_su", "volume_su",
]
REPORT_RENAMES = {"corp_cust_id": "cust_id"}

# --- fixed values: customer master ----------------------------------------
CUSTOMER_RAW_COLUMNS = [
    "corp_cust_898_lvl_9_id", "cust_country_name",
    "la_cust_channel_name", "la_cust_sub_channel_name",
    "la_cust_team_name", "la_cust_sub_team_name",
    "la_local_cnosgc_reporting_customer_optima_id",
    "la_local_cnosgc_reporting_customer_name",
]
CUSTOMER_KEYS_RAW = ["corp_cust_898_lvl_9_id", "cust_country_name"]
CUSTOMER_RENAMES = {
    "corp_cust_898_lvl_9_id": "cust_id",
    "la_local_cnosgc_reporting_customer_optima_id": "optima_id",
    "la_local_cnosgc_reporting_customer_name": "optima_name",
    "la_cust_channel_name": "channel",
    "la_cust_sub_channel_name": "sub_channel",
    "la_cust_team_name": "team",
    "la_cust_sub_team_name": "sub_team",
}

# --- fixed values: product master -----------------------------------------
PRODUCT_RAW_COLUMNS = [
    "corporate_fpc", "corporate_item_gtin", "corporate_product_name",
    "corporate_brand_name", "corporate_category_name", "corporate_sub_sector_name",
]
PRODUCT_KEYS_RAW = ["corporate_fpc", "corporate_item_gtin"]
PRODUCT_TEXT_COLUMNS = [
    "corporate_product_name", "corporate_brand_name",
    "corporate_category_name", "corporate_sub_sector_name",
]
PRODUCT_RENAMES = {"corporate_fpc": "prod_id"}

# --- fixed values: category dictionary ------------------------------------
DICTIONARY_COLUMNS = ["corporate_category_name", "category_smo"]

# Measures carried from the monthly grain to the fiscal-quarter grain, and
# their names in the model vocabulary.
QUARTER_MEASURE_RENAMES = {
    "gs_lc": "gross_sales",
    "giv_lc": "giv",
    "nos_lc": "nos",
    "nsrd_total_lc": "nsrd",
    "nit_lc": "nit_lc",
    "sd_total_lc": "sd",
    "nos_excl_NIT": "nos_excl_NIT",
    "nsrd_excl_nit": "nsrd_excl_nit",
    "volume_excl_nit_su": "volume_excl_nit_su",
}
QUARTER_KEYS = ["fiscal_year", "quarter", "category_smo", "customer", "channel", "team"]

# Measures the summaries add up.
SUMMARY_MEASURES = ["gross_sales", "giv", "nos", "nsrd", "sd", "nos_excl_NIT",
                    "nsrd_excl_nit", "volume_excl_nit_su"]


def report_schema() -> T.StructType:
    fields = [T.StructField(c, T.StringType()) for c in REPORT_ID_COLUMNS]
    fields += [T.StructField(c, T.DoubleType()) for c in REPORT_MEASURES]
    return T.StructType(fields)


def string_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
