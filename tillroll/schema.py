"""Schemas of the raw extracts and of the curated retail tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns that the extracts deliver. They are read as text only; typing happens in the cleaning step.
RAW_HOUSEHOLD_COLUMNS = (
    "HSHD_NUM", "L", "AGE_RANGE", "MARITAL", "INCOME_RANGE",
    "HOMEOWNER", "HSHD_COMPOSITION", "HH_SIZE", "CHILDREN",
)
RAW_PRODUCT_COLUMNS = (
    "PRODUCT_NUM", "DEPARTMENT", "COMMODITY", "BRAND_TY", "NATURAL_ORGANIC_FLAG",
)
RAW_TRANSACTION_COLUMNS = (
    "BASKET_NUM", "HSHD_NUM", "PURCHASE_", "PRODUCT_NUM", "SPEND",
    "UNITS", "STORE_R", "WEEK_NUM", "YEAR",
)

# Names and types of the curated tables.
HOUSEHOLDS = T.StructType([
    T.StructField("hshd_num", T.LongType(), False),
    T.StructField("loyalty_flag", T.StringType()),
    T.StructField("age_range", T.StringType()),
    T.StructField("marital_status", T.StringType()),
    T.StructField("income_range", T.StringType()),
    T.StructField("homeowner_desc", T.StringType()),
    T.StructField("hshd_composition", T.StringType()),
    T.StructField("hh_size", T.StringType()),
    T.StructField("children", T.StringType()),
])

PRODUCTS = T.StructType([
    T.StructField("product_num", T.LongType()),
    T.StructField("department", T.StringType()),
    T.StructField("commodity", T.StringType()),
    T.StructField("brand_ty", T.StringType()),
    T.StructField("natural_organic_flag", T.StringType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("basket_num", T.LongType()),
    T.StructField("hshd_num", T.LongType()),
    T.StructField("purchase_date", T.DateType()),
    T.StructField("product_num", T.LongType()),
    T.StructField("spend", T.DoubleType()),
    T.StructField("units", T.DoubleType()),
    T.StructField("store_r", T.StringType()),
    T.StructField("week_num", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
])


def raw_schema(columns) -> T.StructType:
    """All-text schema for a raw extract with the given header."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
