"""Relational-database source for the three curated tables.

The extracts the reference analyses live in SQL tables; this reads them in
parallel: the fact table is split into ``num_partitions`` ranges of its
numeric key (``partitionColumn`` / ``lowerBound`` / ``upperBound``), so each
task pulls one key range over its own connection instead of one connection
streaming the whole table. Filters and column pruning of later operators
are pushed into the generated SELECTs. The bounds come from one
``min``/``max`` query on the source.

Not exercised by the tests: that needs a reachable database, and this
project starts none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.fixture import RetailTables

# Source table names and their lower-case column mapping.
TABLES = {
    "households": ("Households", {
        "HSHD_NUM": "hshd_num", "LOYALTY_FLAG": "loyalty_flag", "AGE_RANGE": "age_range",
        "MARITAL_STATUS": "marital_status", "INCOME_RANGE": "income_range",
        "HOMEOWNER_DESC": "homeowner_desc", "HSHD_COMPOSITION": "hshd_composition",
        "HH_SIZE": "hh_size", "CHILDREN": "children"}),
    "products": ("Products", {
        "PRODUCT_NUM": "product_num", "DEPARTMENT": "department", "COMMODITY": "commodity",
        "BRAND_TY": "brand_ty", "NATURAL_ORGANIC_FLAG": "natural_organic_flag"}),
    "transactions": ("Transactions", {
        "BASKET_NUM": "basket_num", "HSHD_NUM": "hshd_num", "PURCHASE_DATE": "purchase_date",
        "PRODUCT_NUM": "product_num", "SPEND": "spend", "UNITS": "units", "STORE_R": "store_r",
        "WEEK_NUM": "week_num", "YEAR": "year"}),
}


def _read(spark: SparkSession, url: str, table: str, props: dict, split: str | None,
          num_partitions: int) -> DataFrame:
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in props.items():
        reader = reader.option(k, v)
    if split:
        b = (spark.read.format("jdbc").option("url", url)
             .option("query", f"SELECT MIN({split}) AS lo, MAX({split}) AS hi FROM {table}")
             .options(**props).load().first())
        if b is not None and b["lo"] is not None:
            reader = (reader.option("partitionColumn", split)
                      .option("lowerBound", int(b["lo"])).option("upperBound", int(b["hi"]) + 1)
                      .option("numPartitions", num_partitions))
    return reader.load()


def read_tables(spark: SparkSession, url: str, props: dict | None = None,
                num_partitions: int = 64) -> RetailTables:
    props = dict(props or {})
    out = {}
    for key, (table, cols) in TABLES.items():
        split = "BASKET_NUM" if key == "transactions" else None
        df = _read(spark, url, table, props, split, num_partitions)
        out[key] = df.select(*[F.col(src).alias(dst) for src, dst in cols.items()])
    return RetailTables(**out)
