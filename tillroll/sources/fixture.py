"""Retail view of the driver's TPC-H-style tables.

The retail model (households, products, transaction lines) is derived from
``customer``, ``part`` and ``lineitem`` ⋈ ``orders`` ⋈ ``supplier`` ⋈
``nation`` ⋈ ``region``. Every column is one SQL expression, rendered once
for Spark (``selectExpr``) and once for DuckDB (the oracle), so both engines
read the very same mapping. Raw (all-text) renderings carry deliberate
dirt — padding, blanks, missing tokens, a bad key, several date layouts — so
the cleaning step is exercised over whole tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.heavy import can_be_hot, heavy_keys, split_join
from tillroll.session import written

# (output column, expression). ``{S}`` is the text type of the dialect.
HOUSEHOLDS_RAW = (
    ("HSHD_NUM", "case when c_custkey % 97 = 96 then 'bad' else cast(c_custkey as {S}) end"),
    ("L", "case when c_acctbal >= 0 then ' Y ' else 'N' end"),
    ("AGE_RANGE", "concat('AGE_', cast(c_custkey % 7 as {S}))"),
    ("MARITAL", "concat('MAR_', cast(c_custkey % 3 as {S}), ' ')"),
    ("INCOME_RANGE",
     "case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then '   ' "
     "else concat('  ', c_mktsegment, ' ') end"),
    ("HOMEOWNER", "concat('HO_', cast(c_nationkey % 2 as {S}))"),
    ("HSHD_COMPOSITION", "concat('COMP_', cast(c_nationkey % 5 as {S}))"),
    ("HH_SIZE", "cast(1 + c_custkey % 5 as {S})"),
    ("CHILDREN", "case when c_custkey % 4 = 0 then null else cast(c_custkey % 4 as {S}) end"),
)

PRODUCTS = (
    ("product_num", "p_partkey"),
    ("department", "p_type"),
    ("commodity", "p_name"),
    ("brand_ty", "p_brand"),
    ("natural_organic_flag",
     "case when p_size % 10 = 0 then null when p_size % 3 = 0 then 'Y' else 'N' end"),
)

# Raw text rendering of ``part``; the missing flag arrives as the token 'NA'
# and the header is padded, so cleaning must give back ``PRODUCTS``.
PRODUCTS_RAW = (
    (" product_num", "cast(p_partkey as {S})"),
    ("DEPARTMENT ", "p_type"),
    ("Commodity", "p_name"),
    ("BRAND_TY", "p_brand"),
    ("natural_organic_flag",
     "case when p_size % 10 = 0 then 'NA' when p_size % 3 = 0 then 'Y' else 'N' end"),
)

# Week numbers run on across years (1 = the week of 1995-01-01).
_WEEK = {
    "spark": "cast(1 + floor(datediff(o_orderdate, date'1995-01-01') / 7) as int)",
    "duckdb": "cast(1 + floor(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) / 7) as int)",
}

TRANSACTIONS = (
    ("basket_num", "l_orderkey"),
    ("hshd_num", "o_custkey"),
    ("purchase_date", "cast(o_orderdate as date)"),
    ("product_num", "l_partkey"),
    ("spend", "l_extendedprice"),
    ("units", "l_quantity"),
    ("store_r", "r_name"),
    ("week_num", "{WEEK}"),
    ("year", "cast(year(o_orderdate) as int)"),
)

# Date layouts per dialect for the raw rendering of the purchase date.
_DATE_TEXT = {
    "spark": {
        "dmy": "upper(date_format(o_orderdate, 'dd-MMM-yy'))",
        "iso": "date_format(o_orderdate, 'yyyy-MM-dd')",
        "us": "date_format(o_orderdate, 'MM/dd/yyyy')",
    },
    "duckdb": {
        "dmy": "upper(strftime(o_orderdate, '%d-%b-%y'))",
        "iso": "strftime(o_orderdate, '%Y-%m-%d')",
        "us": "strftime(o_orderdate, '%m/%d/%Y')",
    },
}

TRANSACTIONS_RAW = (
    ("BASKET_NUM", "cast(l_orderkey as {S})"),
    (" hshd_num ", "cast(o_custkey as {S})"),
    ("PURCHASE_",
     "case when l_orderkey % 101 = 0 then 'junk' when l_linenumber % 3 = 0 then {DMY} "
     "when l_linenumber % 3 = 1 then {ISO} else {US} end"),
    ("PRODUCT_NUM", "cast(l_partkey as {S})"),
    ("spend", "case when l_orderkey % 89 = 0 then 'NaN' "
              "else cast(cast(l_extendedprice as decimal(12, 2)) as {S}) end"),
    ("UNITS", "cast(l_quantity as {S})"),
    ("STORE_R", "r_name"),
    ("WEEK_NUM", "cast({WEEK} as {S})"),
    ("YEAR", "cast(year(o_orderdate) as {S})"),
)

_TEXT = {"spark": "string", "duckdb": "varchar"}


def render(columns, dialect: str) -> list[str]:
    """``expr AS name`` strings for the given dialect."""
    subs = {"S": _TEXT[dialect], "WEEK": _WEEK[dialect]}
    subs.update({k.upper(): v for k, v in _DATE_TEXT[dialect].items()})
    out = []
    for name, expr in columns:
        text = expr
        for _ in range(2):  # WEEK contains no placeholders; two passes suffice
            text = text.format(**subs) if "{" in text else text
        quoted = f"`{name}`" if dialect == "spark" else f'"{name}"'
        out.append(f"{text} AS {quoted}")
    return out


@dataclass(frozen=True)
class RetailTables:
    """The three curated tables every report reads."""

    households: DataFrame
    products: DataFrame
    transactions: DataFrame
    # keys with a large share of the lines, by column; results don't depend on them
    heavy: dict[str, list] = field(default_factory=dict)
    # rows of a dimension, by table, where they were counted
    rows: dict[str, int] = field(default_factory=dict)


# Schemas of the driver tables (declared, so reads skip schema
# inference; columns the mapping does not use are never read).
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def households_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr(*render(HOUSEHOLDS_RAW, "spark"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(*render(PRODUCTS, "spark"))


def products_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(*render(PRODUCTS_RAW, "spark"))


def _line_source(spark: SparkSession, sf_dir: str, order_join: str | None = "merge") -> DataFrame:
    """lineitem ⋈ orders ⋈ supplier ⋈ (nation → region name).

    orders and supplier grow with the data: each joins as a plain scan so
    the planner's size check sees its real size (broadcast while small,
    sort-merge on the key beyond that; AQE re-plans from runtime sizes).
    nation (25 rows) and region (5 rows) are fixed-size in the TPC-H
    specification, so their pre-joined lookup is broadcast at any scale.

    Lines join orders as a sort-merge join on the order key (the hint only
    fixes what the planner picks anyway once orders outgrows a broadcast).
    Its exchanges are the planner's own. The basket key (= order key) keeps the
    join's hash partitioning through the broadcast dimension joins, so
    per-basket aggregates need no second shuffle. Where the lines are large
    enough for a hot task, a sketch looks for orders with a large share of
    them; if there are any, their lines do not take part in the shuffle
    (``heavy.split_join``), and per-basket aggregates shuffle partial rows.
    An input stored as a few large row groups is still spread over all cores.
    ``order_join=None`` leaves the choice to the planner, for selective
    reports (a one-household pull, whose filtered orders side is small) where
    a broadcast of that side is better.
    """
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = (nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    hot = []
    if order_join and can_be_hot(spark, f"{sf_dir}/lineitem.parquet"):
        hot = heavy_keys(li, ["l_orderkey"])["l_orderkey"]
    return (split_join(li, orders, "l_orderkey", "o_orderkey", hot, order_join)
              .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
              .join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey")))


def transactions(spark: SparkSession, sf_dir: str, order_join: str | None = "merge") -> DataFrame:
    return _line_source(spark, sf_dir, order_join).selectExpr(*render(TRANSACTIONS, "spark"))


def transactions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_source(spark, sf_dir).selectExpr(*render(TRANSACTIONS_RAW, "spark"))


RAW = {"households": households_raw, "products": products_raw, "transactions": transactions_raw}


def write_csv_drop(spark: SparkSession, sf_dir: str, table: str, path: str) -> str:
    """The raw rows of a table as delivered files: CSV with headers, in two column orders.

    One half of the rows has the columns in order, the other in reverse with
    an extra column whose text holds commas and doubled quotes.
    """
    rows = RAW[table](spark, sf_dir)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    half = F.col("_half")
    raw = written(rows.withColumn("_half", F.pmod(F.xxhash64(*columns), F.lit(2))), f"raw-{table}")
    note = F.concat(F.lit('a "note", on '), F.coalesce(columns[0], F.lit("none"))).alias("Note")
    for i, order in enumerate((columns, [note, *reversed(columns)])):
        (raw.where(half == i).select(*order).write.option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/order={i}"))
    return path


def load(spark: SparkSession, sf_dir: str, order_join: str | None = "merge") -> RetailTables:
    """Curated retail tables over the driver tables (households cleaned)."""
    from tillroll.operators.cleaning import clean_households

    return RetailTables(
        households=clean_households(households_raw(spark, sf_dir)),
        products=products(spark, sf_dir),
        transactions=transactions(spark, sf_dir, order_join),
    )


def duckdb_views() -> str:
    """``WITH`` prefix defining the same retail views in DuckDB SQL."""
    def sel(cols):
        return ",\n    ".join(render(cols, "duckdb"))

    hh_raw = f"SELECT {sel(HOUSEHOLDS_RAW)} FROM customer"
    prod = f"SELECT {sel(PRODUCTS)} FROM part"
    prod_raw = f"SELECT {sel(PRODUCTS_RAW)} FROM part"
    src = ("FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
           "JOIN supplier ON l_suppkey = s_suppkey "
           "JOIN nation ON s_nationkey = n_nationkey "
           "JOIN region ON n_regionkey = r_regionkey")
    tx = f"SELECT {sel(TRANSACTIONS)} {src}"
    tx_raw = f"SELECT {sel(TRANSACTIONS_RAW)} {src}"
    return (
        "WITH households_raw AS (" + hh_raw + "),\n"
        "products AS (" + prod + "),\n"
        "products_raw AS (" + prod_raw + "),\n"
        "transactions AS (" + tx + "),\n"
        "transactions_raw AS (" + tx_raw + ")"
    )
