"""Household line pull: one household's lines with product and household
attributes, first ``n`` by a fixed 6-key order, optionally re-sorted.

The household filter is applied to the fact side; Catalyst carries it
across the equi-join to the household scan and pushes both into Parquet.
For curated tables written sorted by ``hshd_num`` the scan then skips every
row group whose key range excludes the household.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.star import star
from tillroll.sources.fixture import RetailTables

# Output columns of the pull, in order, with their sources.
PULL_COLUMNS = (
    ("hshd_num", "hshd_num"),
    ("basket_num", "basket_num"),
    ("date", "purchase_date"),
    ("product_num", "product_num"),
    ("department", "department"),
    ("commodity", "commodity"),
    ("spend", "spend"),
    ("units", "units"),
    ("store_region", "store_r"),
    ("week_num", "week_num"),
    ("year", "year"),
    ("loyalty_flag", "loyalty_flag"),
    ("age_range", "age_range"),
    ("marital_status", "marital_status"),
    ("income_range", "income_range"),
    ("homeowner_desc", "homeowner_desc"),
    ("hshd_composition", "hshd_composition"),
    ("hshd_size", "hh_size"),
    ("children", "children"),
)

# Keys a pull may be re-sorted by; anything else -> hshd_num.
SORT_KEYS = ("hshd_num", "basket_num", "date", "product_num", "department", "commodity")

# The 6-key order is not unique on real lines; these break the remaining ties.
_TIEBREAK = ("spend", "units", "store_region")


def data_pull(t: RetailTables, hshd_num: int = 10, n: int = 100) -> DataFrame:
    hid = int(hshd_num)
    lines = t.transactions.filter(F.col("hshd_num") == F.lit(hid))
    joined = lines.join(t.households, "hshd_num").join(t.products, "product_num")
    out = joined.select(*[F.col(src).alias(name) for name, src in PULL_COLUMNS])
    order = [F.col(k).asc_nulls_first() for k in SORT_KEYS + _TIEBREAK]
    return out.orderBy(*order).limit(int(n))


def data_pull_sql(t: RetailTables, hshd_num: int = 10, n: int = 100) -> DataFrame:
    """``data_pull`` as parameterised Spark SQL over the star (same rows)."""
    columns = ", ".join(f"{source} AS {name}" for name, source in PULL_COLUMNS)
    keys = ", ".join(f"{k} ASC NULLS FIRST" for k in SORT_KEYS + _TIEBREAK)
    statement = f"SELECT {columns} FROM {{lines}} WHERE hshd_num = :household ORDER BY {keys} LIMIT :rows"
    return t.transactions.sparkSession.sql(
        statement, args={"household": int(hshd_num), "rows": int(n)}, lines=star(t))


def data_pull_sorted(t: RetailTables, hshd_num: int = 10, n: int = 100,
                     sort_by: str = "hshd_num", ascending: bool = True) -> DataFrame:
    """The first ``n`` lines (6-key order), then re-sorted by one key.

    The limit is taken before the re-sort, so this is *not* the top ``n`` by
    ``sort_by``. NULLs go last in both directions.
    """
    key = sort_by if sort_by in SORT_KEYS else "hshd_num"
    c = F.col(key)
    first = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    rest = [F.col(k).asc_nulls_first() for k in SORT_KEYS + _TIEBREAK if k != key]
    return data_pull(t, hshd_num, n).orderBy(first, *rest)
