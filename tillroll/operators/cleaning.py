"""Typed cleaning of the raw extracts (one projection per table).

Households: header normalised, ``L`` -> loyalty flag, key coerced to an
integer (unparseable keys dropped, '10.7' -> 10), every text field
null-preserving stripped (a blank field becomes '' and stays distinct from
NULL). Products and transactions: missing tokens -> NULL, no stripping,
numbers parsed leniently, purchase date parsed from several layouts.

``checked`` cleans and says of each raw row what is wrong with it: a record
that does not fit its header or a household without a usable key is not kept;
a line or product with a bad key, or a date in no known layout, is kept with
a NULL there, as before, but no longer unnoticed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import schema
from tillroll.functions.cleaning import (
    MISSING_TOKENS,
    clean_text,
    coerce_key,
    missing_to_null,
    parse_date,
    to_number,
)


def normalise_header(df: DataFrame) -> DataFrame:
    """Header names stripped and upper-cased (a metadata-only rename)."""
    return df.toDF(*[c.strip().upper() for c in df.columns])


def _columns(raw: DataFrame, needed, renames=None) -> dict[str, Column]:
    """Raw columns keyed by their normalised header (strip + upper + rename).

    Resolving names once in Python keeps the cleaning a single projection
    over the raw scan (no intermediate rename steps to analyse).
    """
    renames = renames or {}
    cols = {}
    for c in raw.columns:
        key = c.strip().upper()
        cols[renames.get(key, key)] = F.col("`" + c.replace("`", "``") + "`")
    missing = [c for c in needed if renames.get(c, c) not in cols]
    if missing:
        raise ValueError(f"raw extract lacks columns {missing}; has {raw.columns}")
    return cols


def _households(raw: DataFrame) -> list[Column]:
    c = _columns(raw, schema.RAW_HOUSEHOLD_COLUMNS, {"L": "LOYALTY_FLAG"})
    return [
        coerce_key(c["HSHD_NUM"]).alias("hshd_num"),
        clean_text(c["LOYALTY_FLAG"]).alias("loyalty_flag"),
        clean_text(c["AGE_RANGE"]).alias("age_range"),
        clean_text(c["MARITAL"]).alias("marital_status"),
        clean_text(c["INCOME_RANGE"]).alias("income_range"),
        clean_text(c["HOMEOWNER"]).alias("homeowner_desc"),
        clean_text(c["HSHD_COMPOSITION"]).alias("hshd_composition"),
        clean_text(c["HH_SIZE"]).alias("hh_size"),
        clean_text(c["CHILDREN"]).alias("children"),
    ]


def clean_households(raw: DataFrame) -> DataFrame:
    return raw.select(*_households(raw)).filter(F.col("hshd_num").isNotNull())


def _long(c: Column) -> Column:
    return to_number(c, "bigint")


def _int(c: Column) -> Column:
    return to_number(c, "int")


def _products(raw: DataFrame) -> list[Column]:
    c = _columns(raw, schema.RAW_PRODUCT_COLUMNS)
    return [
        _long(c["PRODUCT_NUM"]).alias("product_num"),
        missing_to_null(c["DEPARTMENT"]).alias("department"),
        missing_to_null(c["COMMODITY"]).alias("commodity"),
        missing_to_null(c["BRAND_TY"]).alias("brand_ty"),
        missing_to_null(c["NATURAL_ORGANIC_FLAG"]).alias("natural_organic_flag"),
    ]


def clean_products(raw: DataFrame) -> DataFrame:
    return raw.select(*_products(raw))


def _transactions(raw: DataFrame) -> list[Column]:
    c = _columns(raw, schema.RAW_TRANSACTION_COLUMNS, {"PURCHASE_": "PURCHASE_DATE"})
    return [
        _long(c["BASKET_NUM"]).alias("basket_num"),
        _long(c["HSHD_NUM"]).alias("hshd_num"),
        parse_date(c["PURCHASE_DATE"]).alias("purchase_date"),
        _long(c["PRODUCT_NUM"]).alias("product_num"),
        to_number(c["SPEND"]).alias("spend"),
        to_number(c["UNITS"]).alias("units"),
        missing_to_null(c["STORE_R"]).alias("store_r"),
        _int(c["WEEK_NUM"]).alias("week_num"),
        _int(c["YEAR"]).alias("year"),
    ]


def clean_transactions(raw: DataFrame) -> DataFrame:
    return raw.select(*_transactions(raw))


# What may be wrong with a raw row, most serious first.
REASONS = ("malformed", "bad_key", "bad_date")
_PARSED = {"households": _households, "products": _products, "transactions": _transactions}
_CURATED = {"households": schema.HOUSEHOLDS, "products": schema.PRODUCTS, "transactions": schema.TRANSACTIONS}
_KEYS = {"households": {"HSHD_NUM": "hshd_num"}, "products": {"PRODUCT_NUM": "product_num"},
         "transactions": {"BASKET_NUM": "basket_num", "HSHD_NUM": "hshd_num", "PRODUCT_NUM": "product_num"}}


def checked(raw: DataFrame, table: str) -> DataFrame:
    """Curated columns of every raw row, with kept_, reason_ (NULL when all is well), record_ (NULL without a reason) and file_.

    ``raw`` comes from ``read_extract``. Each value is parsed once; whether
    it is bad shows from the parsed value beside its text. The JIT leaves
    methods of more than 8,000 bytes alone and the parsing of a line is close
    to that, so what only a bad row needs stays out of it: the texts of its
    keys are looked at by a lambda, and no other row's record is written.
    """
    named = _columns(raw, [])
    texts = {k: f"r_{k}" for k in named if not k.startswith("_")}
    text = {k: F.col("`" + t.replace("`", "``") + "`") for k, t in texts.items()}
    parsed = raw.select(*_PARSED[table](raw), *[named[k].alias(t) for k, t in texts.items()],
                        F.col("_malformed").alias("malformed_"), F.col("_file").alias("file_"))
    whole = F.col("malformed_").isNull()
    no_key = reduce(or_, [F.col(column).isNull() for column in _KEYS[table].values()])
    # an empty household key is as useless as a bad one; elsewhere a missing key is just missing
    bad_key = no_key if table == "households" else no_key & F.exists(
        F.array(*[F.when(F.col(column).isNull(), text[k]) for k, column in _KEYS[table].items()]), _given)
    bad_date = F.lit(False)
    if table == "transactions":
        date = text["PURCHASE_" if "PURCHASE_" in text else "PURCHASE_DATE"]
        bad_date = F.col("purchase_date").isNull() & _given(F.trim(date))
    reason = F.when(~whole, "malformed").when(bad_key, "bad_key").when(bad_date, "bad_date")
    kept = whole & (F.col("hshd_num").isNotNull() if table == "households" else F.lit(True))
    record = F.coalesce("malformed_", F.to_json(F.struct(*[c.alias(k) for k, c in text.items()])))
    return parsed.withColumns({"kept_": kept, "reason_": reason}).select(
        *_CURATED[table].fieldNames(), "kept_", "reason_", F.when(F.col("reason_").isNotNull(), record).alias("record_"),
        "file_")


def _given(text: Column) -> Column:
    """Whether there is a text and it is none of the missing tokens."""
    return ~F.coalesce(text.isin(*MISSING_TOKENS), F.lit(True))


def kept(rows: DataFrame, table: str) -> DataFrame:
    """The curated table of checked rows."""
    return rows.where("kept_").select(*_CURATED[table].fieldNames())


def rejected(rows: DataFrame, table: str) -> DataFrame:
    """What was wrong, by row: table, reason, whether the row was kept, its file and its text."""
    return rows.where("reason_ is not null").select(
        F.lit(table).alias("source"), F.col("reason_").alias("reason"), F.col("kept_").alias("kept"),
        F.col("file_").alias("file"), F.col("record_").alias("record"))


def reject_counts(rows: DataFrame, table: str) -> DataFrame:
    """``rejected`` by source, reason and whether kept, with the number of rows.

    Counted before the rows without a reason go: a filter on the reason
    would be pushed below the parsing and parse each value again, in code
    too large to compile.
    """
    counts = rows.groupBy(F.col("reason_").alias("reason"), F.col("kept_").alias("kept")).agg(
        F.count("reason_").alias("n_rows")).where("n_rows > 0")
    return counts.select(F.lit(table).alias("source"), "reason", "kept", "n_rows")
