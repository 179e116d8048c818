"""Cleaning expressions for raw text extracts.

Every function maps Column -> Column so the whole cleaning step stays one
projection inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The field texts a default pandas CSV read turns into missing
# values (pandas ``read_csv`` documentation, ``na_values`` defaults). A field
# is missing only when the whole text equals one of them.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Months as text of the purchase date, in order, three letters each.
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
# Fixed value: two-digit years from here on are of the 1900s, below of the 2000s.
PIVOT = "69"

_EDGE_SPACE = r"(?U)^\s+|\s+$"
# Plain decimal numbers: no type suffix, no hexadecimal.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def missing_to_null(c: Column) -> Column:
    """NULL when the raw field is one of the missing-value tokens."""
    return F.when(c.isin(*MISSING_TOKENS), F.lit(None).cast("string")).otherwise(c)


def py_strip(c: Column) -> Column:
    """Strip leading/trailing whitespace of every kind; NULL stays NULL."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def clean_text(c: Column) -> Column:
    """Raw field -> missing tokens to NULL -> stripped text ('' stays '')."""
    return py_strip(missing_to_null(c))


def category(c: Column, width: int = 128) -> Column:
    """Grouping label: text cut to ``width``, blank-trimmed, blank/NULL -> 'Unknown'."""
    cut = F.substring(c.cast("string"), 1, width)
    return F.coalesce(F.nullif(F.trim(cut), F.lit("")), F.lit("Unknown"))


def coerce_key(c: Column) -> Column:
    """Text -> integral key: numeric parse (bad -> NULL), then truncate.

    Whole numbers are read exactly, whatever their length; '10.7' becomes 10
    by way of double; anything else is a bad key. Nearly every cell ends at
    the first cast.
    """
    d = c.try_cast("double")
    return F.coalesce(c.try_cast("bigint"), F.when(c.rlike(_NUMBER) & (F.abs(d) < F.lit(9.2e18)), d.cast("bigint")))


def _double(c: Column) -> Column:
    """Text of a plain number as double, else NULL (the cast alone also takes suffixes, hexadecimal and NaN)."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def to_number(c: Column, target: str = "double") -> Column:
    """Numeric text -> number; bad text, NaN and the missing tokens, none of which is a plain number, -> NULL."""
    if target == "double":
        return _double(c)
    if target == "bigint":
        return coerce_key(c)
    return coerce_key(c).try_cast(target)    # out of range -> NULL


def _plain_date_text(c: Column) -> Column:
    """Date text without edge space, time of day, and with marks between its parts."""
    t = F.when(c.rlike(r"(?U)^\s|\s$"), py_strip(c)).otherwise(c)
    time = r"^(\d{4}-\d{2}-\d{2})[T ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"
    # a text that does not fit the pattern stays as it is
    return F.when(F.length(t) == 19, F.regexp_replace(t, time, "$1")).when(
        F.length(t) == 8, F.regexp_replace(t, r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")).otherwise(t)


def parse_date(c: Column) -> Column:
    """Text -> date (d-MMM-y, M/d/y, yyyy-M-d, yyyy/M/d, yyyyMMdd, ISO with a time); unparseable -> NULL.

    The three parts are put in order and read by one cast. Two-digit years
    follow the common pivot: 69-99 -> 1969-1999, 00-68 -> 2000-2068.
    """
    text = _plain_date_text(c)
    slash = text.contains("/")
    part = F.split(text, F.when(slash, F.lit("/")).otherwise("-"))
    first, second, third = (F.get(part, F.lit(i)) for i in range(3))
    leads = F.length(first) == 4                                  # the year comes first
    at = F.instr(F.lit(MONTHS), F.upper(second))
    name = F.when((F.length(second) == 3) & (at % 3 == 1), F.shiftright((at + 2) * 21846, 16).cast("string"))
    year = F.when(leads, first).otherwise(third)
    month = F.when(leads, second).when(slash, first).otherwise(name)
    day = F.when(leads, third).when(slash, second).otherwise(first)
    year = F.when(F.length(year) == 2, F.concat(F.when(year >= PIVOT, "19").otherwise("20"), year)).otherwise(year)
    plain = F.concat(year, F.lit("-"), month, F.lit("-"), day)
    # the cast alone would also take a sign, a time or a year of another length
    return F.when((F.size(part) == 3) & plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), plain.try_cast("date"))
