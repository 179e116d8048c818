"""Money arithmetic with the rounding the reports promise.

Sums of doubles depend on the order of addition, so money is summed in whole
cents as 64-bit integers: exact and the same under every partitioning up to
9.2e16 currency units, and an overflow is an error. Averages are rounded
half-to-even in integer cents (no binary-fraction ties).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Cents beyond this do not fit in 64 bits.
_MOST = 9.2e18


def cents(amount: Column) -> Column:
    """Amount in whole cents; NULL for NULL and non-finite amounts, an error for one out of range."""
    c = F.round(amount.cast("double") * 100)
    return F.when(F.abs(c) < _MOST, c.cast("bigint")).when(
        F.abs(c) < float("inf"), F.raise_error(F.concat(F.lit("amount out of range: "), amount.cast("string"))).cast("bigint"))


def money_sum(amount: Column) -> Column:
    """Exact sum of amounts, each rounded to cents (output type double).

    NULL and non-finite amounts do not count; NULL when nothing counts.
    """
    return F.sum(cents(amount)) / F.lit(100.0)


def half_even_ratio(total: Column, n: Column) -> Column:
    """round_half_even(total / n, 2) computed exactly in integer cents.

    ``total`` is an amount in currency units, ``n`` a positive count.
    """
    cents = F.round(total * 100).cast("bigint")
    r = F.pmod(cents, n)
    q = ((cents - r) / n).cast("bigint")
    bump = (2 * r > n) | ((2 * r == n) & (q % 2 != 0))
    return ((q + F.when(bump, 1).otherwise(0)) / F.lit(100.0)).cast("double")
