"""Column expressions shared by the operators (all JVM-side, no UDFs)."""

from tillroll.functions.cleaning import (
    MISSING_TOKENS,
    category,
    coerce_key,
    missing_to_null,
    parse_date,
    py_strip,
)
from tillroll.functions.rounding import half_even_ratio, money_sum

__all__ = [
    "MISSING_TOKENS",
    "category",
    "coerce_key",
    "half_even_ratio",
    "missing_to_null",
    "money_sum",
    "parse_date",
    "py_strip",
]
