"""Exact median by narrowing.

The values are first reduced to (value, frequency) by a partial aggregate,
so a value held by a third of all rows is one row, and that table is written
once. Then a histogram with a fixed number of equal bins over the range of
the values says which bin holds each middle rank. A bin with few distinct
values is read in order; one with many is the range of the next histogram.
Every step is one job over the count table that sends a bounded number of
rows, and no task orders more than ``few`` values. Two steps are usual;
values spread over all magnitudes of a double need a few more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import materialize


def _values_at(counts: DataFrame, ranks: list[int], before: int = 0) -> list[float]:
    """Values at 1-based ranks of a small (v, f) table that ``before`` rows precede."""
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("upto", F.sum("f").over(w) + before)
    hit = F.lit(False)
    for r in ranks:
        hit = hit | ((F.col("upto") >= r) & (F.col("upto") - F.col("f") < r))
    rows = sorted((x["upto"], x["v"]) for x in upto.where(hit).collect())
    return [next(v for u, v in rows if u >= r) for r in ranks]


def _narrow(counts: DataFrame, ranks: list[int], low: float, high: float, before: int, few: int,
            bins: int) -> list[float]:
    """Values at ranks that lie in [low, high], below which ``before`` rows lie."""
    # halves, since the difference of two doubles may be out of range
    width = (high / 2 - low / 2)
    place = F.least(F.floor((F.col("v") / 2 - F.lit(low / 2)) / F.lit(width) * bins), F.lit(bins - 1))
    inside = counts.where(F.col("v").between(low, high))
    found = sorted(map(tuple, inside.groupBy(place.alias("bin")).agg(
        F.sum("f"), F.count(F.lit(1)), F.min("v"), F.max("v")).collect()))       # at most ``bins`` rows
    out: dict[int, float] = {}
    for _, rows, distinct, first, last in found:
        here = [r for r in ranks if before < r <= before + rows]
        if first == last:
            out |= {r: first for r in here}
        elif here and distinct <= few:
            within = counts.where(F.col("v").between(first, last))
            out |= dict(zip(here, _values_at(within, here, before)))
        elif here:
            out |= dict(zip(here, _narrow(counts, here, first, last, before, few, bins)))
        before += rows
    return [out[r] for r in ranks]


def exact_median(df: DataFrame, col: str, few: int = 100_000, bins: int = 10_000) -> float | None:
    """Interpolated median of ``col`` (NULL and NaN ignored); None when empty."""
    value = F.col(col).cast("double")
    counts = materialize(df.where(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("v"))
                         .agg(F.count(F.lit(1)).alias("f")))
    seen = counts.agg(F.count(F.lit(1)).alias("d"), F.sum("f").alias("n"), F.min("v").alias("low"),
                      F.max("v").alias("high")).first()
    if not seen["d"]:
        return None
    n = seen["n"]
    ranks = sorted({(n + 1) // 2, n // 2 + 1})  # 1-based middle rank(s)
    if seen["d"] <= few:
        vals = _values_at(counts, ranks)
    else:
        vals = _narrow(counts, ranks, seen["low"], seen["high"], 0, few, bins)
    lo, hi = vals[0], vals[-1]
    return lo + (hi - lo) * 0.5
