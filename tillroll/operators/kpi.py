"""Dashboard aggregates: KPI totals and the six spend rankings.

Each ranking is ``groupBy -> sum -> top-N`` (Spark plans a partial
aggregate before the shuffle and a TakeOrderedAndProject at the end). The
``dashboard_sums`` report computes all six in a single pass over the star
with GROUPING SETS instead of re-running the join per series, and on request
the distinct baskets in the same pass, as one more grouping set. Its sums
are whole cents, so those of several parts of the lines add up to those of
the whole (``plans.maintained``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.cleaning import category
from tillroll.functions.rounding import cents, money_sum

# The six dashboard series, their grouping label and how many
# top groups each shows (None = all groups, in key order).
SERIES = (
    # name, source column, label width for the 'Unknown' normaliser, top-N
    ("department", "department", None, 5),
    ("week", "week_num", None, None),
    ("income", "income_range", 256, 12),
    ("children", "children", 128, 10),
    ("brand", "brand_ty", 128, 14),
    ("organic", "natural_organic_flag", 128, 8),
)


def _sum_spend() -> Column:
    return money_sum(F.col("spend"))


def kpi_totals(star: DataFrame, approx_baskets: bool = False) -> DataFrame:
    """One row: total spend (0 when empty), distinct baskets, has-data flag,
    and the spend as display text ('3,159,237,275.87').

    ``approx_baskets`` swaps the exact distinct count (a shuffle of the
    distinct basket keys) for a HyperLogLog++ sketch merged from per-task
    partial sketches (~1% relative error, no key shuffle).
    """
    baskets = (F.approx_count_distinct("basket_num", 0.01) if approx_baskets
               else F.count_distinct("basket_num"))
    return _totals(star.agg(F.coalesce(_sum_spend(), F.lit(0.0)).alias("total_spend"),
                            baskets.alias("total_transactions")))


def _totals(agg: DataFrame) -> DataFrame:
    return agg.select(
        "total_spend", "total_transactions",
        ((F.col("total_transactions") > 0) | (F.col("total_spend") > 0)).alias("has_data"),
        F.format_number("total_spend", 2).alias("total_spend_text"),
    )


def spend_by(star: DataFrame, key: Column, name: str, n: int | None) -> DataFrame:
    """Top-``n`` groups of ``key`` by spend (ties by label, NULL label first)."""
    agg = star.groupBy(key.alias(name)).agg(_sum_spend().alias("spend"))
    if n is None:
        return agg.orderBy(F.col(name).asc_nulls_first())
    return agg.orderBy(F.col("spend").desc(), F.col(name).asc_nulls_first()).limit(n)


def spend_by_department(star: DataFrame, n: int = 5) -> DataFrame:
    return spend_by(star, F.col("department"), "department", n)


def spend_by_week(star: DataFrame) -> DataFrame:
    return spend_by(star, F.col("week_num"), "week_num", None)


def spend_by_income(star: DataFrame, n: int = 12) -> DataFrame:
    return spend_by(star, category(F.col("income_range"), 256), "cat", n)


def spend_by_children(star: DataFrame, n: int = 10) -> DataFrame:
    return spend_by(star, category(F.col("children"), 128), "cat", n)


def spend_by_brand(star: DataFrame, n: int = 14) -> DataFrame:
    return spend_by(star, category(F.col("brand_ty"), 128), "cat", n)


def spend_by_organic(star: DataFrame, n: int = 8) -> DataFrame:
    return spend_by(star, category(F.col("natural_organic_flag"), 128), "cat", n)


def spend_by_hh_size(star: DataFrame, n: int | None = None) -> DataFrame:
    """Extension: spend per household-size band (all bands by default)."""
    return spend_by(star, category(F.col("hh_size"), 128), "cat", n)


def spend_by_store_region(star: DataFrame, n: int | None = None) -> DataFrame:
    """Extension: spend per store region (all regions by default)."""
    return spend_by(star, category(F.col("store_r"), 128), "cat", n)


BASKETS = "baskets"


def dashboard_sums(star: DataFrame, baskets: bool = False) -> DataFrame:
    """(series, label, week_num, cents, n): spend of every label of the six series, in one pass.

    GROUPING SETS expands each line once per set inside the scan stage, the
    partial aggregate collapses it to at most the number of labels per task,
    and only those partial rows cross the shuffle. With ``baskets`` a seventh
    set has a group per basket, which a second aggregate turns into one row:
    n is then the number of distinct baskets.
    """
    names = [name for name, *_ in SERIES]
    keys = [(F.col(src) if width is None else category(F.col(src), width)).alias(f"k_{name}")
            for name, src, width, _ in SERIES]
    if baskets:
        names.append(BASKETS)
        keys.append(F.col("basket_num").alias(f"k_{BASKETS}"))
    base = star.select(*keys, cents(F.col("spend")).alias("cents"))
    agg = base.groupingSets([[f"k_{n}"] for n in names], *[f"k_{n}" for n in names]).agg(
        F.sum("cents").alias("cents"), *[F.grouping(f"k_{n}").alias(f"g_{n}") for n in names])
    series, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(names):
        hit = F.col(f"g_{name}") == 0
        series = F.when(hit, F.lit(name)).otherwise(series)
        if name != BASKETS:
            label = F.when(hit, F.col(f"k_{name}").cast("string")).otherwise(label)
    if not baskets:
        return agg.select(series.alias("series"), label.alias("label"), F.col("k_week").alias("week_num"), "cents",
                          F.lit(None).cast("bigint").alias("n"))
    long = agg.select(series.alias("series"), label.alias("label"), F.col("k_week").alias("week_num"), "cents",
                      F.col(f"k_{BASKETS}").isNotNull().alias("counts"))
    return long.groupBy("series", "label", "week_num").agg(
        F.sum("cents").alias("cents"), F.count_if("counts").alias("n"))


def series_of(sums: DataFrame) -> DataFrame:
    """The dashboard's series from ``dashboard_sums`` (of all lines, or added up from parts)."""
    spend = F.col("cents") / F.lit(100.0)
    w = Window.partitionBy("series").orderBy(
        F.when(F.col("series") == "week", F.col("week_num")).asc_nulls_first(),
        F.col("spend").desc(), F.col("label").asc_nulls_first())
    ranked = (sums.where(F.col("series") != BASKETS)
              .select("series", "label", "week_num", spend.alias("spend")).withColumn("rank", F.row_number().over(w)))
    limits = F.lit(None).cast("int")
    for name, _, _, n in SERIES:
        if n is not None:
            limits = F.when(F.col("series") == name, F.lit(n)).otherwise(limits)
    keep = limits.isNull() | (F.col("rank") <= limits)
    return ranked.filter(keep).select("series", "label", "spend", "rank")


def totals_of(sums: DataFrame) -> DataFrame:
    """The KPI row from ``dashboard_sums`` with baskets."""
    of = F.col("series") == BASKETS
    return _totals(sums.agg(F.coalesce(F.sum(F.when(of, F.col("cents"))) / F.lit(100.0), F.lit(0.0)).alias("total_spend"),
                            F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)).alias("total_transactions")))


def dashboard_series(star: DataFrame) -> DataFrame:
    """All six series in one aggregate pass, long format.

    Columns: series, label (text; the department label may be NULL), spend,
    rank (1 = first bar).
    """
    return series_of(dashboard_sums(star))
