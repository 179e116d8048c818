"""Purchase-recency churn rule.

weeks_since_last_purchase = (latest week in the data) - (household's last
week); 'High Risk' when it is 8 or more, else 'Low Risk' (also when
unknown). The household rollup is materialised once (one row per
household); the latest week is a scalar subquery over it, which Spark runs
as its own one-row job and inlines, so there is no join and no second pass
over the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.summaries import household_rollup
from tillroll.session import materialize

# Fixed value: weeks without a purchase from which a household is at risk.
HIGH_RISK_WEEKS = 8


def churn_recency(star: DataFrame, threshold: int = HIGH_RISK_WEEKS,
                  rollup: DataFrame | None = None) -> DataFrame:
    rollup = rollup if rollup is not None else materialize(household_rollup(star))
    latest = rollup.agg(F.max("last_purchase_week")).scalar()
    gap = F.col("weeks_since_last_purchase")
    return rollup.select(
        "hshd_num", "last_purchase_week", "total_spend", "total_baskets",
        (latest - F.col("last_purchase_week")).cast("int").alias("weeks_since_last_purchase"),
    ).withColumn(
        "churn_risk", F.when(gap >= threshold, F.lit("High Risk")).otherwise(F.lit("Low Risk")))


def churn_counts(star: DataFrame, threshold: int = HIGH_RISK_WEEKS) -> DataFrame:
    """One row: number of High Risk and Low Risk households."""
    r = churn_recency(star, threshold)
    return r.agg(
        F.count_if(F.col("churn_risk") == "High Risk").alias("high_risk_count"),
        F.count_if(F.col("churn_risk") == "Low Risk").alias("low_risk_count"),
    )


def churn_top(star: DataFrame, n: int = 10, threshold: int = HIGH_RISK_WEEKS) -> DataFrame:
    """Households longest without a purchase (all households, not only High Risk)."""
    r = churn_recency(star, threshold)
    return r.orderBy(F.col("weeks_since_last_purchase").desc_nulls_last(),
                     F.col("hshd_num").asc()).limit(n)
