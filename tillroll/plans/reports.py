"""The three reports a retail analyst opens, as plans over the curated tables.

* ``household_report`` - the line pull of one household, re-sorted.
* ``dashboard`` - KPI row + the six spend series (one grouping-sets pass).
* ``insights`` - CLV top list, basket pairs, basket-value drivers, churn.

Each value is a DataFrame (lazy) except where a model must be fitted first.
Shared inputs are computed once. The dashboard's sums and distinct baskets
are one pass over the star, written as a small table that its two outputs
read. The insights need three things of the star, all of which the
(household, basket, week) table holds; it is written once, and the household
rollup, the basket summary and the itemsets come from it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.ml import basket_value, clv
from tillroll.operators import basket, churn, kpi, pull, summaries
from tillroll.operators.star import star
from tillroll.session import materialize
from tillroll.sources.fixture import RetailTables


@dataclass
class Dashboard:
    totals: DataFrame
    series: DataFrame


@dataclass
class Insights:
    top_clv: DataFrame
    basket_pairs: DataFrame
    basket_drivers: DataFrame
    churn_counts: DataFrame
    churn_top: DataFrame


def household_report(t: RetailTables, hshd_num: int = 10, n: int = 100,
                     sort_by: str = "hshd_num", ascending: bool = True) -> DataFrame:
    return pull.data_pull_sorted(t, hshd_num, n, sort_by, ascending)


def dashboard(t: RetailTables) -> Dashboard:
    sums = materialize(kpi.dashboard_sums(star(t), baskets=True))
    return Dashboard(totals=kpi.totals_of(sums), series=kpi.series_of(sums))


def insights(t: RetailTables, top: int = 10) -> Insights:
    codes = basket.dense_codes(t.products, "commodity")
    coded = basket.code_commodities(t.products, codes)
    s = star(replace(t, products=coded))
    facts = materialize(summaries.basket_facts(s))
    rollup = materialize(summaries.rollup_of_facts(facts))
    summary = materialize(summaries.summary_of_facts(facts))
    itemsets = materialize(summaries.itemsets_of_facts(facts))
    recency = churn.churn_recency(s, rollup=rollup)
    counts = recency.agg(
        F.count_if(F.col("churn_risk") == "High Risk").alias("high_risk_count"),
        F.count_if(F.col("churn_risk") == "Low Risk").alias("low_risk_count"))
    longest = recency.orderBy(F.col("weeks_since_last_purchase").desc_nulls_last(),
                              F.col("hshd_num").asc()).limit(top)
    return Insights(
        top_clv=clv.clv_top(s, top, rollup=rollup),
        basket_pairs=basket.top_pairs(basket.pairs_of(itemsets, codes), top),
        basket_drivers=basket_value.basket_value_gbt(s, summary=summary),
        churn_counts=counts,
        churn_top=longest,
    )
