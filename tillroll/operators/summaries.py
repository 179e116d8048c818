"""Household and basket summaries over the star.

``household_rollup`` is the one aggregate behind the household summary, the
CLV features and the churn table (spend, units, distinct baskets, distinct
weeks, last week). Lines are first grouped to (household, basket, week), which
spreads a household holding a third of all lines over many reducers and
keeps the basket partitioning of the order join; the household then counts
its baskets with one distinct aggregate and its weeks, a calendar-bounded
domain, as a set. No line is expanded.

``basket_facts`` keeps everything the insights need of a (household, basket,
week), so that one pass over the star serves the household rollup, the basket
summary and the itemsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.rounding import money_sum


def household_baskets(star: DataFrame) -> DataFrame:
    """(household, basket, week) with its spend and units."""
    return star.groupBy("hshd_num", "basket_num", "week_num").agg(
        money_sum(F.col("spend")).alias("spend"),
        F.sum(F.col("units").cast("double")).alias("units"))


def basket_facts(coded_star: DataFrame) -> DataFrame:
    """(household, basket, week) with its spend, units, lines, commodity codes and departments."""
    return coded_star.groupBy("hshd_num", "basket_num", "week_num").agg(
        money_sum(F.col("spend")).alias("spend"),
        F.sum(F.col("units").cast("double")).alias("units"),
        F.count(F.lit(1)).alias("n_lines"),
        F.collect_set("cid").alias("items"),
        F.collect_set("department").alias("departments"))


def summary_of_facts(facts: DataFrame) -> DataFrame:
    """``basket_summary`` from ``basket_facts``: a basket's parts differ in household or week only, so they are few."""
    def distinct(c: str):
        return F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("bigint")

    return facts.groupBy("basket_num").agg(
        F.sum("n_lines").alias("n_lines"), distinct("items").alias("n_commodity"),
        distinct("departments").alias("n_department"), money_sum(F.col("spend")).alias("basket_spend"))


def itemsets_of_facts(facts: DataFrame) -> DataFrame:
    """(basket_num, items) of baskets with a commodity, from ``basket_facts``."""
    return facts.groupBy("basket_num").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).where(F.size("items") > 0)


def household_rollup(star: DataFrame) -> DataFrame:
    return rollup_of_facts(household_baskets(star))


def rollup_of_facts(facts: DataFrame) -> DataFrame:
    """Household figures from (household, basket, week) rows."""
    return facts.groupBy("hshd_num").agg(
        money_sum(F.col("spend")).alias("total_spend"),
        F.sum("units").alias("total_units"),
        F.count_distinct("basket_num").alias("total_baskets"),
        F.size(F.collect_set("week_num")).cast("bigint").alias("active_weeks"),
        F.max("week_num").alias("last_purchase_week"),
    )


def household_summary(star: DataFrame) -> DataFrame:
    """Households with at least one basket: spend, units, baskets, weeks."""
    return (household_rollup(star)
            .filter(F.col("total_baskets") > 0)
            .select("hshd_num", "total_spend", "total_units", "total_baskets", "active_weeks"))


def basket_summary(star: DataFrame) -> DataFrame:
    """Per basket: lines, distinct commodities/departments, spend.

    A basket's distinct commodities and departments are bounded by the
    product dimension, so they are counted as the size of a set built by a
    partial (map-side) aggregate: one shuffle, no Expand of the lines.
    """
    return star.groupBy("basket_num").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.size(F.collect_set("commodity")).cast("bigint").alias("n_commodity"),
        F.size(F.collect_set("department")).cast("bigint").alias("n_department"),
        money_sum(F.col("spend")).alias("basket_spend"),
    )
