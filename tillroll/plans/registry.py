"""Named queries over the driver tables: ``name -> f(spark, sf_dir) -> DataFrame``.

Each entry derives the retail tables from the given Parquet directory and
runs one report or operator over the whole of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tillroll.ml import basket_value, churn_model, clv
from tillroll.operators import basket, churn, cleaning, kpi, pull, summaries
from tillroll.operators.star import star
from tillroll.plans import maintained
from tillroll.session import checkpoint_dir
from tillroll.sources import fixture, warehouse
from tillroll.sources.csv_extracts import HOUSEHOLDS_FILE, PRODUCTS_FILE, read_extract
from tillroll.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]


def _on_star(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(star(fixture.load(spark, sf_dir)))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _on_tables(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(fixture.load(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _selective(fn) -> Query:
    """For one-household reports: the planner picks the order-join strategy."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(fixture.load(spark, sf_dir, order_join=None))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _on_coded(fn) -> Query:
    """Star whose products carry the dense commodity code, plus the codes."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = fixture.load(spark, sf_dir)
        codes = basket.dense_codes(t.products, "commodity")
        coded = basket.code_commodities(t.products, codes)
        s = star(replace(t, products=coded))
        return fn(s, codes)
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _read_back(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table's raw rows written as CSV, read by name and checked."""
    path = fixture.write_csv_drop(spark, sf_dir, table, f"{checkpoint_dir(spark)}/csv-{table}-{uuid.uuid4().hex}")
    return cleaning.checked(read_extract(spark, path), table)


def _from_csv(table: str) -> Query:
    return lambda spark, sf_dir: cleaning.kept(_read_back(spark, sf_dir, table), table)


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each extract that ingest rejects or keeps with a bad value, by reason."""
    rows = [cleaning.reject_counts(_read_back(spark, sf_dir, t), t) for t in ("households", "products", "transactions")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def delivered_warehouse(spark: SparkSession, sf_dir: str) -> str:
    """A warehouse fed the way deliveries come: a refresh from CSV files, then files of lines through a stream.

    The two halves of the line files have different column orders. The last
    batch is delivered once more, as after a crash before its checkpoint.
    """
    root = f"{checkpoint_dir(spark)}/warehouse-{uuid.uuid4().hex}"
    landing, wh = f"{root}/landing", f"{root}/tables"
    for table, name in (("households", HOUSEHOLDS_FILE), ("products", PRODUCTS_FILE)):
        fixture.write_csv_drop(spark, sf_dir, table, f"{landing}/{name}")
    lines = fixture.write_csv_drop(spark, sf_dir, "transactions", f"{root}/lines")
    warehouse.refresh(spark, landing, wh, lines=f"{lines}/order=0")
    for _ in range(2):                       # the second run finds nothing new
        ingest.stream_into_warehouse(spark, f"{lines}/order=1", wh).awaitTermination()
    last = warehouse.current(spark, wh)[-1]
    if last["kind"] == "append":
        warehouse.append_files(spark, [f"{lines}/order=1"], wh, last["stream"], last["batch"])
    return wh


def streamed_kpi_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI totals over refreshed and streamed lines."""
    return kpi.kpi_totals(star(warehouse.read_current(spark, delivered_warehouse(spark, sf_dir))))


def maintained_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six series, added up from the sums that each delivery left."""
    return maintained.dashboard(spark, delivered_warehouse(spark, sf_dir)).series


def build() -> dict[str, Query]:
    q: dict[str, Query] = {}
    # ingest / cleaning
    q["clean_households"] = lambda s, d: cleaning.clean_households(fixture.households_raw(s, d))
    q["clean_products"] = lambda s, d: cleaning.clean_products(fixture.products_raw(s, d))
    q["clean_transactions"] = lambda s, d: cleaning.clean_transactions(fixture.transactions_raw(s, d))
    q["clean_households_csv"] = _from_csv("households")
    q["clean_products_csv"] = _from_csv("products")
    q["clean_transactions_csv"] = _from_csv("transactions")
    q["ingest_rejects"] = ingest_rejects
    q["star_join"] = _on_tables(star)
    # household pull
    q["data_pull"] = _selective(lambda t: pull.data_pull(t, 10, 100))
    q["data_pull_sql"] = _selective(lambda t: pull.data_pull_sql(t, 10, 100))
    q["data_pull_top20"] = _selective(lambda t: pull.data_pull(t, 10, 20))
    q["data_pull_sorted"] = _selective(
        lambda t: pull.data_pull_sorted(t, 10, 20, sort_by="date", ascending=False))
    # dashboard
    q["kpi_totals"] = _on_star(kpi.kpi_totals)
    q["spend_by_department"] = _on_star(kpi.spend_by_department)
    q["spend_by_week"] = _on_star(kpi.spend_by_week)
    q["spend_by_income"] = _on_star(kpi.spend_by_income)
    q["spend_by_children"] = _on_star(kpi.spend_by_children)
    q["spend_by_brand"] = _on_star(kpi.spend_by_brand)
    q["spend_by_organic"] = _on_star(kpi.spend_by_organic)
    q["spend_by_hh_size"] = _on_star(kpi.spend_by_hh_size)
    q["spend_by_store_region"] = _on_star(kpi.spend_by_store_region)
    q["dashboard_series"] = _on_star(kpi.dashboard_series)
    q["streamed_kpi_totals"] = streamed_kpi_totals
    q["maintained_dashboard"] = maintained_dashboard
    # summaries and churn
    q["household_summary"] = _on_star(summaries.household_summary)
    q["basket_summary"] = _on_star(summaries.basket_summary)
    q["churn_recency"] = _on_star(churn.churn_recency)
    q["churn_counts"] = _on_star(churn.churn_counts)
    q["churn_top"] = _on_star(churn.churn_top)
    # market baskets
    q["basket_items"] = _on_star(basket.basket_items)
    q["pair_counts"] = _on_coded(basket.pair_counts)
    q["frequent_pairs"] = _on_coded(lambda s, c: basket.pair_counts(s, c, min_support=50))
    q["basket_pairs"] = _on_coded(lambda s, c: basket.top_pairs(basket.pair_counts(s, c), 10))
    q["association_rules"] = _on_coded(basket.association_rules)
    q["frequent_itemsets"] = _on_coded(basket.frequent_itemsets)
    # basket value
    q["basket_value_median"] = _on_star(basket_value.basket_value_median)
    q["basket_value_label"] = _on_star(basket_value.basket_value_label)
    q["basket_value_training"] = _on_star(
        lambda s: basket_value.training_frame(basket_value.basket_value_label(s)))
    q["basket_value_gbt"] = _on_star(basket_value.basket_value_gbt)
    q["gbt_first_split"] = _on_star(basket_value.gbt_first_split)
    # lifetime value
    q["clv_features"] = _on_star(clv.clv_features)
    q["clv_predict"] = _on_star(clv.clv_predict)
    q["clv_top"] = _on_star(clv.clv_top)
    q["clv_rf"] = _on_star(clv.clv_rf)
    q["clv_holdout"] = _on_star(clv.clv_holdout)
    q["churn_features"] = _on_star(churn_model.churn_training_frame)
    q["churn_backtest"] = _on_star(churn_model.churn_backtest)
    q["churn_model"] = _on_star(churn_model.churn_model)
    return q
