"""The maintained dashboard equals the full one after each increment and reads new lines only."""

import os

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillroll.operators import kpi, summaries
from tillroll.operators.star import star
from tillroll.plans import maintained, reports
from tillroll.sources import fixture, warehouse
from tillroll.sources.fixture import RetailTables


def _same(a, b):
    assert sorted(map(str, a.series.collect())) == sorted(map(str, b.series.collect()))
    assert a.totals.collect() == b.totals.collect()


def test_equal_to_the_full_dashboard_after_each_increment(spark, scratch, monkeypatch):
    src = fixture.load(spark, SF_SMALL)
    part = F.pmod(F.xxhash64("basket_num", "product_num"), F.lit(4))      # baskets continue in later parts
    wh = os.path.join(scratch, "wh")
    warehouse.write_version(spark, RetailTables(src.households, src.products, src.transactions.where(part == 0)), wh, version="1")
    read, scanned = warehouse.read_lines, []
    monkeypatch.setattr(warehouse, "read_lines", lambda s, w, live: scanned.append([c["commit"] for c in live]) or read(s, w, live))
    for i in range(4):
        if i:
            warehouse.append_lines(spark, src.transactions.where(part == i), wh, "s", i)
        scanned.clear()
        got = maintained.dashboard(spark, wh)
        assert scanned == [[i + 1]]                      # the lines of the new commit, nothing else
        _same(got, reports.dashboard(warehouse.read_current(spark, wh)))
    assert got.totals.first()["total_transactions"] == src.transactions.join(src.households, "hshd_num").select(
        "basket_num").distinct().count()
    scanned.clear()
    assert maintained.maintain(spark, wh) == [] and scanned == []
    near = maintained.dashboard(spark, wh, exact_baskets=False).totals.first()
    exact = got.totals.first()
    assert abs(near["total_transactions"] - exact["total_transactions"]) <= 0.05 * exact["total_transactions"]
    # a refresh starts anew, with its own dimensions
    fewer = RetailTables(src.households.where("hshd_num % 2 = 0"), src.products, src.transactions)
    warehouse.write_version(spark, fewer, wh, version="2")
    _same(maintained.dashboard(spark, wh), reports.dashboard(fewer))


def test_dashboard_without_lines(spark, scratch):
    src = fixture.load(spark, SF_SMALL)
    none = RetailTables(src.households, src.products, src.transactions.limit(0))
    row = reports.dashboard(none).totals.first()
    assert (row["total_spend"], row["total_transactions"], row["has_data"]) == (0.0, 0, False)
    wh = os.path.join(scratch, "wh")
    warehouse.write_version(spark, none, wh, version="1")
    _same(maintained.dashboard(spark, wh), reports.dashboard(none))


def test_dashboard_sums_equal_separate_queries(spark):
    s = star(fixture.load(spark, SF_SMALL))
    sums = kpi.dashboard_sums(s, baskets=True)
    assert kpi.totals_of(sums).collect() == kpi.kpi_totals(s).collect()
    assert sorted(map(str, kpi.series_of(sums).collect())) == sorted(map(str, kpi.dashboard_series(s).collect()))


def test_basket_facts_give_all_summaries(spark):
    from tillroll.operators import basket

    t = fixture.load(spark, SF_SMALL)
    coded = basket.code_commodities(t.products)
    s = star(RetailTables(t.households, coded, t.transactions))
    facts = summaries.basket_facts(s)
    # a basket over two households and weeks is merged
    facts = facts.withColumn("hshd_num", F.col("hshd_num") % 7)

    def rows(df):
        return sorted(map(str, df.collect()))

    assert rows(summaries.summary_of_facts(facts)) == rows(summaries.basket_summary(s))
    assert rows(summaries.rollup_of_facts(summaries.basket_facts(s))) == rows(summaries.household_rollup(s))
    a = {r["basket_num"]: set(r["items"]) for r in summaries.itemsets_of_facts(facts).collect()}
    assert a == {r["basket_num"]: set(r["items"]) for r in basket.basket_itemsets(s).collect()}
