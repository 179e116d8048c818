"""Driver contract and the composite insights report."""

import __spark_entry__ as entry_module
from tests.conftest import SF_SMALL
from tillroll.plans import reports
from tillroll.sources import fixture


def test_entry_flagship(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["series", "label", "spend", "rank"]
    rows = df.collect()
    assert {r["series"] for r in rows} == {
        "department", "week", "income", "children", "brand", "organic"}


def test_queries_and_oracles_align():
    q, o = entry_module.queries(), entry_module.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 36


def test_insights_report(spark):
    ins = reports.insights(fixture.load(spark, SF_SMALL))
    assert ins.top_clv.count() == 10
    assert ins.basket_pairs.count() == 10
    assert ins.basket_drivers.count() == 3
    c = ins.churn_counts.first()
    assert c["high_risk_count"] + c["low_risk_count"] > 0
    assert ins.churn_top.count() == 10


def test_sql_views(spark):
    from tillroll.plans.views import register_views
    t = fixture.load(spark, SF_SMALL)
    names = register_views(spark, t, prefix="t_")
    assert names == ["t_households", "t_products", "t_transactions", "t_star"]
    n = spark.sql("SELECT count(*) AS n FROM t_star WHERE hshd_num = :h", args={"h": 10}).first()["n"]
    from tillroll.operators.pull import data_pull
    assert n == data_pull(t, 10, 1000).count()


def test_output_columns_unique_and_lower_case(spark):
    # fitted, or run as a whole in tests of their own, which look at their columns
    elsewhere = {"basket_value_gbt", "clv_rf", "churn_model", "streamed_kpi_totals", "maintained_dashboard", "pipeline"}
    for name, fn in entry_module.queries().items():
        if name in elsewhere:
            continue
        cols = fn(spark, SF_SMALL).columns
        assert len(cols) == len(set(cols)), name
        assert all(c == c.lower() and c.strip() == c for c in cols), (name, cols)
