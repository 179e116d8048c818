"""Known results on the sf0.01 fixture (FIXTURES.md §5), independent of the oracle SQL."""

import pytest

from tillroll.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def q():
    return registry.build()


def test_golden_values(spark, q):
    assert q["clean_households"](spark, SF).count() == 1485
    k = q["kpi_totals"](spark, SF).first()
    assert k["total_spend"] == 3159237275.87
    assert k["total_transactions"] == 14619
    assert k["total_spend_text"] == "3,159,237,275.87"
    dept = q["spend_by_department"](spark, SF).collect()
    assert (dept[0]["department"], dept[0]["spend"]) == ("MEDIUM", 554117120.45)
    assert (dept[1]["department"], dept[1]["spend"]) == ("STANDARD", 541820924.95)
    assert q["spend_by_week"](spark, SF).count() == 344
    assert q["spend_by_income"](spark, SF).count() == 6
    assert q["spend_by_children"](spark, SF).count() == 4
    assert q["spend_by_organic"](spark, SF).count() == 3
    top = q["basket_pairs"](spark, SF).first()
    assert {top["item_1"], top["item_2"]} == {"hot ring", "red plate"}
    assert top["times_bought_together"] == 118
    assert q["pair_counts"](spark, SF).count() == 2016
    c = q["churn_counts"](spark, SF).first()
    assert (c["high_risk_count"], c["low_risk_count"]) == (1199, 286)
    assert q["basket_value_median"](spark, SF).first()["median_basket_spend"] == 200558.9
    assert q["data_pull"](spark, SF).count() == 28
