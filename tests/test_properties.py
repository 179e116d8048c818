"""Property checks: exact arithmetic helpers and pair mining vs brute force."""

import itertools
from collections import Counter
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillroll.functions.rounding import half_even_ratio
from tillroll.operators import basket
from tillroll.operators.star import star
from tillroll.sources import fixture
from tillroll.sources.fixture import RetailTables


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(1, 500)), min_size=50, max_size=50))
def test_half_even_ratio_matches_decimal(spark, pairs):
    df = spark.createDataFrame([(c / 100.0, n) for c, n in pairs], "total double, n long")
    got = [r[0] for r in df.select(half_even_ratio(F.col("total"), F.col("n"))).collect()]
    want = [float((Decimal(c) / Decimal(n) / 100).quantize(Decimal("0.01"), ROUND_HALF_EVEN))
            for c, n in pairs]
    assert got == want


def test_half_even_ties(spark):
    df = spark.createDataFrame([(0.05, 2), (0.15, 2), (0.25, 2), (-0.05, 2)], "t double, n long")
    got = [r[0] for r in df.select(half_even_ratio(F.col("t"), F.col("n"))).collect()]
    assert got == [0.02, 0.08, 0.12, -0.02]


def test_pairs_equal_brute_force(spark):
    t = fixture.load(spark, SF_SMALL)
    coded = basket.code_commodities(t.products)
    s = star(RetailTables(t.households, coded, t.transactions))
    got = {(r[0], r[1]): r[2] for r in basket.pair_counts(s, basket.commodity_codes(coded)).collect()}
    lines = star(t).select("basket_num", "commodity").collect()
    items = {}
    for b, c in lines:
        if c is not None:
            items.setdefault(b, set()).add(c)
    want = Counter()
    for cs in items.values():
        for a, b in itertools.combinations(sorted(cs), 2):
            want[(a, b)] += 1
    assert got == dict(want)
    # item support on the diagonal
    diag = {r["a"]: r["n"] for r in basket.cooccurrence(basket.basket_itemsets(s))
            .where("a = b").collect()}
    codes = {r["cid"]: r["commodity"] for r in basket.commodity_codes(coded).collect()}
    support = Counter(c for cs in items.values() for c in cs)
    assert {codes[k]: v for k, v in diag.items()} == dict(support)


def test_pairs_beyond_one_word(spark):
    """More than 64 commodities: codes spread over several 64-bit words."""
    prod = [(i, "D", f"c{i:03d}", "B", "Y") for i in range(150)]
    hh = [(1, "Y", "A", "M", "I", "H", "C", "2", "1")]
    import datetime as dt
    baskets = {1: [0, 63, 64, 149], 2: [63, 64], 3: [5, 70, 140, 149], 4: list(range(0, 150, 7))}
    tx = [(b, 1, dt.date(2018, 1, 1), p, 1.0, 1.0, "E", 1, 2018) for b, ps in baskets.items() for p in ps]
    from tillroll import schema
    t = RetailTables(spark.createDataFrame(hh, schema.HOUSEHOLDS),
                     spark.createDataFrame(prod, schema.PRODUCTS),
                     spark.createDataFrame(tx, schema.TRANSACTIONS))
    coded = basket.code_commodities(t.products)
    s = star(RetailTables(t.households, coded, t.transactions))
    got = {(r[0], r[1]): r[2] for r in basket.pair_counts(s, basket.commodity_codes(coded)).collect()}
    want = Counter()
    for ps in baskets.values():
        for a, b in itertools.combinations(sorted(f"c{p:03d}" for p in ps), 2):
            want[(a, b)] += 1
    assert got == dict(want)


def test_exact_median_small_and_narrowed(spark):
    import random
    import statistics

    from tillroll.operators.median import exact_median

    rng = random.Random(11)
    cases = [[3.0], [1.0, 2.0], [rng.uniform(-1e6, 1e6) for _ in range(801)], [1e-300, 1.0, 1e300, -1e300, 5.0, 6.0],
             [1.7e308, -1.7e308, 0.0, 2.0, 4.0, 4.0], [7.0] * 300 + [float(i) for i in range(200)]]
    for xs in cases:
        df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double").repartition(5)
        want = statistics.median(xs)
        assert exact_median(df, "x") == pytest.approx(want, rel=1e-12)
        assert exact_median(df, "x", few=3, bins=5) == pytest.approx(want, rel=1e-12)
    assert exact_median(spark.createDataFrame([], "x double"), "x") is None


def test_median_takes_few_jobs_over_the_counts(spark):
    from tillroll.operators.median import exact_median

    df = spark.range(60_000).selectExpr("cast((id * 7919) % 60013 as double) / 100 as x")
    spark.sparkContext.setJobGroup("median", "")
    try:
        value = exact_median(df, "x", few=50)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("median"))
    xs = sorted((i * 7919) % 60013 / 100 for i in range(60_000))
    assert value == pytest.approx((xs[29_999] + xs[30_000]) / 2)
    assert jobs <= 10       # the counts and their checkpoint, range, histogram, bin; AQE runs each shuffle as a job


def test_dense_codes_across_partitions(spark):
    from tillroll.operators.basket import dense_codes
    names = [f"n{i:04d}" for i in range(500)] * 2 + [None]
    df = spark.createDataFrame([(n,) for n in names], "commodity string").repartition(7)
    codes = {r["commodity"]: r["cid"] for r in dense_codes(df, "commodity").collect()}
    assert len(codes) == 500
    assert codes == {n: i for i, n in enumerate(sorted(set(n for n in names if n)))}


def test_min_support_pruning_is_exact(spark):
    t = fixture.load(spark, SF_SMALL)
    coded = basket.code_commodities(t.products)
    s = star(RetailTables(t.households, coded, t.transactions))
    codes = basket.commodity_codes(coded)
    full = {(r[0], r[1]): r[2] for r in basket.pair_counts(s, codes).collect()}
    for k in (2, 3):
        pruned = {(r[0], r[1]): r[2] for r in basket.pair_counts(s, codes, min_support=k).collect()}
        assert pruned == {p: n for p, n in full.items() if n >= k}
