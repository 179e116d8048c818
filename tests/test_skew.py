"""A household holding a third of all lines: exact results, and when the
dimension cannot be broadcast AQE splits the hot join partition."""

import datetime as dt

from pyspark.sql import functions as F

from tillroll.operators import summaries
from tillroll.operators.star import star
from tillroll.sources.fixture import RetailTables

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
}


def test_hot_household_is_split_and_exact(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        n = 300_000
        tx = spark.range(n).select(
            F.floor(F.col("id") / 4).cast("long").alias("basket_num"),
            F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 997 + 2)
            .cast("long").alias("hshd_num"),
            F.lit(dt.date(2020, 1, 1)).alias("purchase_date"),
            (F.col("id") % 50).alias("product_num"), F.lit(1.0).alias("spend"),
            F.lit(1.0).alias("units"), F.lit("E").alias("store_r"),
            (F.col("id") % 10).cast("int").alias("week_num"), F.lit(2020).alias("year"))
        hh = spark.range(1, 1000).select(
            F.col("id").alias("hshd_num"),
            *[F.lit("x").alias(c) for c in ["loyalty_flag", "age_range", "marital_status",
                                             "income_range", "homeowner_desc", "hshd_composition",
                                             "hh_size", "children"]])
        pr = spark.range(50).select(
            F.col("id").alias("product_num"), F.lit("D").alias("department"),
            F.lit("C").alias("commodity"), F.lit("B").alias("brand_ty"),
            F.lit("Y").alias("natural_organic_flag"))
        rollup = summaries.household_rollup(star(RetailTables(hh, pr, tx)))
        rows = {r["hshd_num"]: r for r in rollup.collect()}
        plan = rollup._jdf.queryExecution().executedPlan().toString()
        assert "isSkewJoin=true" in plan or "skew=true" in plan
        assert rows[1]["total_spend"] == n // 3
        assert rows[1]["total_baskets"] == len({i // 4 for i in range(0, n, 3)})
        assert sum(r["total_spend"] for r in rows.values()) == n
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_basket_pairs_and_summary_exact(spark):
    import itertools
    from collections import Counter

    from tillroll import schema
    from tillroll.operators import basket

    d = dt.date(2020, 1, 1)
    # basket 0 holds a third of all lines, spread over 100 commodities
    lines = [(0, 1, d, i % 100, 1.0, 1.0, "E", 1, 2020) for i in range(3000)]
    lines += [(1 + i // 5, 1, d, (i * 7) % 100, 1.0, 1.0, "E", 1, 2020) for i in range(6000)]
    tx = spark.createDataFrame(lines, schema.TRANSACTIONS).repartition(8)
    hh = spark.createDataFrame([(1, "Y", "A", "M", "I", "H", "C", "2", "1")], schema.HOUSEHOLDS)
    pr = spark.createDataFrame([(i, f"D{i % 7}", f"c{i:03d}", "B", "Y") for i in range(100)],
                               schema.PRODUCTS)
    t = RetailTables(hh, pr, tx)
    codes = basket.dense_codes(pr, "commodity")
    s = star(RetailTables(hh, basket.code_commodities(pr, codes), tx))
    got = {(r[0], r[1]): r[2] for r in basket.pair_counts(s, codes).collect()}
    items = {}
    for b, _, _, p, *_ in lines:
        items.setdefault(b, set()).add(f"c{p:03d}")
    want = Counter(pr_ for cs in items.values() for pr_ in itertools.combinations(sorted(cs), 2))
    assert got == dict(want)
    bs = {r["basket_num"]: r for r in summaries.basket_summary(star(t)).collect()}
    assert bs[0]["n_lines"] == 3000 and bs[0]["n_commodity"] == 100 and bs[0]["n_department"] == 7


def test_pairs_of_a_large_assortment(spark):
    """20,000 commodities, most baskets small, some wide and close together: exact, counters only where dense."""
    import itertools
    import random
    from collections import Counter

    from tillroll.operators import basket

    rng = random.Random(5)
    sets = [sorted(rng.sample(range(20_000), rng.randrange(1, 9))) for _ in range(2_000)]
    sets += [list(range(640, 1_240)), list(range(0, 20_000, 70)), sorted(rng.sample(range(700, 1_000), 120))]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "basket_num long, items array<int>").repartition(4)
    want = Counter(p for s in sets for p in itertools.combinations_with_replacement(s, 2))
    for dense_from in (basket.DENSE_FROM, 1, 1_000):
        got = {(r["a"], r["b"]): r["n"] for r in basket.cooccurrence(df, dense_from).collect()}
        assert got == dict(want)
    blocks = basket._blocks(df)
    dense = blocks.where(F.size("ids") >= basket.DENSE_FROM).select("a", "j").distinct().count()
    every = blocks.select("a", "j").distinct().count()
    assert dense < 0.3 * every      # 64 counters for these only


def test_itemsets_against_brute_force(spark):
    import itertools
    import random
    from collections import Counter

    from tillroll.operators import basket

    rng = random.Random(8)
    names = [f"n{i:02d}" for i in range(12)]
    sets = [sorted(rng.sample(range(12), rng.randrange(1, 7))) for _ in range(300)] + [list(range(12))]
    star_ = spark.createDataFrame([(b, c) for b, s in enumerate(sets) for c in s + s[:1]] + [(900, None)],
                                  "basket_num long, cid int")
    codes = spark.createDataFrame(list(enumerate(names)), "cid int, commodity string")
    for one_in, size in ((40, 3), (100, 2), (10_000, 4)):
        least = max(1, -(-len(sets) // one_in))
        count = Counter(c for s in sets for k in range(size, len(s) + 1) for c in itertools.combinations(s, k))
        want = {("; ".join(names[i] for i in c), len(c), n) for c, n in count.items() if n >= least}
        got = basket.frequent_itemsets(star_, codes, one_in, size).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert basket.frequent_itemsets(star_.limit(0), codes).count() == 0
