"""Work per row at size: parsing compiles, rows are parsed once, staged rows are columnar, mined baskets are few."""

import itertools
import os
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillroll.ml import churn_model
from tillroll.operators import basket, cleaning, kpi
from tillroll.operators.star import BROADCAST_ROWS, star
from tillroll.plans import maintained
from tillroll.sources import fixture, warehouse
from tillroll.sources.csv_extracts import read_extract
from tillroll.sources.fixture import RetailTables


def _read_back(spark, scratch, table):
    return read_extract(spark, fixture.write_csv_drop(spark, SF_SMALL, table, os.path.join(scratch, table)))


def _method_bytes(df):
    """Size of the largest method of each generated class of the plan."""
    debug = getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package")
    plans = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    stats = [plans.apply(i)._3().toString() for i in range(plans.size())]
    return [int(re.search(r"ByteCodeStats\((-?\d+),", x).group(1)) for x in stats]


def test_checked_rows_compile(spark, scratch):
    for table in ("households", "products", "transactions"):
        sizes = _method_bytes(cleaning.checked(_read_back(spark, scratch, table), table))
        assert sizes and 0 < min(sizes) and max(sizes) < 8_000       # the JIT leaves larger methods alone


def test_reject_counts_parse_once(spark, scratch):
    for table in ("households", "products", "transactions"):
        rows = cleaning.checked(_read_back(spark, scratch, table), table)
        counts = cleaning.reject_counts(rows, table)
        want = cleaning.rejected(rows, table).groupBy("source", "reason", "kept").count().collect()
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want))
        # the only filter is on the counts, above the aggregate
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Filter") < plan.index("Aggregate") and plan.count("Filter") == 1


def test_only_bad_rows_have_a_record(spark, scratch):
    rows = cleaning.checked(_read_back(spark, scratch, "transactions"), "transactions")
    got = {tuple(r) for r in rows.groupBy(F.isnull("reason_"), F.isnull("record_")).count().select(F.expr("* except (count)")).collect()}
    assert got == {(True, True), (False, False)}


def test_raw_rows_are_staged_as_columns(spark, scratch, monkeypatch):
    staged, write = [], fixture.written
    monkeypatch.setattr(fixture, "written", lambda df, name: staged.append(write(df, name)) or staged[-1])
    fixture.write_csv_drop(spark, SF_SMALL, "transactions", os.path.join(scratch, "drop"))
    assert all(f.endswith(".parquet") for f in staged[0].inputFiles())
    assert staged[0].count() == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()


def test_three_passes_over_the_lines_of_a_commit(spark, scratch):
    wh = os.path.join(scratch, "wh")
    warehouse.write_version(spark, fixture.load(spark, SF_SMALL), wh, version="1")
    maintained.maintain(spark, wh)
    live = warehouse.current(spark, wh)
    kept = spark.read.parquet(maintained._folder(wh, live[0], live[0], "sketch")).first()
    sums = spark.read.parquet(maintained._folder(wh, live[0], live[0], "sums"))
    assert kept["cents"] == sums.where("series = 'baskets'").first()["cents"] == sums.where(
        "series = 'week'").agg(F.sum("cents")).first()[0]


def test_triple_baskets_keep_every_frequent_set(spark):
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(30), rng.randrange(1, 8))) for _ in range(400)]
    sets += [sorted([1, 2, 3, 4, *rng.sample(range(5, 30), 2)]) for _ in range(12)]
    sets += [sorted(rng.sample(range(30), 20)) for _ in range(5)]
    df = spark.createDataFrame([(i, rng.sample(s, len(s))) for i, s in enumerate(sets)], "basket_num long, items array<int>")
    least = 10

    def frequent(baskets):
        count = Counter(c for s in baskets for k in (3, 4) for c in itertools.combinations(sorted(s), k))
        return {c: n for c, n in count.items() if n >= least}

    for narrow in (basket.NARROW, 4, 2):
        got = [r["items"] for r in basket.triple_baskets(df, least, narrow).collect()]
        assert frequent(got) == frequent(sets) and (1, 2, 3, 4) in frequent(got)
    few = basket.triple_baskets(df, least).collect()
    assert len(few) < 0.5 * len(sets) and len({r["basket_num"] for r in few}) == len(few)


def test_churn_scores_take_no_model_into_the_tasks(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.sql import Observation

    # a session that has observed a frame cannot be serialised, nor can a model that holds it
    spark.range(3).observe(Observation("seen"), F.count(F.lit(1)).alias("n")).collect()
    lines = star(fixture.load(spark, SF_SMALL))
    scored = churn_model.churn_model(lines, horizon=30)
    assert "UDF" not in scored._jdf.queryExecution().optimizedPlan().toString()
    data = churn_model.churn_training_frame(lines, horizon=30)
    vec = VectorAssembler(inputCols=list(churn_model.FEATURES), outputCol="raw").transform(data)
    scaled = StandardScaler(inputCol="raw", outputCol="features").fit(vec).transform(vec)
    model = LogisticRegression(featuresCol="features", labelCol="churned", maxIter=100, regParam=0.01).fit(scaled)
    want = {r["hshd_num"]: float(model.predictProbability(r["features"])[1]) for r in scaled.collect()}
    got = {r["hshd_num"]: r["churn_probability"] for r in scored.collect()}
    assert got.keys() == want.keys() and len(set(got.values())) > 10
    assert all(abs(got[h] - want[h]) < 6e-5 for h in want)
    # one kind of household only
    assert {r["churn_probability"] for r in churn_model.churn_model(lines, horizon=-1_000).collect()} == {1.0}


def _warehouse_of_many_products(spark, scratch):
    """A million and more products in a few compressed megabytes; a household with a third of the lines."""
    src = fixture.load(spark, SF_SMALL)
    more = spark.range(10_000, 10_000 + BROADCAST_ROWS, 1, 2).selectExpr(
        "id AS product_num", "'D' AS department", "'C' AS commodity", "'B' AS brand_ty", "'Y' AS natural_organic_flag")
    products = src.products.unionByName(more)
    lines = src.transactions.withColumns({
        "product_num": F.when(F.col("basket_num") % 5 == 0, F.col("product_num") + 10_000).otherwise(F.col("product_num")),
        "hshd_num": F.when(F.col("basket_num") % 3 == 0, 10).otherwise(F.col("hshd_num"))})
    wh = os.path.join(scratch, "wh")
    tables = RetailTables(src.households, products, lines)
    warehouse.write_version(spark, tables, wh, version="1")
    return wh, tables


def _joins(df):
    return set(re.findall(r"(\w+Join) \[(\w+)#", df._jdf.queryExecution().executedPlan().toString()))


def test_many_rows_in_small_files_are_not_broadcast(spark, scratch):
    wh, tables = _warehouse_of_many_products(spark, scratch)
    t = warehouse.read_current(spark, wh)
    assert 10 in t.heavy["hshd_num"] and t.rows == {"households": tables.households.count(), "products": tables.products.count()}
    totals = kpi.kpi_totals(star(t))
    assert _joins(totals) == {("SortMergeJoin", "product_num"), ("BroadcastHashJoin", "hshd_num")}
    assert totals.collect() == kpi.kpi_totals(star(tables)).collect()


def test_lines_of_a_commit_are_joined_once(spark, scratch, monkeypatch):
    wh, tables = _warehouse_of_many_products(spark, scratch)
    read, sums = [], kpi.dashboard_sums
    monkeypatch.setattr(kpi, "dashboard_sums", lambda lines: read.extend(lines.inputFiles()) or sums(lines))
    got = maintained.dashboard(spark, wh)
    monkeypatch.undo()
    assert read and not any(f"/{t}/v=" in f for f in read for t in ("households", "products", "transactions"))
    assert os.listdir(os.path.join(wh, "_staging")) == []
    want = kpi.dashboard_series(star(tables))
    assert sorted(map(str, got.series.collect())) == sorted(map(str, want.collect()))
    assert got.totals.collect() == kpi.kpi_totals(star(tables)).collect()
