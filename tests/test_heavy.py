"""A hot order or household without any skew option of the session: exact results, raw lines spread."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.test_oracle import _norm
from tests.conftest import SF_SMALL
from tillroll.operators import summaries
from tillroll.operators.heavy import THRESHOLD, heavy_keys, split_join
from tillroll.operators.star import star
from tillroll.plans import oracle, registry
from tillroll.sources import fixture, warehouse
from tillroll.sources.fixture import RetailTables

FORCE = "spark.sql.adaptive.forceOptimizeSkewedJoin"
BASKET_QUERIES = ("basket_items", "pair_counts", "frequent_pairs", "basket_pairs", "association_rules",
                  "basket_value_median", "basket_value_label", "basket_value_training", "basket_summary", "kpi_totals")
HOT = 7


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    """The smallest tables, with a third of all lines moved to one order; lines in six files."""
    folder = str(tmp_path_factory.mktemp("hot"))
    for name in ("region", "nation", "customer", "supplier", "part", "orders"):
        os.symlink(f"{SF_SMALL}/{name}.parquet", f"{folder}/{name}.parquet")
    lines = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    order = pa.array([HOT if i % 3 == 0 else k for i, k in enumerate(lines["l_orderkey"].to_pylist())], pa.int64())
    lines = lines.set_column(lines.schema.get_field_index("l_orderkey"), "l_orderkey", order)
    os.makedirs(f"{folder}/lineitem.parquet")
    for i in range(6):
        pq.write_table(lines.slice(i * 1000, 1000), f"{folder}/lineitem.parquet/{i}.parquet")
    return folder


@pytest.fixture()
def no_options(spark):
    old = {k: spark.conf.get(k, None) for k in (FORCE, THRESHOLD, "spark.sql.files.openCostInBytes")}
    spark.conf.set(FORCE, "false")
    spark.conf.set(THRESHOLD, "10k")                  # small enough for the tables here to count as large
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")      # a task a file
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", BASKET_QUERIES)
def test_basket_queries_with_a_hot_order(spark, hot_dir, no_options, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        path = f"{hot_dir}/{t}.parquet" + ("/*.parquet" if t == "lineitem" else "")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    df = registry.build()[name](spark, hot_dir)
    rel = con.sql(oracle.build()[name])
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(_norm(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())


def test_no_task_holds_the_hot_orders_lines(spark, hot_dir, no_options):
    lines = fixture.load(spark, hot_dir).transactions
    by_task = lines.where(f"basket_num = {HOT}").groupBy(F.spark_partition_id()).count().collect()
    total = sum(r["count"] for r in by_task)
    assert total >= 2000 and max(r["count"] for r in by_task) <= total / 6 + 2
    # and the aggregate above reads them there: its first half runs before its shuffle
    plan = summaries.basket_summary(star(fixture.load(spark, hot_dir)))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan.split("Exchange hashpartitioning(basket_num")[1]


def test_sketch_names_all_heavy_keys(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 50 == 1, 6).otherwise(F.col("id") + 100).alias("k"),
        F.lit(None).cast("long").alias("none")).repartition(7)
    found = heavy_keys(rows, ["k", "none"], 0.01)
    assert {5, 6} <= set(found["k"]) and len(found["k"]) <= 100 and found["none"] == []
    assert heavy_keys(rows.limit(0), ["k"]) == {"k": []}


def test_split_join_equals_plain_join(spark):
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k long, v string")
    dim = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k long, w string")
    want = sorted(map(tuple, facts.join(dim, "k").collect()))
    for heavy in ([], [1], [1, 9], [1, 2, 3, 4]):
        assert sorted(map(tuple, split_join(facts, dim, "k", "k", heavy).collect())) == want


def test_warehouse_names_heavy_households(spark, scratch, no_options):
    src = fixture.load(spark, SF_SMALL)
    one = src.transactions.withColumn("hshd_num", F.when(F.col("product_num") % 3 == 0, F.lit(10)).otherwise(F.col("hshd_num")))
    wh = os.path.join(scratch, "wh")
    warehouse.write_version(spark, RetailTables(src.households, src.products, one), wh, version="1", line_files=8)
    t = warehouse.read_current(spark, wh)
    assert 10 in t.heavy["hshd_num"]
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        s = star(t)
        hot = s.where("hshd_num = 10").groupBy(F.spark_partition_id()).count().collect()
        got = sorted(map(tuple, summaries.household_summary(s).collect()))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(hot) >= 2 and max(r["count"] for r in hot) < 0.7 * sum(r["count"] for r in hot)
    assert got == sorted(map(tuple, summaries.household_summary(star(RetailTables(src.households, src.products, one))).collect()))
