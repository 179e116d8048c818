"""The dashboard kept up to date from increments.

Each commit of the warehouse gets its own sums, made from the lines of that
commit alone and written beside the tables: spend in cents by label of every
series, and the basket keys that no earlier commit since the refresh has. A
basket that a later delivery continues is therefore counted once, exactly;
older lines are never read again, only older basket keys. Reading the
dashboard adds up the small tables. A refresh replaces all lines and may
change the dimensions, so its sums start anew.

Each commit also keeps a HyperLogLog sketch of its baskets. With
``exact_baskets=False`` neither basket keys are kept nor old ones read; the
merged sketches then estimate the count (about 1 %).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import kpi
from tillroll.operators.star import star
from tillroll.plans.reports import Dashboard
from tillroll.sources import commits, warehouse

SUMS = "series string, label string, week_num int, cents bigint, n bigint"
# what the sums need of a line
COLUMNS = ("basket_num", "spend", *(source for _, source, *_ in kpi.SERIES))


def _folder(root: str, first: dict, commit: dict, what: str) -> str:
    return f"{root}/dashboard/since={first['commit']}/commit={commit['commit']}/{what}"


def _done(spark: SparkSession, folder: str) -> bool:
    fs, path = commits.file_system(spark, f"{folder}/_SUCCESS")
    return fs.exists(path)


def maintain(spark: SparkSession, root: str, exact_baskets: bool = True) -> list[int]:
    """Make the sums of commits that lack them; returns their numbers. Safe to repeat: finished sums stay."""
    live = warehouse.current(spark, root)
    first, made = live[0], []
    for i, commit in enumerate(live):
        sums = _folder(root, first, commit, "sums")
        if _done(spark, sums):
            continue
        joined = star(warehouse.read_commits(spark, root, live, [commit])).select(*COLUMNS)
        staging = f"{root}/_staging/dashboard-{uuid.uuid4().hex}"
        try:
            # dimensions too large to broadcast shuffle every line: joined once, read three times
            joined.write.parquet(staging)
            lines = spark.read.schema(joined.schema).parquet(staging)
            _sums_of(spark, lines, _folder(root, first, commit, ""),
                     [_folder(root, first, c, "baskets") for c in live[:i]], exact_baskets)
        finally:
            fs, path = commits.file_system(spark, staging)
            fs.delete(path, True)
        made.append(commit["commit"])
    return made


def _sums_of(spark: SparkSession, lines: DataFrame, folder: str, before: list[str], exact_baskets: bool) -> None:
    """Write the sums of one commit's joined lines; ``before`` has the basket keys of the commits that precede it."""
    if exact_baskets:
        keys = lines.select("basket_num").where("basket_num is not null").distinct()
        if before:
            keys = keys.join(spark.read.schema("basket_num bigint").parquet(*before), "basket_num", "left_anti")
        keys.write.mode("overwrite").parquet(f"{folder}baskets")
    # the lines are as many as the delivery's: one pass for the sketch and the total
    sketch = f"{folder}sketch"
    lines.agg(F.hll_sketch_agg("basket_num").alias("sketch"), F.sum(kpi.cents(F.col("spend"))).alias("cents")
              ).write.mode("overwrite").parquet(sketch)
    series = kpi.dashboard_sums(lines)
    total = spark.read.schema("cents bigint").parquet(sketch).select(
        F.lit(kpi.BASKETS).alias("series"), F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("int").alias("week_num"), "cents", F.lit(None).cast("bigint").alias("n"))
    # last, and in one write: its success mark says that the commit is done
    series.unionByName(total).coalesce(1).write.mode("overwrite").parquet(f"{folder}sums")


def dashboard(spark: SparkSession, root: str, exact_baskets: bool = True) -> Dashboard:
    """The dashboard of the current tables; equal to ``reports.dashboard`` over all their lines."""
    maintain(spark, root, exact_baskets)
    live = warehouse.current(spark, root)

    def read(what: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(*[_folder(root, live[0], c, what) for c in live])

    sums = read("sums", SUMS).groupBy("series", "label", "week_num").agg(F.sum("cents").alias("cents"))
    if exact_baskets:
        n = read("baskets", "basket_num bigint").agg(F.count(F.lit(1))).scalar()
    else:
        n = read("sketch", "sketch binary").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch"))).scalar()
    with_baskets = sums.withColumn("n", F.when(F.col("series") == kpi.BASKETS, n))
    return Dashboard(totals=kpi.totals_of(with_baskets), series=kpi.series_of(sums))
