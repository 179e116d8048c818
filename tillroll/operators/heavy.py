"""Keys that hold a large share of the rows, and joins that keep them spread.

A hash or merge join brings all rows of one key to one task, and an
aggregate on the same key is then planned without a shuffle, so it reads
them raw. ``heavy_keys`` finds such keys with a frequent-items sketch (one
pass, at most ``1 / share`` keys). ``split_join`` joins their rows where they
are scanned against the few dimension rows they need, and all others by the
planner's join; the aggregate on top reduces each task's rows before it
shuffles them, so a task sees one partial row of a heavy key per task before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is heavy from this share of the rows on; a sketch then tracks a few hundred keys.
SHARE = 0.005
THRESHOLD = "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"


def heavy_keys(rows: DataFrame, columns, share: float = SHARE) -> dict[str, list]:
    """Per column, every value that at least ``share`` of the rows have, and no more than a few others.

    The sketch may name values below the share; its size bounds both.
    """
    found = rows.select(*columns).stat.freqItems(list(columns), share).first()
    return {c: sorted(v for v in (found[f"{c}_freqItems"] or []) if v is not None) for c in columns}


def can_be_hot(spark: SparkSession, path: str) -> bool:
    """Whether a table's files are larger than what AQE calls a skewed partition; a smaller one has no hot task."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return size > spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(THRESHOLD))


def split_join(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, heavy: list,
               hint: str | None = None) -> DataFrame:
    """Inner join of facts with a dimension; rows of the keys in ``heavy`` stay where they are scanned.

    The dimension rows of the heavy keys are broadcast: ``dim_key`` is unique
    in ``dim``, so they are no more than the keys.
    """
    def on(f: DataFrame, d: DataFrame) -> DataFrame:
        if fact_key == dim_key:
            return f.join(d, fact_key)
        return f.join(d, F.col(fact_key) == F.col(dim_key))

    hinted = (lambda d: d.hint(hint)) if hint else (lambda d: d)
    if not heavy:
        return on(facts, hinted(dim))
    hot_fact, hot_dim = F.col(fact_key).isin(heavy), F.col(dim_key).isin(heavy)
    hot = on(facts.where(hot_fact), F.broadcast(dim.where(hot_dim)))
    rest = on(facts.where(~hot_fact), hinted(dim.where(~hot_dim)))
    return rest.unionByName(hot)
