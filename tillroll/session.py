"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library's plans are designed around. AQE re-plans joins from
# runtime sizes (broadcast only when a side is measured small, sort-merge
# otherwise) and splits skewed shuffle partitions; the UI stays off.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot basket of the order join even though the basket aggregate
    # then needs its own shuffle (of partial sums)
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpointed intermediates are deleted once their DataFrame is gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "tillroll",
    driver_memory: str | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session configured for the library's plans.

    Master, memory and partition count are set only when given, so what
    spark-submit or the cluster configures stands.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Order: the directory the SparkContext already uses, else the session's
    ``spark.checkpoint.dir`` setting. Only in local mode, with neither set,
    do we pick a scratch folder; on a cluster that is an error, because the
    executors would each write to their own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tillroll-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A stable per-job folder under the configured shared checkpoint base.

    Uses the ``spark.checkpoint.dir`` setting itself (not the per-application
    subfolder Spark creates under it), so a restarted job - e.g. a stream
    resuming from its checkpoint - finds the same folder again.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Used for small intermediate aggregates (one row per household or
    basket) that several actions or a scalar subquery read: they are
    computed once instead of re-running the star join, and the lineage is
    cut so a lost executor only costs re-reading files.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    For rows that are as many as the lines, or whose size should tell the
    planner whether to broadcast them: the files are columnar and compressed
    and their size is known, which a checkpoint's serialised rows are not.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
