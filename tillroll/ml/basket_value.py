"""High-value basket label and the boosted-tree drivers of basket value.

Label: a basket is high-value when its spend is at or above the exact
median basket spend (``operators.median``: distributed selection over value
counts, bounded work per task).

Model: gradient-boosted trees on (lines, distinct commodities, distinct
departments). The three features are small integers, so baskets are first
grouped to (features, label) -> weight; the fit then reads a table bounded
by the feature domain instead of one row per basket, with identical splits.
A cut may lie between any two neighbouring values of a feature (``maxBins``
follows the data). ``gbt_first_split`` lists every cut of the first tree's
root with its gain, so that the model's first decision can be checked.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators.median import exact_median
from tillroll.operators.summaries import basket_summary
from tillroll.session import materialize

# Model inputs with their report labels, and the model size.
FEATURES = (
    ("n_lines", "Lines in basket"),
    ("n_commodity", "Distinct commodities"),
    ("n_department", "Distinct departments"),
)
GBT_PARAMS = dict(maxDepth=3, maxIter=48, stepSize=0.1, seed=42)
# The training table is bounded by the feature domain (a few hundred rows)
# and cached: rebuilding it from lineage after an executor loss is cheaper
# than checkpointing the boosting state every few iterations.
GBT_CHECKPOINT_INTERVAL = -1
MIN_BASKETS = 40

IMPORTANCE_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("importance_pct", T.DoubleType()),
    T.StructField("reason", T.StringType()),
])


def basket_value_label(star: DataFrame | None, approx_median: bool = False,
                       accuracy: int = 10_000, summary: DataFrame | None = None) -> DataFrame:
    """Basket summary + high-value label; the summary is materialised once
    and read by both the median computation and the labelling pass.

    ``approx_median`` swaps the exact median for a one-pass quantile sketch
    (rank error at most 1/``accuracy`` of the baskets). ``summary`` lets a
    caller share one materialised basket summary.
    """
    bs = summary if summary is not None else materialize(basket_summary(star))
    if approx_median:
        med = bs.agg(F.percentile_approx("basket_spend", 0.5, accuracy).alias("m")).first()["m"]
    else:
        med = exact_median(bs, "basket_spend")
    label = (F.col("basket_spend") >= F.lit(med)) if med is not None else F.lit(None)
    return bs.select(
        "basket_num", "n_lines", "n_commodity", "n_department", "basket_spend",
        label.cast("int").alias("high_value_basket"),
    )


def basket_value_median(star: DataFrame) -> DataFrame:
    """One row: the exact median basket spend (4 decimals)."""
    bs = materialize(basket_summary(star))
    med = exact_median(bs, "basket_spend")
    return bs.sparkSession.range(1).select(
        F.round(F.lit(med).cast("double"), 4).alias("median_basket_spend"))


def training_frame(labelled: DataFrame) -> DataFrame:
    """Baskets grouped to (features, label) with a basket-count weight."""
    cols = [name for name, _ in FEATURES]
    return labelled.groupBy(*cols, "high_value_basket").agg(
        F.count(F.lit(1)).cast("double").alias("weight"))


def gbt_first_split(star: DataFrame, digits: int = 9) -> DataFrame:
    """Every cut at the root of the first boosted tree, best first.

    Columns: feature, cut (midpoint of neighbouring values), n_left, n_right
    (baskets), gain, rank_. The first tree fits labels -1 and 1 with variance
    impurity: the gain is the impurity of all baskets less that of both
    sides, each weighted by its share. Values of a feature are few, so the
    running sums are over a bounded table.
    """
    grouped = training_frame(basket_value_label(star))
    names = [name for name, _ in FEATURES]
    by_value = (grouped.unpivot(["high_value_basket", "weight"], names, "feature", "value")
                .groupBy("feature", "value").agg(
                    F.sum("weight").alias("w"),
                    F.sum(F.when(F.col("high_value_basket") == 1, F.col("weight")).otherwise(-F.col("weight"))).alias("s")))
    order = Window.partitionBy("feature").orderBy("value")
    every = Window.partitionBy("feature")
    sums = by_value.select(
        "feature", "value", F.lead("value").over(order).alias("next"),
        F.sum("w").over(order).alias("wl"), F.sum("s").over(order).alias("sl"),
        F.sum("w").over(every).alias("w"), F.sum("s").over(every).alias("s"))

    def impurity(s, w):
        return 1 - (s / w) * (s / w)

    wr, sr = F.col("w") - F.col("wl"), F.col("s") - F.col("sl")
    gain = impurity(F.col("s"), F.col("w")) - (F.col("wl") / F.col("w")) * impurity(F.col("sl"), F.col("wl")) \
        - (wr / F.col("w")) * impurity(sr, wr)
    cuts = sums.where("next is not null").select(
        "feature", ((F.col("value") + F.col("next")) / 2).alias("cut"),
        F.col("wl").cast("bigint").alias("n_left"), wr.cast("bigint").alias("n_right"),
        F.round(gain, digits).alias("gain"))
    best = Window.orderBy(F.col("gain").desc(), "feature", "cut")         # a row a cut
    return cuts.withColumn("rank_", F.row_number().over(best))


def basket_value_gbt(star: DataFrame, rows_per_partition: int = 200_000,
                     summary: DataFrame | None = None) -> DataFrame:
    """Feature importances (percent, 2 decimals) of the boosted-tree model, with the reason when there is none.

    Columns: feature, importance_pct, reason. Without a trainable model
    (fewer than 40 baskets, a single spend value or a single label) there is
    one row that has only a reason. The guard is one global aggregate
    (min < max stands for "more than one distinct value", no distinct
    shuffle). The grouped training table is sized to its row count before
    caching: each boosting iteration runs several small jobs over it, so
    it should not be spread over more partitions than its size needs.
    """
    spark = star.sparkSession
    labelled = basket_value_label(star, summary=summary)
    guard = labelled.agg(
        F.count(F.lit(1)).alias("n"),
        (F.min("basket_spend") < F.max("basket_spend")).alias("spend_varies"),
        (F.min("high_value_basket") < F.max("high_value_basket")).alias("label_varies"),
    ).first()
    reason = (f"fewer than {MIN_BASKETS} baskets" if guard["n"] < MIN_BASKETS
              else "all baskets have the same spend" if not guard["spend_varies"]
              else "all baskets have the same label" if not guard["label_varies"] else None)
    if reason:
        return spark.createDataFrame([(None, None, reason)], IMPORTANCE_SCHEMA)
    grouped = materialize(training_frame(labelled))
    sizes = grouped.agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(name).alias(name) for name, _ in FEATURES]).first()
    assembled = VectorAssembler(
        inputCols=[name for name, _ in FEATURES], outputCol="features"
    ).transform(grouped).select("features", "high_value_basket", "weight")
    assembled = assembled.coalesce(1 + sizes["rows"] // rows_per_partition).cache()
    try:
        model = _classifier(max(sizes[name] for name, _ in FEATURES)).fit(assembled)
    finally:
        assembled.unpersist()
    imps = model.featureImportances.toArray()
    rows = [(label, round(float(v) * 100, 2), None) for (_, label), v in zip(FEATURES, imps)]
    return spark.createDataFrame(rows, IMPORTANCE_SCHEMA)


def _classifier(values: int) -> GBTClassifier:
    """The model; with more bins than a feature has values, every cut between two values is tried."""
    return GBTClassifier(featuresCol="features", labelCol="high_value_basket", weightCol="weight",
                         checkpointInterval=GBT_CHECKPOINT_INTERVAL, maxBins=max(32, values + 1), **GBT_PARAMS)
