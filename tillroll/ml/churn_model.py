"""Extension: a churn classifier with a label from a later time window.

Households are described by their lines up to a cutoff week (latest week
minus ``horizon``); the label says whether they bought nothing after the
cutoff. The label therefore comes from future behaviour, not from the
recency rule it is meant to improve on.

``churn_backtest`` asks how well plain recency foretold that, from several
earlier weeks on: features and label as they would have been at each.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.rounding import money_sum
from tillroll.operators.summaries import household_baskets
from tillroll.session import materialize

FEATURES = ("spend", "units", "baskets", "weeks", "recency")


def churn_training_frame(star: DataFrame, horizon: int = 8) -> DataFrame:
    """Per household with lines up to the cutoff: features over those lines
    and ``churned`` = 1.0 when it bought nothing after the cutoff.

    The lines are read once, into the (household, basket, week) table; the
    latest week and the conditional aggregates per household read that.
    """
    baskets = materialize(household_baskets(star))
    latest = baskets.agg(F.max("week_num").alias("w")).first()["w"]
    if latest is None:
        latest = 0
    cutoff = F.lit(int(latest) - int(horizon))
    pre = F.col("week_num") <= cutoff
    g = baskets.groupBy("hshd_num").agg(
        money_sum(F.when(pre, F.col("spend"))).alias("spend"),
        F.sum(F.when(pre, F.col("units"))).alias("units"),
        F.count_distinct(F.when(pre, F.col("basket_num"))).cast("double").alias("baskets"),
        F.size(F.collect_set(F.when(pre, F.col("week_num")))).cast("double").alias("weeks"),
        (cutoff - F.max(F.when(pre, F.col("week_num")))).cast("double").alias("recency"),
        F.count_if(pre).alias("n_pre"),
        F.max("week_num").alias("last_week"),
    )
    return g.where(F.col("n_pre") > 0).select(
        "hshd_num", *FEATURES,
        F.when(F.col("last_week") > cutoff, 0.0).otherwise(1.0).alias("churned"))


def churn_model(star: DataFrame, horizon: int = 8) -> DataFrame:
    """Per household: the churn label and the fitted churn probability.

    The training frame (one row per household) is materialised once; the
    scaler fit, the optimiser's passes and the scoring all read it. Without
    households the result is empty. The probability is written out from the
    coefficients: the fitted model's own function takes its training summary
    and with it the session into the tasks, which cannot be serialised once
    the session has observed a frame (``warehouse.refresh`` does).
    """
    data = materialize(churn_training_frame(star, horizon))
    if data.isEmpty():
        return data.select("hshd_num", F.col("churned").cast("int").alias("churned"),
                           F.lit(0.0).alias("churn_probability"))
    vec = VectorAssembler(inputCols=list(FEATURES), outputCol="raw").transform(data)
    scaler = StandardScaler(inputCol="raw", outputCol="features").fit(vec)
    model = LogisticRegression(featuresCol="features", labelCol="churned",
                               maxIter=100, regParam=0.01).fit(scaler.transform(vec))
    margin = F.lit(float(model.intercept))
    for name, weight, std in zip(FEATURES, model.coefficients.toArray().tolist(), scaler.std.toArray().tolist()):
        margin = margin + F.col(name) * F.lit(1 / std if std else 0.0) * F.lit(weight)
    return data.select(
        "hshd_num", F.col("churned").cast("int").alias("churned"),
        F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)), 4).alias("churn_probability"))


def churn_backtest(star: DataFrame, horizon: int = 8, origins: int = 4) -> DataFrame:
    """Per cutoff week: households known by then, how many churned, and the AUC of their recency.

    Cutoffs lie one horizon apart, the last one horizon before the latest
    week. A household is known when it bought by the cutoff, and churned when
    it bought nothing in the ``horizon`` weeks after it. All cutoffs are
    conditional aggregates of one pass. The AUC is the chance that a churned
    household was away longer than one that stayed, ties counting half; it is
    summed over the distinct recencies (weeks, a calendar-bounded domain) and NULL when
    there is only one kind.
    """
    weeks = materialize(household_baskets(star).select("hshd_num", "week_num").distinct())
    latest = weeks.agg(F.max("week_num").alias("w")).first()["w"] or 0
    cutoffs = [int(latest) - horizon * (i + 1) for i in range(origins)]
    week = F.col("week_num")
    per_household = weeks.groupBy("hshd_num").agg(
        *[F.max(F.when(week <= c, week)).alias(f"last_{i}") for i, c in enumerate(cutoffs)],
        *[F.count_if((week > c) & (week <= c + horizon)).alias(f"after_{i}") for i, c in enumerate(cutoffs)])
    rows = per_household.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("cutoff_week"), (F.lit(c) - F.col(f"last_{i}")).alias("recency"),
                 (F.col(f"after_{i}") == 0).alias("churned")) for i, c in enumerate(cutoffs)])).alias("r")).select("r.*")
    by_recency = rows.where("recency is not null").groupBy("cutoff_week", "recency").agg(
        F.count_if("churned").alias("gone"), F.count_if(~F.col("churned")).alias("stayed"))
    shorter = Window.partitionBy("cutoff_week").orderBy("recency").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("gone") * (F.coalesce(F.sum("stayed").over(shorter), F.lit(0)) + F.col("stayed") / 2)
    sums = by_recency.withColumn("wins", wins).groupBy("cutoff_week").agg(
        F.sum(F.col("gone") + F.col("stayed")).alias("n_households"), F.sum("gone").alias("n_churned"),
        F.sum("wins").alias("wins"), F.sum("stayed").alias("n_stayed"))
    pairs = F.nullif(F.col("n_churned").cast("double") * F.col("n_stayed"), F.lit(0.0))
    return sums.select("cutoff_week", "n_households", "n_churned", F.round(F.col("wins") / pairs, 6).alias("auc_recency"))
