"""Customer lifetime value: household features, OLS fit, predictions.

Target: estimated_future_clv = 1.25 × total_spend. Features: total spend,
units, baskets, active weeks and average basket value (half-even cents).
The fit (``ml.least_squares``) leaves out columns that others determine, such
as weeks where every basket fell into its own week. Because the target is an
exact multiple of one feature, a correct fit predicts 1.25 × spend; ``clv_ok``
reports that per household. The feature table (one row per household) is
materialised once; the fit and the scoring both read it.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.rounding import half_even_ratio
from tillroll.ml import least_squares
from tillroll.operators.summaries import household_summary
from tillroll.session import materialize

# Feature columns and the target multiplier.
FEATURES = ("total_spend", "total_units", "total_baskets", "active_weeks", "avg_basket_value")
CLV_MULTIPLIER = 1.25


def clv_features(star: DataFrame, rollup: DataFrame | None = None) -> DataFrame:
    """Household features; ``rollup`` (``summaries.household_rollup``) lets a
    caller share one household aggregate with the churn report."""
    if rollup is not None:
        hs = rollup.where(F.col("total_baskets") > 0)
    else:
        hs = household_summary(star)
    return hs.select(
        "hshd_num", "total_spend", "total_units", "total_baskets", "active_weeks",
        half_even_ratio(F.col("total_spend"), F.col("total_baskets")).alias("avg_basket_value"),
        (F.col("total_spend") * CLV_MULTIPLIER).alias("estimated_future_clv"),
    )


def _assemble(feats: DataFrame, cols) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(feats)


def clv_fit(feats: DataFrame) -> least_squares.LeastSquares | None:
    """The regression; None without households. Its ``dropped`` names the columns left out, and why."""
    return least_squares.fit(feats, FEATURES, "estimated_future_clv")


def clv_predict(star: DataFrame, rollup: DataFrame | None = None) -> DataFrame:
    """Predicted CLV per household; empty without households.

    The prediction is rounded half-even to cents. A target of whole cents
    times 1.25 has four decimals at most, so the fit's own rounding error is
    taken off there first and cannot tip a tie.
    """
    feats = materialize(clv_features(star, rollup))
    model = clv_fit(feats)
    prediction = model.predict() if model else F.lit(0.0)
    return feats.withColumn("prediction", prediction).select(
        "hshd_num", "total_spend", "estimated_future_clv",
        F.bround(F.round("prediction", 4), 2).alias("predicted_clv"),
        (F.abs(F.col("prediction") - F.col("estimated_future_clv")) < 0.01).alias("clv_ok"),
    )


def clv_top(star: DataFrame, n: int = 10, rollup: DataFrame | None = None) -> DataFrame:
    return (clv_predict(star, rollup)
            .orderBy(F.col("predicted_clv").desc(), F.col("hshd_num").asc())
            .limit(n))


def clv_rf(star: DataFrame, num_trees: int = 20, max_depth: int = 5, seed: int = 42) -> DataFrame:
    """Extension: random-forest CLV predictions per household; empty without households."""
    feats = materialize(clv_features(star))
    if feats.isEmpty():
        return feats.select("hshd_num", "estimated_future_clv", F.lit(0.0).alias("rf_predicted_clv"))
    data = _assemble(feats, FEATURES)
    model = RandomForestRegressor(featuresCol="features", labelCol="estimated_future_clv",
                                  numTrees=num_trees, maxDepth=max_depth, seed=seed).fit(data)
    return model.transform(data).select(
        "hshd_num", "estimated_future_clv", F.round("prediction", 2).alias("rf_predicted_clv"))


def clv_holdout(star: DataFrame, test_one_in: int = 5) -> DataFrame:
    """Extension: fit without every fifth household number, score those.

    One row: households on each side, root mean squared error (cents) and R²
    (6 decimals) on the held-out ones; NULL metrics with no household on
    either side.
    """
    feats = materialize(clv_features(star))
    held = F.pmod("hshd_num", F.lit(test_one_in)) == 0
    model = clv_fit(feats.where(~held))
    prediction = model.predict() if model else F.lit(None).cast("double")
    y = F.col("estimated_future_clv")
    scored = feats.select(held.alias("held"), y.alias("y"), (y - prediction).alias("off"))
    mean = scored.where("held").agg(F.avg("y")).scalar()
    on_held = lambda c: F.when(F.col("held"), c)
    sums = scored.withColumn("mean", mean).agg(
        F.count_if(~F.col("held")).alias("n_train"), F.count_if("held").alias("n_test"),
        F.avg(on_held(F.col("off") * F.col("off"))).alias("mse"),
        F.avg(on_held((F.col("y") - F.col("mean")) * (F.col("y") - F.col("mean")))).alias("var"))
    return sums.select("n_train", "n_test", F.round(F.sqrt("mse"), 2).alias("rmse"),
                       F.round(1 - F.col("mse") / F.nullif(F.col("var"), F.lit(0.0)), 6).alias("r2"))
