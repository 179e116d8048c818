"""Model checks: the CLV fit recovers the known target; boosting is sane."""

import pytest

from tests.conftest import SF_SMALL
from pyspark.sql import functions as F

from tillroll.ml import basket_value, churn_model, clv, least_squares
from tillroll.operators.star import star
from tillroll.sources import fixture


@pytest.fixture(scope="module")
def s(spark):
    return star(fixture.load(spark, SF_SMALL))


def test_clv_recovers_multiplier(s):
    feats = clv.clv_features(s)
    model = clv.clv_fit(feats)
    assert model.slope["total_spend"] == pytest.approx(1.25, abs=1e-12)
    assert all(abs(v) < 1e-6 for c, v in model.slope.items() if c != "total_spend") and abs(model.intercept) < 1e-6
    assert clv.clv_predict(s).where("NOT clv_ok").count() == 0
    assert clv.clv_fit(feats.limit(0)) is None and clv.clv_predict(s.limit(0)).count() == 0


def test_collinear_and_constant_columns_are_dropped(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    a, b = rng.normal(50, 9, 400), rng.normal(-3, 2, 400)
    rows = [(float(x), float(x) * 2 + 1, float(y), float(y) + float(x), 7.0, 3 * float(x) - 2 * float(y) + 11) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "a double, twice_a double, b double, a_and_b double, seven double, y double")
    fit = least_squares.fit(df, ["a", "twice_a", "b", "a_and_b", "seven"], "y")
    assert fit.dropped["seven"] == "constant" and sorted(fit.dropped.values()) == ["collinear"] * 2 + ["constant"]
    assert len(fit.slope) == 2
    off = df.select((F.col("y") - fit.predict()).alias("d")).agg(F.max(F.abs("d"))).first()[0]
    assert off < 1e-9
    noisy = df.withColumn("y", F.col("y") + F.randn(3))
    got = least_squares.fit(noisy, ["a", "b"], "y")
    y = np.array([r["y"] for r in noisy.orderBy("a").collect()])
    order = np.argsort(a)
    want = np.linalg.lstsq(np.column_stack([a[order], b[order], np.ones(400)]), y, rcond=None)[0]
    assert [got.slope["a"], got.slope["b"], got.intercept] == pytest.approx(list(want), rel=1e-9)
    assert least_squares.fit(df, ["seven"], "y").slope == {}


def test_first_split_is_the_models(s):
    cuts = basket_value.gbt_first_split(s).orderBy("rank_").collect()
    lab = basket_value.basket_value_label(s)
    names = [c for c, _ in basket_value.FEATURES]
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=names, outputCol="features").transform(basket_value.training_frame(lab)).coalesce(1)
    root = basket_value._classifier(64).fit(data).trees[0].toDebugString.split("\n")[1].strip()
    best = cuts[0]
    assert root == f"If (feature {names.index(best['feature'])} <= {best['cut']})"
    assert best["gain"] > 0 and best["n_left"] + best["n_right"] == lab.count()


def test_untrained_model_gives_its_reason(s, spark):
    rows = basket_value.basket_value_gbt(s.limit(3)).collect()
    assert [(r["feature"], r["importance_pct"]) for r in rows] == [(None, None)] and "fewer than 40" in rows[0]["reason"]
    same = s.withColumn("spend", F.lit(1.0)).dropDuplicates(["basket_num"])
    assert "same spend" in basket_value.basket_value_gbt(same).first()["reason"]


def test_backtest_against_brute_force(s):
    got = {r["cutoff_week"]: r for r in churn_model.churn_backtest(s, horizon=6, origins=3).collect()}
    bought = {}
    for r in s.select("hshd_num", "week_num").distinct().collect():
        bought.setdefault(r[0], set()).add(r[1])
    latest = max(max(w) for w in bought.values())
    for i in range(1, 4):
        c = latest - 6 * i
        known = [(c - max(x for x in w if x <= c), not any(c < x <= c + 6 for x in w))
                 for w in bought.values() if min(w) <= c]
        gone, stayed = [r for r, g in known if g], [r for r, g in known if not g]
        auc = sum((x > y) + (x == y) / 2 for x in gone for y in stayed) / (len(gone) * len(stayed))
        assert (got[c]["n_households"], got[c]["n_churned"]) == (len(known), len(gone))
        assert got[c]["auc_recency"] == pytest.approx(auc, abs=1e-6)
    assert churn_model.churn_backtest(s.limit(0)).count() == 0


def test_gbt_importances(s):
    rows = basket_value.basket_value_gbt(s).collect()
    assert [r["feature"] for r in rows] == [
        "Lines in basket", "Distinct commodities", "Distinct departments"]
    assert sum(r["importance_pct"] for r in rows) == pytest.approx(100, abs=0.02)
    assert rows[0]["importance_pct"] == max(r["importance_pct"] for r in rows)


def test_weighted_training_frame_preserves_baskets(s):
    lab = basket_value.basket_value_label(s)
    grouped = basket_value.training_frame(lab)
    assert grouped.agg({"weight": "sum"}).first()[0] == lab.count()


def test_weighted_gbt_equals_per_basket_gbt(s):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    lab = basket_value.basket_value_label(s)
    cols = [c for c, _ in basket_value.FEATURES]
    va = VectorAssembler(inputCols=cols, outputCol="features")
    params = dict(labelCol="high_value_basket", checkpointInterval=-1, **basket_value.GBT_PARAMS)
    per_basket = va.transform(lab.withColumn("weight", F.lit(1.0))).coalesce(1).cache()
    grouped = va.transform(basket_value.training_frame(lab)).coalesce(1).cache()
    a = GBTClassifier(weightCol="weight", **params).fit(per_basket).featureImportances.toArray()
    b = GBTClassifier(weightCol="weight", **params).fit(grouped).featureImportances.toArray()
    assert list(a) == pytest.approx(list(b), abs=1e-9)


def test_approx_median_label_close(s):
    exact = basket_value.basket_value_label(s)
    approx = basket_value.basket_value_label(s, approx_median=True)
    n = exact.count()
    diff = exact.join(approx.withColumnRenamed("high_value_basket", "h2"), "basket_num") \
        .where("high_value_basket <> h2").count()
    assert diff <= max(2, n // 1000)
