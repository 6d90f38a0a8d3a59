"""Comparison of learners over folded rows."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from barriometrics.operators import selection

FEATURES = ["area", "rooms"]


def listings(spark, n=3000):
    rng = np.random.default_rng(3)
    area, rooms = rng.integers(1, 7, n) * 10.0, rng.integers(1, 5, n) * 1.0
    price = area * rooms + np.where(area > 30, 100.0, 0.0) + rng.normal(0, 20, n)
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(area, rooms, price, strict=True)], "area double, rooms double, price double").coalesce(1)


def test_learners_get_a_row_for_each_tuple_of_bins(spark, monkeypatch):
    given = []

    class Counted(DecisionTreeRegressor):
        def fit(self, dataset, params=None):
            given.append(dataset.count())
            return super().fit(dataset, params)

    monkeypatch.setattr(selection, "DecisionTreeRegressor", Counted)
    selection.compare_models(listings(spark), FEATURES, trees=2)
    assert len(given) == 3 and max(given) <= 2 * 24  # two parts of 6 areas and 4 numbers of rooms, not 2,000 rows


def test_errors_are_those_of_learners_that_see_every_row(spark):
    df = listings(spark)
    found = {r["model"]: r["rmse"] for r in selection.compare_models(df, FEATURES, trees=6).collect()}
    rows = selection.materialise(selection._assembled(df, FEATURES, "price"))
    learners = {
        "linear": LinearRegression(labelCol="price"), "decision_tree": DecisionTreeRegressor(labelCol="price", seed=42),
        "gradient_boosting": GBTRegressor(labelCol="price", seed=42, maxIter=6),
        "random_forest": RandomForestRegressor(labelCol="price", seed=42, numTrees=6),
    }
    for name, learner in learners.items():
        judge = RegressionEvaluator(labelCol="price", metricName="rmse")
        whole = CrossValidator(estimator=learner, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=3, seed=42).fit(rows)
        if name == "random_forest":  # draws its bootstraps and features otherwise; six trees with one feature at a node vary much by seed
            assert 18 < found[name] < 50 and 18 < whole.avgMetrics[0] < 50
        else:
            assert found[name] == pytest.approx(whole.avgMetrics[0], rel=1e-6), name


def test_bootstraps_draw_rows_and_add_up(spark):
    df = listings(spark).selectExpr("CAST(area > 30 AS int) AS part", *FEATURES, "price")
    tuples, products = selection.fold_bootstrapped(df, FEATURES, "price", ((15.0, 25.0, 35.0, 45.0, 55.0), (1.5, 2.5, 3.5)), 50.0, 3, 1)
    sums = tuples.selectExpr("sum(n)", "sum(total)", "sum(n_0)", "sum(n_2)", "count(*)", "count(distinct part, features)").first()
    assert sums[0] == 3000 and sums[4] == sums[5] == 24 and sorted(products) == [0, 1]
    assert sums[1] == pytest.approx(df.selectExpr("sum(price - 50)").first()[0])
    assert products[0][0, 0] + products[1][0, 0] == 3000
    assert 2700 < sums[2] < 3300 and 2700 < sums[3] < 3300 and sums[2] != sums[3]


def test_rows_without_a_label_are_an_error(spark):
    with pytest.raises(ValueError, match="price"):
        selection.compare_models(listings(spark, 60).selectExpr("area", "rooms", "nullif(rooms, 2) AS price"), FEATURES)
