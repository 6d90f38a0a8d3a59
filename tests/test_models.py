import random

import pytest
from pyspark.sql import functions as F

from barriometrics.operators import models, reports, selection
from barriometrics.plans import queries_models

QUICK = {"maxIter": 4, "maxDepth": 3}
FEATURES = ["total_area", "rooms", "bedrooms", "antiquity"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(400):
        area, rooms = float(rng.randint(20, 120)), float(rng.randint(1, 5))
        name = rng.choice(["PALERMO", "RETIRO", "ELSEWHERE"])
        data.append((str(i), name, area * 1000 + rooms * 500 + (20000 if name == "PALERMO" else 0), area, rooms, rooms, float(rng.randint(0, 9))))
    return spark.createDataFrame(data, "code string, neighborhood string, price double, total_area double, rooms double, bedrooms double, antiquity double").cache()


def test_split_is_stable_and_near_its_share(rows):
    split = models.train_test_split(rows, "code")
    again = models.train_test_split(rows.repartition(3), "code")
    assert {(r["code"], r["split"]) for r in split.collect()} == {(r["code"], r["split"]) for r in again.collect()}
    assert 0.6 < split.filter("split = 'train'").count() / 400 < 0.8


def test_models_by_neighborhood(rows):
    fitted = models.train_per_neighborhood(rows, params=QUICK)
    assert set(fitted) == {"PALERMO", "RETIRO"}
    scored = models.predict_by_neighborhood(rows, fitted)
    assert scored.count() == 400
    missing = scored.filter(F.col("neighborhood_prediction").isNull()).select("neighborhood").distinct().collect()
    assert [r[0] for r in missing] == ["ELSEWHERE"]


def test_latest_model_by_date(spark, rows, tmp_path):
    root = str(tmp_path / "models")
    low = models.train_simple(rows.withColumn("price", F.lit(1.0)), params=QUICK)
    high = models.train_simple(rows.withColumn("price", F.lit(9.0)), params=QUICK)
    models.save_model(low, root, "ohe", "2025-02-01")
    models.save_model(high, root, "ohe", "2024-12-31")
    loaded = models.load_latest_model(spark, root, "ohe")
    assert models.predict_simple(rows, loaded).first()["simple_prediction"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        models.load_latest_model(spark, root, "other")


def test_rent_range(spark, rows):
    model = models.train_ohe(rows, params={"maxIter": 10, "maxDepth": 5, "featureSubsetStrategy": "all"})
    requests = spark.createDataFrame([(1, "PALERMO", 2, 1, 5, "20-110")], "request_id int, neighborhood string, rooms int, bedrooms int, antiquity int, total_area string")
    out = reports.rent_range(requests, model).first()
    assert out["rent_result_min"] < out["rent_result_max"]


def test_request_checks(spark):
    data = [("PALERMO", "40", "2", "1", "5"), (None, "40", "2", "1", "5"), ("X", "40.5", "2", "1", "5"), ("X", "40", None, "1", "5")]
    df = spark.createDataFrame(data, "neighborhood string, total_area string, rooms string, bedrooms string, antiquity string")
    assert [r["error"] for r in models.validate_requests(df).collect()] == [
        None, "neighborhood: must be a string", "total_area: must be an integer", "rooms: missing",
    ]
    with pytest.raises(ValueError):
        models.integer_features(df.drop("rooms"))


def test_sample(spark, rows):
    first = selection.sample_n(rows.select("code", "price"), 50).collect()
    second = selection.sample_n(rows.select("code", "price").repartition(5), 50).collect()
    assert len(first) == 50 and sorted(first) == sorted(second)
    with pytest.raises(ValueError):
        selection.sample_n(rows.select("code"), 401)


def test_feature_studies(rows):
    importance = selection.feature_importance(rows, FEATURES, numTrees=5, maxDepth=3).collect()
    assert importance[0]["feature"] == "total_area"
    components = selection.pca_explained(rows, FEATURES).collect()
    assert components[-1]["cumulative"] == pytest.approx(1) and components[0]["needed"]
    assert selection.corr_with(rows, ["price", *FEATURES]).first()["feature"] == "price"
    assert selection.drop_collinear(rows, FEATURES) != FEATURES  # rooms and bedrooms are the same column
    assert len(selection.rfe(rows, FEATURES, keep=2)) == 2
    flat = rows.withColumn("flat", F.lit(1.0))
    assert selection.low_variance_filter(flat, [*FEATURES, "flat"]) == FEATURES
    assert selection.select_features(rows, FEATURES, share=0.25) == ["total_area"]


def test_rows_without_a_feature_come_back_unscored(spark, rows):
    gaps = rows.withColumn("antiquity", F.when(F.col("code") % 7 > 0, F.col("antiquity")))
    wanted = gaps.filter("antiquity IS NULL").count()
    simple, one_hot = models.train_simple(gaps, params=QUICK), models.train_ohe(gaps, params=QUICK)
    scored = [
        models.predict_simple(gaps, simple, "p"), models.predict_ohe(gaps, one_hot, "p"),
        models.predict_by_neighborhood(gaps, {"PALERMO": simple, "RETIRO": simple, "ELSEWHERE": simple}, "p"),
    ]
    for df in scored:
        assert df.count() == 400 and df.filter("p IS NULL").count() == wanted == df.filter("p IS NULL AND antiquity IS NULL").count()


@pytest.mark.parametrize("name", ["train_simple", "train_ohe", "train_per_neighborhood", "save_load_latest_model", "predict_simple", "predict_ohe", "predict_by_neighborhood", "scored_stock", "rent_range", "feature_importance", "compare_models"])
def test_registered_fits_use_the_operators_own_parameters(name, monkeypatch):
    seen = []

    class Stop(Exception):
        pass

    def stop(*args, **kwargs):
        seen.append(kwargs)
        raise Stop

    for owner, fit in [(models, "train_simple"), (models, "train_ohe"), (models, "train_per_neighborhood"), (selection, "feature_importance"), (selection, "compare_models")]:
        monkeypatch.setattr(owner, fit, stop)
    for part, value in {"training_rows": None, "_halves": (None, None), "materialise": None, "scratch_path": ""}.items():
        monkeypatch.setattr(queries_models, part, lambda *args, value=value: value)
    monkeypatch.setattr(queries_models.flows, "stock_listings", lambda *args: None)
    monkeypatch.setattr(queries_models.dt, "stock", lambda *args: None)
    with pytest.raises(Stop):
        getattr(queries_models, name)(None, "")
    assert seen == [{}]
