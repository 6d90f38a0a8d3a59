"""Registered queries: price models, scoring, accuracy, feature studies.

The fits use the operators' own parameters (``models.GBT_PARAMS`` for the price models). SQL cannot fit trees; it
checks which rows come out, the error that knowing only the mean would make, and that the fit beats it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barriometrics import dims
from barriometrics.operators import evaluation, models, reports, selection
from barriometrics.plans import driver_tables as dt, flows
from barriometrics.plans.queries_listings import STOCK_SQL
from barriometrics.plans.queries_metrics import report_requests
from barriometrics.plans.registry import RUN_DATE, query, rounded
from barriometrics.session import materialise, scratch_path

STUDY_FEATURES = ["total_area", "rooms", "bedrooms", "bathrooms", "garages", "antiquity"]


def training_rows(spark, sf):
    """Model-ready listings: mapped neighbourhoods and no gaps."""
    rows = dt.facts(spark, sf).filter(F.col("neighborhood") != dims.UNMAPPED)
    return rows.select(
        "code", "part", "neighborhood", "price", "total_area", "rooms",
        F.coalesce(F.col("bedrooms"), F.col("rooms") - 1).alias("bedrooms"), "bathrooms", "garages",
        F.coalesce(F.col("antiquity"), F.lit(50.0)).alias("antiquity"),
    )


def _halves(spark, sf):
    """Listings to learn from and to test on, whose prices follow area and rooms (those of the table are drawn apart from both)."""
    follows = F.col("price") * 0.1 + F.col("total_area") * 400 + F.col("rooms") * 2000
    rows = materialise(models.train_test_split(training_rows(spark, sf).withColumn("price", follows), "code"))
    return rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test")


def _held_out(train, scored, prediction, *by):
    """Row counts of both halves, the held-out error of the training mean, and whether the fit's is below a share of it."""
    means = train.groupBy(*by).agg(F.avg("price").alias("mean"), F.count("*").alias("n_train"))
    joined = scored.join(means, list(by)) if by else scored.select("*", means.select(F.struct("mean", "n_train").alias("m")).scalar().alias("m")).select("*", "m.*")
    error = lambda c: F.sqrt(F.avg(F.pow(F.col("price") - F.col(c), 2)))
    sums = joined.groupBy(*by).agg(
        F.first("n_train").alias("n_train"), F.count(prediction).alias("n"), error("mean").alias("mean_rmse"), error(prediction).alias("rmse")
    )
    return sums.select(*by, "n_train", "n", F.round("mean_rmse", 2).alias("mean_rmse"), (F.col("rmse") < BEATEN * F.col("mean_rmse")).alias("beats_mean"))


#: A fit must leave less than this share of the mean's error.
BEATEN = 0.5
_TRAINING = """, t AS (SELECT * REPLACE (price * 0.1::DOUBLE + total_area * 400 + rooms * 2000 AS price), substr(md5(code), 1, 8) < 'b3333333' AS train
  FROM facts WHERE neighborhood <> 'OTRO')"""
_HELD_OUT = f"""{_TRAINING}, m AS (SELECT avg(price) AS mean, count(*) AS n_train FROM t WHERE train)
    SELECT any_value(n_train) AS n_train, count(*) AS n, round(sqrt(avg(pow(price - mean, 2))), 2) AS mean_rmse, true AS beats_mean FROM t, m WHERE NOT train"""


@query("train_simple", _HELD_OUT, ("facts",))
def train_simple(spark, sf):
    train, test = _halves(spark, sf)
    model = models.train_simple(train)
    return _held_out(train, models.predict_simple(test, model), "simple_prediction")


@query("train_ohe", _HELD_OUT, ("facts",))
def train_ohe(spark, sf):
    train, test = _halves(spark, sf)
    model = models.train_ohe(train)
    return _held_out(train, models.predict_ohe(test, model), "ohe_prediction")


@query(
    "train_per_neighborhood",
    f"""{_TRAINING}, m AS (SELECT neighborhood, avg(price) AS mean, count(*) AS n_train FROM t WHERE train GROUP BY 1)
    SELECT neighborhood, any_value(n_train) AS n_train, count(*) AS n, round(sqrt(avg(pow(price - mean, 2))), 2) AS mean_rmse, true AS beats_mean
    FROM t JOIN m USING (neighborhood) WHERE NOT train GROUP BY 1""",
    ("facts",),
)
def train_per_neighborhood(spark, sf):
    """Hold-out errors of the model of each neighbourhood."""
    train, test = _halves(spark, sf)
    fitted = models.train_per_neighborhood(train)
    return _held_out(train, models.predict_by_neighborhood(test, fitted), "neighborhood_prediction", "neighborhood")


@query(
    "train_test_split",
    "SELECT code, part, CASE WHEN substr(md5(code), 1, 8) < 'b3333333' THEN 'train' ELSE 'test' END AS split FROM facts WHERE neighborhood <> 'OTRO'",
    ("facts",),
)
def train_test_split(spark, sf):
    return models.train_test_split(training_rows(spark, sf), "code").select("code", "part", "split")


@query(
    "evaluate",
    """SELECT count(*) AS n, round(sqrt(avg(pow(original_price - simple_prediction, 2))), 2) AS rmse,
    round(1 - sum(pow(original_price - simple_prediction, 2)) / (var_pop(original_price) * count(*)), 6) AS r2 FROM predictions""",
    ("predictions",),
)
def evaluate(spark, sf):
    result = evaluation.evaluate(predictions(spark, sf), "original_price", "simple_prediction")
    return rounded(rounded(result, 2, "rmse"), 6, "r2")


def _scored(df, prediction, *more):
    """The rows with whether they are scored and whether the score is a price like those of the listings."""
    near = F.col(prediction).between(0, 200_000)
    return df.select("code", *more, F.col(prediction).isNotNull().alias("scored"), F.coalesce(near, F.lit(False)).alias("near"))


@query("save_load_latest_model", f"{_TRAINING} SELECT code, part, true AS scored, true AS same FROM t", ("facts",))
def save_load_latest_model(spark, sf):
    """Two stored models; the newer one is found by its date and scores every listing as before it was stored."""
    train, test = _halves(spark, sf)
    root = scratch_path(spark, "models")
    models.save_model(models.train_simple(test), root, "wo_ohe", "2001-07-01")
    newer = models.train_simple(train)
    models.save_model(newer, root, "wo_ohe", RUN_DATE)
    latest = models.load_latest_model(spark, root, "wo_ohe")
    scored = models.predict_simple(models.predict_simple(training_rows(spark, sf), latest), newer, "before")
    return scored.select("code", "part", F.col("simple_prediction").isNotNull().alias("scored"), (F.col("simple_prediction") == F.col("before")).alias("same"))


@query(
    "validate_input",
    """SELECT code, CASE WHEN neighborhood = 'OTRO' THEN 'neighborhood: must be a string' WHEN bedrooms IS NULL THEN 'bedrooms: missing'
    WHEN antiquity IS NULL THEN 'antiquity: missing' WHEN garages > 0 THEN 'antiquity: must be an integer' END AS error FROM facts""",
    ("facts",),
)
def validate_input(spark, sf):
    whole = lambda c: F.col(c).cast("int").cast("string")
    requests = dt.facts(spark, sf).select(
        "code",
        F.when(F.col("neighborhood") != dims.UNMAPPED, F.col("neighborhood")).alias("neighborhood"),
        whole("total_area").alias("total_area"), whole("rooms").alias("rooms"), whole("bedrooms").alias("bedrooms"),
        F.when(F.col("garages") > 0, F.col("antiquity").cast("string")).otherwise(whole("antiquity")).alias("antiquity"),
    )
    return models.validate_requests(requests).select("code", "error")


_SCORED = "SELECT code, {}price, true AS scored, true AS near FROM facts"


@query("predict_simple", _SCORED.format("") + " WHERE neighborhood <> 'OTRO'", ("facts",))
def predict_simple(spark, sf):
    rows = training_rows(spark, sf)
    return _scored(models.predict_simple(rows, models.train_simple(rows)), "simple_prediction", "price")


@query("predict_ohe", _SCORED.format("neighborhood, "), ("facts",))
def predict_ohe(spark, sf):
    """Scores all listings, the unmapped ones with no flag set."""
    model = models.train_ohe(training_rows(spark, sf))
    everything = dt.facts(spark, sf).withColumns({c: F.coalesce(F.col(c), F.lit(1.0)) for c in ("bedrooms", "antiquity")})
    return _scored(models.predict_ohe(everything, model), "ohe_prediction", "neighborhood", "price")


@query(
    "predict_by_neighborhood",
    "SELECT code, neighborhood, price, neighborhood <> 'OTRO' AS scored, neighborhood <> 'OTRO' AS near FROM facts",
    ("facts",),
)
def predict_by_neighborhood(spark, sf):
    """Scores all listings; the unmapped ones have no model."""
    fitted = models.train_per_neighborhood(materialise(training_rows(spark, sf)))
    everything = dt.facts(spark, sf).withColumns({c: F.coalesce(F.col(c), F.lit(1.0)) for c in ("bedrooms", "antiquity")})
    return _scored(models.predict_by_neighborhood(everything, fitted), "neighborhood_prediction", "neighborhood", "price")


@query(
    "scored_stock",
    STOCK_SQL + """, aged AS (SELECT *, ceil(coalesce(antiquity, avg(antiquity) OVER (PARTITION BY raw_neighborhood))) AS age FROM kept)
    SELECT aged."Codigo" AS argenprop_code, CASE WHEN usd THEN amount * 1225 ELSE amount END::DOUBLE AS original_price, n.neighborhood,
      age IS NOT NULL AS simple_scored, age IS NOT NULL AS ohe_scored, age IS NOT NULL AND n.neighborhood <> 'OTRO' AS neighborhood_scored, true AS classed
    FROM aged JOIN names n USING (raw_neighborhood) WHERE coalesce(total, covered) <> 0 AND (CASE WHEN usd THEN amount * 1225 ELSE amount END) < 5000000""",
    ("facts",),
)
def scored_stock(spark, sf):
    """The accuracy study: three models trained on the listings score the portal's stock."""
    rows = materialise(training_rows(spark, sf))
    fitted = models.train_per_neighborhood(rows)
    stock = flows.stock_listings(dt.stock(spark, sf))
    found = flows.scored_stock(stock, models.train_simple(rows), models.train_ohe(rows), fitted)
    classed = [F.col(f"{m}_prediction").isNull() == F.col(f"{m}_dev_category").isNull() for m in evaluation.MODELS]
    return found.select(
        "argenprop_code", "original_price", "neighborhood", *[F.col(f"{m}_prediction").isNotNull().alias(f"{m}_scored") for m in evaluation.MODELS],
        (classed[0] & classed[1] & classed[2]).alias("classed"),
    )


# ---- accuracy -------------------------------------------------------------------------------


def predictions(spark, sf):
    """Listings with three predictions computed from their columns, so that SQL can follow."""
    price, rooms = F.col("price"), F.col("rooms")
    return dt.facts(spark, sf).select(
        "code", "neighborhood", "total_area", "rooms", price.alias("original_price"),
        (price * (0.35 + rooms * 0.17)).alias("simple_prediction"),
        (price + (F.col("total_area") - 75) * 200).alias("ohe_prediction"),
        (price * (1 + (rooms - 4) * 0.1 + F.col("garages") * 0.05)).alias("neighborhood_prediction"),
    )


def _deviations(spark, sf):
    return evaluation.with_deviations(predictions(spark, sf))


@query(
    "prediction_deviation",
    "SELECT code, round(simple_deviation, 6) AS simple_deviation, round(ohe_deviation, 6) AS ohe_deviation, round(neighborhood_deviation, 6) AS neighborhood_deviation FROM deviations",
    ("predictions",),
)
def prediction_deviation(spark, sf):
    names = [f"{m}_deviation" for m in evaluation.MODELS]
    return rounded(_deviations(spark, sf), 6, *names).select("code", *names)


def _bin(c: str) -> str:
    edges = " ".join(f"WHEN {c} <= {edge} THEN {i}" for i, edge in enumerate(evaluation.BIN_EDGES))
    return f"CASE {edges} ELSE 11 END"


_LABELS = ", ".join(f"({i}, '{name}')" for i, name in enumerate(dims.DEVIATION_LABELS))


@query(
    "deviation_bins",
    f""", labels_(position, dev_category) AS (VALUES {_LABELS}),
    s AS (SELECT {_bin('simple_deviation')} AS position, count(*) AS n FROM deviations GROUP BY 1), o AS (SELECT {_bin('ohe_deviation')} AS position, count(*) AS n FROM deviations GROUP BY 1),
    b AS (SELECT {_bin('neighborhood_deviation')} AS position, count(*) AS n FROM deviations GROUP BY 1)
    SELECT position, dev_category, coalesce(s.n, 0) AS simple_count, coalesce(o.n, 0) AS ohe_count, coalesce(b.n, 0) AS neighborhood_count
    FROM labels_ LEFT JOIN s USING (position) LEFT JOIN o USING (position) LEFT JOIN b USING (position)""",
    ("predictions",),
)
def deviation_bins(spark, sf):
    return evaluation.deviation_bins(_deviations(spark, sf))


_BIN_NAMES = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(dims.DEVIATION_LABELS))


@query("deviation_category", f"SELECT code, CASE {_bin('ohe_deviation')} {_BIN_NAMES} END AS ohe_dev_category FROM deviations", ("predictions",))
def deviation_category(spark, sf):
    return evaluation.with_categories(_deviations(spark, sf)).select("code", "ohe_dev_category")


_ACC = "round(avg(CASE WHEN abs({m}_deviation) <= 30 THEN 1 ELSE 0 END) * 100, 4)"
_ACCS = ", ".join(f"{_ACC.format(m=m)} AS {m}_accuracy" for m in evaluation.MODELS)
_INACC = ", ".join(f"round(100 - avg(CASE WHEN abs({m}_deviation) <= 30 THEN 1 ELSE 0 END) * 100, 4) AS {m}_inaccuracy" for m in evaluation.MODELS)


@query("accuracy_within_30", f"SELECT {_ACCS} FROM deviations", ("predictions",))
def accuracy_within_30(spark, sf):
    return rounded(evaluation.accuracy(_deviations(spark, sf)), 4, *[f"{m}_accuracy" for m in evaluation.MODELS])


@query("accuracy_by_neighborhood", f"SELECT neighborhood, count(*) AS n, {_ACCS}, {_INACC} FROM deviations GROUP BY 1", ("predictions",))
def accuracy_by_neighborhood(spark, sf):
    shares = [f"{m}_{kind}" for m in evaluation.MODELS for kind in ("accuracy", "inaccuracy")]
    return rounded(evaluation.accuracy_by_neighborhood(_deviations(spark, sf)), 4, *shares)


@query("deviation_outliers", "SELECT code, original_price, ohe_prediction FROM deviations WHERE ohe_deviation > 50 OR ohe_deviation < -50", ("predictions",))
def deviation_outliers(spark, sf):
    return evaluation.deviation_outliers(_deviations(spark, sf)).select("code", "original_price", "ohe_prediction")


@query("price_band_filter", "SELECT code, original_price FROM predictions WHERE original_price > 30000 AND original_price < 90000", ("predictions",))
def price_band_filter(spark, sf):
    return evaluation.price_band(predictions(spark, sf), below=90000, above=30000).select("code", "original_price")


# ---- sampling and feature studies -----------------------------------------------------------


@query(
    "sample_n",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), l_orderkey, l_linenumber, l_partkey LIMIT 500",
)
def sample_n(spark, sf):
    return selection.sample_n(dt.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), 500)


@query("feature_importance")
def feature_importance(spark, sf):
    return selection.feature_importance(training_rows(spark, sf), STUDY_FEATURES)


@query("pca_explained")
def pca_explained(spark, sf):
    return selection.pca_explained(training_rows(spark, sf), STUDY_FEATURES)


_CORR = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, price), 6) AS correlation FROM t" for c in ["price", *STUDY_FEATURES]
)


@query(
    "corr_with_price",
    f", t AS (SELECT * REPLACE (coalesce(bedrooms, rooms - 1) AS bedrooms, coalesce(antiquity, 50) AS antiquity) FROM facts WHERE neighborhood <> 'OTRO') {_CORR}",
    ("facts",),
)
def corr_with_price(spark, sf):
    return rounded(selection.corr_with(training_rows(spark, sf), ["price", *STUDY_FEATURES]), 6, "correlation")


def _feature_table(spark, names):
    return dims.constant_table(spark, [(i, n) for i, n in enumerate(names)], "position, feature")


_VARIANCE = " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS v FROM t" for c in STUDY_FEATURES)


@query(
    "low_variance_filter",
    f""", t AS (SELECT * REPLACE (coalesce(bedrooms, rooms - 1) AS bedrooms, coalesce(antiquity, 50) AS antiquity) FROM facts WHERE neighborhood <> 'OTRO'),
    v AS ({_VARIANCE}) SELECT feature FROM v WHERE v > 0.3""",
    ("facts",),
)
def low_variance_filter(spark, sf):
    return _feature_table(spark, selection.low_variance_filter(training_rows(spark, sf), STUDY_FEATURES)).select("feature")


_STUDY = """, t AS (SELECT * REPLACE (coalesce(bedrooms, rooms - 1) AS bedrooms, coalesce(antiquity, 50) AS antiquity) FROM facts WHERE neighborhood <> 'OTRO')"""
_STRENGTHS = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS feature, abs(corr({c}, price)) AS r FROM t" for i, c in enumerate(STUDY_FEATURES))


# The F-test of one feature grows with its squared correlation, so the order is that of |r|.
@query("feature_selection", f"{_STUDY}, s AS ({_STRENGTHS}) SELECT feature FROM s ORDER BY r DESC, position LIMIT 3", ("facts",))
def feature_selection(spark, sf):
    return _feature_table(spark, selection.select_features(training_rows(spark, sf), STUDY_FEATURES, share=0.5)).select("feature")


_PAIRS = [(a, b) for i, a in enumerate(STUDY_FEATURES) for b in STUDY_FEATURES[i + 1 :]]


def _collinear_sql() -> str:
    """The pairs one after the other, each step with the features gone so far."""
    sums = ", ".join([f"corr({a}, {b}) AS {a}_{b}" for a, b in _PAIRS] + [f"abs(corr({c}, price)) AS with_{c}" for c in STUDY_FEATURES])
    steps = [f"{_STUDY}, r AS (SELECT {sums} FROM t), g0 AS (SELECT CAST([] AS VARCHAR[]) AS gone)"]
    for i, (a, b) in enumerate(_PAIRS):
        settled = f"list_contains(gone, '{a}') OR list_contains(gone, '{b}') OR abs(coalesce({a}_{b}, 0)) <= 0.3"
        weaker = f"CASE WHEN coalesce(with_{a}, 0) < coalesce(with_{b}, 0) THEN '{a}' ELSE '{b}' END"
        steps.append(f"g{i + 1} AS (SELECT CASE WHEN {settled} THEN gone ELSE list_append(gone, {weaker}) END AS gone FROM g{i}, r)")
    names = ", ".join(f"('{c}')" for c in STUDY_FEATURES)
    return ", ".join(steps) + f" SELECT feature FROM (VALUES {names}) f(feature), g{len(_PAIRS)} WHERE NOT list_contains(gone, feature)"


@query("multicollinearity_filter", _collinear_sql(), ("facts",))
def multicollinearity_filter(spark, sf):
    return _feature_table(spark, selection.drop_collinear(training_rows(spark, sf), STUDY_FEATURES)).select("feature")


@query("rfe")
def rfe(spark, sf):
    return _feature_table(spark, selection.rfe(training_rows(spark, sf), STUDY_FEATURES))


@query("compare_models")
def compare_models(spark, sf):
    return selection.compare_models(training_rows(spark, sf), STUDY_FEATURES)


@query(
    "rent_range",
    "SELECT o_orderkey AS request_id, true AS scored, true AS near FROM orders JOIN customer ON o_custkey = c_custkey JOIN names ON nk = c_nationkey",
    ("names",),
)
def rent_range(spark, sf):
    """Predicted rent at both ends of the area each request names."""
    model = models.train_ohe(training_rows(spark, sf))
    found = reports.rent_range(report_requests(spark, sf), model)
    ends = F.col("rent_result_min").isNotNull() & F.col("rent_result_max").isNotNull()
    return found.select("request_id", ends.alias("scored"), (F.least("rent_result_min", "rent_result_max") > 0).alias("near"))
