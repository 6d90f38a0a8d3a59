"""Rent-price models: training, storage, input checks and batch scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barriometrics import dims
from barriometrics.operators import boosting
from barriometrics.operators.boosting import BoostedTrees
from barriometrics.operators.cleaning import neighborhood_flag, one_hot_neighborhood

FEATURES = ("total_area", "rooms", "bedrooms", "antiquity")
FLAGS = tuple(neighborhood_flag(n) for n in dims.VALID_NEIGHBORHOODS)
TRAIN_SHARE = 0.7

# The tuned boosting parameters.
GBT_PARAMS = {
    "maxIter": 1000, "stepSize": 0.01, "maxDepth": 9, "subsamplingRate": 0.5,
    "featureSubsetStrategy": "log2", "minInstancesPerNode": 2, "minInstancesToSplit": 5, "seed": 5, "maxBins": boosting.MAX_BINS,
}


def split_side(key: Column, train_share: float = TRAIN_SHARE, seed: str = "") -> Column:
    """'train' or 'test' by a digest of the row's key: stable under retries and repartitioning."""
    edge = f"{int(train_share * 2**32):08x}"
    digest = F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed))), 1, 8)
    return F.when(digest < edge, F.lit("train")).otherwise(F.lit("test"))


def train_test_split(df: DataFrame, key: str, train_share: float = TRAIN_SHARE, seed: str = "") -> DataFrame:
    return df.withColumn("split", split_side(F.col(key), train_share, seed))


def _params(params: Mapping[str, object] | None) -> dict[str, object]:
    unknown = set(params or {}) - set(GBT_PARAMS)
    if unknown:
        raise ValueError(f"unknown boosting parameters: {sorted(unknown)}")
    return {**GBT_PARAMS, **(params or {})}


def train_simple(df: DataFrame, label: str = "price", params: Mapping[str, object] | None = None) -> BoostedTrees:
    return boosting.fit(df, FEATURES, label, _params(params))["all"]


def train_ohe(df: DataFrame, label: str = "price", params: Mapping[str, object] | None = None) -> BoostedTrees:
    """As ``train_simple`` with one 0/1 flag per reported neighbourhood."""
    return boosting.fit(one_hot_neighborhood(df), (*FEATURES, *FLAGS), label, _params(params))["all"]


def train_per_neighborhood(df: DataFrame, label: str = "price", params: Mapping[str, object] | None = None) -> dict[str, BoostedTrees]:
    """One model for each reported neighbourhood that has rows, all fitted side by side from one fold."""
    known = F.when(F.col("neighborhood").isin(*dims.VALID_NEIGHBORHOODS), F.col("neighborhood"))
    return boosting.fit(df, FEATURES, label, _params(params), known)


def integer_features(df: DataFrame) -> DataFrame:
    """Features truncated to whole numbers, as the scoring inputs carry them."""
    missing = [c for c in FEATURES if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.withColumns({c: F.col(c).cast("bigint").cast("double") for c in FEATURES})


def predict_simple(df: DataFrame, model: BoostedTrees, into: str = "simple_prediction") -> DataFrame:
    """Every row comes back; one that lacks a feature has a NULL prediction."""
    return boosting.score(integer_features(df), {"all": model}, into)


def predict_ohe(df: DataFrame, model: BoostedTrees, into: str = "ohe_prediction") -> DataFrame:
    """Scores with the fixed flags; an unknown neighbourhood has none set."""
    return boosting.score(one_hot_neighborhood(integer_features(df)), {"all": model}, into).drop(*FLAGS)


def predict_by_neighborhood(
    df: DataFrame, models: Mapping[str, BoostedTrees], into: str = "neighborhood_prediction"
) -> DataFrame:
    """Each row is scored by its neighbourhood's model; rows without a model keep a NULL prediction."""
    return boosting.score(integer_features(df), models, into, F.upper("neighborhood"))


def save_model(model: BoostedTrees, root: str, family: str, trained_on: str) -> str:
    """Stores a model under its family and training date (yyyy-MM-dd)."""
    path = f"{root}/family={family}/date={trained_on}"
    boosting.save(SparkSession.active(), model, path)
    return path


def load_latest_model(spark: SparkSession, root: str, family: str) -> BoostedTrees:
    """The family's model with the latest training date."""
    try:
        stored = spark.read.parquet(f"{root}/family={family}/date=*")
    except AnalysisException as missing:
        raise ValueError(f"no model of family {family}") from missing
    dates = F.regexp_extract(F.col("_metadata.file_path"), r"/date=(\d{4}-\d{2}-\d{2})/", 1)
    newest = stored.agg(F.max(dates)).first()[0]
    return boosting.load(spark, f"{root}/family={family}/date={newest}")


def validate_requests(df: DataFrame, fields: Sequence[str] = FEATURES) -> DataFrame:
    """Adds ``error``: the first failed check of a text request, NULL for a usable one."""
    checks: list[Column] = [F.when(F.col("neighborhood").isNull(), F.lit("neighborhood: must be a string"))]
    for name in fields:
        value = F.col(name).cast("string")
        checks.append(F.when(value.isNull(), F.lit(f"{name}: missing")))
        checks.append(F.when(~value.rlike(r"^-?\d+$"), F.lit(f"{name}: must be an integer")))
    return df.withColumn("error", F.coalesce(*checks))
