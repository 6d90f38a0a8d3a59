"""How close predictions are to asking prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barriometrics import dims

MODELS = ("simple", "ohe", "neighborhood")
BIN_EDGES = (-50, -40, -30, -20, -10, 0, 10, 20, 30, 40, 50)


def evaluate(df: DataFrame, label: str = "price", prediction: str = "prediction") -> DataFrame:
    """Row count, root mean squared error and R² in one pass."""
    error = F.col(label) - F.col(prediction)
    sums = df.agg(
        F.count("*").alias("n"), F.sum(error * error).alias("sse"), F.var_pop(label).alias("variance")
    )
    return sums.select(
        "n",
        F.sqrt(F.try_divide("sse", "n")).alias("rmse"),
        (1 - F.try_divide(F.col("sse"), F.col("variance") * F.col("n"))).alias("r2"),
    )


def deviation(prediction: Column, actual: Column) -> Column:
    return F.try_divide(prediction - actual, actual) * 100


def with_deviations(df: DataFrame, actual: str = "original_price", models: Sequence[str] = MODELS) -> DataFrame:
    """Adds each model's deviation in percent of the asking price."""
    return df.withColumns({f"{m}_deviation": deviation(F.col(f"{m}_prediction"), F.col(actual)) for m in models})


def deviation_position(value: Column) -> Column:
    """Index of the right-closed deviation class, NULL for NULL."""
    position = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(BIN_EDGES):
        position = position.when(value <= edge, i)
    return position.otherwise(len(BIN_EDGES))


def with_categories(df: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in dims.DEVIATION_LABELS])
    return df.withColumns(
        {f"{m}_dev_category": F.try_element_at(labels, deviation_position(F.col(f"{m}_deviation")) + 1) for m in models}
    )


def deviation_bins(df: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """Rows per deviation class and model, empty classes included, in class order.

    Rows are first folded to the few combinations of classes, so each is classified once per model.
    """
    positions = [deviation_position(F.col(f"{m}_deviation")).alias(m) for m in models]
    folded = df.groupBy(*positions).agg(F.count("*").alias("n"))
    counts = folded.agg(
        *[
            F.coalesce(F.sum(F.when(F.col(m) == i, F.col("n"))), F.lit(0)).alias(f"{m}_{i}")
            for m in models
            for i in range(len(dims.DEVIATION_LABELS))
        ]
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("dev_category"),
            *[F.col(f"{m}_{i}").alias(f"{m}_count") for m in models],
        )
        for i, name in enumerate(dims.DEVIATION_LABELS)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _within(model: str, limit: float) -> Column:
    """Share of rows within the limit; a missing deviation counts as a miss."""
    hit = F.coalesce((F.abs(f"{model}_deviation") <= limit).cast("int"), F.lit(0))
    return (F.avg(hit) * 100).alias(f"{model}_accuracy")


def accuracy(df: DataFrame, limit: float = 30, models: Sequence[str] = MODELS) -> DataFrame:
    return df.agg(*[_within(m, limit) for m in models])


def accuracy_by_neighborhood(df: DataFrame, limit: float = 30, models: Sequence[str] = MODELS) -> DataFrame:
    shares = df.groupBy("neighborhood").agg(F.count("*").alias("n"), *[_within(m, limit) for m in models])
    return shares.select(
        "*", *[(100 - F.col(f"{m}_accuracy")).alias(f"{m}_inaccuracy") for m in models]
    )


def deviation_outliers(df: DataFrame, model: str = "ohe", limit: float = 50) -> DataFrame:
    return df.filter(F.abs(f"{model}_deviation") > limit)


def price_band(df: DataFrame, below: float, above: float | None = None, price: str = "original_price") -> DataFrame:
    kept = df.filter(F.col(price) < below)
    return kept if above is None else kept.filter(F.col(price) > above)
