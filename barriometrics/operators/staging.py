"""RAW listing texts to typed STG rows. Everything here is a projection or a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barriometrics.functions import text
from barriometrics.schemas import STG_COLUMNS


def split_location(df: DataFrame) -> DataFrame:
    """``location`` 'neighbourhood, city' to two columns; further parts are not kept."""
    return df.select(
        "*",
        text.part(F.col("location"), ",", 1).alias("neighborhood"),
        text.part(F.col("location"), ",", 2).alias("city"),
    )


def split_price(df: DataFrame) -> DataFrame:
    """``price`` 'CUR amount' to ``currency`` and ``amount``."""
    return df.select(
        "*",
        text.part(F.col("price"), " ", 1).alias("currency"),
        text.part(F.col("price"), " ", 2).alias("amount"),
    )


def priced_z(amount: Column) -> Column:
    return ~F.trim(amount).eqNullSafe("precio")


def priced_a(amount: Column) -> Column:
    return amount.isNotNull() & (amount != "None")


def _typed(df: DataFrame, code: str) -> DataFrame:
    keep = [c for c in ("created_at", "updated_at", "snapshot_date") if c in df.columns]
    return df.select(code, *STG_COLUMNS, *keep)


def stage_z(raw: DataFrame, usd_rate: float) -> DataFrame:
    """RAW of portal Z to STG: location, price in pesos, features; age is not published there."""
    features = F.col("features")
    df = split_price(raw).filter(priced_z(F.col("amount")))
    df = df.withColumns(
        {
            "price": text.to_pesos(F.col("currency"), F.col("amount"), F.lit(usd_rate)),
            "expenses": text.expenses_z(F.col("expenses")),
            "neighborhood": text.part(F.col("location"), ",", 1),
            "location": text.part(F.col("location"), ",", 2),
            **{name: text.feature_z(features, name) for name in text.FEATURE_PATTERNS},
            "antiquity": F.lit(None).cast("double"),
        }
    )
    return _typed(df, "zonaprop_code")


def stage_a(raw: DataFrame, usd_rate: float) -> DataFrame:
    """RAW of portal A to STG: features are a list, garages are not published there."""
    items = F.col("features")
    df = split_price(raw).filter(priced_a(F.col("amount")))
    df = df.withColumns(
        {
            "price": text.to_pesos(F.col("currency"), F.col("amount"), F.lit(usd_rate)),
            "expenses": text.expenses_a(F.col("expenses")),
            "neighborhood": text.neighborhood_of_listing_a(F.col("location")),
            "location": F.lit(text.CITY),
            "total_area": text.try_double(text.area_a(items)),
            "rooms": text.try_double(text.rooms_a(items)),
            "bedrooms": text.try_double(text.bedrooms_a(items)),
            "bathrooms": text.try_double(text.bathrooms_a(items)),
            "garages": F.lit(None).cast("double"),
            "antiquity": text.try_double(text.antiquity_a(items)),
        }
    )
    return _typed(df, "argenprop_code")


def null_column(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast("double"))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Projects columns away; names the table does not have are ignored."""
    return df.drop(*names)


def stamp_audit_dates(df: DataFrame, run_date: str | None = None) -> DataFrame:
    """``created_at`` and ``updated_at`` as yyyy-MM-dd texts of the run date (today by default)."""
    day = F.current_date() if run_date is None else F.lit(run_date).cast("date")
    stamp = F.date_format(day, "yyyy-MM-dd")
    return df.withColumns({"created_at": stamp, "updated_at": stamp})


def cast_all_string(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
