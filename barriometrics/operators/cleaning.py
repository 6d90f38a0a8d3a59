"""Cleaning, imputation and outlier rules on STG rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from barriometrics import dims
from barriometrics.functions import text
from barriometrics.operators.lookups import attach
from barriometrics.operators.order_stats import quantiles
from barriometrics.schemas import NUMERIC_LISTING_COLUMNS


def union_portals(*tables: DataFrame) -> DataFrame:
    first, *others = tables
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def parse_price_text(df: DataFrame, literal: bool = False) -> DataFrame:
    """Price text to a number; ``literal`` reproduces the older reports' text replacements."""
    parse = text.price_number_literal if literal else text.price_number
    return df.withColumn("price", parse(F.col("price").cast("string")))


def coerce_numeric(df: DataFrame, columns: Sequence[str] = NUMERIC_LISTING_COLUMNS) -> DataFrame:
    """Columns to DOUBLE; text that is no number becomes NULL. DOUBLE columns stay untouched."""
    pending = [c for c in columns if not isinstance(df.schema[c].dataType, DoubleType)]
    return df.withColumns({c: F.col(c).try_cast("double") for c in pending})


def fill_garages_zero(df: DataFrame) -> DataFrame:
    return df.withColumn("garages", F.coalesce("garages", F.lit(0.0)))


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def lowercase_description(df: DataFrame) -> DataFrame:
    return df.withColumn("description", F.lower("description"))


def fill_studio(df: DataFrame) -> DataFrame:
    """A described studio has one bedroom, room and bathroom where these are unknown."""
    studio = F.contains("description", F.lit("monoambiente"))
    one = lambda c: F.when(studio & F.col(c).isNull(), 1.0).otherwise(F.col(c))
    return df.withColumns({c: one(c) for c in ("bedrooms", "rooms", "bathrooms")})


def fill_rooms_from_text(df: DataFrame) -> DataFrame:
    return df.withColumn("rooms", F.coalesce("rooms", text.rooms_in_text(F.col("description"))))


def derive_bedrooms(df: DataFrame) -> DataFrame:
    """Unknown bedrooms are the rooms less one; none counts as one."""
    known = F.coalesce(F.col("bedrooms"), F.col("rooms") - 1)
    return df.withColumn("bedrooms", F.when(known == 0, 1.0).otherwise(known))


def derive_bathrooms(df: DataFrame) -> DataFrame:
    return df.withColumn("bathrooms", F.coalesce("bathrooms", text.bathrooms_from_rooms(F.col("rooms"))))


def group_means(df: DataFrame, column: str, by: str) -> DataFrame:
    """``by`` and ``_mean``, one row per group; NULL groups are left out."""
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.avg(column).alias("_mean"))


def fill_from_mean(df: DataFrame, column: str) -> DataFrame:
    """Unknown values take ``_mean``, which goes; then every value is rounded up."""
    return df.withColumn(column, F.ceil(F.coalesce(column, "_mean")).cast("double")).drop("_mean")


def impute_group_mean(df: DataFrame, column: str, by: str) -> DataFrame:
    """Unknown values take the group's mean; then every value is rounded up.

    The mean is a partial aggregate joined back, not a window, so a hot group is never gathered.
    """
    return fill_from_mean(attach(df, group_means(df, column, by), [by]), column)


def impute_lookup(df: DataFrame, column: str, by: str) -> DataFrame:
    """Values still unknown come from the typical age of the neighbourhood, else the default."""
    ages = dims.typical_ages(df.sparkSession).withColumnRenamed("raw_neighborhood", by)
    joined = df.join(F.broadcast(ages), by, "left")
    filled = F.coalesce(F.col(column), F.col("typical_age"), F.lit(float(dims.DEFAULT_AGE)))
    return joined.withColumn(column, filled).drop("typical_age")


def min_value_filter(df: DataFrame, price: str = "price", area: str = "total_area") -> DataFrame:
    return df.filter((F.col(price) > 1000) & (F.col(area) > 10))


def iqr_bounds(df: DataFrame, column: str) -> DataFrame:
    """One row: exact quartiles and the fences 1.5 interquartile ranges outside them."""
    q = quantiles(df, F.col(column), {"q1": 0.25, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return q.select("n", "q1", "q3", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))


def iqr_outlier_filter(df: DataFrame, column: str) -> DataFrame:
    """Rows within the fences. The fences enter the filter as scalar subqueries, not as a join."""
    bounds = iqr_bounds(df, column).select(F.struct("lower", "upper").alias("b"))
    fence = bounds.scalar()
    return df.filter((F.col(column) >= fence["lower"]) & (F.col(column) <= fence["upper"]))


def iqr_fence(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    """The fences as two numbers, for rows that are written and filtered again; none where there are no rows."""
    return tuple(iqr_bounds(df, column).select("lower", "upper").first())


def within(df: DataFrame, column: str, fence: tuple[float | None, float | None]) -> DataFrame:
    """Rows inside two known fences; as plain numbers they reach the scan of a written table."""
    lower, upper = (F.lit(x).cast("double") for x in fence)
    return df.filter((F.col(column) >= lower) & (F.col(column) <= upper))


def outlier_report(df: DataFrame, column: str) -> DataFrame:
    """Rows before and after the fences, the fences and the number of outliers."""
    fence = iqr_bounds(df, column).select(F.struct("lower", "upper").alias("b")).scalar()
    fenced = df.select(F.col(column).alias("x"), fence.alias("b"))
    outside = (F.col("x") < F.col("b.lower")) | (F.col("x") > F.col("b.upper"))
    inside = (F.col("x") >= F.col("b.lower")) & (F.col("x") <= F.col("b.upper"))
    return fenced.agg(
        F.max("b.lower").alias("lower_bound"),
        F.max("b.upper").alias("upper_bound"),
        F.count_if(outside).alias("outliers"),
        F.count("*").alias("rows_before"),
        F.count_if(inside).alias("rows_after"),
    )


def neighborhood_flag(name: str) -> str:
    return f"neighborhood_{name}"


def one_hot_neighborhood(df: DataFrame, column: str = "neighborhood", values: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per value (the 19 fixed names by default); an unknown name is all zeros."""
    upper = F.upper(F.col(column))
    flags = {
        neighborhood_flag(v): F.coalesce((upper == F.lit(v)).cast("int"), F.lit(0))
        for v in (values or dims.VALID_NEIGHBORHOODS)
    }
    return df.withColumns(flags)


def stock_filters(df: DataFrame) -> DataFrame:
    """Rentals of flats and houses in the capital that state an amount and a neighbourhood."""
    return df.filter(
        F.col("MontoOperacion").isNotNull()
        & (F.col("MontoOperacion") != 0)
        & (F.col("TipoOperacion") == "Alquiler")
        & (F.col("Pais") == "Argentina")
        & (F.col("Provincia") == "Capital Federal")
        & F.col("Barrio").isNotNull()
        & F.col("TipoPropiedad").isin("Departamento", "Casa")
    )


def coalesce_area(df: DataFrame, total: str = "PropiedadSuperficieTotal", covered: str = "SuperficieCubierta") -> DataFrame:
    """Total surface, else covered surface; rows with neither, or zero, are dropped."""
    filled = df.withColumn(total, F.coalesce(total, covered))
    return filled.filter(F.col(total).isNotNull() & (F.col(total) != 0))


def rooms_from_area(df: DataFrame, rooms: str = "CantidadDormitorios", area: str = "PropiedadSuperficieTotal") -> DataFrame:
    unknown = F.col(rooms).isNull() | (F.col(rooms) == 0)
    return df.withColumn(rooms, F.when(unknown, text.rooms_from_area(F.col(area))).otherwise(F.col(rooms)))


def stock_defaults(df: DataFrame, rooms: str = "rooms") -> DataFrame:
    """Stock rows carry no bedrooms, bathrooms or garages; single-room rows get two bedrooms."""
    return df.withColumns(
        {
            "bedrooms": F.when(F.col(rooms) == 1, 2.0).otherwise(F.col(rooms) - 1),
            "bathrooms": F.lit(1),
            "garages": F.lit(1),
        }
    )


def price_to_pesos(df: DataFrame, amount: str = "MontoOperacion", currency: str = "Nombre", rate: float = 1225.0) -> DataFrame:
    converted: Column = F.when(F.col(currency) == "Dolares", F.col(amount) * rate).otherwise(F.col(amount))
    return df.withColumn(amount, converted)
