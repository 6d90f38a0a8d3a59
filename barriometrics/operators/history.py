"""Price history series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EXCLUDED_TYPES = ("Oficina", "Local")


def monthly_series(historic: DataFrame, value: str, run_date: str, months: int = 12) -> DataFrame:
    """Mean of ``value`` by month and neighbourhood without offices and shops, last ``months`` months.

    Months are ISO texts, so the cut is compared as text and reaches the scan.
    """
    cut = F.date_format(F.add_months(F.lit(run_date).cast("date"), -months), "yyyy-MM")
    kept = historic.filter(~F.col("Inmueble").isin(*EXCLUDED_TYPES) & (F.col("Mes") >= cut))
    return (
        kept.groupBy("Mes", "Barrio")
        .agg(F.avg(value).alias("mean_value"))
        .select(F.to_date("Mes", "yyyy-MM").alias("month"), F.col("Barrio").alias("neighborhood"), "mean_value")
    )


def price_m2_series(historic: DataFrame, run_date: str) -> DataFrame:
    return monthly_series(historic, "mediana_por_m2", run_date)


def price_series(historic: DataFrame, run_date: str) -> DataFrame:
    return monthly_series(historic, "mediana_precio", run_date)
