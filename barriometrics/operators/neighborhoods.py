"""Free-text neighbourhood names to the 19 reported ones."""

from __future__ import annotations

from difflib import get_close_matches

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from barriometrics import dims
from barriometrics.operators.lookups import attach


@F.pandas_udf(T.StringType())
def closest_valid_name(names: pd.Series) -> pd.Series:
    """The most similar reported name, or the unmapped mark below the cutoff."""
    def closest(name: str | None) -> str | None:
        if name is None:
            return None
        found = get_close_matches(name, dims.VALID_NEIGHBORHOODS, n=1, cutoff=dims.FUZZY_CUTOFF)
        return found[0] if found else dims.UNMAPPED

    return names.map(closest)


def name_mapping(df: DataFrame, column: str, long_aliases: bool = True) -> DataFrame:
    """``column`` -> ``_mapped`` for each distinct name: alias first, then the closest reported name."""
    distinct = df.select(column).dropna().distinct().withColumn("alias", F.upper(F.col(column)))
    known = distinct.join(F.broadcast(dims.aliases(df.sparkSession, long_aliases)), "alias", "left")
    direct = known.filter(F.col("canonical").isNotNull()).select(column, F.col("canonical").alias("_mapped"))
    # Names are short, so merged shuffle partitions would hand them all to one Python worker.
    cores = df.sparkSession.sparkContext.defaultParallelism
    unknown = known.filter(F.col("canonical").isNull()).repartition(cores, column)
    fuzzy = unknown.select(column, closest_valid_name("alias").alias("_mapped"))
    return direct.unionByName(fuzzy)


def map_neighborhood(
    df: DataFrame, column: str = "neighborhood", into: str = "neighborhood", long_aliases: bool = True
) -> DataFrame:
    """Adds or replaces ``into``. Python sees each distinct name once; rows meet it by a lookup join."""
    names = name_mapping(df, column, long_aliases)
    return attach(df, names, [column]).withColumn(into, F.col("_mapped")).drop("_mapped")


def drop_unmapped(df: DataFrame, column: str = "neighborhood") -> DataFrame:
    return df.filter(F.col(column) != dims.UNMAPPED)
