"""Comparing dated snapshots of the same listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barriometrics.operators.lookups import attach


def snapshot_date(path: Column) -> Column:
    """Date of a file named ``..._DDMMYYYY.csv``."""
    return F.try_to_date(F.nullif(F.regexp_extract(path, r"_(\d{8})\.csv$", 1), F.lit("")), "ddMMyyyy")


def snapshot_month(path: Column) -> Column:
    """First day of the month of a file named ``...YYYYMM.xlsx``."""
    return F.try_to_date(F.nullif(F.regexp_extract(path, r"(\d{6})\.xlsx$", 1), F.lit("")), "yyyyMM")


def latest_snapshots(df: DataFrame, n: int, source: str = "source", date: str = "snapshot_date") -> DataFrame:
    """Rows of the newest ``n`` snapshots of each source.

    Dates are ranked on the distinct (source, date) pairs, a table as small as the list of files.
    Joined back by broadcast it prunes date folders at run time, and rows are not shuffled on the
    few dates.
    """
    dates = df.select(source, date).dropna().distinct()
    newest = dates.withColumn("_rank", F.row_number().over(Window.partitionBy(source).orderBy(F.desc(date))))
    return attach(df, newest.filter(F.col("_rank") <= n).drop("_rank"), [source, date], "left_semi")


def code_presence(old: DataFrame, new: DataFrame, code: str = "code", by: Sequence[str] = ()) -> DataFrame:
    """Rows per (``by``, code) in each snapshot. One hash aggregate over both, no join."""
    keys = [*by, code]
    both = old.select(*keys, F.lit(0).alias("_new")).unionByName(new.select(*keys, F.lit(1).alias("_new")))
    return both.groupBy(*keys).agg(
        F.count_if(F.col("_new") == 0).alias("n_old"), F.count_if(F.col("_new") == 1).alias("n_new")
    )


def citywide(presence: DataFrame, code: str = "code") -> DataFrame:
    """The presence per code whatever its neighbourhood, from the table per neighbourhood and code."""
    return presence.groupBy(code).agg(F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"))


def change_counts(presence: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and distinct codes that are only in the new or only in the old snapshot."""
    added, gone = F.col("n_old") == 0, F.col("n_new") == 0
    zero = F.lit(0)
    return presence.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(added, F.col("n_new"))), zero).alias("new_rows"),
        F.coalesce(F.sum(F.when(gone, F.col("n_old"))), zero).alias("removed_rows"),
        F.count_if(added).alias("new_codes"),
        F.count_if(gone).alias("removed_codes"),
        F.count_if(F.col("n_old") > 0).alias("old_codes"),
        F.count_if(F.col("n_new") > 0).alias("all_new_codes"),
    )


def only_in(left: DataFrame, right: DataFrame, code: str = "code", by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``left`` whose code ``right`` does not hold (within ``by``).

    The right side is one row per key; a hot code on the left is split by the skew-join rule.
    """
    keys = [*by, code]
    return left.join(right.select(*keys).distinct(), keys, "left_anti")
