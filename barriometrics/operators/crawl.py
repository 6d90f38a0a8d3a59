"""Rules on crawled result pages: stop conditions, de-duplication, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barriometrics.functions import text
from barriometrics.operators.lookups import attach

PAGES_PER_RANGE = 1000


def with_previous(df: DataFrame, group: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """``value`` of the row before within ``group`` by the integer ``order``.

    A long group is cut into ranges of ``order``: each range looks back on its own and only the
    first row of a range asks the table of range ends.
    """
    keys = list(group)
    ranged = df.withColumn("_range", F.floor(F.col(order) / PAGES_PER_RANGE))
    here = Window.partitionBy(*keys, "_range").orderBy(order)
    ends = ranged.groupBy(*keys, "_range").agg(F.max_by(F.struct(value), order).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_range")))
    ranged = ranged.withColumn("_lag", F.lag(F.struct(value)).over(here))
    joined = ranged.join(ends.drop("_end"), [*keys, "_range"], "left")
    return joined.withColumn(name, F.coalesce("_lag", "_before")[value]).drop("_range", "_lag", "_before")


def repeated_pages(pages: DataFrame) -> DataFrame:
    """Flags pages whose non-empty id set equals the set of the page before in the same crawl.

    ``repeated`` marks the page, ``stops`` the second repeat in a row, where the crawl ends.
    """
    seen = with_previous(pages, ["barrio"], "page", "ids", "previous")
    seen = seen.withColumn(
        "repeated", F.coalesce((F.size("ids") > 0) & (F.col("ids") == F.col("previous")), F.lit(False))
    ).drop("previous")
    seen = with_previous(seen, ["barrio"], "page", "repeated", "previous")
    return seen.withColumn("stops", F.col("repeated") & F.coalesce("previous", F.lit(False))).drop("previous")


def past_the_end(page: Column, final_url: Column) -> Column:
    """A page after the first whose final address names an earlier page, or none, is past the end."""
    shown = text.page_number(final_url)
    return (page > 1) & (shown.isNull() | (shown < page))


def keep_before_stop(pages: DataFrame, stop: Column) -> DataFrame:
    """Pages of each crawl before its first page where ``stop`` holds."""
    cuts = pages.filter(stop).groupBy("barrio").agg(F.min("page").alias("cut"))
    joined = attach(pages, cuts, ["barrio"])
    return joined.filter(F.col("cut").isNull() | (F.col("page") < F.col("cut"))).drop("cut")


def first_per_code(df: DataFrame, code: str, order: Sequence[str]) -> DataFrame:
    """Keeps the first row per listing code by ``order``, then by the remaining columns.

    A minimum over the row folds copies on the map side, so one hot code does not fill a task.
    """
    rest = [c for c in df.columns if c != code and c not in order]
    row = F.struct(*order, *rest)
    kept = df.groupBy(code).agg(F.min(row).alias("_row"))
    return kept.select(*[F.col(code) if c == code else F.col(f"_row.{c}").alias(c) for c in df.columns])


def latest_per_code(df: DataFrame, code: str, loaded_at: str) -> DataFrame:
    """Keeps the last written row per listing code; equal times fall to the greater row."""
    rest = [c for c in df.columns if c not in (code, loaded_at)]
    kept = df.groupBy(code).agg(F.max(F.struct(loaded_at, *rest)).alias("_row"))
    return kept.select(*[F.col(code) if c == code else F.col(f"_row.{c}").alias(c) for c in df.columns])


def dedup_report(df: DataFrame, code: str) -> DataFrame:
    """Row count before and after keeping one row per code (a missing code counts as one)."""
    per_code = df.groupBy(code).agg(F.count("*").alias("n"))
    return per_code.agg(F.sum("n").alias("rows_before"), F.count("*").alias("rows_after"))


def fix_code_column(df: DataFrame) -> DataFrame:
    """Portal A files written under the other portal's code name get the right one."""
    return df.withColumnRenamed("zonaprop_code", "argenprop_code")
