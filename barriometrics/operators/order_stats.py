"""Exact order statistics and quantiles without gathering a group in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in one buffer. Here values
are first counted, which folds repeats before the shuffle. A coarse monotone bucket of the value
(a bounded number per group, whatever the row count) then tells which bucket holds each wanted
rank. A bucket that holds one is cut again into equal steps between its own least and greatest value,
so a nearly constant column spreads as well, and only the values of the steps with a wanted rank are ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

RankOf = Callable[[Column], Column]
BUCKETS_PER_DECADE = 2048
#: Decades below 1 that a double reaches.
SMALLEST_DECADE = 330
STEPS = 4096


def _bucket(value: Column) -> Column:
    magnitude = F.floor((F.log10(F.abs(value)) + SMALLEST_DECADE) * BUCKETS_PER_DECADE)
    return F.when(value < 0, -magnitude).when(value > 0, magnitude).otherwise(F.lit(0).cast("long"))


def _step(value: Column, low: Column, high: Column) -> Column:
    width = high - low
    even = (high > low) & (width < F.lit(float("inf")))
    return F.when(even, F.floor((value - low) / width * STEPS)).otherwise(F.lit(0).cast("long"))


def _held(wanted: Column, upto: Column, weight: Column) -> Column:
    """The wanted ranks that fall inside (upto - weight, upto], counted from there."""
    before = upto - weight
    return F.transform(
        F.filter(wanted, lambda s: (s.r > before) & (s.r <= upto)),
        lambda s: F.struct(s.stat.alias("stat"), (s.r - before).alias("r")),
    )


def order_statistics(
    df: DataFrame, value: Column, ranks: Mapping[str, RankOf], by: Sequence[str] = ()
) -> DataFrame:
    """One row per group: ``by``, ``n`` and for each name the value at that 1-based rank.

    ``ranks`` maps an output name to a function of the group's row count. A rank outside 1..n
    gives NULL. NULL and NaN values and NULL groups are left out.
    """
    keys = list(by)
    group = keys or [F.lit(0)]
    counted = (
        df.select(*keys, value.cast("double").alias("v"))
        .dropna()
        .groupBy(*keys, "v")
        .agg(F.count("*").alias("w"))
        .withColumn("bucket", _bucket(F.col("v")))
    )
    n = F.col("n")
    wanted = F.array(
        *[F.struct(F.lit(name).alias("stat"), rank(n).cast("long").alias("r")) for name, rank in ranks.items()]
    )
    running = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = (
        counted.groupBy(*keys, "bucket")
        .agg(F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("high"))
        .select(
            *keys, "bucket", "w", "low", "high",
            F.sum("w").over(running).alias("upto"),
            F.sum("w").over(Window.partitionBy(*group)).alias("n"),
        )
        .select(*keys, "bucket", "n", "low", "high", _held(wanted, F.col("upto"), F.col("w")).alias("wanted"))
    )
    # The first bucket always stays, by one row, so that n is reported even where no rank lies inside 1..n.
    first = F.col("bucket") == F.min("bucket").over(Window.partitionBy(*group))
    buckets = buckets.withColumn("_first", first).filter((F.size("wanted") > 0) | F.col("_first")).drop("_first")
    part = [*keys, "bucket", "step"]
    values = (
        counted.join(buckets, [*keys, "bucket"])
        .filter((F.size("wanted") > 0) | (F.col("v") == F.col("low")))
        .withColumn("step", _step(F.col("v"), F.col("low"), F.col("high")))
    )
    running = Window.partitionBy(*keys, "bucket").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = (
        values.groupBy(*part)
        .agg(F.sum("w").alias("w"), F.first("wanted").alias("wanted"))
        .withColumn("upto", F.sum("w").over(running))
        .select(*part, (F.size("wanted") == 0).alias("_first"), _held(F.col("wanted"), F.col("upto"), F.col("w")).alias("wanted"))
        .filter((F.size("wanted") > 0) | F.col("_first"))
        .drop("_first")
    )
    within = Window.partitionBy(*part).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = (
        values.select(*part, "n", "v", "w")
        .join(steps, part)
        .withColumn("upto", F.sum("w").over(within))
        .withColumn("held", _held(F.col("wanted"), F.col("upto"), F.col("w")))
    )
    found = [
        F.max(F.when(F.array_contains(F.col("held.stat"), name), F.col("v"))).alias(name) for name in ranks
    ]
    return values.groupBy(*keys).agg(F.max("n").alias("n"), *found)


def quantiles(df: DataFrame, value: Column, probabilities: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated exact quantiles: ``by``, ``n`` and one column per name."""
    ranks: dict[str, RankOf] = {}
    for name, p in probabilities.items():
        ranks[f"{name}_lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(p)) + 1
        ranks[f"{name}_hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p)) + 1
    stats = order_statistics(df, value, ranks, by)
    columns = []
    for name, p in probabilities.items():
        position = (F.col("n") - 1) * F.lit(p)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        columns.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return stats.select(*by, "n", *columns)
