"""Joining a derived per-key table back to a large table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from barriometrics.session import materialise

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 2**20
#: Rows of one key beyond which the key is dealt over several tasks.
HOT_KEY_ROWS = 100_000
SALTS = 64


def attach(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Join ``small`` (unique on ``on``) to ``big`` without gathering a hot key in one task.

    ``small`` is written out and measured first. Up to ``broadcast_rows`` rows and 64 MB of text it is
    broadcast, so ``big`` is not shuffled at all. Beyond that both sides are hashed on the key and never
    broadcast, whatever their files' sizes promise. Keys with very many rows, counted first, are dealt by a
    salt taken from the map partition of ``big``, and only their rows of ``small`` are repeated; rows without
    a key, which meet none, are dealt over ``SALTS``. ``stored`` says that ``small`` already is a written table.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    if not stored:
        small = materialise(small, "lookup")
    width = F.sum(F.octet_length(F.to_json(F.struct(*small.columns))))
    size = small.agg(F.count("*").alias("rows"), F.coalesce(width, F.lit(0)).alias("bytes")).first()
    if size["rows"] <= broadcast_rows and size["bytes"] <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    counts = big.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_KEY_ROWS)
    hot = F.broadcast(materialise(counts.select(*on, F.ceil(F.col("_n") / HOT_KEY_ROWS).cast("int").alias("_salts")), "hot-keys"))
    salts = F.coalesce("_salts", F.lit(1))
    keyless = reduce(or_, [F.col(c).isNull() for c in on])
    dealt = F.spark_partition_id() % F.when(keyless, F.lit(SALTS)).otherwise(salts)
    salted_big = big.join(hot, on, "left").withColumn("_salt", dealt).drop("_salts")
    salted_small = small.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted_big.join(salted_small.hint("merge"), [*on, "_salt"], how).drop("_salt")
