"""Reading snapshot files and key-value exports with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from barriometrics import schemas
from barriometrics.operators.snapshots import snapshot_date


def spread(scan: DataFrame) -> DataFrame:
    """A file scan with fewer splits than cores, dealt out before per-row text work.

    Large inputs have more splits than cores and pass unchanged, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def scan_raw_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.RAW_Z, with_date: bool = False) -> DataFrame:
    """Snapshot CSV files with header; descriptions may hold line breaks and quotes.

    ``with_date`` adds the snapshot date from each file's name.
    """
    df = (
        spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    )
    return df.withColumn("snapshot_date", snapshot_date(F.col("_metadata.file_path"))) if with_date else df


def parse_feature_list(df: DataFrame) -> DataFrame:
    """Portal A CSV files hold features as a list literal text; it becomes an array of strings."""
    inner = F.regexp_extract("features", r"^\s*\[(.*)\]\s*$", 1)
    items = F.regexp_extract_all(inner, F.lit(r"'([^']*)'|\"([^\"]*)\""), 0)
    return df.withColumn(
        "features",
        F.when(F.col("features").isNotNull(), F.transform(items, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))),
    )


def scan_kv_items(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Key-value items, one JSON object ``{column: {type: value}}`` per line, as flat text rows."""
    lines = spark.read.text(path)
    item = F.from_json("value", schemas.KV_ITEM)
    return lines.select(item.alias("item")).select(
        *[F.try_element_at(F.map_values(F.col("item")[c]), F.lit(1)).alias(c) for c in columns]
    )


def scan_historic(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HISTORIC).option("header", True).csv(path)
