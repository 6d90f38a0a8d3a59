"""Result pages that arrive while a crawl runs, turned into RAW listing rows as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from barriometrics.operators.extract import extract_cards


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New page files (url, html) of a folder, as a stream."""
    return spark.readStream.schema("url STRING, html STRING").parquet(folder)


def write_cards(pages: DataFrame, portal: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends every card once. Repeats of a listing are left to ``crawl.first_per_code`` over the
    finished crawl: they can be days apart, so no watermark could bound that state."""
    return (
        extract_cards(pages, portal)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
