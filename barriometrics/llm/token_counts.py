"""Token counts through a digest cache.

The cache is a table of (content digest, tokens) in a folder for each tokenizer version. Texts are joined
to it by digest, each distinct text that it lacks is encoded once, and the new counts are appended. The
digest is that of the normalised content: white-space runs become one space where the tokenizer drops
white space. Copies fold on the map side before the shuffle, so a text that fills a third of the corpus
is sent once from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barriometrics.llm import arrow_text
from barriometrics.llm.encoders import encoder, version
from barriometrics.session import materialise

_CACHE = "digest binary, n_tokens long"


def digest(text: Column, path: str) -> Column:
    body = F.regexp_replace(text, "[\\x09-\\x0D\\x20]+", " ") if encoder(path).by_word else text
    return F.unhex(F.sha2(body.cast("binary"), 256))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _cached(spark: SparkSession, folder: str) -> DataFrame:
    """The stored counts; a digest that two writers have appended counts once."""
    stored = spark.read.schema(_CACHE).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], _CACHE)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def add_missing(documents: DataFrame, path: str, cache: str, text: str = "text") -> str:
    """Encode each distinct text that the cache lacks once, append the counts; the version's folder."""
    spark = documents.sparkSession
    folder = f"{cache}/version={version(path)}"
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    once = documents.select(digest(body, path).alias("digest"), body.alias("text")).dropDuplicates(["digest"])
    misses = once.join(_cached(spark, folder).select("digest"), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrow_text.pieces(batch, "text"):
                counts = np.diff(encoder(path).encode_rows(piece.column("text"))[1])
                yield pa.RecordBatch.from_arrays([piece.column("digest"), pa.array(counts)], ["digest", "n_tokens"])

    misses.mapInArrow(encode, _CACHE).write.mode("append").parquet(folder)
    return folder


def token_counts(documents: DataFrame, path: str, cache: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row's whole text; the cache folder gains what it lacked.

    NULL and empty texts have 0 of both. Repeated rows each have a row. Tokens are those of the library
    without begin, end or added tokens, truncation or padding.
    """
    folder = add_missing(documents, path, cache, text)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keys = documents.select(F.col(doc_id).alias(doc_id), F.octet_length(body).cast("long").alias("n_bytes"), digest(body, path).alias("digest"))
    keys = materialise(keys, "digests")
    return keys.join(_cached(documents.sparkSession, folder), "digest").drop("digest")
