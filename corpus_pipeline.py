"""From raw documents to token ids, in four stages; each works on all that the one before it kept.

1. toxicity: documents that the factorization machine rejects go;
2. simhash: of each group of near-duplicates (SimHash of four-word shingles, at most 4 differing bits) one document stays;
3. decontamination: documents that hold a benchmark passage go;
4. sentencepiece: the rest is encoded, with parity and round trip checked.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barriometrics.llm import decontaminate, sentencepiece_backend, simhash, toxicity
from barriometrics.llm.queries import PIECES, table
from barriometrics.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, parity, round_trip."""
    found = sentencepiece_backend.encode(docs, public_tokenizers.path(PIECES), carry=["doc_id"])
    return found.select("row.*", "encoded.*")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
#: The fitted classifier, the fingerprints and the encoder are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
