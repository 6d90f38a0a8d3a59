"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barriometrics.llm import (
    conversation_repair, decontaminate, host_reputation, html_extract, lattice_lm, sentencepiece_backend, simhash, spelling_groups, substring_dedup, token_counts,
    token_files, topk_search, toxicity,
)
from barriometrics.llm.model_file import ModelFile
from barriometrics.session import scratch_path

WORDS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 1
TOKEN_LIMIT = 2048
#: The rules of the URL query, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.report(table(spark, folder, "embeddings"))


def op2_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_lm.scores(table(spark, folder, "documents"), ModelFile.read(public_tokenizers.path(PIECES)))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(WORDS), scratch_path(spark, "token-cache"))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return host_reputation.judge(pages, host_reputation.outcomes_of(pages, table(spark, folder, "labels")), RULES)


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.report(table(spark, folder, "documents"), public_tokenizers.path(WORDS), END_ID)


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_backend.report(table(spark, folder, "documents"), public_tokenizers.path(PIECES))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.report(table(spark, folder, "documents"))


def op9_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.report(table(spark, folder, "pages"))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.report(table(spark, folder, "documents"))


def op12_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups.report(table(spark, folder, "documents"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.report(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_topk_search, op2_lattice_lm, op3_token_counts, op4_toxicity, op5_host_reputation, op6_token_files, op7_sentencepiece, op8_simhash,
        op9_html_extract, op10_decontaminate, op11_substring_dedup, op12_spelling_groups,
        op13_conversation_repair,
    )
}

ORACLES: dict[str, str] = {
    "op1_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10""",
}
