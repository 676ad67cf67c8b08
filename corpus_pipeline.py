"""The corpus pipeline: toxicity, near-duplicates, secrets, mix, token ids.

STAGES are applied in order; run() writes each stage's rows to the shared folder and reads them
again, so a later stage never repeats an earlier one. All stages but the last return the
columns of documents.

- toxicity: documents whose score reaches the threshold of their language go.
- near_duplicates: one document of each group of near-duplicates stays (five-word shingles).
- secrets: every span of a secret is replaced in the text; no document goes.
- mixture: each source's rows are taken as often as its target weight says (0 to 2 times).
- tokens: token ids of every document, with an end id, and digests of ids and decoded text.

Nulls, ties and odd tables: any column may be null; a null text counts as an empty one in every stage, a null language or source as a
value of its own. All texts without words are near-duplicates of each other, so one of them stays. Of rows that repeat wholly one
stays, of near-duplicates the one with the smallest doc_id (null ids last, then by the text's MD5). Texts of any length are
processed whole. Columns besides those of documents are carried along by all stages but the last, and may have any names that don't begin with two
underscores. An empty table gives an empty result.

SQL can't express the toxicity and near-duplicate stages, so ORACLE_SQL is None; tests hold each
stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia import shipping
from marginalia.llm import mixing, pieces, secret_scan, simhash, toxicity
from marginalia.llm.common import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipping.ship(spark)
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipping.ship(spark)
    return simhash.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipping.ship(spark)
    return secret_scan.redact(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, cap=2)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipping.ship(spark)
    return pieces.encoded(docs, ["doc_id", "lang", "source"])


STAGES = [("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage), ("mixture", mixture_stage), ("tokens", token_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
