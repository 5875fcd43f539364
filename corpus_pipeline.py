"""A corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

1. language: documents without a known language (no letter, or no language at half the probability) go.
2. near_duplicates: one document of each SimHash component stays, the one of the smallest id.
3. decontaminate: documents that hold a word window of a benchmark item go.
4. secrets: every secret is replaced by a mark in the text, and n_chars follows.
5. encode: SentencePiece ids of each text, with their number and whether they decode to it.

Defined cases are those of the operators; empty tables go through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import decontaminate, langid, secrets, sentencepiece_codec, simhash
from readloom.llm.common import fold, materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.train(docs.filter(fold("doc_id", 3) != 1)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redacted(docs, secrets.train(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.verified(docs, sentencepiece_codec.load())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("encode", encoded),
]

#: SQL can express neither the models nor the fingerprints; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, f"stage-{name}")
    return docs
