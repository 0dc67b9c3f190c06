"""A training-corpus pipeline over `documents`: each stage applies one operator to all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it back for the next one. A null text counts as empty. Empty input gives empty output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leanprompt.llm import bpe, decontaminate, pii, quality, simhash
from leanprompt.llm.common import keep, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labelled rows of docs outside its held-out fold."""
    net = quality.train(spark, docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(s):
        return s.map(shared.value.score)

    return docs.where(score(F.coalesce("text", F.lit(""))) >= 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    found = keep(decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti")


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("pii", redacted), ("bpe", tokenised)]
#: Fitted models and fingerprints are beyond SQL; tests/llm holds the pipeline against its operators' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs)
    return docs
