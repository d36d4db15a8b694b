"""The training-data pipeline: five stages over ``documents``, each written and read again.

Toxic documents are dropped, one document of each near-duplicate class stays, documents that leak benchmark
items are dropped, secrets are blotted out, and the rest is encoded as token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import bpe, decontaminate, minhash, secret_scan, toxicity
from casewright.llm.common import remainder, stored

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, usable=remainder(F.col("doc_id"), toxicity.HELD_OUT) != 0)
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return minhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    return decontaminate.keep_unleaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the number of characters follows."""
    cleaned = secret_scan.redact(docs, secret_scan.learn_formats(docs))
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(kind))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, packed as little-endian unsigned 32-bit numbers, and what they decode to, digested."""
    return bpe.encode(docs, RANKS).select(
        "doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", blot_secrets),
    ("bpe", encode),
]

#: No stage but the last could be said in SQL; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
