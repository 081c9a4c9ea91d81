"""From documents to token ids: toxicity, near-dedup, secrets, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; run() writes each stage's rows as Parquet into the shared folder and
reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codemap_spark.llm import bpe, minhash_dedup, mixing, secret_scan, toxicity
from codemap_spark.llm.queries import tokenizer_json
from codemap_spark.llm.scratch import arrow_batches, materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted to be toxic; labels teach, they never decide on a document."""
    arrow_batches(spark)
    return toxicity.clean(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    arrow_batches(spark)
    return minhash_dedup.keep_one(spark, docs, k=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the values of secrets; no document goes."""
    arrow_batches(spark)
    return secret_scan.redact(docs, length_col="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source comes near its target of words."""
    return mixing.mixed(spark, docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text and decodes it back: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    arrow_batches(spark)
    return bpe.digests(spark, docs, tokenizer_json())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the learned lexicon nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(spark, docs, name)
    return docs
