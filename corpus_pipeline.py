"""A corpus pipeline: documents in, tokens out. Each stage works on all that the one before it kept.

toxicity drops the documents that the scorer rejects; lines takes repeated lines out; near_duplicates keeps one document of
each group; decontamination drops contaminated documents; tokens encodes what is left. All but the last stage return the
columns of documents (n_chars follows the text).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import bpe, decontam, lines, omh, toxicity
from emberline.llm.common import read, written

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.deduplicated(docs, exact_words=1)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return omh.deduplicated(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text's bytes back."""
    ids = docs.select("doc_id", "text", bpe.encode(F.col("text"), BYTE_BPE, public_tokenizers.PATTERN).alias("ids"))
    decoded = bpe.decode(F.col("ids"), BYTE_BPE, public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (decoded == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Learnt scores, sketches and merges have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
