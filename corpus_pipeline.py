"""The corpus pipeline: quality rules, near-duplicates, source mix, byte-level BPE, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Cases, of every stage. Null or blank text: rejected by quality_rules, which asks for 50 words; by itself near_dedup keeps it, source_mix
never takes it and byte_bpe gives it no tokens. Null language or source: a group of its own. Null ids: never duplicates. Rows
that share an id are one document to near_dedup, which keeps one, and two to the other stages. Repeated rows and ties: as
in the operators. Very long texts: whole. Empty table: empty result. Extra columns, of any name: kept up to byte_bpe.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe, minhash, mixing, quality
from quillgraph.llm.common import ship, table, written

#: Near-duplicates by five words, as stages of a corpus take them.
NEAR = minhash.Near(shingle=5)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.filter_documents(docs, NEAR)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]
#: MinHash and BPE are beyond SQL; tests/llm/test_pipeline.py holds the stages and run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
