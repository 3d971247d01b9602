"""A corpus pipeline: quality rules, exact duplicates, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all the rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again for the next one. All but the last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import exact_dedup, mixing, packing, quality_rules, simhash
from cohortry.llm.shared import stored

#: The hashes of SimHash and of the mix have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or a certified cutoff reject."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place in it."""
    pieces = stored(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, keep_ids=False), "pieces")
    return packing.pack(pieces.drop("ids"), 2048)


STAGES = [("quality_rules", good_documents), ("exact_dedup", without_copies), ("simhash_dedup", without_near_copies), ("mix_sources", mixed), ("pack_sequences", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
