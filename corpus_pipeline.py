"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing to target weights, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from normalog.llm.bpe_codec import bpe_encode
from normalog.llm.common import partitions
from normalog.llm.disclosure import sanitise
from normalog.llm.mixing import mixed
from normalog.llm.quality_hosts import keep_good
from normalog.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and their host's verdict."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of SimHash near copies (five words, an estimated likeness of 0.8 or more)."""
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities generalised to their kind, disclosing terms removed."""
    return sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in twice as many shards as the session has shuffle partitions."""
    return mixed(docs, shards=1 << max(4, (2 * partitions(spark) - 1).bit_length()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, as counts and digests."""
    return bpe_encode(docs)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_duplicates), ("PII", personal_data), ("mixing", mix_sources), ("BPE encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


#: Components, urn draws and byte-pair merges have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None
