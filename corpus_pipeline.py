"""From raw documents to token shards: quality rules, near duplicates, benchmark passages, mixing, token ids.

Each stage takes (spark, docs, folder of tables) and returns the rows that go on, with the columns of documents;
the last returns where each document of the mix lies in the written token shards. ``run`` writes every stage's result as Parquet
in the shared folder and reads it again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from colsmith.llm import contamination, mixing, neardup, quality, tokens
from colsmith.llm.queries import BYTE_BPE, MIX_TEMPERATURE
from colsmith.session import scratch_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources say; a copy is a row of its own."""
    return mixing.mix(docs, temperature=MIX_TEMPERATURE).drop("copy", "mix_order")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each row in the token shards, from the written files."""
    path = scratch_path(spark, "token-shards")
    tokens.write(docs, path, public_tokenizers.path(BYTE_BPE))
    return tokens.read(spark, path)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

ORACLE_SQL = None  # sketches, tokenizers and cascades have no SQL form; tests compare run() with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
