"""Pipeline over documents: language, near-duplicates, benchmark leaks, mixing, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its rows are written and
reread. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm import decontamination, language, mixing, near_dup, sharding
from peerlens.llm.common import materialize, read_table
from peerlens.llm.queries import held_out

SHARDS = 16


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null, empty or without a letter, or so unlike all learned languages that
    their matches with the best one are no longer than random ones."""
    labelled = docs.filter(~held_out(F.col("doc_id"))).select("text", "lang")
    found = language.identify(docs.select(F.struct("*").alias("d"), "text"), labelled)
    return found.filter(language.recognised()).select("d.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 80 %) the smallest doc_id stays."""
    return near_dup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of five words or more go: shorter ones occur in clean documents too."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), min_item_words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, so that sources come to their target weights."""
    return mixing.repeat_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

# Stages 1 to 3 and 5 rest on models and hashes that SQL does not have; tests hold them to brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
