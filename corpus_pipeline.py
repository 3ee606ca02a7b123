"""The training-corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; run()
writes every stage's rows as Parquet into the shared folder and rereads them for the
next. All stages but the last return the columns of documents; the last adds each
row's shard and its slot there. A document that the mix reads twice is two rows.

Defined results, by the operators' docstrings: documents with a null or empty text fail
the quality rules and go; a null doc_id, language or source is kept as a value of its
own; texts of any length are read whole; of equal and near texts the one of the smallest
doc_id stays, rows that repeat it count once; other columns, whatever their names, pass
through unharmed, but for shard and slot, which the last stage replaces; an empty table
passes every stage and gives no rows. Every stage's table is written before the next
one starts, so what a lost executor held is read again from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenery.llm import decontaminate, mixing, near_dedup, quality, sharding
from scenery.llm.common import materialise, packed, unpacked


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix reads it."""
    return mixing.mixture(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return unpacked(sharding.shard(packed(docs, "doc_id", "text", "source")), "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", shards),
]

#: Robust estimates and seeded signatures have no SQL form; the tests hold each stage against its brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
