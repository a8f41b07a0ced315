"""A corpus in five stages: toxic documents go, one of each near-duplicate group stays, benchmark passages go,
sources are mixed to their weights, and the rest is placed in shards.

Each stage takes (spark, docs, sf_dir), with ``docs`` the rows that the stage before it kept, and returns their columns,
whatever else they are called; rows with a null doc_id, text or source take part like any others, repeated rows are
copies of each other, long texts are read whole, and an empty table stays empty. The operators' docstrings say what each
case means for them. The last stage adds ``shard`` and replaces a column of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firnline.llm import decontamination, mixing, sharding, similar, toxicity
from firnline.llm.storage import Scratch

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, "doc_id", sharding.balanced(SHARDS))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix),
    ("sharding", shard),
]

#: Model scores and XXH64 fingerprints have no SQL here; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
