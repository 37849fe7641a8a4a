"""From raw documents to mixed and sharded training rows, in five stages.

Every stage takes the rows that its predecessor kept; all but the last return the columns of ``documents``, the last adds ``vslot``, ``shard`` and ``map_version``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folianta.llm import minhash, mixing, sharding, tiling, weak_rules
from folianta.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or that the rules' votes make likelier bad than good, go."""
    return weak_rules.keep_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest id stays."""
    return minhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover half of a benchmark item or more go."""
    return tiling.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition of a document that the mix takes."""
    return mixing.mix_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard, by the stored map of virtual slots after one rebalance for these rows."""
    return sharding.assign(docs, sharding.next_map(spark, sharding.slot_loads(docs)))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", source_mix),
    ("sharding", shards),
]

#: Stages 1 to 3 have no SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
