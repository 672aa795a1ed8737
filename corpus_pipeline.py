"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; between stages
the rows are written as Parquet to the shared folder and read again, so a lost executor costs a stage at
most. All but the last return the columns of ``documents``, extra ones included. What each stage does
with nulls, empty texts, ties, repeated rows, empty tables and clashing column names is in its operator's
docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratum.llm import decontam, mixing, neardup, quality, sharding
from stratum.llm.common import materialize, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the additive model scores at its threshold or above."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class linked by five-word shingles at a Jaccard similarity of 0.8."""
    return neardup.one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 0.8 or more of a benchmark item's five-word shingles."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source up to its target of words; a document taken n times is there n times."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each row's shard and its slot there, along a Hilbert curve."""
    return sharding.shard_rows(docs)


STAGES = [
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
