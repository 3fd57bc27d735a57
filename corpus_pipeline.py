"""A training corpus from raw documents: the stages in order, each one an operator of ``llm``.

Every stage takes the documents that the one before it kept, as a table, and returns documents with the
same columns; the last one returns the shards.  Nothing in a stage depends on what a document was
before it, so each can be run again by itself from the table it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estatescope.llm import decontamination, mixing, near_copies, quality, sharding
from estatescope.llm.registry import read, ship
from estatescope.workspace import stored, work_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word similarity of 0.8 or more.

    SimHash, checked as whole sets, finds the closest ones; a prefix-filter join all others."""
    ship(spark)
    return near_copies.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span with a benchmark item."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents once for each pass that takes them, the last one perhaps in part."""
    return mixing.mixed_documents(docs).select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix with its shard and its slot there."""
    return sharding.laws(sharding.sharded(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Components of near copies, the draw of the mix and label propagation are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is a table that the next one reads."""
    ship(spark)
    folder = work_folder(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{number}")
    return docs
