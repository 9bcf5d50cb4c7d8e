"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wireloom.llm import decontam, mixing, neardup, quality, sharding
from wireloom.session import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the quality classifier rejects. It learns from all of labels, for documents that are in docs.

    A null text is scored as an empty one, and empty texts like any other; repeated rows have
    one score and stay or go together; a null doc_id has no label but is scored. Without
    labels every score is 0.5, so all rows stay. Other columns pass through, whatever their
    names; an empty table gives an empty table.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group linked at similarity 0.8 on sets of 5-word shingles.

    Of a group the row of the smallest doc_id stays, of rows that agree in it one alone;
    rows without a doc_id stay as they are.
    Texts without words are linked with nothing and all stay; a text of fewer than 5 words
    is one shingle. Other columns pass through, whatever their names; an empty table gives
    an empty table.
    """
    return neardup.keep_one(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents with a 10-word window of a benchmark item, or all of a shorter item.

    Null and empty texts have no words and stay; repeated rows stay or go together; items
    without item_id or words find nothing, and an empty benchmark takes nothing out. Other
    columns pass through, whatever their names; an empty table gives an empty table.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop="documents")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or cuts documents so that the sources' words meet their targets.

    Null sources are one source, the last. Null and empty texts have no words to take and are
    not in the mix. Rows equal in doc_id, source and text are one row repeated, and no row
    gives more than twice its words. Other columns pass through, whatever their names; an
    empty table gives an empty table.
    """
    return mixing.mix_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard (0 to 23) and slot to every row; columns of these names give way.

    Shards' numbers of rows are at most one apart. Rows with equal texts or a shared line go
    together as far as that allows; a null text counts as an empty one; rows equal in doc_id
    and text are one row repeated, a null doc_id is known by its text. Other columns pass
    through, whatever their names; an empty table gives an empty table.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A trained classifier and hash permutations can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
