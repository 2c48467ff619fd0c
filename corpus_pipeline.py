"""A training corpus in five stages; each calls one of the operators of ``deedlens.llm``.

Every stage takes null, empty and very long texts (a null text counts as empty, and stays
null in what a filtering stage keeps), repeated rows, null ids, extra columns of any name,
and empty tables, which give empty results.  Its operator's module states what they give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deedlens.llm.common import stored, table
from deedlens.llm.minhash import keep_first
from deedlens.llm.packing import pack_documents
from deedlens.llm.quality import keep_quality
from deedlens.llm.suffix_dedup import without_repeats
from deedlens.llm.toxicity import keep_clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all of them where no label of both kinds can be learned from."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; all of them where no toxic label can be learned from.  Equal texts go or stay together."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id.  Empty texts are copies; rows without an id go."""
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that a document of a smaller doc_id has."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Trained models and sampling decide: SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
