"""A corpus pipeline: drop poor documents, exact copies and near copies, mix the sources, encode.

Every stage takes the documents its predecessor kept and returns a DataFrame,
which is written as Parquet and read again for the next stage. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, mixing, pieces, quality, simhash
from millrace.llm.common import stored, table
from millrace.llm.queries import MODEL


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every distinct text, the one with the largest doc_id."""
    return exact_dedup.distinct_texts(docs, keep="largest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies, the one with the smallest doc_id."""
    return simhash.one_of_each(docs, shingle=3, radius=2)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources repeated up to twice by temperature."""
    return mixing.mixed(docs, repeat=2.0)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every row: doc_id, sample, ids, log_p, perturbed, log_inclusion."""
    return pieces.encode(docs, MODEL, samples=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("SentencePiece", encoded),
]

#: No SQL can express the classifier, the fingerprints or the sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
