"""The corpus pipeline over ``documents``: each stage is one of the operators of ``aeropanel.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aeropanel.llm import lines, mixing, packing, quality, simhash
from aeropanel.llm.common import materialize


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; it learns from ``labels``.

    Null and empty texts are scored like others, repeated rows each, texts of any length whole; no rows give no rows.
    """
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines, short ones too, whose template an earlier document has; n_chars follows the text.

    Null and empty texts stay as they are; a text may lose all its lines; rows equal in doc_id and text are one
    document; null ids come last; no rows give no rows.
    """
    return lines.dedup_documents(docs, min_tokens=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a similarity of 0.8 or more over shingles of five words.

    The smallest doc_id of a group stays; null ids only where the group has no other; texts without words are one
    group; of repeated rows one stays; no rows give no rows.
    """
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as its targets ask, up to three times.

    A null source is a source; texts without words go along as their source's whole repeats say; repeated rows and
    null ids are documents of their own; no rows give no rows.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids.

    A null or empty text is its end id; very long texts are cut at sequences' ends; repeated rows and null ids are
    documents of their own; no rows give no rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None  # SQL can't express the stages; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
