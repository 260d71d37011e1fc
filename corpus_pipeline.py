"""Corpus pipeline: quality, line dedup, near-duplicate documents, decontamination, token ids.

``STAGES`` are applied to ``documents`` in order; every stage but the last returns the columns it
was given, the last one the token digests of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, decontaminate, line_dedup, quality, simhash
from tickloom.llm.common import save
from tickloom.llm.queries import table, vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a near-duplicate line before them makes redundant."""
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.round_trip_digests(docs, vocabulary())


STAGES = [("quality", keep_good), ("line_dedup", dedup_lines), ("near_copies", drop_near_copies),
          ("decontamination", decontaminated), ("token_ids", token_ids)]

#: No SQL: the classifier is trained, and the vocabulary is outside the tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
