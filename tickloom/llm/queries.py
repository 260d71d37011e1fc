"""Registered queries of the subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> str:
    """Place of the public vocabulary; read here, never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import bpe

    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import line_dedup

    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import decontaminate

    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import lm

    return lm.score(table(spark, sf_dir, "documents"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tickloom.llm import pii

    out = pii.replace_entities(table(spark, sf_dir, "documents"), "corpus-surrogates-1")
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"),
                      F.array_join(F.transform("entities", lambda e: e["kind"]), ",").alias("kinds"), "text")


@query
def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import embed_dedup

    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import chat

    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_trees(chat.from_turns(rows)))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tickloom.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        F.when(F.col("score") >= model.s.threshold, 1).otherwise(0).alias("predicted"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import substring

    return substring.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import repair

    return repair.report(repair.damage(table(spark, sf_dir, "conversations")))


@query
def op12_topk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import topk_vectors

    return topk_vectors.search(table(spark, sf_dir, "embeddings"))


@query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import lexical

    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)
