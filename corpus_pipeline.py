"""Corpus preparation from raw documents to packed training sequences, one table per stage.

Defined results: null text counts as empty, fails the quality rules and goes; null languages and sources are a language
and a source of their own; rows that repeat are one document from exact dedup on; an empty table passes all stages and
gives no rows; further columns, of any name, are carried to the last stage, which returns pieces of documents instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenflow.llm import exact_dedup, mixing, near_dedup, packing, quality
from lumenflow.llm.common import documents, scratch, workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, scratch(spark, "index"), docs.count())
    kept = exact_dedup.drop_copies(docs, index)
    index.close()
    return kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, packing.vocabulary_path())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mix", source_mix),
    ("packing", packed_sequences),
]
#: Perplexity bands, signatures, rounding draws and token ids aren't expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns. What a stage writes for itself is deleted when its result is written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        with workspace(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
