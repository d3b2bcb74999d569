"""Usages that arrive as files, kept as a table of same-method collaborations.

The reference analysis is a batch; this keeps its most asked result up to date. Each micro-batch adds the distinct
(method, category, api) it brings to a store by its number, so a batch that is repeated overwrites itself, and the
result is the batch operator over the store. Nothing is kept in the stream's own state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.collaboration import together

SCHEMA = "method string, category string, api string"


def keep(spark: SparkSession, incoming: str, store: str, checkpoint: str) -> StreamingQuery:
    """Add all files (JSON lines of SCHEMA) below ``incoming`` that aren't in the store yet, then stop."""

    def add(batch: DataFrame, number: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(f"{store}/batch={number}")

    files = spark.readStream.schema(SCHEMA).json(incoming)
    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collaborations(spark: SparkSession, store: str) -> DataFrame:
    """Same-method collaborations of all usages so far."""
    return together(spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(store), "method")
