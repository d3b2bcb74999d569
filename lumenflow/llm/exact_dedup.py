"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is first reduced to one row per digest (partial
aggregation on the map side, so a hot text shuffles one row a task), then meets the index in a sort-merge join: an
anti-join finds what is new, and the batch's digests are appended with their counts, so that later batches know all
copies. Only digests and ids move between machines, never texts.

A batch has a name. What the index already holds of that batch is neither counted again nor appended again, so a batch
that is repeated, wholly or after it was broken off, leaves the index as one run would.

Defined results: null text counts as empty text; a null doc_id is larger than any other (it is kept only where a
group has no other id); rows that repeat doc_id and text are one document and share one verdict in the report, while
``drop_copies`` returns one of them; an empty table gives an empty report; further columns, of any name, are ignored by
the report and passed through by ``drop_copies``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Bucketed, attach, bucket_count, documents, filled, packed_rows, scratch, stored

SCHEMA = "digest BINARY, keep_id BIGINT, n_rows BIGINT, batch STRING"
#: Digests in a bucket, and the least number of buckets.
EACH, LEAST = 2_000_000, 16


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space made one space."""
    return F.unhex(F.sha2(F.regexp_replace(filled(text), f"[{SPACE}]+", " "), 256))


class DigestIndex(Bucketed):
    """Digests of all batches, one row for each digest and batch. ``expected``: rows it is to hold, when it is new."""

    def __init__(self, spark: SparkSession, path: str, expected: int = 0):
        super().__init__(spark, path, SCHEMA, "digest", bucket_count(expected, EACH, LEAST))

    def others(self, batch: str) -> DataFrame:
        """digest, old_id, old_rows of what other batches brought; all rows of a digest carry the same id."""
        rows = self.rows().filter(F.col("batch") != batch)
        return rows.groupBy("digest").agg(F.min("keep_id").alias("old_id"), F.sum("n_rows").alias("old_rows"))

    def unseen(self, groups: DataFrame, batch: str) -> DataFrame:
        """Those of ``groups`` whose digest no other batch has."""
        return groups.join(self.rows().filter(F.col("batch") != batch).select("digest").hint("merge"), "digest", "left_anti")

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append (digest, keep_id, n_rows) of a batch, but for what the index has of it."""
        held = self.rows().filter(F.col("batch") == batch).select("digest")
        self.append(groups.select("digest", "keep_id", "n_rows", F.lit(batch).alias("batch")).join(held.hint("merge"), "digest", "left_anti"))


def _hashed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, digest of each row; digest, keep_id, n_rows of each distinct digest. Both stored."""
    seen = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    return seen, stored(seen.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows")), "batch")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Match a batch with the index, append it, and report on every row.

    Returns doc_id, keep_id, group_size, kept, text_sha256. A text the index already has keeps the id stored there,
    and group_size counts the rows of other batches too.
    """
    batch = batch or uuid.uuid4().hex
    seen, rows = _hashed(docs)
    known = index.others(batch).withColumn("old", F.lit(True))
    keep = F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id")
    merged = rows.join(known.hint("merge"), "digest", "left").select("digest", "n_rows", keep, (F.col("n_rows") + F.coalesce("old_rows", F.lit(0))).alias("group_size"))
    groups = stored(merged, "groups")
    index.add(groups, batch)
    return attach(seen, groups, "digest", "n_rows").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row where doc_id and text repeat.

    Rows meet the texts that stay on one key, a digest of text and id, by which copies of a row are found as well.
    """
    batch = batch or uuid.uuid4().hex

    def key(found: Column, doc_id: Column) -> Column:
        return F.unhex(F.sha2(F.concat(found, F.coalesce(doc_id.cast("string"), F.lit("-")).cast("binary")), 256)).alias("key")

    _, rows = _hashed(docs)
    new = stored(index.unseen(rows, batch).select(key(F.col("digest"), F.col("keep_id"))), "new")
    known = index.others(batch).withColumn("old", F.lit(True))
    index.add(rows.join(known.hint("merge"), "digest", "left").select("digest", F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"), "n_rows"), batch)
    keyed = packed_rows(docs).select("row", key(digest(F.col("row.text")), F.col("row.doc_id").cast("long")))
    return keyed.join(new, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = DigestIndex(spark, scratch(spark, "index"), docs.count())
    report = deduplicate(docs, index)
    index.close()
    return report


SQL = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
