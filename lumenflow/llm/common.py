"""Helpers shared by the text operators: scratch space, hot-key joins, word expressions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import scratch, stored, workspace  # noqa: F401

#: ASCII white space, as a Java and Python character class.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is hot when it holds at least one row in HOT_SHARE, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they run; once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="lumenflow-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/lumenflow_code.zip", "w") as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(f"{folder}/lumenflow_code.zip")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def filled(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of many ``rows`` to one row per ``key`` in ``groups``, safe against hot keys.

    ``groups`` must be stored and must carry in ``size`` how many of ``rows`` have its key. Keys with one row in
    HOT_SHARE or more are broadcast: the sizes sum to the number of rows, so they are HOT_SHARE at most. All others
    meet in a shuffled join in which no key is large.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_SHARE >= total
    big = F.broadcast(groups.filter(hot))
    return rows.join(big, key).unionByName(rows.join(F.broadcast(groups.filter(hot).select(key)), key, "left_anti").join(groups.filter(~hot), key))


def packed_rows(docs: DataFrame) -> DataFrame:
    """One column ``row`` that holds all others, so that none of them can clash with a name an operator uses."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def bucket_count(rows: int, each: int, least: int) -> int:
    """Buckets of a table that is to hold ``rows`` rows: a power of two, with ``each`` rows a bucket or fewer."""
    return max(least, 1 << max(0, -(-rows // each) - 1).bit_length())


class Bucketed:
    """A table bucketed and sorted by ``key`` at ``path`` that outlives the session; it knows its number of buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int):
        from pyspark.errors import AnalysisException

        self.spark, self.key, self.place = spark, key, f"{path}/rows"
        try:
            buckets = spark.read.schema("buckets int").parquet(f"{path}/spec").first()["buckets"]
        except AnalysisException:
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/spec")
        self.buckets, self.name = buckets, f"table_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.place}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """One file a bucket: rows are dealt to the buckets before they are written."""
        dealt = rows.select(*self.rows().columns).repartition(self.buckets, self.key)
        dealt.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.place).mode("append").saveAsTable(self.name)

    def close(self) -> None:
        """Forget the name in the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def running_sums(lengths: str) -> Column:
    """Array whose element k is the sum of the first k elements of the integer array column ``lengths``.

    Folds over arrays copy what they built at each step, so the array is cut into pieces of the root of its size: n to
    the power of 1.5 at most. ``lengths`` must be a column of the row, as an expression would be computed for each piece.
    """
    none, size = F.array().cast("array<long>"), F.size(lengths)
    step = F.greatest(F.ceil(F.sqrt(size)), F.lit(1)).cast("int")

    def inner(piece: Column, start: Column) -> Column:
        first = F.struct(start.alias("pos"), none.alias("out"))
        return F.aggregate(piece, first, lambda a, x: F.struct((a["pos"] + x).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")), lambda a: a["out"])

    def outer(acc: Column, piece: Column) -> Column:
        total = F.aggregate(piece, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.struct((acc["pos"] + total).alias("pos"), F.concat(acc["out"], F.array(inner(piece, acc["pos"]))).alias("out"))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / step).cast("int")), lambda k: F.slice(lengths, k * step + 1, step))
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<array<long>>").alias("out"))
    return F.when(size > 0, F.flatten(F.aggregate(pieces, start, outer, lambda a: a["out"]))).otherwise(none)
