"""Tables that operators write for themselves in the folder all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[list[str]] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below the folder the cluster names in spark.checkpoint.dir.

    Where the setting is absent it is a temporary folder of this process, which only a local master can share with its
    executors; on other masters that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="lumenflow-")
            atexit.register(shutil.rmtree, _own[app], True)
        root = _own[app]
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    if _made:
        _made[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whichever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Folders named by ``scratch`` inside are deleted at the end: write what shall stay to one named outside."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


def stored(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, lost executors cost nothing. ``by``: a
    column that gets a folder for each value."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, key: str, what: str) -> Iterator[DataFrame]:
    """Distinct rows of ``df`` as a table bucketed and sorted by ``key``, for several joins on it: none deals them out again."""
    spark, name = df.sparkSession, f"{what}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).distinct().write.format("parquet").bucketBy(n, key).sortBy(key).option("path", scratch(spark, what)).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffles of queries that are done, else they stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()
