"""Program-graph tables projected from business tables, for tests and benchmarks on data of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Project:
    """The tables of one data folder, as code facts: methods call methods, statements read and write variables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def raw_calls(self) -> DataFrame:
        """caller, callee with repetitions: customers call orders, orders parts, parts suppliers, suppliers parts."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
        layers = [
            self.table("orders").select(name("C", "o_custkey").alias("caller"), name("O", "o_orderkey").alias("callee")),
            lines.select(name("O", "l_orderkey").alias("caller"), name("P", "l_partkey").alias("callee")),
            lines.filter("l_linenumber = 1").select(name("P", "l_partkey").alias("caller"), name("S", "l_suppkey").alias("callee")),
            lines.filter("l_linenumber = 2").select(name("S", "l_suppkey").alias("caller"), name("P", "l_partkey").alias("callee")),
        ]
        out = layers[0].withColumn("layer", F.lit(0))
        for i, layer in enumerate(layers[1:], 1):
            out = out.unionByName(layer.withColumn("layer", F.lit(i)))
        return out

    def calls(self) -> DataFrame:
        return self.raw_calls().groupBy("caller", "callee").agg(F.min("layer").alias("layer"))

    def usages(self, placed: bool = False) -> DataFrame:
        """Sensitive API usages: method (order), category, api (part), file (order priority); ``placed`` adds part_file
        and part_row, where the table holds the row."""
        place = [F.col("_metadata.file_name").alias("part_file"), F.col("_metadata.row_index").alias("part_row")] if placed else []
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("method"), F.concat("l_returnflag", "l_linestatus").alias("category"), F.col("l_partkey").alias("api"), F.col("l_linenumber").alias("line"), *place)
        return lines.join(self.table("orders").select(F.col("o_orderkey").alias("method"), F.col("o_orderpriority").alias("file")), "method")

    def statements(self) -> DataFrame:
        """Statements of each method (user) in order, with variable and kind."""
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        kind = F.create_map(*[F.lit(x) for kv in {"signup": "source", "error": "clear", "view": "copy", "click": "invoke", "purchase": "sink"}.items() for x in kv])
        base = self.table("events").select("event_id", "ts", "user_id", "event_type", "value")
        return base.select(F.col("user_id").alias("method"), "event_id", F.row_number().over(order).cast("long").alias("idx"), kind[F.col("event_type")].alias("kind"), (F.col("event_id") % 5).alias("var"), ((F.col("event_id") + 1) % 5).alias("from_var"))

    def blocks(self) -> DataFrame:
        """Basic blocks of four statements, with the kind of the last one."""
        st = self.statements().withColumn("block", F.floor((F.col("idx") - 1) / 4).cast("long"))
        return st.groupBy("method", "block").agg(F.max_by("kind", "idx").alias("last_kind"), (F.max_by("kind", "idx") == "invoke").alias("branches"), F.max((F.col("kind") == "invoke").cast("int")).cast("boolean").alias("invokes"), F.max((F.col("kind") == "clear").cast("int")).cast("boolean").alias("throws"), F.count(F.lit(1)).alias("n_stmts"))

    def block_edges(self) -> DataFrame:
        """Successors: the next block; the one after it behind a branch; the one before behind a loop's end; the third next, as a handler,
        from a block that may throw."""
        b = self.blocks().select("method", "block", "last_kind")
        steps = F.expr("CASE last_kind WHEN 'invoke' THEN array(struct(0 AS succ_idx, 1 AS step), struct(1 AS succ_idx, 2 AS step)) WHEN 'clear' THEN array(struct(0 AS succ_idx, 1 AS step), struct(1 AS succ_idx, -1 AS step)) ELSE array(struct(0 AS succ_idx, 1 AS step)) END")
        e = b.select("method", F.col("block").alias("src"), F.explode(steps).alias("e")).select("method", "src", "e.succ_idx", (F.col("src") + F.col("e.step")).cast("long").alias("dst"))
        throws = self.blocks().filter("throws").select("method", F.col("block").alias("src"), F.lit(9).alias("succ_idx"), (F.col("block") + 3).alias("dst"), F.lit(True).alias("exceptional"))
        e = e.withColumn("exceptional", F.lit(False)).unionByName(throws)
        return e.join(b.select("method", F.col("block").alias("dst")), ["method", "dst"], "left_semi")


#: The same projections as SQL, common table expressions.
SQL = {
    "calls": """
raw_calls AS (
  SELECT 'C' || o_custkey AS caller, 'O' || o_orderkey AS callee, 0 AS layer FROM orders
  UNION ALL SELECT 'O' || l_orderkey, 'P' || l_partkey, 1 FROM lineitem
  UNION ALL SELECT 'P' || l_partkey, 'S' || l_suppkey, 2 FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT 'S' || l_suppkey, 'P' || l_partkey, 3 FROM lineitem WHERE l_linenumber = 2),
calls AS (SELECT caller, callee, min(layer) AS layer FROM raw_calls GROUP BY 1, 2)""",
    "usages": """
usages AS (SELECT l_orderkey AS method, l_returnflag || l_linestatus AS category, l_partkey AS api, l_linenumber AS line, o_orderpriority AS file
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "statements": """
statements AS (SELECT user_id AS method, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx,
  CASE event_type WHEN 'signup' THEN 'source' WHEN 'error' THEN 'clear' WHEN 'view' THEN 'copy' WHEN 'click' THEN 'invoke' WHEN 'purchase' THEN 'sink' END AS kind,
  event_id % 5 AS var, (event_id + 1) % 5 AS from_var FROM events)""",
    "blocks": """
blocks AS (SELECT method, (idx - 1) // 4 AS block, arg_max(kind, idx) AS last_kind, bool_or(kind = 'invoke') AS invokes, bool_or(kind = 'clear') AS throws, count(*) AS n_stmts
  FROM statements GROUP BY 1, 2)""",
    "block_edges": """
block_edges AS (SELECT e.method, e.src, e.succ_idx, e.dst FROM (
  SELECT method, block AS src, 0 AS succ_idx, block + 1 AS dst FROM blocks
  UNION ALL SELECT method, block, 1, block + 2 FROM blocks WHERE last_kind = 'invoke'
  UNION ALL SELECT method, block, 9, block + 3 FROM blocks WHERE throws
  UNION ALL SELECT method, block, 1, block - 1 FROM blocks WHERE last_kind = 'clear') e
  JOIN blocks b ON b.method = e.method AND b.block = e.dst)""",
}


def with_tables(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(SQL[n] for n in names)
