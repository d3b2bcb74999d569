"""Dataflow over statements (method, idx, kind, var, from_var) and control-flow edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored

DEFINES = ("source", "clear", "copy")


def def_use(statements: DataFrame) -> DataFrame:
    """Each use of a variable with its latest earlier definition in straight-line order: var, use_idx, def_idx."""
    defs = statements.filter(F.col("kind").isin(*DEFINES)).select("method", "idx", "var", F.lit(True).alias("is_def"))
    uses = statements.filter("kind IN ('copy', 'sink')").select("method", "idx", F.when(F.col("kind") == "copy", F.col("from_var")).otherwise(F.col("var")).alias("var"), F.lit(False).alias("is_def"))
    before = Window.partitionBy("method", "var").orderBy("idx", "is_def").rowsBetween(Window.unboundedPreceding, -1)
    both = defs.unionByName(uses).withColumn("def_idx", F.last(F.when(F.col("is_def"), F.col("idx")), True).over(before))
    return both.filter("NOT is_def AND def_idx IS NOT NULL").select("method", "var", F.col("idx").alias("use_idx"), "def_idx")


def block_summaries(statements: DataFrame, size: int = 4) -> tuple[DataFrame, DataFrame]:
    """Last definition of each variable in each block (gen), which is also what the block kills."""
    defs = statements.filter(F.col("kind").isin(*DEFINES)).select("method", F.floor((F.col("idx") - 1) / size).cast("long").alias("block"), "var", "idx")
    gen = defs.groupBy("method", "block", "var").agg(F.max("idx").alias("def_idx"))
    return gen, gen.select("method", "block", "var")


def reaching(gen: DataFrame, kill: DataFrame, edges: DataFrame) -> DataFrame:
    """method, block, var, def_idx that hold where a block begins: semi-naive rounds over (fact, block).

    A fact enters the successors of its block, and goes on from a block that doesn't define its variable. Each round
    extends only what the last one found, until a round finds nothing.
    """
    edges = stored(edges.select("method", "src", "dst").distinct(), "cfg")
    kill = stored(kill.distinct(), "kill")
    step = lambda out: out.join(edges, (out["method"] == edges["method"]) & (out["block"] == edges["src"])).select(out["method"], F.col("dst").alias("block"), "var", "def_idx").distinct()
    fresh = stored(step(gen), "in0")
    known = fresh
    for k in count(1):
        fresh = stored(step(fresh.join(kill, ["method", "block", "var"], "left_anti")).join(known, ["method", "block", "var", "def_idx"], "left_anti"), f"in{k}")
        if fresh.limit(1).count() == 0:
            break
        known = known.unionByName(fresh)
        if k % 8 == 0:
            known = stored(known, f"known{k}")
    return known


def straight_taint(statements: DataFrame) -> DataFrame:
    """Sinks whose variable was last written by a source, in straight-line order: method, var, source_idx, sink_idx."""
    writes = statements.filter("kind IN ('source', 'clear')").select("method", "idx", "var", F.col("kind").alias("w"))
    sinks = statements.filter("kind = 'sink'").select("method", "idx", "var", F.lit(None).cast("string").alias("w"))
    before = Window.partitionBy("method", "var").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("w").isNotNull(), F.struct("w", "idx")), True).over(before)
    return writes.unionByName(sinks).withColumn("last", last).filter("w IS NULL AND last.w = 'source'").select("method", "var", F.col("last.idx").alias("source_idx"), F.col("idx").alias("sink_idx"))


def taint(statements: DataFrame) -> DataFrame:
    """method, var, idx: variables that are tainted behind statement idx, with copies, as a fixpoint over versions.

    Every write makes a version of its variable. A source's version is tainted, a copy's version is if the version of
    the variable it reads is, a cleared one isn't. Versions form a forest by what they read, so pointer jumps settle
    chains of any length in log(length) rounds.
    """
    writes = statements.filter(F.col("kind").isin(*DEFINES))
    reads = def_use(statements.filter("kind <> 'sink'")).select("method", F.col("use_idx").alias("idx"), "def_idx")
    base = writes.filter("kind <> 'copy'").select("method", "idx", F.col("idx").alias("root"))
    copies = writes.filter("kind = 'copy'").join(reads, ["method", "idx"]).select("method", "idx", F.col("def_idx").alias("root"))
    up = stored(base.unionByName(copies), "versions")
    for k in count():
        nxt = up.join(up.select("method", F.col("idx").alias("root"), F.col("root").alias("far")), ["method", "root"]).select("method", "idx", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved"))
        nxt = stored(nxt, f"jump{k}")
        up = nxt.select("method", "idx", "root")
        if nxt.filter("moved").limit(1).count() == 0:
            break
    sources = statements.filter("kind = 'source'").select("method", F.col("idx").alias("root"))
    return up.join(sources, ["method", "root"], "left_semi").join(writes.select("method", "idx", "var"), ["method", "idx"]).select("method", "var", "idx", F.col("root").alias("source_idx"))


def tainted_sinks(statements: DataFrame) -> DataFrame:
    """method, var, source_idx, sink_idx: sinks reached by a source through copies."""
    marked = taint(statements).withColumnRenamed("idx", "def_idx")
    uses = def_use(statements).join(statements.filter("kind = 'sink'").select("method", F.col("idx").alias("use_idx")), ["method", "use_idx"], "left_semi")
    return uses.join(marked, ["method", "var", "def_idx"]).select("method", "var", "source_idx", F.col("use_idx").alias("sink_idx"))


def points_to(allocs: DataFrame, copies: DataFrame, loads: DataFrame, stores: DataFrame) -> DataFrame:
    """node, obj: inclusion-based points-to sets.

    allocs (node, obj); copies (src, dst); loads (base, field, dst); stores (base, field, src). A field of an object is
    a node of its own, named obj.field; loads and stores add copy edges as base sets grow. Semi-naive, until a
    round finds nothing.
    """
    edges = stored(copies.select("src", "dst").distinct(), "copies")
    known = stored(allocs.select("node", "obj").distinct(), "pts")
    fresh, field = known, F.concat(F.col("obj"), F.lit("."), F.col("field"))
    for k in count():
        at = fresh.withColumnRenamed("node", "base")
        added = at.join(loads, "base").select(field.alias("src"), "dst").unionByName(at.join(stores, "base").select("src", field.alias("dst"))).distinct()
        added = stored(added.join(edges, ["src", "dst"], "left_anti"), f"added{k}")
        flows = fresh.join(edges, fresh["node"] == edges["src"]).select(F.col("dst").alias("node"), "obj").unionByName(known.join(added, known["node"] == added["src"]).select(F.col("dst").alias("node"), "obj"))
        fresh = stored(flows.distinct().join(known, ["node", "obj"], "left_anti"), f"fresh{k}")
        if fresh.limit(1).count() == 0 and added.limit(1).count() == 0:
            return known
        known, edges = known.unionByName(fresh), edges.unionByName(added)
        if k % 8 == 7:  # a union of few tables is read, not of one a round
            known, edges = stored(known, f"pts{k}"), stored(edges, f"edges{k}")


def may_alias(points: DataFrame) -> DataFrame:
    """How many nodes share each object, and the least of them: (obj, n_nodes, first_node); aliases share a row's obj."""
    return points.groupBy("obj").agg(F.countDistinct("node").alias("n_nodes"), F.min("node").alias("first_node"))
