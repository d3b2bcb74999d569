"""Static single assignment and loops, on control-flow edges (method, src, dst) and immediate dominators.

defs and uses are (method, block, idx, var): statement ``idx`` of ``block`` writes or reads ``var``; a statement reads
before it writes. Blocks that no way leads to have no dominators: their uses see definitions of their own block only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def phis(defs: DataFrame, frontier: DataFrame) -> DataFrame:
    """method, block, var: where ways with different definitions meet, by iterated dominance frontiers.

    frontier: (method, block, frontier). A phi is a definition, too, so rounds go on from the phis that are new.
    """
    frontier = stored(frontier.select("method", "block", "frontier").distinct(), "frontier")
    step = lambda at: at.join(frontier, ["method", "block"]).select("method", F.col("frontier").alias("block"), "var").distinct()
    known = fresh = stored(step(defs.select("method", "block", "var").distinct()), "phi")
    while fresh.limit(1).count():
        fresh = stored(step(fresh).join(known, ["method", "block", "var"], "left_anti"), "phi")
        known = known.unionByName(fresh)
    return known


def versions(defs: DataFrame, placed: DataFrame) -> DataFrame:
    """method, block, idx, var, version: all definitions numbered from 1 a variable, in order of blocks; a phi's idx is null."""
    every = defs.select("method", "block", "idx", "var").unionByName(placed.select("method", "block", F.lit(None).cast(defs.schema["idx"].dataType).alias("idx"), "var"))
    order = Window.partitionBy("method", "var").orderBy("block", F.col("idx").asc_nulls_first())
    return every.distinct().withColumn("version", F.row_number().over(order))


def visible(points: DataFrame, numbered: DataFrame, dominance: DataFrame) -> DataFrame:
    """``points`` (method, block, idx, var, ...) with the version that holds before ``idx``, at the block's end if null.

    The latest definition earlier in the block, a phi before all others, else the last one of the nearest proper
    dominator that defines the variable; with phis in place no other can hold. 0: nothing is defined yet.
    dominance: (method, block, dominator).
    """
    numbered = stored(numbered, "versions")
    extra = [c for c in points.columns if c not in ("method", "block", "idx", "var")]
    # A statement's use sorts before its own definition; a phi first and a point at the end last.
    place = F.struct(F.col("block_end").alias("end"), F.col("idx").alias("idx"), F.col("is_def").alias("is_def"))
    info = F.struct(*extra).alias("extra") if extra else F.lit(None).cast("struct<none:int>").alias("extra")
    asked = points.select("method", "block", "idx", "var", F.col("idx").isNull().alias("block_end"), F.lit(False).alias("is_def"), info, F.lit(None).cast("int").alias("version"))
    made = numbered.select("method", "block", "idx", "var", F.lit(False).alias("block_end"), F.lit(True).alias("is_def"), F.lit(None).cast(asked.schema["extra"].dataType).alias("extra"), "version")
    before = Window.partitionBy("method", "block", "var").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    here = stored(asked.unionByName(made).withColumn("near", F.last("version", True).over(before)).filter("NOT is_def"), "points")
    last = numbered.groupBy("method", "block", "var").agg(F.max("version").alias("far"))
    depth = dominance.groupBy("method", F.col("block").alias("dominator")).agg(F.count(F.lit(1)).alias("depth"))
    above = dominance.join(depth, ["method", "dominator"], "left").select("method", "block", "dominator", F.coalesce("depth", F.lit(0)).alias("depth"))
    wanted = here.filter("near IS NULL").select("method", "block", "var").distinct()
    outs = wanted.join(above, ["method", "block"]).join(last.withColumnRenamed("block", "dominator"), ["method", "dominator", "var"])
    found = outs.groupBy("method", "block", "var").agg(F.max_by("far", "depth").alias("far"))
    out = here.join(found, ["method", "block", "var"], "left")
    return out.select("method", "block", "idx", "var", *[F.col(f"extra.{c}").alias(c) for c in extra], F.coalesce("near", "far", F.lit(0)).alias("version"))


def phi_arguments(placed: DataFrame, edges: DataFrame, numbered: DataFrame, dominance: DataFrame) -> DataFrame:
    """method, block, var, source, version: what each phi takes on the way from each preceding block."""
    ways = edges.select("method", F.col("src").alias("source"), F.col("dst").alias("phi")).distinct()
    ends = placed.withColumnRenamed("block", "phi").join(ways, ["method", "phi"])
    at = ends.select("method", F.col("source").alias("block"), F.lit(None).cast(numbered.schema["idx"].dataType).alias("idx"), "var", "phi")
    return visible(at, numbered, dominance).select("method", F.col("phi").alias("block"), "var", F.col("block").alias("source"), "version")


def natural_loops(edges: DataFrame, dominance: DataFrame) -> DataFrame:
    """method, header, block: the blocks of each natural loop, its header included; loops of one header are one.

    An edge to a block that dominates its source, or is it, closes a loop; the loop holds what reaches the source
    without passing the header.
    """
    live = dominance.select("method", F.col("block").alias("src")).unionByName(dominance.select("method", F.col("dominator").alias("src"))).distinct()
    edges = stored(edges.select("method", "src", "dst").distinct(), "ways")
    inner = edges.join(dominance.select("method", F.col("block").alias("src"), F.col("dominator").alias("dst")), ["method", "src", "dst"], "left_semi")
    back = stored(inner.unionByName(edges.filter("src = dst")), "back")
    heads = back.select("method", F.col("dst").alias("header"), F.col("dst").alias("block")).distinct()
    fresh = stored(back.filter("src <> dst").select("method", F.col("dst").alias("header"), F.col("src").alias("block")).distinct(), "loop")
    reachable = live.withColumnRenamed("src", "block")
    known = heads.unionByName(fresh)
    while fresh.limit(1).count():
        up = fresh.join(edges.select("method", F.col("dst").alias("block"), "src"), ["method", "block"]).select("method", "header", F.col("src").alias("block")).distinct()
        fresh = stored(up.join(reachable, ["method", "block"], "left_semi").join(known, ["method", "header", "block"], "left_anti"), "loop")
        known = known.unionByName(fresh)
    return known


def edited(statements: DataFrame, edits: DataFrame) -> DataFrame:
    """method, block, idx, text after edits, numbered anew from 1 in each block.

    statements: (method, block, idx, text). edits: (method, block, idx, action, place, text): 'before' and 'after' put a
    statement next to ``idx``, several in order of ``place``; 'remove' and 'replace' concern ``idx`` itself, of several
    replacements the last in order of ``place`` holds, and a removed statement stays removed.
    """
    key = ["method", "block", "idx"]
    own = edits.filter("action IN ('remove', 'replace')").groupBy(*key).agg(F.bool_or(F.col("action") == "remove").alias("gone"), F.max_by("text", "place").alias("instead"))
    kept = statements.select(*key, "text").join(own, key, "left").filter("gone IS NOT TRUE")
    kept = kept.select(*key, F.lit(1).alias("side"), F.lit(0).alias("place"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.col("instead")).alias("text"))
    put = edits.filter("action IN ('before', 'after')").join(statements.select(*key).distinct(), key, "left_semi")
    put = put.select(*key, F.when(F.col("action") == "before", 0).otherwise(2).alias("side"), "place", "text")
    order = Window.partitionBy("method", "block").orderBy("idx", "side", "place", "text")
    return kept.unionByName(put).select("method", "block", F.row_number().over(order).cast("long").alias("n"), "text").withColumnRenamed("n", "idx")
