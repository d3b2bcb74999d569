"""Taint across procedures: tabulation of path edges as joins.

A fact is (var, source): variable ``var`` holds what statement ``source`` brought in; the zero fact has neither. A path
edge (proc, d_var, d_source, node, var, source) says that the second fact holds before ``node`` if the first holds where
``proc`` begins. Tables:

statements (proc, node, kind, target, operand), kind one of source, assign, clear, sanitize, sink, call, return, other
flow (proc, src, dst), successors, exceptional ones included
entries (proc, node), where procedures begin
calls (proc, node, callee), actuals (proc, node, callee, operand, param), arguments and what they are bound to
results (callee, operand), what a procedure returns; the caller's ``target`` receives it

Rounds extend what the last one found. Callees are entered with each fact once, whoever calls; their summaries are
applied at every call that entered them, so only matched calls and returns are followed.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored

FACT = ["var", "source"]
ENTERED = ["d_var", "d_source"]
EDGE = ["proc", *ENTERED, "node", *FACT]


def normal_flow(edges: DataFrame) -> DataFrame:
    """Facts behind each statement: sources give a fact for zero, assignments copy, targets and sanitized operands die.

    ``edges`` are path edges with the statement's kind, target and operand; so is the result, with new facts.
    """
    zero, kind = F.col("var").isNull(), F.col("kind")
    writes = kind.isin("source", "assign", "clear", "call") & F.col("target").isNotNull()
    dies = (writes & (F.col("var") == F.col("target"))) | ((kind == "sanitize") & (F.col("var") == F.col("operand")))
    fact = lambda var, source: F.struct(var.alias("var"), source.alias("source"))
    stay = F.when(zero | ~F.coalesce(dies, F.lit(False)), fact(F.col("var"), F.col("source")))
    born = F.when(zero & (kind == "source"), fact(F.col("target"), F.col("node")))
    copied = F.when((kind == "assign") & (F.col("var") == F.col("operand")), fact(F.col("target"), F.col("source")))
    facts = F.array_compact(F.array(stay, born, copied))
    return edges.select(*[c for c in edges.columns if c not in FACT], F.explode(F.array_distinct(facts)).alias("f")).select("*", "f.*").drop("f")


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> F.Column:
    """Equality that holds for nulls, too: the zero fact has them."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def _new(found: DataFrame, known: DataFrame, names: list[str]) -> DataFrame:
    found = found.select(*names).distinct()
    return found.join(known, _same(found, known, names), "left_anti")


def path_edges(statements: DataFrame, flow: DataFrame, entries: DataFrame, calls: DataFrame, actuals: DataFrame, results: DataFrame, roots: DataFrame, normal: Callable[[DataFrame], DataFrame] = normal_flow) -> DataFrame:
    """All path edges from ``roots`` (proc); ``normal`` is the flow over a statement."""
    s, flow = stored(statements, "statements"), stored(flow.distinct(), "flow")
    none_v, none_s = F.lit(None).cast(s.schema["target"].dataType).alias("var"), F.lit(None).cast(s.schema["node"].dataType).alias("source")
    fresh = stored(roots.select("proc").distinct().join(entries, "proc").select("proc", none_v.alias("d_var"), none_s.alias("d_source"), "node", none_v, none_s), "path")
    known, incoming, summaries = fresh, None, None
    for k in count():
        at = fresh.join(s, ["proc", "node"])
        over = normal(at).join(flow.withColumnRenamed("src", "node"), ["proc", "node"])
        found = over.select("proc", *ENTERED, F.col("dst").alias("node"), *FACT)
        # Into callees, each entered with each fact; zero enters always.
        here = at.filter("kind = 'call'").select(*EDGE, "target").join(calls, ["proc", "node"])
        bound = actuals.select("proc", "node", "callee", F.col("operand").alias("var"), F.col("param").alias("into"))
        inside = here.filter("var IS NULL").withColumn("into", none_v).unionByName(here.join(bound, ["proc", "node", "callee", "var"]).select(*here.columns, "into"))
        entered = stored(inside.select(*EDGE, "target", "callee", "into"), f"entered{k}")
        begun = entered.select("callee", F.col("into").alias("var"), "source").distinct().join(entries.withColumnRenamed("proc", "callee"), "callee")
        found = found.unionByName(begun.select(F.col("callee").alias("proc"), F.col("var").alias("d_var"), F.col("source").alias("d_source"), "node", *FACT))
        # Out of callees: what a return hands back for the fact the callee was entered with.
        ends = at.filter("kind = 'return' AND var IS NOT NULL AND var = operand").select(F.col("proc").alias("callee"), *ENTERED, F.col("source").alias("back"))
        ended = stored(ends.distinct(), f"ended{k}")
        pairs = [(entered, ended)]
        if incoming is not None:
            pairs += [(entered, summaries), (incoming, ended)]
        for came, went in pairs:
            went = went.select(F.col("callee").alias("of"), F.col("d_var").alias("w_var"), F.col("d_source").alias("w_source"), "back")
            match = (came["callee"] == went["of"]) & came["into"].eqNullSafe(went["w_var"]) & came["source"].eqNullSafe(went["w_source"])
            back = came.join(went, match).filter("target IS NOT NULL").select("proc", *ENTERED, "node", F.col("target").alias("var"), F.col("back").alias("source"))
            found = found.unionByName(back.join(flow.withColumnRenamed("src", "node"), ["proc", "node"]).select("proc", *ENTERED, F.col("dst").alias("node"), *FACT))
        incoming = entered if incoming is None else incoming.unionByName(entered)
        summaries = ended if summaries is None else summaries.unionByName(ended)
        fresh = stored(_new(found, known, EDGE), f"path{k}")
        if fresh.limit(1).count() == 0:
            return known
        known = known.unionByName(fresh)
        if k % 8 == 7:
            known, incoming, summaries = stored(known, "known"), stored(incoming, "incoming"), stored(summaries, "summaries")


def hits(edges: DataFrame, statements: DataFrame) -> DataFrame:
    """proc, node, var, source: sinks whose operand is tainted, and by which source; once each."""
    sinks = statements.filter("kind = 'sink'").select("proc", "node", F.col("operand").alias("var"))
    return edges.join(sinks, ["proc", "node", "var"]).select("proc", "node", "var", "source").distinct()


def undefined_flow(edges: DataFrame) -> DataFrame:
    """``normal_flow`` where 'undefined' statements give their target no value, and 'define' and 'read' give it one."""
    kind = F.when(F.col("kind") == "undefined", "source").when(F.col("kind").isin("define", "read"), "clear").otherwise(F.col("kind"))
    return normal_flow(edges.withColumn("kind", kind))


def undefined_reads(statements: DataFrame, flow: DataFrame, entries: DataFrame, calls: DataFrame, actuals: DataFrame, results: DataFrame, roots: DataFrame) -> DataFrame:
    """proc, node, var, source: reads of a field of ``operand`` that statement ``source`` may have left undefined.

    Tables as above; kinds are undefined, define, assign, read, call, return and other. The same tabulation as for taint
    with another flow over statements.
    """
    edges = path_edges(statements, flow, entries, calls, actuals, results, roots, undefined_flow)
    reads = statements.filter("kind = 'read'").select("proc", "node", F.col("operand").alias("var"))
    return edges.join(reads, ["proc", "node", "var"]).select("proc", "node", "var", "source").distinct()


def minimal_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcomes (sink, fact, path) but for those whose statements are a superset of another's at the same sink and fact.

    Of equal sets the first path in order stays.
    """
    rows = outcomes.select("sink", "fact", "path", F.array_sort(F.array_distinct("path")).alias("set")).distinct()
    first = rows.groupBy("sink", "fact", "set").agg(F.min("path").alias("path"))
    other = first.select(F.col("sink").alias("o_sink"), F.col("fact").alias("o_fact"), F.col("set").alias("o_set"))
    inside = (F.col("sink") == F.col("o_sink")) & (F.col("fact") == F.col("o_fact")) & (F.size("o_set") < F.size("set")) & (F.size(F.array_except("o_set", "set")) == 0)
    return first.join(other, inside, "left_anti").select("sink", "fact", "path")
