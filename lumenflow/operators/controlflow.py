"""Control-flow facts from blocks (method, block, branches, invokes) and edges (method, src, succ_idx, dst, exceptional)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored


def branches(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Each block that ends in a condition (branches) and on which side calls follow: successor 0 is the true one."""
    calls = blocks.select("method", F.col("block").alias("dst"), "invokes")
    side = edges.filter("NOT exceptional").join(calls, ["method", "dst"]).groupBy("method", F.col("src").alias("block")).agg(
        F.coalesce(F.bool_or(F.when(F.col("succ_idx") == 0, F.col("invokes"))), F.lit(False)).alias("yes"), F.coalesce(F.bool_or(F.when(F.col("succ_idx") == 1, F.col("invokes"))), F.lit(False)).alias("no"))
    name = F.when(F.col("yes") & F.col("no"), "both_branches").when(F.col("yes"), "true_branch").when(F.col("no"), "false_branch").otherwise("unknown")
    return blocks.filter("branches").select("method", "block").join(side, ["method", "block"], "left").select("method", "block", F.coalesce(name, F.lit("unknown")).alias("branch_side"))


def tries(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks with exceptional successors: whether the call stands in the block or in a handler, and if a handler calls."""
    calls = blocks.select("method", F.col("block").alias("dst"), F.col("invokes").alias("handler_invokes"))
    behind = edges.filter("exceptional").join(calls, ["method", "dst"]).groupBy("method", F.col("src").alias("block")).agg(F.bool_or("handler_invokes").alias("has_fallback"))
    side = F.when(F.col("invokes"), "try_body").otherwise("catch_handler")
    return blocks.join(behind, ["method", "block"]).select("method", "block", side.alias("branch_side"), "has_fallback")


def guarding(blocks: DataFrame, dominance: DataFrame) -> DataFrame:
    """Branching blocks that dominate a block with a call. dominance: (method, block, dominator), pairs."""
    calls = blocks.filter("invokes").select("method", "block")
    over = dominance.join(calls, ["method", "block"], "left_semi").select("method", F.col("dominator").alias("block")).distinct()
    return blocks.filter("branches").select("method", "block").join(over, ["method", "block"], "left_semi")


def dominance(idoms: DataFrame) -> DataFrame:
    """method, block, dominator: all proper dominators, from immediate ones, by doubling."""
    known = stored(idoms.select("method", "block", F.col("idom").alias("dominator")), "dom")
    while True:
        up = known.select("method", F.col("block").alias("dominator"), F.col("dominator").alias("far"))
        longer = known.join(up, ["method", "dominator"]).select("method", "block", F.col("far").alias("dominator")).distinct()
        new = stored(longer.join(known, ["method", "block", "dominator"], "left_anti"), "dom")
        if new.limit(1).count() == 0:
            return known
        known = stored(known.unionByName(new), "dom")


def frontiers(edges: DataFrame, idoms: DataFrame) -> DataFrame:
    """method, block, frontier: blocks where a block's dominance ends: it dominates a predecessor but not, properly, them."""
    over = dominance(idoms)
    self_ = idoms.select("method", "block").unionByName(idoms.select("method", F.col("idom").alias("block"))).distinct()
    weak = over.select("method", "block", "dominator").unionByName(self_.select("method", "block", F.col("block").alias("dominator")))
    before = edges.select("method", F.col("src").alias("block"), F.col("dst").alias("frontier")).distinct()
    at = weak.join(before, ["method", "block"]).select("method", F.col("dominator").alias("block"), "frontier").distinct()
    strict = over.select("method", F.col("dominator").alias("block"), F.col("block").alias("frontier"))
    return at.join(strict, ["method", "block", "frontier"], "left_anti")


def tree_order(idoms: DataFrame) -> DataFrame:
    """method, block, depth, path: the dominator tree; sorting by path visits it depth first, children in block order."""
    now = stored(idoms.join(idoms.select("method", F.col("block").alias("idom")), ["method", "idom"], "left_anti").select("method", F.col("idom").alias("block"), F.lit(0).alias("depth"), F.array("idom").alias("path")).distinct(), "tree")
    done = now
    while True:
        below = idoms.select("method", F.col("idom").alias("up"), "block")
        now = stored(now.withColumnRenamed("block", "up").join(below, ["method", "up"]).select("method", "block", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("block")).alias("path")), "tree")
        if now.limit(1).count() == 0:
            return done
        done = done.unionByName(now)


def unreachable(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """method, block of blocks that no way leads to from their method's first block."""
    first = stored(blocks.groupBy("method").agg(F.min("block").alias("block")), "first")
    seen = frontier = first
    while frontier.limit(1).count():
        step = frontier.join(edges.select("method", F.col("src").alias("block"), "dst"), ["method", "block"]).select("method", F.col("dst").alias("block")).distinct()
        frontier = stored(step.join(seen, ["method", "block"], "left_anti"), "reachable")
        seen = seen.unionByName(frontier)
    return blocks.select("method", "block").join(seen, ["method", "block"], "left_anti")


def terminator_flaws(statements: DataFrame) -> DataFrame:
    """method, block, flaw: several ends of a block, or an end that isn't last. statements: (method, block, idx, ends)."""
    per = statements.groupBy("method", "block").agg(F.count_if("ends").alias("n"), F.max("idx").alias("last"), F.max(F.when(F.col("ends"), F.col("idx"))).alias("end"))
    flaw = F.when(F.col("n") > 1, "several_terminators").when(F.col("end") < F.col("last"), "terminator_not_last")
    return per.select("method", "block", flaw.alias("flaw")).filter("flaw IS NOT NULL")


def snippets(statements: DataFrame, context: int = 2) -> DataFrame:
    """method, first_line, last_line, code: lines from ``context`` before to behind, and texts in order. Lines from 1 count.

    statements: (method, idx, line, text).
    """
    known = F.when(F.col("line") > 0, F.col("line"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), "\n")
    return statements.groupBy("method").agg(F.greatest(F.min(known) - context, F.lit(1)).alias("first_line"), (F.max("line") + context).alias("last_line"), code.alias("code"))


def loops(edges: DataFrame) -> DataFrame:
    """Blocks with a successor that doesn't come later, once a block."""
    return edges.filter("dst <= src").groupBy("method", F.col("src").alias("block")).agg(F.min("dst").alias("header"))


def flaws(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks other than a method's first without a predecessor."""
    return blocks.filter("block > 0").select("method", "block").join(edges.select("method", F.col("dst").alias("block")), ["method", "block"], "left_anti")


def dominators(edges: DataFrame) -> DataFrame:
    """method, block, idom: immediate dominators from block 0. A method's graph is small; methods run in parallel."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        follow: dict[int, list[int]] = {}
        for a, b in zip(frame["src"], frame["dst"]):
            follow.setdefault(a, []).append(b)
        order, state, stack = [], {0: 1}, [(0, iter(follow.get(0, ())))]
        while stack:  # post-order
            node, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                order.append(node)
                stack.pop()
            elif child not in state:
                state[child] = 1
                stack.append((child, iter(follow.get(child, ()))))
        rank = {n: len(order) - i for i, n in enumerate(order)}
        before: dict[int, list[int]] = {}
        for a in order:
            for b in follow.get(a, ()):
                before.setdefault(b, []).append(a)
        above = {0: 0}
        moved = True
        while moved:
            moved = False
            for n in sorted(order, key=rank.get):
                if n == 0:
                    continue
                best = None
                for p in before[n]:
                    if p not in above:
                        continue
                    q = best
                    if q is None:
                        best = p
                        continue
                    while p != q:
                        if rank[p] > rank[q]:
                            p = above[p]
                        else:
                            q = above[q]
                    best = p
                if best is not None and above.get(n) != best:
                    above[n], moved = best, True
        rows = [(int(frame["method"].iloc[0]), int(n), int(above[n])) for n in order if n]
        return pd.DataFrame(rows, columns=["method", "block", "idom"])

    return edges.groupBy("method").applyInPandas(one, "method long, block long, idom long")
