"""Traversals of call graphs as iterated joins: one round a level for all starts together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import call_type, method_name
from ..sources.store import bucketed, release, scratch, stored, workspace

#: Parts into which the targets of ways down are dealt, so that what a search writes is a fraction of its result.
SLICES = 8


def reach(edges: DataFrame, starts: DataFrame, levels: int = 15) -> DataFrame:
    """node, depth: least number of edges (src, dst) from any of ``starts`` (node), ``levels`` at most."""
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    frontier = stored(starts.select("node", F.lit(0).alias("depth")).distinct(), "reach0")
    seen = frontier
    for depth in range(1, levels + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), f"reach{depth}")
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen


def nearest(edges: DataFrame, starts: DataFrame, entries: DataFrame, levels: int = 15, strict: bool = False) -> DataFrame:
    """start, entry, depth, path: for each start (node) the entry (node) fewest edges away, backwards along (src, dst).

    One search from all entries forward along the edges, a row a node: its depth, the first entry at that depth in string
    order and, of the callers that lead to it, the first. Paths are read off the callers, level by level, for starts
    only. A start that is an entry is its own, at depth 0; with ``strict`` a start never counts as its own entry.
    """
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    starts, entries = stored(starts.select("node").distinct(), "starts"), stored(entries.select("node").distinct(), "entries")
    seen = entries.select("node", F.lit(0).alias("depth"), F.col("node").alias("entry"), F.lit(None).cast("string").alias("caller"))
    frontier = seen
    for depth in range(1, levels + 1):
        step = frontier.select(F.col("node").alias("src"), "entry").join(edges, "src")
        first = step.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("entry", F.col("src").alias("caller"))).alias("m"))
        fresh = first.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth"), "m.entry", "m.caller")
        frontier = stored(fresh, f"near{depth}")
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    found = stored(seen, "near")
    if strict:  # a start that is an entry takes the best of its callers
        own = starts.join(entries, "node", "left_semi").withColumnRenamed("node", "dst").join(edges, "dst").select("dst", F.col("src").alias("node"))
        best = own.join(found.filter(F.col("depth") < levels), "node").groupBy(F.col("dst").alias("start")).agg(F.min(F.struct("depth", "entry", F.col("node").alias("caller"))).alias("m"))
        again = best.select("start", "m.entry", (F.col("m.depth") + 1).alias("depth"), "m.caller")
        plain = starts.join(entries, "node", "left_anti").join(found, "node").select(F.col("node").alias("start"), "entry", "depth", "caller")
        reached = plain.unionByName(again)
    else:
        reached = starts.join(found, "node").select(F.col("node").alias("start"), "entry", "depth", "caller")
    paths = stored(reached.select("start", "entry", "depth", F.array("start").alias("path"), "caller"), "paths")
    done = paths.filter("caller IS NULL")
    up = found.select(F.col("node").alias("caller"), F.col("caller").alias("next"))
    for depth in range(levels):
        paths = stored(paths.filter("caller IS NOT NULL").join(up, "caller").select("start", "entry", "depth", F.concat("path", F.array("caller")).alias("path"), F.col("next").alias("caller")), f"path{depth}")
        if paths.limit(1).count() == 0:
            break
        done = done.unionByName(paths.filter("caller IS NULL"))
    return done.drop("caller")


def links(paths: DataFrame) -> DataFrame:
    """start, place, caller, callee, call_type: the calls of each path of ``nearest``, from the entry down."""
    down = F.reverse("path")
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at(down, i).alias("caller"), F.element_at(down, i + 1).alias("callee")))
    each = paths.filter(F.size("path") > 1).select("start", F.posexplode(pairs).alias("place", "p"))
    return each.select("start", "place", "p.caller", "p.callee", call_type(method_name(F.col("p.callee"))).alias("call_type"))


def paths_down(edges: DataFrame, pairs: DataFrame, levels: int = 10) -> DataFrame:
    """top, target, path: a shortest way along the edges from top to target, the first in string order; [] if there is
    none within ``levels`` or both are one.

    Searches go up from the targets and keep, for each node, the first of its shortest ways down. Targets are dealt to
    SLICES searches, one after another; what one has written is deleted before the next. Which nodes lie how many levels
    above any target is found first: it tells where to stop, and whether a node may be met again at all.
    """
    spark = pairs.sparkSession
    kept = [scratch(spark, "paths") for _ in range(SLICES)]
    with workspace(spark), bucketed(edges.select("src", "dst"), "dst", "edges") as edges:
        pairs = stored(pairs.select("top", "target").distinct().withColumn("slice", F.pmod(F.xxhash64("target"), F.lit(SLICES)).cast("int")), "pairs", "slice")
        met, above = _levels(edges, pairs, levels)
        release(spark)
        for k, path in enumerate(kept):
            with workspace(spark):
                some = pairs.filter(F.col("slice") == k).select("top", "target")
                seen = now = some.select("target", F.col("target").alias("node"), F.array("target").alias("path")).distinct()
                found, last = None, max(above, default=0)
                for depth in range(1, last + 1):
                    step = now.join(edges, now["node"] == edges["dst"]).select("target", F.col("src").alias("node"), F.concat(F.array("src"), "path").alias("path"))
                    if depth > 1:  # a node has one edge to a target
                        step = step.repartition("target", "node").groupBy("target", "node").agg(F.min("path").alias("path"))
                    if met:
                        step = step.join(seen.select("target", "node"), ["target", "node"], "left_anti")
                    now = stored(step, f"up{depth}") if depth < last else step
                    seen = seen.unionByName(now) if met else seen
                    if depth in above:
                        found = now if found is None else found.unionByName(now)
                none = F.array().cast("array<string>")
                out = some.withColumn("path", none) if found is None else some.join(found.withColumnRenamed("node", "top"), ["target", "top"], "left").withColumn("path", F.coalesce("path", none))
                out.select("top", "target", "path").write.parquet(path)
            release(spark)
    return spark.read.schema("top string, target string, path array<string>").parquet(*kept)


def _levels(edges: DataFrame, pairs: DataFrame, levels: int) -> tuple[bool, set[int]]:
    """Whether some node lies at several levels above targets, and the levels, from one up, at which tops lie."""
    nodes = stored(pairs.select(F.col("target").alias("node")).distinct(), "level0")
    every = nodes.withColumn("depth", F.lit(0))
    for depth in range(1, levels + 1):
        nodes = stored(nodes.join(edges, nodes["node"] == edges["dst"]).select(F.col("src").alias("node")).distinct(), f"level{depth}")
        if nodes.limit(1).count() == 0:
            break
        every = every.unionByName(nodes.withColumn("depth", F.lit(depth)))
    met = every.groupBy("node").count().filter("count > 1").limit(1).count() > 0
    above = every.filter("depth > 0").join(pairs.select(F.col("top").alias("node")).distinct(), "node", "left_semi").select("depth").distinct()
    return met, {r["depth"] for r in above.collect()}


def ancestors(edges: DataFrame, starts: DataFrame, levels: int = 10) -> DataFrame:
    """start, node, depth of everything that reaches a start within ``levels``, itself included."""
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    frontier = stored(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct(), "anc0")
    seen = frontier
    for depth in range(1, levels + 1):
        step = frontier.join(edges, frontier["node"] == edges["dst"]).select("start", F.col("src").alias("node")).distinct()
        frontier = stored(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), f"anc{depth}")
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen


def common_ancestor(edges: DataFrame, pairs: DataFrame, levels: int = 10) -> DataFrame:
    """a, b, lca: the second method itself if it reaches the first, else the common ancestor nearest to the second."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    up = ancestors(edges, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), levels)
    first = pairs.join(up.select(F.col("start").alias("a"), "node"), "a")
    both = first.join(up.select(F.col("start").alias("b"), "node", "depth"), ["b", "node"])
    return both.groupBy("a", "b").agg(F.min(F.struct("depth", "node")).alias("m")).select("a", "b", F.col("m.node").alias("lca"), F.col("m.depth").cast("int").alias("depth"))


def sharing(edges: DataFrame, nodes: DataFrame, levels: int = 10) -> DataFrame:
    """a, b: all pairs of nodes, a < b, that have a common ancestor within ``levels``; no other pair has a least one."""
    up = stored(ancestors(edges, nodes, levels).select("start", "node"), "up")
    return up.select("node", F.col("start").alias("a")).join(up.select("node", F.col("start").alias("b")), "node").filter("a < b").select("a", "b").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) joined by a path of one edge or more, by doubling: log(longest path) rounds, until none is new."""
    known = stored(edges.select("src", "dst").distinct(), "closure")
    while True:
        longer = known.select("src", F.col("dst").alias("mid")).join(known.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        new = stored(longer.join(known, ["src", "dst"], "left_anti"), "closure")
        if new.limit(1).count() == 0:
            return known
        known = stored(known.unionByName(new), "closure")


def strong_components(edges: DataFrame) -> DataFrame:
    """node, root, in_cycle: strongly connected components, named by their greatest node.

    Colours: every node takes the greatest node that reaches it; those that reach the colour's own node within the
    colour are its component. What has a component leaves, and the rest is coloured anew, until nothing is left.
    """
    pairs = stored(edges.select("src", "dst").distinct(), "edges")
    left = stored(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    done, live = None, pairs
    while left.limit(1).count():
        colour = stored(left.select("node", F.col("node").alias("root")), "colour")
        while True:
            push = live.join(colour.select(F.col("node").alias("src"), "root"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("root").alias("near"))
            after = stored(colour.join(push, "node", "left").select("node", F.greatest("root", "near").alias("root"), (F.col("near") > F.col("root")).alias("moved")), "colour")
            colour = after.select("node", "root")
            if after.filter("moved").limit(1).count() == 0:
                break
        inside = live.join(colour.select(F.col("node").alias("src"), "root"), "src").join(colour.select(F.col("node").alias("dst"), F.col("root").alias("other")), "dst").filter("root = other")
        inside = stored(inside.select("src", "dst", "root"), "inside")
        member = frontier = stored(colour.filter("node = root"), "member")
        while frontier.limit(1).count():
            back = inside.join(frontier.select(F.col("node").alias("dst"), "root"), ["dst", "root"]).select(F.col("src").alias("node"), "root").distinct()
            frontier = stored(back.join(member, ["node", "root"], "left_anti"), "member")
            member = stored(member.unionByName(frontier), "members")
        done = member if done is None else done.unionByName(member)
        left = stored(left.join(member, "node", "left_anti"), "left")
        live = stored(live.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"), "live")
    if done is None:
        return left.select("node", F.col("node").alias("root"), F.lit(False).alias("in_cycle"))
    sizes = done.groupBy("root").agg((F.count(F.lit(1)) > 1).alias("many"))
    loops = pairs.filter("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    return done.join(sizes, "root").join(loops, "node", "left").select("node", "root", (F.col("many") | F.coalesce("loop", F.lit(False))).alias("in_cycle"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in over distinct edges."""
    pairs = edges.select("src", "dst").distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: least node of its component in the undirected graph, by least labels with pointer jumps."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    now = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        step = stored(now.join(near, "node").select("node", "root", F.least("root", "r").alias("up")), "step")
        jump = step.select(F.col("node").alias("up"), F.col("up").alias("far"))
        after = stored(step.join(jump, "up").select("node", F.least("up", "far").alias("root"), (F.least("up", "far") != F.col("root")).alias("moved")), "roots")
        now = after.select("node", "root")
        if after.filter("moved").limit(1).count() == 0:
            return now
