import random

import pytest

from lumenflow.operators import controlflow, ssa


def frames(spark, edges, defs, uses):
    e = spark.createDataFrame(edges, "method long, src long, dst long")
    make = lambda rows: spark.createDataFrame(rows, "method long, block long, idx long, var string")
    idoms = controlflow.dominators(e)
    return e, make(defs), make(uses), idoms, controlflow.dominance(idoms)


def reaching(edges, defs, block, idx, var):
    """All definitions, and None for the method's begin, from which a way leads to the point unbroken."""
    inside = [i for b, i, v in defs if b == block and v == var and i < idx]
    if inside:
        return {max(inside)}
    found, seen, work = set(), set(), [block]
    if block == 0:
        found.add(None)
    while work:
        b = work.pop()
        for a in {s for s, d in edges if d == b} - seen:
            seen.add(a)
            ends = [i for c, i, v in defs if c == a and v == var]
            if ends:
                found.add(max(ends))
            else:
                work.append(a)
                if a == 0:
                    found.add(None)
    return found


@pytest.mark.parametrize("seed", [3, 4])
def test_versions_stand_for_the_definitions_that_reach(spark, seed):
    rng = random.Random(seed)
    n = 9
    edges = {(b, b + 1) for b in range(n - 1)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(6)}
    defs = [(b, 10 * b + k, rng.choice("xy")) for b in range(n) for k in (1, 4) if rng.random() < 0.5]
    uses = [(b, 10 * b + k, v) for b in range(n) for k in (0, 1, 5) for v in "xy"]
    e, d, u, idoms, over = frames(spark, [(1, *x) for x in edges], [(1, *x) for x in defs], [(1, *x) for x in uses])
    placed = ssa.phis(d, controlflow.frontiers(e, idoms))
    numbered = ssa.versions(d, placed)
    site = {(r["var"], r["version"]): r for r in numbered.collect()}
    arguments = {}
    for r in ssa.phi_arguments(placed, e, numbered, over).collect():
        arguments.setdefault((r["block"], r["var"]), set()).add(r["version"])

    def meant(var, version):
        found, seen, work = set(), set(), [version]
        while work:
            v = work.pop()
            if v in seen:
                continue
            seen.add(v)
            r = site.get((var, v))
            if r is None:
                found.add(None)
            elif r["idx"] is not None:
                found.add(r["idx"])
            else:
                work += arguments[r["block"], var]
                if r["block"] == 0:
                    found.add(None)
        return found

    got = ssa.visible(u, numbered, over).collect()
    assert len(got) == len(uses)
    for r in got:
        assert meant(r["var"], r["version"]) == reaching(edges, defs, r["block"], r["idx"], r["var"]), r


def test_loops_with_self_edges_and_shared_headers(spark):
    rows = [(1, 0, 1), (1, 1, 2), (1, 2, 1), (1, 2, 3), (1, 3, 1), (1, 3, 4), (1, 4, 4), (1, 7, 2), (2, 0, 0)]
    e = spark.createDataFrame(rows, "method long, src long, dst long")
    got = ssa.natural_loops(e, controlflow.dominance(controlflow.dominators(e)))
    assert {(r["method"], r["header"], r["block"]) for r in got.collect()} == {(1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 4, 4), (2, 0, 0)}


def test_edits_renumber_each_block(spark):
    st = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 3, "c")], "method long, block long, idx long, text string")
    ed = spark.createDataFrame([(1, 0, 1, "after", 2, "z"), (1, 0, 1, "after", 1, "y"), (1, 0, 2, "remove", 0, None), (1, 0, 2, "before", 0, "w"), (1, 1, 3, "replace", 0, None), (1, 9, 9, "before", 0, "none")], "method long, block long, idx long, action string, place int, text string")
    assert sorted((r["block"], r["idx"], r["text"]) for r in ssa.edited(st, ed).collect() if r["block"] == 0) == [(0, 1, "a"), (0, 2, "y"), (0, 3, "z"), (0, 4, "w")]
    assert [(r["idx"], r["text"]) for r in ssa.edited(st, ed).collect() if r["block"] == 1] == [(1, None)]
