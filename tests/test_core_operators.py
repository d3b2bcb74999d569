import random

import pytest

from lumenflow.functions import names, sinks
from lumenflow.operators import collaboration, controlflow, dataflow, graph
from pyspark.sql import functions as F


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def chain(spark, n):
    return edges(spark, *[(f"m{i:02}", f"m{i + 1:02}") for i in range(n)])


@pytest.mark.parametrize("length, found", [(15, True), (16, False)])
def test_nearest_entry_stops_at_its_bound(spark, length, found):
    got = graph.nearest(chain(spark, length), spark.createDataFrame([(f"m{length:02}",)], "node string"), spark.createDataFrame([("m00",)], "node string")).collect()
    assert [(r["entry"], r["depth"]) for r in got] == ([("m00", length)] if found else [])


def test_nearest_entry_of_an_entry_is_itself(spark):
    got = graph.nearest(edges(spark, ("a", "b")), spark.createDataFrame([("b",)], "node string"), spark.createDataFrame([("b",), ("a",)], "node string")).collect()
    assert [(r["entry"], r["depth"], r["path"]) for r in got] == [("b", 0, ["b"])]


def test_common_ancestor(spark):
    pair = spark.createDataFrame([("a", "b")], "a string, b string")
    assert graph.common_ancestor(edges(spark, ("c", "a"), ("c", "b")), pair).first()["lca"] == "c"
    assert graph.common_ancestor(edges(spark, ("c", "a"), ("c", "b"), ("b", "a")), pair).first()["lca"] == "b"


def test_closure_and_components_of_a_cycle(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"))
    assert graph.closure(e).count() == 10
    assert {r["node"]: r["root"] for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


@pytest.mark.parametrize("n, level", [(1, "low"), (2, "low"), (3, "medium"), (4, "high")])
def test_risk(spark, n, level):
    assert spark.range(1).select(names.risk(F.lit(n)).alias("r")).first()["r"] == level


@pytest.mark.parametrize(
    "text, expected",
    [
        ("http x.request( console.y .log(", ("network", "http.request")),
        ("Session.get(", ("network", "rcp.Session.get")),
        ("prefs preferences.putSync(", ("storage", "preferences.putSync")),
        ("console.log(", ("log", "console.log")),
        ("console only", None),
    ],
)
def test_sink_order(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(sinks.classify(F.col("t")).alias("s")).first()["s"]
    assert (tuple(got) if got else None) == expected


def test_readable_names(spark):
    rows = [("Page.%AM0$build", "Page.build_callback_0"), ("%dflt.run", "[module].run"), ("x%dflt.func_main_0", "[module-level init]"), ("Page.run", None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "n string").select(names.readable(F.col("n")).alias("r")).collect()
    assert [r["r"] for r in got] == [b for _, b in rows]


def statements(spark, *rows):
    return spark.createDataFrame([(1, i + 1, k, v, f) for i, (k, v, f) in enumerate(rows)], "method long, idx long, kind string, var long, from_var long")


def test_redefinition_kills_taint(spark):
    assert dataflow.straight_taint(statements(spark, ("source", 1, 0), ("clear", 1, 0), ("sink", 1, 0))).count() == 0
    assert dataflow.tainted_sinks(statements(spark, ("source", 1, 0), ("clear", 1, 0), ("sink", 1, 0))).count() == 0


def test_taint_follows_copies(spark):
    got = dataflow.tainted_sinks(statements(spark, ("source", 1, 0), ("copy", 2, 1), ("clear", 1, 0), ("copy", 3, 2), ("sink", 3, 0), ("sink", 1, 0))).collect()
    assert [(r["var"], r["source_idx"], r["sink_idx"]) for r in got] == [(3, 1, 5)]


def test_both_definitions_reach_behind_a_branch(spark):
    gen = spark.createDataFrame([(1, 0, 7, 1), (1, 1, 7, 2)], "method long, block long, var long, def_idx long")
    e = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 2)], "method long, src long, dst long")
    got = dataflow.reaching(gen, gen.select("method", "block", "var"), e).filter("block = 2").collect()
    assert sorted(r["def_idx"] for r in got) == [1, 2]


def test_dominators_of_a_diamond(spark):
    e = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 3)], "method long, src long, dst long")
    assert {r["block"]: r["idom"] for r in controlflow.dominators(e).collect()} == {1: 0, 2: 0, 3: 0}


def test_points_to_through_a_field(spark):
    mk = spark.createDataFrame
    got = dataflow.points_to(mk([("a", "A"), ("t", "B")], "node string, obj string"), edges(spark, ("a", "b")), mk([("a", "f", "c")], "base string, field string, dst string"), mk([("b", "f", "t")], "base string, field string, src string"))
    assert {r["obj"] for r in got.filter("node = 'c'").collect()} == {"B"}


def test_groups_need_two_categories(spark):
    u = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (2, "x", 1), (2, "y", 1)], "method long, category string, api long")
    assert [(r["method"], r["categories"]) for r in collaboration.together(u, "method").collect()] == [(2, "x,y")]


def test_cross_method_takes_every_pair(spark):
    calls = [("c", "o1"), ("c", "o2"), ("o1", "p1"), ("o1", "p2"), ("o1", "p3"), ("o2", "p4"), ("d", "o3"), ("o3", "p5"), ("o3", "p6"), ("p6", "p7")]
    used = [("p1", "x", 1), ("p2", "x", 2), ("p3", "y", 3), ("p4", "z", 4), ("p5", "x", 5), ("p6", "x", 6), ("p7", "y", 7)]
    up = {m: {m: 0} for m, _, _ in used}
    for seen in up.values():
        for k in range(10):
            seen.update({a: k + 1 for a, b in calls if seen.get(b) == k and a not in seen})
    groups = {}
    for a, ca, _ in used:
        for b, cb, _ in used:
            both = set(up[a]) & set(up[b])
            if a < b and ca != cb and both:
                groups.setdefault(min(both, key=lambda n: (up[b][n], n)), set()).update((a, b))
    expected = {lca: (",".join(sorted({c for m, c, _ in used if m in ms})), len({(c, i) for m, c, i in used if m in ms})) for lca, ms in groups.items()}
    usages = spark.createDataFrame(used, "method string, category string, api long")
    pairs = graph.sharing(edges(spark, *calls), usages.select(F.col("method").alias("node")))
    got = {r["lca"]: (r["categories"], r["n_apis"]) for r in collaboration.across_methods(usages, edges(spark, *calls), pairs).collect()}
    assert got == expected and {"c", "o1"} <= set(got)


def test_cross_method_without_listed_pairs_equals_the_pairs(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(collaboration, "SLICES", 2)
    monkeypatch.setattr(collaboration, "FEW", 1)  # the second round has work
    calls = edges(spark, *[(f"m{rng.randrange(16)}", f"m{rng.randrange(16)}") for _ in range(22)])
    usages = spark.createDataFrame([(f"m{rng.randrange(16)}", "xy"[rng.randrange(2)], i) for i in range(20)], "method string, category string, api long")
    pairs = graph.sharing(calls, usages.select(F.col("method").alias("node")).distinct(), 3)
    expected = sorted(map(tuple, collaboration.across_methods(usages, calls, pairs, 3).collect()))
    assert expected and sorted(map(tuple, collaboration.across_all(usages, calls, 3).collect())) == expected


def test_cross_method_looks_on_where_the_first_partners_share_a_nearer_ancestor(spark, monkeypatch):
    rng = random.Random(9)
    calls = edges(spark, *[("top", f"o{i}") for i in range(12)], *[(f"o{rng.randrange(12)}", f"m{m:02}") for m in range(40) for _ in range(2)], (None, "m01"))
    usages = spark.createDataFrame([(f"m{m:02}", "xyz"[rng.randrange(3)] if rng.random() < 0.9 else None, rng.randrange(9)) for m in range(40) for _ in range(1 + m % 3)], "method string, category string, api long")
    pairs = graph.sharing(calls, usages.select(F.col("method").alias("node")).distinct())
    expected = sorted(map(str, collaboration.across_methods(usages, calls, pairs).collect()))
    assert any("lca='top'" in r for r in expected)
    settled = []
    real = collaboration._settle
    monkeypatch.setattr(collaboration, "_settle", lambda *a: settled.append(a[1]) or real(*a))
    for few in (4, 0.05):  # the second leaves most methods without a partner at first
        monkeypatch.setattr(collaboration, "FEW", few)
        assert sorted(map(str, collaboration.across_all(usages, calls).collect())) == expected
    assert [hot is None for hot in settled[-2:]] == [True, False]
