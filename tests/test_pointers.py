import random

import pytest

from lumenflow.operators import pointers

SCHEMAS = {
    "entries": "method string", "allocs": "method string, var string, obj string, type string", "copies": "method string, src string, dst string",
    "loads": "method string, base string, field string, dst string", "stores": "method string, base string, field string, src string",
    "calls": "method string, site string, receiver string, name string, target string, result string", "actuals": "site string, pos int, var string",
    "formals": "method string, pos int, var string", "returns": "method string, var string", "dispatch": "type string, name string, target string",
}


def brute(t, k):
    """Facts and calls by sweeping over all rules until nothing changes."""
    push = lambda ctx, site: ((site, *ctx))[:k]
    reached, facts, edges, called = {(m, ()) for (m,) in t["entries"]}, set(), set(), set()
    kind = {o: ty for _, _, o, ty in t["allocs"]}
    while True:
        before = len(reached), len(facts), len(edges), len(called)
        facts |= {((None, m, c, v), o) for m, c in reached for n, v, o, _ in t["allocs"] if n == m}
        edges |= {((None, m, c, a), (None, m, c, b)) for m, c in reached for n, a, b in t["copies"] if n == m}
        held = {}
        for node, o in facts:
            held.setdefault(node, set()).add(o)
        for m, c in list(reached):
            at = lambda v: (None, m, c, v)  # noqa: E731, B023
            edges |= {((o, None, (), f), at(d)) for n, b, f, d in t["loads"] if n == m for o in held.get(at(b), ())}
            edges |= {(at(s), (o, None, (), f)) for n, b, f, s in t["stores"] if n == m for o in held.get(at(b), ())}
            for n, site, receiver, name, target, result in t["calls"]:
                if n != m:
                    continue
                inner = push(c, site)
                goals = [(target, None)] if target else [(g, o) for o in held.get(at(receiver), ()) for ty, nm, g in t["dispatch"] if ty == kind[o] and nm == name]
                for goal, o in goals:
                    called.add((m, c, site, goal, inner))
                    reached.add((goal, inner))
                    edges |= {(at(a), (None, goal, inner, f)) for s, i, a in t["actuals"] if s == site for g, j, f in t["formals"] if g == goal and i == j >= 0}
                    edges |= {((None, goal, inner, r), at(result)) for g, r in t["returns"] if g == goal and result}
                    facts |= {((None, goal, inner, f), o) for g, j, f in t["formals"] if o and g == goal and j == -1}
        facts |= {(b, o) for a, b in edges for o in held.get(a, ())}
        if before == (len(reached), len(facts), len(edges), len(called)):
            return facts, called


def random_program(rng):
    methods, v = ["main", "f", "A.run", "B.run"], lambda: rng.choice("xyz")
    t = {"entries": [("main",)], "dispatch": [("A", "run", "A.run"), ("B", "run", "B.run"), ("B", "go", "f")]}
    t["allocs"] = [(m, v(), f"o{i}", rng.choice("AB")) for i, m in enumerate(methods * 2)]
    t["copies"] = [(m, v(), v()) for m in methods]
    t["loads"] = [(m, v(), "g", v()) for m in methods]
    t["stores"] = [(m, v(), "g", v()) for m in methods]
    t["calls"] = [(m, f"s{m}{i}", None if static else v(), rng.choice(["run", "go"]), "f" if static else None, rng.choice([None, "x", "y"])) for m in methods for i, static in enumerate([True, False])]
    t["actuals"] = [(c[1], 0, v()) for c in t["calls"]]
    t["formals"] = [(m, 0, "x") for m in methods[1:]] + [(m, -1, "this") for m in methods[2:]]
    t["returns"] = [(m, v()) for m in methods[1:]]
    return t


def frames(spark, t):
    return pointers.Program(**{n: spark.createDataFrame(t[n], s).coalesce(1) for n, s in SCHEMAS.items()})


@pytest.mark.parametrize(("seed", "k"), [(1, 2), (3, 0)])
def test_contexts_equal_brute_force(spark, seed, k):
    t = random_program(random.Random(seed))
    facts, called = pointers.solve(frames(spark, t), k)
    want_facts, want_called = brute(t, k)
    assert {((r["field_of"], r["method"], tuple(r["ctx"]), r["var"]), r["obj"]) for r in facts.collect()} == want_facts
    assert {(r["method"], tuple(r["ctx"]), r["site"], r["target"], tuple(r["inner"])) for r in called.collect()} == want_called
    assert len(want_called) > 4


def test_dispatch_containers_and_type_differences(spark):
    frame = spark.createDataFrame
    table = pointers.dispatch_table(frame([("A", None), ("B", "A"), ("C", "B")], "class string, super string"), frame([("A.m", "A", "m"), ("B.m", "B", "m"), ("A.n", "A", "n")], "method string, class string, name string"))
    assert {tuple(r) for r in table.collect()} == {("A", "m", "A.m"), ("B", "m", "B.m"), ("C", "m", "B.m"), ("A", "n", "A.n"), ("B", "n", "A.n"), ("C", "n", "A.n")}
    calls = frame([("f", "1", "a", "add", None, None), ("f", "2", "b", "set", None, None), ("f", "3", "a", "set", None, None)], SCHEMAS["calls"])
    actuals = frame([("1", 0, "x"), ("2", 0, "k"), ("2", 1, "y"), ("3", 1, "z")], SCHEMAS["actuals"])
    puts = pointers.container_stores(calls, actuals, frame([("f", "a", "Set"), ("f", "b", "Map")], "method string, var string, type string"))
    assert {tuple(r) for r in puts.collect()} == {("f", "a", "[]", "x"), ("f", "b", "[]", "y")}
    points, types = frame([("p", 1), ("p", 2), ("q", 1)], "node string, obj int"), frame([(1, "A"), (2, "B")], "obj int, type string")
    off = pointers.type_differences(points, frame([("p", "A"), ("q", "A"), ("r", "A")], "node string, declared string"), types)
    assert [tuple(r) for r in off.collect()] == [("p", "A", ["A", "B"])]


def test_storage_library_results_and_function_values(spark):
    make = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1)
    accesses = spark.createDataFrame([
        ("main", None, "setOrCreate", "user", "u", None), ("main", None, "setOrCreate", None, "u", None), ("main", None, "link", "user", None, "l"), ("main", "l", "set", None, "v", None),
        ("cb", None, "prop", "user", None, "p"), ("cb", "p", "set", None, "w", None), ("cb", "p", "get", None, None, "g"), ("cb", None, "get", "user", None, "h"), ("cb", None, "get", "other", None, "n"),
    ], "method string, receiver string, name string, property string, value string, result string")
    calls = make("calls", [("main", "s1", None, "on", "lib.on", "r")])
    s_allocs, copies, loads, stores = pointers.storage_facts(accesses)
    l_allocs, back = pointers.library_facts(calls, spark.createDataFrame([("lib.on", "Handle")], "target string, type string"), spark.createDataFrame([("s1", "f")], "site string, var string"))
    f_allocs, dispatch = pointers.function_facts(spark.createDataFrame([("main", "f", "cb")], "method string, var string, function string"))
    allocs = make("allocs", [("main", "u", "U", "T"), ("main", "v", "V", "T"), ("cb", "w", "W", "T"), ("never", "z", "Z", "T")])
    none = {n: make(n, []) for n in ("actuals", "formals", "returns")}
    p = pointers.Program(entries=make("entries", [("main",)]), allocs=allocs.unionByName(s_allocs).unionByName(l_allocs).unionByName(f_allocs), copies=copies, loads=loads, stores=stores, calls=calls.unionByName(back), dispatch=dispatch, **none)
    facts, called = pointers.solve(p, 1)
    held = {}
    for r in pointers.without_contexts(facts).collect():
        held.setdefault((r["method"], r["var"]), set()).add(r["obj"])
    assert held["main", "r"] == {"library:lib.on"} and ("never", "z") not in held and ("cb", "n") not in held
    assert held["main", "l"] == held["cb", "h"] == held["cb", "g"] == {"U", "V"}
    assert held["cb", "p"] == {"U", "V", "W"}  # what is written to a one-way tie stays there
    assert {(r["site"], r["target"]) for r in called.collect()} == {("s1", "lib.on"), ("s1:f", "cb")}
