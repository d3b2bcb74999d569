import collections
import json
import os
import random

import pytest
from lumenflow.functions import labels
from lumenflow.operators import callgraph, controlflow, graph, report, taint
from lumenflow.sources import manifests, store
from pyspark.sql import functions as F


def pairs(spark, *rows):
    return spark.createDataFrame(rows, "src string, dst string")


def test_rapid_types_equal_brute_force(spark):
    rng = random.Random(3)
    targets = [(f"m{rng.randrange(14)}", f"m{rng.randrange(14)}", f"c{rng.randrange(5)}", rng.random() < 0.3) for _ in range(30)]
    news = [(f"m{rng.randrange(14)}", f"c{rng.randrange(5)}") for _ in range(6)]
    reached, made, edges = {"m0", "m1"}, set(), set()
    while True:
        made |= {c for m, c in news if m in reached}
        new = {(a, b) for a, b, c, static in targets if a in reached and (static or c in made)}
        if new == edges and reached >= {b for _, b in new}:
            break
        edges, reached = new, reached | {b for _, b in new}
    got, seen = callgraph.rapid(spark.createDataFrame(targets, "caller string, callee string, class string, static boolean"), spark.createDataFrame(news, "method string, class string"), spark.createDataFrame([("m0",), ("m1",)], "method string"))
    assert {tuple(r) for r in got.collect()} == edges and {r[0] for r in seen.collect()} == reached


def test_a_broken_analysis_falls_back(spark):
    def broken():
        return spark.sql("SELECT nowhere FROM nothing")

    edges = lambda *rows: spark.createDataFrame(rows, "caller string, callee string")
    got = callgraph.built(broken, lambda: edges(("a", "b")), edges(("a", "b"), ("b", "c")))
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("b", "c")]


def test_strict_entries_and_paths_down(spark):
    e = pairs(spark, ("a", "b"), ("b", "c"), ("x", "b"), ("c", "d"))
    node = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    got = graph.nearest(e, node("a", "b", "d"), node("a", "b", "x"), strict=True).collect()
    assert {r["start"]: (r["entry"], r["depth"], r["path"]) for r in got} == {"b": ("a", 1, ["b", "a"]), "d": ("b", 2, ["d", "c", "b"])}
    down = graph.paths_down(e, spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "a")], "top string, target string")).collect()
    assert {(r["top"], r["target"]): r["path"] for r in down} == {("a", "d"): ["a", "b", "c", "d"], ("d", "a"): [], ("a", "a"): []}


def test_dominance_frontiers_and_tree(spark):
    e = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 3), (1, 3, 4), (1, 4, 3)], "method long, src long, dst long")
    idom = controlflow.dominators(e)
    got = collections.defaultdict(set)
    for r in controlflow.frontiers(e, idom).collect():
        got[r["block"]].add(r["frontier"])
    assert got == {1: {3}, 2: {3}, 3: {3}, 4: {3}}
    assert [r["block"] for r in controlflow.tree_order(idom).orderBy("path").collect()] == [0, 1, 2, 3, 4]
    assert {(r["block"], r["dominator"]) for r in controlflow.dominance(idom).collect()} == {(1, 0), (2, 0), (3, 0), (4, 3), (4, 0)}


# Taint across procedures


def brute_taint(statements, flow, entries, calls, actuals, results, roots):
    """Path edges by a worklist, one at a time; only matched calls and returns."""
    info, follow, begin = {(p, n): (k, t, o) for p, n, k, t, o in statements}, collections.defaultdict(list), dict(entries)
    for p, a, b in flow:
        follow[p, a].append(b)
    callee, bound = {(p, n): c for p, n, c in calls}, collections.defaultdict(list)
    for p, n, _, o, param in actuals:
        bound[p, n].append((o, param))
    seen, incoming, ends = set(), collections.defaultdict(set), collections.defaultdict(set)
    work = [(p, (None, None), begin[p], (None, None)) for p in roots]

    def back(p, d, n, source):
        target = info[p, n][1]
        work.extend((p, d, m, (target, source)) for m in follow[p, n] if target is not None)

    while work:
        edge = work.pop()
        if edge in seen:
            continue
        seen.add(edge)
        p, d, n, f = edge
        kind, target, operand = info[p, n]
        out = set()
        if not (f[0] is not None and (kind in ("source", "assign", "clear", "call") and f[0] == target or kind == "sanitize" and f[0] == operand)):
            out.add(f)
        if f[0] is None and kind == "source":
            out.add((target, n))
        if f[0] is not None and kind == "assign" and f[0] == operand:
            out.add((target, f[1]))
        work += [(p, d, m, x) for x in out for m in follow[p, n]]
        if kind == "call":
            c = callee[p, n]
            for x in [(None, None)] if f[0] is None else [(param, f[1]) for o, param in bound[p, n] if o == f[0]]:
                incoming[c, x].add((p, d, n))
                work.append((c, x, begin[c], x))
                for source in ends[c, x]:
                    back(p, d, n, source)
        if kind == "return" and f[0] is not None and f[0] == operand:
            ends[p, d].add(f[1])
            for q, e, m in incoming[p, d]:
                back(q, e, m, f[1])
    return seen


def program(rng):
    procs = ["main", "f", "g"]
    statements, flow, calls, actuals = [], [], [], []
    for i, p in enumerate(procs):
        nodes = [100 * i + k for k in range(9)]
        for n in nodes[:-1]:
            kind = rng.choice(["source", "assign", "assign", "clear", "sanitize", "sink", "call", "other"])
            target, operand = f"v{rng.randrange(3)}", f"v{rng.randrange(3)}"
            if kind == "call":
                c = rng.choice(procs[1:])
                calls.append((p, n, c))
                actuals.append((p, n, c, operand, "v0"))
            statements.append((p, n, kind, target, operand))
        statements.append((p, nodes[-1], "return", None, f"v{rng.randrange(3)}"))
        flow += [(p, a, b) for a, b in zip(nodes, nodes[1:])] + [(p, nodes[6], nodes[2])]
    return statements, flow, [(p, 100 * i) for i, p in enumerate(procs)], calls, actuals, [], ["main"]


@pytest.mark.parametrize("seed", [1, 2])
def test_taint_across_procedures_equals_brute_force(spark, seed):
    tables = program(random.Random(seed))
    schemas = ["proc string, node long, kind string, target string, operand string", "proc string, src long, dst long", "proc string, node long", "proc string, node long, callee string", "proc string, node long, callee string, operand string, param string", "callee string, operand string"]
    frames = [spark.createDataFrame(t, s).coalesce(1) for t, s in zip(tables, schemas)]
    edges = taint.path_edges(*frames, spark.createDataFrame([("main",)], "proc string"))
    expected = brute_taint(*tables)
    assert {(r["proc"], (r["d_var"], r["d_source"]), r["node"], (r["var"], r["source"])) for r in edges.collect()} == expected
    sinks = {(p, n): o for p, n, k, _, o in tables[0] if k == "sink"}
    assert {tuple(r) for r in taint.hits(edges, frames[0]).collect()} == {(p, n, f[0], f[1]) for p, _, n, f in expected if f[0] is not None and sinks.get((p, n)) == f[0]}


def test_taint_keeps_calls_apart(spark):
    """Two calls of one procedure: only the call with the tainted argument gets taint back."""
    statements = [("main", 0, "source", "a", None), ("main", 1, "clear", "b", None), ("main", 2, "call", "x", "a"), ("main", 3, "call", "y", "b"), ("main", 4, "sink", None, "x"), ("main", 5, "sink", None, "y"), ("f", 10, "assign", "q", "p"), ("f", 11, "return", None, "q")]
    make = spark.createDataFrame
    frames = [make(statements, "proc string, node long, kind string, target string, operand string"), make([("main", i, i + 1) for i in range(5)] + [("f", 10, 11)], "proc string, src long, dst long"), make([("main", 0), ("f", 10)], "proc string, node long"), make([("main", 2, "f"), ("main", 3, "f")], "proc string, node long, callee string"), make([("main", 2, "f", "a", "p"), ("main", 3, "f", "b", "p")], "proc string, node long, callee string, operand string, param string"), make([("f", "q")], "callee string, operand string")]
    edges = taint.path_edges(*frames, make([("main",)], "proc string"))
    assert [tuple(r) for r in taint.hits(edges, frames[0]).collect()] == [("main", 4, "x", 0)]


def test_outcomes_with_more_statements_go(spark):
    rows = [("s", "f", ["a", "b"]), ("s", "f", ["a", "c", "b"]), ("s", "f", ["b", "a"]), ("s", "g", ["a", "c", "b"]), ("t", "f", ["z"])]
    got = taint.minimal_outcomes(spark.createDataFrame(rows, "sink string, fact string, path array<string>")).collect()
    assert sorted((r["sink"], r["fact"], r["path"]) for r in got) == [("s", "f", ["a", "b"]), ("s", "g", ["a", "c", "b"]), ("t", "f", ["z"])]


# Files


def test_files_of_a_project(spark, tmp_path):
    for name, text in {
        "one/src/main/module.json5": "{ /* x */ module: { name: 'entry', requestPermissions: [ {name: 'p.A', reason: '$string:why'}, ], }, }",
        "one/build/module.json5": "{}",
        "one/src/page.ets": "a\nb\nc\nd\ne\nf\n",
        "one/src/lib.ts": "x",
        "one/oh_modules/dep.ts": "y",
        "one/src/skip/z.ts": "z",
        "two/strings.json": json.dumps({"string": [{"name": "why", "value": "because"}, {"name": "why", "value": "later"}]}),
        "two/sources.json": json.dumps([{"module": "m", "class": "C", "api": "read"}, {"module": "m", "namespace": "n", "api": "on", "kind": "ArgIn", "index": 1}, {"api": "z", "kind": "callback"}]),
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    folder = str(tmp_path)
    short = lambda path: path.split(folder)[1][1:]
    found = manifests.named(spark, folder, "module.json5")
    assert [(short(r["path"]), r["module"], r["permission"], r["reason"]) for r in manifests.permission_rows(found).collect()] == [("one/src/main/module.json5", "entry", "p.A", "$string:why")]
    code = manifests.projects(manifests.sources(spark, folder, ("skip",)), folder)
    assert sorted((short(r["path"]), r["project"]) for r in code.collect()) == [("one/src/lib.ts", "one"), ("one/src/page.ets", "one")]
    spans = code.filter(F.col("path").endswith("page.ets")).select("path", F.explode(F.array(F.lit(1), F.lit(5))).alias("first")).withColumn("last", F.col("first"))
    assert sorted(r["code"] for r in manifests.source_lines(code, spans).collect()) == ["a\nb\nc", "c\nd\ne\nf\n"]
    assert [tuple(r) for r in manifests.string_rows(manifests.named(spark, folder, "strings.json")).collect()] == [("why", "later")]
    assert sorted(map(tuple, manifests.taint_rules(manifests.named(spark, folder, "sources.json")).collect())) == [(": z", "callback", 0), ("m: C.read", "return", 0), ("m: n.on", "argument", 1)]


# Labels and reports


def test_label_helpers(spark):
    row = spark.range(1).select(
        labels.dotted_call(F.lit("a.b.c()")).alias("a"), labels.dotted_call(F.lit("a.b()")).alias("b"), labels.last_bracket(F.lit("x<y><p.q()>")).alias("c"), labels.last_bracket(F.lit("x")).alias("d"),
        labels.is_unclear(F.lit("union"), F.array(F.lit("number"), F.lit("unclear"))).alias("e"), labels.is_unclear(F.lit("class"), F.lit(None).cast("array<string>")).alias("f"),
        labels.method_signature(F.lit("p/x.ts"), F.lit("C"), F.lit("m"), F.array(F.lit("number"), F.lit("string")), F.lit(True)).alias("g"),
        labels.keyword_type(F.lit("RegularExpression")).alias("h"),
    ).first()
    assert tuple(row) == (["a", "b", "c"], [], "p.q", "", True, False, "@p/x.ts: C.[static]m(number, string)", "class RegExp")


def test_reports(spark):
    link = "array<struct<caller:string,callee:string,call_type:string>>"
    rows = [(1, "Page.build", "component_lifecycle", "src/Page.ets", [("Page.build", "Page.load", "direct"), ("Page.load", "Net.fetch", "callback")], "ns", "get", "location", [("log", "console.log"), ("log", "console.info")]), (2, "Page.build", "component_lifecycle", "src/Page.ets", [], "ns", "get", "location", [])]
    chains = spark.createDataFrame(rows, f"api_idx long, entry string, entry_type string, file string, chain {link}, namespace string, method string, category string, sinks array<struct<type:string,api:string>>")
    first, second = report.semantic_context(chains).orderBy("api_idx").collect()
    assert (first["page"], first["component"], first["anchor"], first["simplified"]) == ("Page", "Page", "Net.fetch", "Page.build() -> Page.load() -> Net.fetch() -> ns.get")
    assert first["hint"] == "In Page.ets, function Net.fetch() calls get [location], data flows to log (console.log, console.info)"
    assert (second["anchor"], second["simplified"], second["hint"]) == (None, "ns.get", "In Page.ets calls get [location], data destination: not traced")
    found = report.clusters(chains)
    one = found.first()
    assert (one["n_apis"], len(one["nodes"]), len(one["edges"])) == (2, 5, 4) and sum("style=dashed" in e for e in one["edges"]) == 1
    text = report.document(found).first()["text"]
    assert text.startswith("digraph apis {") and text.count("subgraph") == 1 and text.endswith("}")
    assert [r["line"] for r in report.table_lines(spark.createDataFrame([("a" * 30, 5)], "n string, k long"), "n", ["k"], 3).collect()] == ["a" * 30 + "  5"]
    groups = spark.createDataFrame([("L", "m", "x"), ("L", "L", "y")], "lca string, method string, api string")
    sub = report.subgraphs(groups, spark.createDataFrame([("L", ["e", "L"])], "lca string, path array<string>"), spark.createDataFrame([("L", "m", ["L", "m"])], "top string, target string, path array<string>"), spark.createDataFrame([("m", "x", ["log"])], "method string, api string, sinks array<string>")).first()
    assert sub["entry_path"] == ["e", "L"] and [(b["api"], b["path"], b["sinks"]) for b in sub["branches"]] == [("x", ["L", "m"], ["log"]), ("y", [], [])]


def test_paths_down_take_the_first_shortest_way_and_leave_nothing_between(spark, monkeypatch):
    rng = random.Random(11)
    size, links = 12, 20  # with cycles
    edges = {(f"n{rng.randrange(size)}", f"n{rng.randrange(size)}") for _ in range(links)}
    wanted = [(f"n{i}", f"n{j}") for i in range(size) for j in range(size)]
    expected = {}
    for top in {a for a, _ in wanted}:
        ways, depth, seen = {top: [top]}, 0, {top}
        while ways and depth < 4:
            step = {}
            for a, b in edges:
                if a in ways and b not in seen:
                    step[b] = min(step.get(b, ways[a] + [b]), ways[a] + [b])
            ways, depth, seen = step, depth + 1, seen | set(step)
            expected |= {(top, b): way for b, way in step.items()}
    monkeypatch.setattr(graph, "SLICES", 2, raising=False)
    got = graph.paths_down(pairs(spark, *sorted(edges)), spark.createDataFrame(wanted, "top string, target string"), 4).collect()
    assert {(r["top"], r["target"]): r["path"] for r in got} == {w: expected.get(w, []) for w in wanted} and len(got) == len(wanted)
    made, scratch = [], store.scratch
    for module in (store, graph):
        monkeypatch.setattr(module, "scratch", lambda session, what: made.append(scratch(session, what)) or made[-1], raising=False)
    graph.paths_down(pairs(spark, ("a", "b"), ("b", "c")), spark.createDataFrame([("a", "c")], "top string, target string"))
    left = [p for p in made if os.path.exists(p.removeprefix("file://"))]
    assert len(made) > len(left) == 2 and all("/paths-" in p for p in left)
