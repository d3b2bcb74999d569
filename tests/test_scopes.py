import random

from test_program import brute_taint, program

from lumenflow.operators import scopes, taint

METHOD = "file string, namespace string, namespace_ord int, class string, class_ord int, default_class boolean, name string, static boolean, declared boolean, signature string, params array<struct<name:string,type:string>>"


def library(spark):
    p = lambda *names: [(n, "string") for n in names]
    f = "api/m.d.ts"
    return spark.createDataFrame([
        (f, "ns", 1, "_", 0, True, "get", False, True, "ns.get(a)", p("a")), (f, "ns", 1, "_", 0, True, "get", False, True, "ns.get(a,b)", p("a", "b")),
        (f, "ns", 1, "K", 1, False, "get", False, True, "ns.K.get()", p()), (f, "ns", 1, "K", 1, False, "get", True, True, "ns.K.[static]get(z)", p("z")),
        (f, None, None, "_", 0, True, "get", False, False, "get(q)", p("q")), (f, None, None, "L", 1, False, "put", False, True, "L.put(a)", [("a", "string | Callback"), ]),
        (f, "far", 2, "Z", 1, False, "only", True, True, "far.Z.only()", p()), (f, "far", 2, "Z", 1, False, "on", False, True, "far.Z.on(cb)", [("cb", "AsyncCallback"), ]),
        ("api/other.d.ts", None, None, "_", 0, True, "get", False, True, "other.get()", p()),
    ], METHOD)


def test_rules_mean_the_first_class_that_has_a_fitting_overload(spark):
    rules = spark.createDataFrame([
        (1, "m", "ns", "", "get", ["a", "b"]), (2, "m", "ns", "K", "get", None), (3, "m", "ns", "K", "get", ["a"]), (4, "m", "ns", None, "get", []), (5, "m", "", "", "get", []),
        (6, "m", "", "", "only", []), (7, "m", "none", "", "put", ["a"]), (8, "m", "ns", "K", "get", ["z"]), (9, "absent", "ns", "", "get", []), (10, "m", "", "", "get", ["q"]),
    ], "rule int, module string, namespace string, class string, name string, params array<string>")
    got = {}
    for r in scopes.rule_methods(rules, library(spark)).collect():
        got.setdefault(r["rule"], set()).add((r["signature"], r["step"]))
    # 8 finds nothing: a static method doesn't count beside another of its name in the class.
    assert got == {1: {("ns.get(a,b)", 1)}, 2: {("ns.K.get()", 1)}, 3: {("ns.get(a)", 4)}, 4: {("ns.K.get()", 1)}, 5: {("get(q)", 2)}, 6: {("far.Z.only()", 4)}, 7: {("L.put(a)", 3)}, 10: {("get(q)", 2)}}


def test_textual_rules(spark):
    texts = ["m.d.ts: ns._.get(a: string)", "m.d.ts: _.L.put(a: str|Call)", "m.d.ts: _.L.put(a: string)", "m.d.ts: far.Z.on(...cb: AsyncCallback<number>)", "m.d.ts: ns.K.get()", "m.d.ts: ns._.get(b: string)", "no rule", "m.d.ts: a.b", "m.d.ts: ns.K.get", ""]
    rules = spark.createDataFrame([*enumerate(texts), (99, None)], "rule int, text string")
    assert {r["rule"]: r["signature"] for r in scopes.text_rule_methods(rules, library(spark)).collect()} == {0: "ns.get(a)", 1: "L.put(a)", 3: "far.Z.on(cb)", 4: "ns.K.get()"}


def test_imports_end_in_circles_and_prefer_near_declarations(spark):
    exports = spark.createDataFrame([("a", "x", "b", "y"), ("b", "y", "a", "x"), ("c", None, "d", None), ("d", None, "c", None), ("d", "z", None, None), ("c", "z", "e", "w"), ("e", "w", None, None)], "file string, name string, from_file string, from_name string")
    imports = spark.createDataFrame([(1, "a", "x"), (2, "c", "z"), (3, "d", "z"), (4, "c", "w")], "import_id int, from_file string, name string")
    assert {tuple(r) for r in scopes.imported(imports, exports).collect()} == {(2, "e", "w", 1), (3, "d", "z", 0)}
    none = imports.filter("false")
    assert scopes.imported(none, exports).count() == scopes.imported(imports, exports.filter("false")).count() == 0


def test_undefined_reads_equal_brute_force(spark):
    tables = list(program(random.Random(5)))
    named = {"source": "undefined", "clear": "define", "sink": "read"}
    as_flow = [(p, n, "clear" if k == "sink" else k, t, o) for p, n, k, t, o in tables[0]]
    edges = brute_taint(as_flow, *tables[1:])
    reads = {(p, n): o for p, n, k, _, o in tables[0] if k == "sink"}
    want = {(p, n, var, source) for p, _, n, (var, source) in edges if var is not None and reads.get((p, n)) == var}
    tables[0] = [(p, n, named.get(k, k), t, o) for p, n, k, t, o in tables[0]]
    schemas = ["proc string, node long, kind string, target string, operand string", "proc string, src long, dst long", "proc string, node long", "proc string, node long, callee string", "proc string, node long, callee string, operand string, param string", "callee string, operand string"]
    frames = [spark.createDataFrame(t, s).coalesce(1) for t, s in zip(tables, schemas)]
    got = taint.undefined_reads(*frames, spark.createDataFrame([("main",)], "proc string"))
    assert {tuple(r) for r in got.collect()} == want and want
