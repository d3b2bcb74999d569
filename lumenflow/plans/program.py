"""Queries over call graphs, control flow, files and reports, added to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import callgraph, controlflow, graph, matching, pointers, regions, report, scopes, ssa
from ..sources import manifests
from ..sources.projection import with_tables
from ..sources.store import stored
from .catalog import _DOMINATORS, _FLOW, _SIG, _sigs, query

#: Parts with a manufacturer above each brand and a container, which the table lacks.
_PART = "part AS (SELECT *, left(p_brand, 7) AS p_mfgr, CASE p_size % 4 WHEN 0 THEN 'SM' WHEN 1 THEN 'LG' WHEN 2 THEN 'WRAP' ELSE 'MED' END || ' ' || (p_size % 10) AS p_container FROM main.part)"


def _part(p):
    size = F.concat(F.expr("CASE p_size % 4 WHEN 0 THEN 'SM' WHEN 1 THEN 'LG' WHEN 2 THEN 'WRAP' ELSE 'MED' END"), F.lit(" "), (F.col("p_size") % 10).cast("string"))
    return p.table("part").withColumn("p_mfgr", F.left("p_brand", F.lit(7))).withColumn("p_container", size)


# Labels and types

_TYPES = "CASE p_size % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'undefined' ELSE 'Foo' END"
_TOKENS = [t for t, _ in labels.OPERATORS] + ["in", "?"]
_NAMES = "CASE o " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in labels.OPERATORS) + " END"


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query("category_labels", "SELECT p_partkey, CASE c " + " ".join(f"WHEN '{c}' THEN '{label}'" for c, label, _ in labels.CATEGORIES) + " ELSE upper(c) END AS label, CASE c " + " ".join(f"WHEN '{c}' THEN '{colour}'" for c, _, colour in labels.CATEGORIES) + f" ELSE '{labels.GREY}' END AS colour FROM (SELECT p_partkey, coalesce(list_extract([{_in(c for c, _, _ in labels.CATEGORIES)}], p_size), p_type) AS c FROM part)")
def _(p):
    c = F.coalesce(F.get(F.array(*(F.lit(c) for c, _, _ in labels.CATEGORIES)), F.col("p_size") - 1), F.col("p_type"))
    return p.table("part").select("p_partkey", labels.category_label(c).alias("label"), labels.category_colour(c).alias("colour"))


@query("expression_types", f"""SELECT p_partkey, {_NAMES} AS operator, CASE WHEN o = '+' THEN CASE WHEN l = 'number' AND r = 'number' THEN 'number' WHEN l = 'string' OR r = 'string' THEN 'string' ELSE 'unknown' END
  WHEN o IN ({_in(labels.NUMERIC)}) THEN CASE WHEN l = 'number' AND r = 'number' THEN 'number' ELSE 'unknown' END WHEN o IN ({_in(labels.TRUTH)}) THEN 'boolean'
  WHEN o = '??' THEN CASE WHEN l = 'undefined' THEN r ELSE l END ELSE 'unknown' END AS result,
  CASE WHEN l IN ({_in(labels.KEYWORDS)}) THEN l ELSE 'unclear ' || l END AS named
  FROM (SELECT p_partkey, {_TYPES} AS l, CASE p_partkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'string' ELSE 'Bar' END AS r, list_extract([{_in(_TOKENS)}], 1 + (p_partkey % {len(_TOKENS)})::INT) AS o FROM part)""")
def _(p):
    part = p.table("part").select("p_partkey", F.expr(_TYPES).alias("l"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'string' ELSE 'Bar' END").alias("r"), F.get(F.array(*map(F.lit, _TOKENS)), (F.col("p_partkey") % len(_TOKENS)).cast("int")).alias("o"))
    return part.select("p_partkey", labels.operator_name(F.col("o")).alias("operator"), labels.binary_type(F.col("o"), F.col("l"), F.col("r")).alias("result"), labels.keyword_type(F.col("l")).alias("named"))


@query("name_helpers", f"WITH {_PART} " + r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_mfgr ELSE '' END AS head, least(p_brand, p_container) || '||' || greatest(p_brand, p_container) AS pair,
  (p_size % 3 = 0) AS contained, sha256(p_name) AS digest FROM part""")
def _(p):
    part = _part(p)
    plain = F.regexp_replace("p_mfgr", "[^A-Za-z0-9]", "_")
    call = F.when(F.col("p_size") % 2 == 0, F.concat(plain, F.lit(".b.c()"))).otherwise(plain)
    head = F.when(F.size(labels.dotted_call(call)) == 3, F.col("p_mfgr")).otherwise("")
    union = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("x"), F.col("p_brand"), F.lit("|"), F.col("p_type"), F.lit("y"))).otherwise(F.col("p_brand"))
    contained = labels.union_contained(F.concat_ws("|", "p_brand", "p_type"), union)
    return part.select("p_partkey", head.alias("head"), labels.unordered(F.col("p_brand"), F.col("p_container")).alias("pair"), contained.alias("contained"), F.sha2("p_name", 256).alias("digest"))


# Call graphs: manufacturers are classes above brands; a method is a brand with a container.

_PROGRAM = _PART + """, classes AS (SELECT DISTINCT p_brand AS class, p_mfgr AS super, p_brand LIKE '%5' AS abstract FROM part UNION SELECT DISTINCT p_mfgr, NULL, false FROM part),
methods AS (SELECT DISTINCT p_brand || '.' || p_container AS method, p_brand AS class, p_container AS name, p_container LIKE 'WRAP%' AS generated FROM part),
sites AS (SELECT a.p_partkey AS site, a.p_brand || '.' || a.p_container AS caller, CASE WHEN a.p_size % 5 = 0 THEN 'static' ELSE 'instance' END AS kind, CASE WHEN a.p_size % 5 = 0 THEN b.p_brand ELSE b.p_mfgr END AS receiver, b.p_container AS name FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""


def _program(p):
    part = _part(p)
    classes = part.select(F.col("p_brand").alias("class"), F.col("p_mfgr").alias("super"), F.col("p_brand").endswith("5").alias("abstract")).unionByName(part.select(F.col("p_mfgr").alias("class"), F.lit(None).cast("string").alias("super"), F.lit(False).alias("abstract"))).distinct()
    methods = part.select(F.concat_ws(".", "p_brand", "p_container").alias("method"), F.col("p_brand").alias("class"), F.col("p_container").alias("name"), F.col("p_container").startswith("WRAP").alias("generated"), F.lit(False).alias("abstract")).distinct()
    b = part.select((F.col("p_partkey") - 1).alias("site"), F.col("p_brand").alias("b"), F.col("p_mfgr").alias("m"), F.col("p_container").alias("name"))
    static = F.col("p_size") % 5 == 0
    sites = part.withColumn("site", F.col("p_partkey")).join(b, "site").select("site", F.concat_ws(".", "p_brand", "p_container").alias("caller"), F.when(static, "static").otherwise("instance").alias("kind"), F.when(static, F.col("b")).otherwise(F.col("m")).alias("receiver"), "name")
    return classes, methods, sites


@query("cha_edges", f"WITH {_PROGRAM}, below AS (SELECT class AS receiver, class AS sub, abstract FROM classes UNION SELECT super, class, abstract FROM classes WHERE super IS NOT NULL) SELECT DISTINCT s.site, s.caller, m.method AS callee, m.class FROM sites s JOIN below b ON b.receiver = s.receiver AND NOT b.abstract JOIN methods m ON m.class = b.sub AND m.name = s.name WHERE s.kind <> 'static' AND (NOT m.generated OR m.class = s.receiver) UNION SELECT s.site, s.caller, m.method, m.class FROM sites s JOIN methods m ON m.class = s.receiver AND m.name = s.name WHERE s.kind = 'static'")
def _(p):
    classes, methods, sites = _program(p)
    return callgraph.hierarchy_targets(sites, classes, methods)


@query("site_kinds", f"WITH {_PROGRAM} SELECT site, CASE WHEN kind = 'static' THEN 'direct' WHEN s.name = 'constructor' OR coalesce(m.generated, false) THEN 'special' ELSE 'dynamic' END AS call FROM sites s LEFT JOIN methods m ON m.class = s.receiver AND m.name = s.name")
def _(p):
    _, methods, sites = _program(p)
    return callgraph.site_kinds(sites, methods)


@query("rta_edges")
def _(p):
    classes, methods, sites = _program(p)
    targets = callgraph.hierarchy_targets(sites, classes, methods).join(sites.select("site", (F.col("kind") == "static").alias("static")), "site")
    news = _part(p).filter("p_size <= 10").select(F.concat_ws(".", "p_brand", "p_container").alias("method"), F.col("p_brand").alias("class"))
    edges, _ = callgraph.rapid(targets, news, methods.filter("name LIKE 'SM%'").select("method"))
    return edges


@query("edge_layers", f"WITH {_PROGRAM}, l AS (SELECT caller, receiver || '.' || name AS callee, 1 AS phase FROM sites WHERE kind = 'static' UNION ALL SELECT caller, receiver || '.' || name, 2 FROM sites UNION ALL SELECT 'ROOT', method, 3 FROM methods WHERE name LIKE 'SM%') SELECT caller, callee, min(phase) AS phase FROM l GROUP BY 1, 2")
def _(p):
    _, methods, sites = _program(p)
    named = sites.select("kind", "caller", F.concat_ws(".", "receiver", "name").alias("callee"))
    root = callgraph.with_root(named.limit(0), methods.filter("name LIKE 'SM%'"))
    return callgraph.layered(named.filter("kind = 'static'"), named, root)


@query("callback_match", f"WITH {_SIG}, s AS (SELECT id, left(sig, 12) AS class, regexp_extract_all(sig, '%AM\\d+(?:\\$%AM\\d+)*(?:\\$\\w+)*') AS refs FROM sigs), r AS (SELECT id, class, unnest(refs) AS ref FROM s), m AS (SELECT 'm' || id AS callee, class, 'x.' || refs[1] AS name FROM s WHERE len(refs) > 0) SELECT DISTINCT 'c' || r.id AS caller, m.callee, r.id AS place FROM r JOIN m ON m.class = r.class AND (m.name = r.ref OR ends_with(m.name, '.' || r.ref))")
def _(p):
    s = _sigs(p).select("id", F.left("sig", F.lit(12)).alias("class"), "sig")
    ref = F.get(F.regexp_extract_all("sig", F.lit(callgraph.CALLBACK), F.lit(0)), F.lit(0))
    methods = s.select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("method"), "class", F.concat(F.lit("x."), ref).alias("name")).filter("name IS NOT NULL")
    return callgraph.callback_edges(s.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("method"), "class", F.col("id").alias("place"), F.col("sig").alias("text")), methods)


@query("event_handlers", "SELECT DISTINCT caller, callee FROM (SELECT l_orderkey AS caller, arg_min('f' || l_suppkey, (l_linenumber, 'f' || l_suppkey)) AS callee FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_suppkey % 3 <> 0 GROUP BY l_orderkey, l_returnflag)")
def _(p):
    lines = p.table("lineitem")
    function = F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("f"), F.col("l_suppkey").cast("string")))
    return callgraph.event_edges(lines.select(F.col("l_orderkey").alias("method"), F.col("l_returnflag").alias("site"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("place"), function.alias("function")), ["A", "R"])


@query("call_degrees", with_tables("calls") + "SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT caller AS node, 1 AS o, 0 AS i FROM calls UNION ALL SELECT callee, 0, 1 FROM calls) GROUP BY 1")
def _(p):
    return graph.degrees(p.raw_calls().select(F.col("caller").alias("src"), F.col("callee").alias("dst")))


_SCC = _PART + ", e AS (SELECT DISTINCT p_brand AS src, p_container AS dst FROM part WHERE p_size % 7 = 0 UNION SELECT p_container, p_brand FROM part WHERE p_size % 11 = 0)"


@query("strong_components", f"WITH RECURSIVE {_SCC}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), m AS (SELECT a.src AS node, max(a.dst) AS top FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src GROUP BY 1) SELECT n.node, greatest(n.node, coalesce(top, n.node)) AS root, m.node IS NOT NULL AS in_cycle FROM n LEFT JOIN m USING (node)")
def _(p):
    part = _part(p)
    e = part.filter("p_size % 7 = 0").select(F.col("p_brand").alias("src"), F.col("p_container").alias("dst")).unionByName(part.filter("p_size % 11 = 0").select(F.col("p_container").alias("src"), F.col("p_brand").alias("dst")))
    return graph.strong_components(e)


@query("chain_links", with_tables("calls") + ", two AS (SELECT a.callee AS start, b.caller AS entry, a.caller AS mid FROM calls a JOIN calls b ON b.callee = a.caller WHERE a.layer = 1 AND b.layer = 0), best AS (SELECT start, arg_min(mid, (entry, mid)) AS mid, min(entry) AS entry FROM two GROUP BY 1) SELECT start, unnest([0, 1]) AS place, unnest([entry, mid]) AS caller, unnest([mid, start]) AS callee, 'direct' AS call_type FROM best")
def _(p):
    links = p.raw_calls().select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    starts, entries = p.raw_calls().filter("layer = 1").select(F.col("callee").alias("node")), p.raw_calls().filter("layer = 0").select(F.col("caller").alias("node"))
    return graph.links(graph.nearest(links, starts, entries))


@query("paths_down", with_tables("calls") + ", t AS (SELECT DISTINCT c.caller AS top, o.callee AS target FROM calls c JOIN calls o ON o.caller = c.callee WHERE c.layer = 0 AND o.layer = 1) SELECT top, target, array_to_string(arg_min([top, c.callee, target], c.callee), ' -> ') AS path FROM t JOIN calls c ON c.caller = top AND c.layer = 0 JOIN calls o ON o.caller = c.callee AND o.callee = target AND o.layer = 1 GROUP BY 1, 2")
def _(p):
    upper = p.raw_calls().filter("layer <= 1")
    first, second = upper.filter("layer = 0").select(F.col("caller").alias("top"), F.col("callee").alias("mid")), upper.filter("layer = 1").select(F.col("caller").alias("mid"), F.col("callee").alias("target"))
    found = graph.paths_down(upper.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), first.join(second, "mid").select("top", "target"))
    return found.select("top", "target", F.array_join("path", " -> ").alias("path"))


# Control flow

@query("unreachable_blocks", _FLOW.replace("WITH ", "WITH RECURSIVE ", 1) + ", few AS (SELECT * FROM block_edges WHERE dst % 3 <> 1 OR succ_idx = 1), r AS (SELECT method, min(block) AS block FROM blocks GROUP BY 1 UNION SELECT r.method, e.dst FROM r JOIN few e ON e.method = r.method AND e.src = r.block) SELECT method, block FROM blocks EXCEPT SELECT method, block FROM r")
def _(p):
    return controlflow.unreachable(p.blocks(), p.block_edges().filter("dst % 3 <> 1 OR succ_idx = 1"))


@query("terminator_flaws", with_tables("statements") + ", s AS (SELECT method, (idx - 1) // 4 AS block, idx, kind = 'invoke' AS ends FROM statements), g AS (SELECT method, block, count(*) FILTER (ends) AS n, max(idx) AS last, max(idx) FILTER (ends) AS stop FROM s GROUP BY 1, 2) SELECT method, block, CASE WHEN n > 1 THEN 'several_terminators' ELSE 'terminator_not_last' END AS flaw FROM g WHERE n > 1 OR stop < last")
def _(p):
    st = p.statements()
    return controlflow.terminator_flaws(st.select("method", F.floor((F.col("idx") - 1) / 4).cast("long").alias("block"), "idx", (F.col("kind") == "invoke").alias("ends")))


@query("method_snippets", with_tables("statements") + "SELECT method, greatest(min(CASE WHEN idx % 4 > 0 THEN idx % 4 + method END) - 2, 1) AS first_line, max(CASE WHEN idx % 4 > 0 THEN idx % 4 + method ELSE 0 END) + 2 AS last_line, string_agg(kind || var, chr(10) ORDER BY idx) AS code FROM statements GROUP BY 1")
def _(p):
    line = F.when(F.col("idx") % 4 > 0, F.col("idx") % 4 + F.col("method")).otherwise(F.lit(0)).cast("long")
    return controlflow.snippets(p.statements().select("method", "idx", line.alias("line"), F.concat("kind", F.col("var").cast("string")).alias("text")))


@query("guarding_branches", _DOMINATORS + " SELECT DISTINCT b.method, b.block FROM blocks b JOIN dom ON dom.method = b.method AND dom.above = b.block JOIN blocks c ON c.method = dom.method AND c.block = dom.block AND c.invokes WHERE b.last_kind = 'invoke'")
def _(p):
    edges = p.block_edges()
    return controlflow.guarding(p.blocks(), controlflow.dominance(controlflow.dominators(edges)))


@query("async_methods", "SELECT user_id AS method, bool_or(event_type = 'purchase') AS is_async FROM events GROUP BY 1")
def _(p):
    return p.table("events").groupBy(F.col("user_id").alias("method")).agg(F.bool_or(F.col("event_type") == "purchase").alias("is_async"))


# Files

@query("manifest_permissions", "SELECT 'm' || c_custkey AS module, p.permission, CASE WHEN c_custkey % 2 = 0 THEN '$string:' || c_nationkey END AS reason, c_mktsegment AS path FROM customer, (VALUES ('perm.A'), ('perm.B')) p(permission)")
def _(p):
    head = F.concat(F.lit("// a comment\n{ module: { name: 'm"), F.col("c_custkey").cast("string"), F.lit("', requestPermissions: [ { name: 'perm.A'"))
    reason = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(", reason: '$string:"), F.col("c_nationkey").cast("string"), F.lit("'"))).otherwise("")
    text = F.concat(head, reason, F.lit("}, {\"name\": \"perm.B\""), reason, F.lit(",}, ], }, }"))
    return manifests.permission_rows(p.table("customer").select(F.col("c_mktsegment").alias("path"), text.alias("text")))


@query("string_resources", "SELECT 's' || p_size AS name, arg_max(p_name, p_partkey) AS value FROM part GROUP BY 1")
def _(p):
    text = F.concat(F.lit('{"string": [{"name": "s'), F.col("p_size").cast("string"), F.lit('", "value": "'), F.col("p_name"), F.lit('"}, ]}'))
    return manifests.string_rows(p.table("part").select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("path"), text.alias("text")))


@query("rule_files", f"WITH {_PART} SELECT p_brand AS package, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS direct_call, p_type AS namespace, 'm' || i AS method, nullif(CASE WHEN i = 0 THEN '' ELSE p_container END, '') AS permission, NULL::VARCHAR AS profiling_category, i::INT AS rule_ord FROM part, range(2) r(i)")
def _(p):
    direct = F.expr("CASE p_size % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END")
    api = lambda i: F.concat(F.lit("{directCall: "), direct, F.lit(", namespace: '"), F.col("p_type"), F.lit(f"', method: 'm{i}', permission: '"), F.lit("") if i == 0 else F.col("p_container"), F.lit("'},"))
    text = F.concat(F.lit("[{package: '"), F.col("p_brand"), F.lit("', apis: ["), api(0), api(1), F.lit("]}, ]"))
    return manifests.rule_rows(_part(p).select(F.col("p_partkey").cast("string").alias("path"), text.alias("text")))


@query("module_files", f"WITH {_PART} SELECT DISTINCT 'app/' || p_mfgr || '/' || p_brand || '/' || p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN 'inner' ELSE 'outer' END AS module, 'app' AS project, (p_container LIKE '%build%') AS generated FROM (SELECT p_partkey, p_size, p_container, p_mfgr || CASE WHEN p_size % 2 = 0 THEN '/in' ELSE '' END AS p_mfgr, p_brand FROM part)")
def _(p):
    part = _part(p)
    root = F.concat(F.col("p_mfgr"), F.when(F.col("p_size") % 2 == 0, "/in").otherwise(""))
    files = part.select(F.concat_ws("/", F.lit("app"), root, F.col("p_brand"), F.col("p_partkey").cast("string")).alias("path"))
    modules = part.select(F.explode(F.array(F.struct(F.lit("outer").alias("module"), F.concat(F.lit("app/"), "p_mfgr").alias("root")), F.struct(F.lit("inner").alias("module"), F.concat(F.lit("app/"), "p_mfgr", F.lit("/in")).alias("root")))).alias("m")).select("m.*").distinct()
    placed = manifests.projects(manifests.module_files(files.distinct().withColumn("path", F.concat(F.lit("/x/"), "path")), modules.withColumn("root", F.concat(F.lit("/x/"), "root"))), "/x")
    return placed.select(F.substring("path", 4, 1_000).alias("path"), "module", "project", manifests.is_generated(F.col("path")).alias("generated"))


# Rules and reports

_USES = """imports AS (SELECT n_nationkey AS file, 'ns' || (n_nationkey % 3) AS origin_name, 'a' || (n_nationkey % 4) AS clause_name, 'k' || n_regionkey AS import_from FROM nation),
rules(package, direct_call, namespace, method, rule_ord) AS (VALUES ('k0', true, 'ns0', 'm1', 1), ('k1', true, 'ns1', 'm2', 2), ('k1', false, 'ns1', 'C.m3', 3), ('k2', NULL, 'ns2', 'm0', 4), ('k2', true, 'ns2', 'm1', 5), ('k3', false, 'ns0', 'C.m2', 6), ('k4', NULL, 'ns1', 'm4', 7)),
s AS (SELECT c_custkey AS stmt, c_nationkey AS file, CASE c_custkey % 3 WHEN 0 THEN 'assigned' WHEN 1 THEN 'bare' ELSE 'constant' END AS shape, 'm' || (c_custkey % 5) AS m, 'a' || (c_nationkey % 4) AS base FROM customer),
u AS (SELECT file, clause_name AS alias, r.* FROM imports JOIN rules r ON import_from = package AND origin_name = namespace)"""


@query("api_patterns", f"""WITH {_USES} SELECT stmt, shape AS pattern, namespace, method, rule_ord FROM s JOIN u ON u.file = s.file AND direct_call AND base = alias AND m = method WHERE shape <> 'constant'
UNION ALL SELECT stmt, 'indirect', namespace, method, rule_ord FROM s JOIN u ON u.file = s.file AND NOT direct_call AND base = alias AND method = 'C.' || m WHERE shape <> 'constant'
UNION ALL SELECT stmt, 'constant', namespace, method, rule_ord FROM s JOIN u ON u.file = s.file AND direct_call IS NULL AND base = alias AND m = method WHERE shape = 'constant'""")
def _(p):
    rules = p.spark.createDataFrame([("k0", True, "ns0", "m1", 1), ("k1", True, "ns1", "m2", 2), ("k1", False, "ns1", "C.m3", 3), ("k2", None, "ns2", "m0", 4), ("k2", True, "ns2", "m1", 5), ("k3", False, "ns0", "C.m2", 6), ("k4", None, "ns1", "m4", 7)], "package string, direct_call boolean, namespace string, method string, rule_ord int")
    key = F.col("n_nationkey")
    imports = p.table("nation").select(key.alias("file"), F.concat(F.lit("ns"), (key % 3).cast("string")).alias("origin_name"), F.concat(F.lit("a"), (key % 4).cast("string")).alias("clause_name"), F.concat(F.lit("k"), F.col("n_regionkey").cast("string")).alias("import_from"), key.alias("import_ord"))
    shape = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'assigned' WHEN 1 THEN 'bare' ELSE 'constant' END")
    name = F.concat(F.lit("m"), (F.col("c_custkey") % 5).cast("string"))
    statements = p.table("customer").select(F.col("c_custkey").alias("stmt"), F.col("c_nationkey").alias("file"), shape.alias("shape"), name.alias("callee"), name.alias("field"))
    alias = F.concat(F.lit("a"), (F.col("file") % 4).cast("string"))
    place = F.when(F.col("shape") == "assigned", 0).otherwise(1)
    right = statements.select("stmt", place.alias("use_idx"), alias.alias("text"), F.concat(alias, F.lit(".C")).alias("type"))
    wrong = statements.select("stmt", (1 - place).alias("use_idx"), F.lit("other").alias("text"), F.lit("other").alias("type"))
    return matching.api_usages(statements, right.unionByName(wrong), imports, rules).select("stmt", "pattern", "namespace", "method", "rule_ord")


def _chains(p):
    """A chain for each order: its customer, the order, its first part in key order; sinks by the order's status."""
    chain = F.array(F.struct(F.concat(F.lit("Page"), F.col("o_custkey").cast("string"), F.lit(".build")).alias("caller"), F.concat(F.lit("Order"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".load")).alias("callee"), F.lit("direct").alias("call_type")))
    sinks = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit("log").alias("type"), F.lit("console.log").alias("api")), F.struct(F.lit("network").alias("type"), F.lit("http.send").alias("api")))).otherwise(F.array().cast("array<struct<type:string,api:string>>"))
    return p.table("orders").select(F.col("o_orderkey").alias("api_idx"), F.concat(F.lit("Page"), F.col("o_custkey").cast("string"), F.lit(".build")).alias("entry"), F.lit("component_lifecycle").alias("entry_type"), F.concat(F.lit("src/"), F.col("o_orderpriority"), F.lit(".ets")).alias("file"), F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<struct<caller:string,callee:string,call_type:string>>")).otherwise(chain).alias("chain"), F.lit("ns").alias("namespace"), F.lit("get").alias("method"), F.lit("location").alias("category"), sinks.alias("sinks"))


@query("semantic_context", """SELECT o_orderkey AS api_idx, o_orderpriority AS page, 'Page' || o_custkey AS component, CASE WHEN o_orderkey % 4 > 0 THEN 'Order' || (o_orderkey % 50) || '.load' END AS anchor,
  CASE WHEN o_orderkey % 4 > 0 THEN 'Page' || o_custkey || '.build() -> Order' || (o_orderkey % 50) || '.load() -> ' ELSE '' END || 'ns.get' AS simplified,
  'In ' || o_orderpriority || '.ets' || CASE WHEN o_orderkey % 4 > 0 THEN ', function Order' || (o_orderkey % 50) || '.load()' ELSE '' END || ' calls get [location]' || CASE WHEN o_orderstatus = 'F' THEN ', data flows to log/network (console.log, http.send)' ELSE ', data destination: not traced' END AS hint FROM orders""")
def _(p):
    return report.semantic_context(_chains(p))


@query("report_statistics", "SELECT (SELECT count(*) FROM nation) AS files, (SELECT count(*) FROM customer) AS methods, (SELECT count(*) FROM orders) AS apis, (SELECT count(*) FROM orders WHERE o_orderkey % 4 > 0) AS chains_with_path, (SELECT count(*) FROM orders) AS chains_total, (SELECT count(*) FROM region) AS collaborations")
def _(p):
    chains = _chains(p)
    return report.statistics(p.table("nation"), p.table("customer"), chains, chains, p.table("region"))


@query("chain_sinks", "SELECT count(*) FILTER (o_orderstatus = 'F') AS network, 0::BIGINT AS storage, 0::BIGINT AS ui_display, count(*) FILTER (o_orderstatus = 'F') AS log, 2 * count(*) FILTER (o_orderstatus = 'F') AS total FROM orders")
def _(p):
    return report.sink_counts(_chains(p))


@query("dot_clusters", "SELECT 'location' AS category, 'Page' || o_custkey || '.build' AS entry, 'LOCATION' AS label, '#3498DB' AS colour, count(*) AS n_apis, 2 + CASE WHEN bool_or(o_orderstatus = 'F') THEN 2 ELSE 0 END AS n_nodes, CASE WHEN bool_or(o_orderkey % 4 > 0) THEN 1 ELSE 0 END + CASE WHEN bool_or(o_orderstatus = 'F') THEN 2 ELSE 0 END AS n_edges FROM orders GROUP BY o_custkey")
def _(p):
    return report.clusters(_chains(p)).select("category", "entry", "label", "colour", "n_apis", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"))


@query("summary_table", "SELECT n_name, rpad(n_name, 24, ' ') || lpad(n_nationkey::VARCHAR, 12, ' ') || lpad(n_regionkey::VARCHAR, 12, ' ') AS line FROM nation")
def _(p):
    return report.table_lines(p.table("nation"), "n_name", ["n_nationkey", "n_regionkey"])


@query("unhandled_sites", f"WITH {_PROGRAM} SELECT site, 'unhandled: ' || name AS line FROM sites s WHERE NOT EXISTS (FROM methods m WHERE m.class = s.receiver AND m.name = s.name)")
def _(p):
    _, methods, sites = _program(p)
    handled = sites.join(methods.select(F.col("class").alias("receiver"), "name"), ["receiver", "name"], "left_semi")
    return report.unhandled(sites, handled)


# Single assignment, loops, edits

_FRONTIER = _DOMINATORS + """, weak AS (SELECT method, block, above FROM dom UNION SELECT method, node, node FROM base),
df AS (SELECT DISTINCT k.method, k.above AS block, w.dst AS frontier FROM weak k JOIN ways w ON w.method = k.method AND w.src = k.block WHERE NOT EXISTS (FROM dom d WHERE d.method = k.method AND d.block = w.dst AND d.above = k.above))"""
_SSA = _FRONTIER + """, defs AS (SELECT method, (idx - 1) // 4 AS block, idx, var FROM statements WHERE kind IN ('source', 'clear', 'copy')),
phi AS (SELECT d.method, f.frontier AS block, d.var FROM defs d JOIN df f ON f.method = d.method AND f.block = d.block UNION SELECT p.method, f.frontier, p.var FROM phi p JOIN df f ON f.method = p.method AND f.block = p.block),
sites AS (SELECT *, row_number() OVER (PARTITION BY method, var ORDER BY block, coalesce(idx, 0)) AS version FROM (FROM defs UNION ALL SELECT method, block, NULL, var FROM phi))"""
#: Best site at a point: of the point's own block before anything of a dominator, then the deepest dominator's last.
_SEEN = """coalesce(arg_max(s.version, CASE WHEN s.block = u.block THEN 1000000000 ELSE coalesce(k, 0) END * 1000000 + s.version), 0) AS version FROM u LEFT JOIN (sites s LEFT JOIN deep ON deep.method = s.method AND deep.block = s.block) ON s.method = u.method AND s.var = u.var
  AND (s.block = u.block AND coalesce(s.idx, 0) < u.idx OR EXISTS (FROM dom WHERE dom.method = u.method AND dom.block = u.block AND dom.above = s.block AND dom.above <> u.block))"""


def _ssa(p):
    """Definitions, uses, edges, dominance and phis of the methods."""
    block = F.floor((F.col("idx") - 1) / 4).cast("long").alias("block")
    st, edges = p.statements(), p.block_edges()
    defs = st.filter("kind IN ('source', 'clear', 'copy')").select("method", block, "idx", "var")
    uses = st.filter("kind IN ('copy', 'sink')").select("method", block, "idx", F.when(F.col("kind") == "copy", F.col("from_var")).otherwise(F.col("var")).alias("var"))
    idoms = stored(controlflow.dominators(edges), "idoms")
    return defs, uses, edges, controlflow.dominance(idoms), ssa.phis(defs, controlflow.frontiers(edges, idoms))


@query("dominance_frontiers", _FRONTIER + " FROM df")
def _(p):
    edges = p.block_edges()
    return controlflow.frontiers(edges, stored(controlflow.dominators(edges), "idoms"))


@query("ssa_phis", _SSA + " FROM phi")
def _(p):
    return _ssa(p)[-1]


@query("ssa_uses", _SSA + ", u AS (SELECT method, (idx - 1) // 4 AS block, idx, CASE kind WHEN 'copy' THEN from_var ELSE var END AS var FROM statements WHERE kind IN ('copy', 'sink')) SELECT u.method, u.block, u.idx, u.var, " + _SEEN + " GROUP BY ALL")
def _(p):
    defs, uses, _, dominance, placed = _ssa(p)
    return ssa.visible(uses, ssa.versions(defs, placed), dominance)


@query("ssa_phi_arguments", _SSA + ", u AS (SELECT phi.method, w.src AS block, 1000000000 AS idx, var, phi.block AS target FROM phi JOIN ways w ON w.method = phi.method AND w.dst = phi.block), r AS (SELECT u.method, u.target, u.var, u.block, " + _SEEN + " GROUP BY ALL) SELECT method, target AS block, var, block AS source, version FROM r")
def _(p):
    defs, _, edges, dominance, placed = _ssa(p)
    return ssa.phi_arguments(placed, edges, ssa.versions(defs, placed), dominance)


@query("natural_loops", _DOMINATORS + """, back AS (SELECT w.method, w.dst AS header, w.src AS block FROM ways w WHERE w.src = w.dst OR EXISTS (FROM dom WHERE dom.method = w.method AND dom.block = w.src AND dom.above = w.dst)),
body AS (SELECT method, header, block FROM back UNION SELECT b.method, b.header, w.src FROM body b JOIN ways w ON w.method = b.method AND w.dst = b.block JOIN base ON base.method = w.method AND base.node = w.src WHERE b.block <> b.header) SELECT DISTINCT method, header, block FROM (FROM body UNION ALL SELECT method, header, header FROM back)""")
def _(p):
    edges = p.block_edges()
    return ssa.natural_loops(edges, controlflow.dominance(stored(controlflow.dominators(edges), "idoms")))


@query("cfg_edits", with_tables("statements") + """, st AS (SELECT method, (idx - 1) // 4 AS block, idx, kind || ' ' || var AS text FROM statements),
done AS (SELECT method, block, idx, 1 AS side, CASE WHEN idx % 7 = 0 THEN 'nop' ELSE text END AS text FROM st WHERE idx % 5 <> 0 UNION ALL SELECT method, block, idx, 0, 'log' FROM st WHERE idx % 3 = 0 UNION ALL SELECT method, block, idx, 2, 'check' FROM st WHERE idx % 5 = 0)
SELECT method, block, row_number() OVER (PARTITION BY method, block ORDER BY idx, side) AS idx, text FROM done""")
def _(p):
    st = p.statements().select("method", F.floor((F.col("idx") - 1) / 4).cast("long").alias("block"), "idx", F.concat_ws(" ", "kind", F.col("var").cast("string")).alias("text"))
    edit = lambda n, action, text: F.when(F.col("idx") % n == 0, F.struct(F.lit(action).alias("action"), F.lit(0).alias("place"), F.lit(text).alias("text")))
    some = F.array_compact(F.array(edit(7, "replace", "nop"), edit(5, "remove", ""), edit(3, "before", "log"), edit(5, "after", "check")))
    return ssa.edited(st, st.select("method", "block", "idx", F.explode(some).alias("e")).select("method", "block", "idx", "e.*"))


@query("structural_regions")
def _(p):
    return regions.regions(p.block_edges()).withColumn("blocks", F.concat_ws(",", "blocks"))


# Points-to sets across procedures

def _objects(p):
    """A method a nation: each customer's object goes through one shared function, into a field and out, and is run."""
    c = p.table("customer").select(F.concat(F.lit("main"), F.col("c_nationkey").cast("string")).alias("method"), F.col("c_custkey").cast("string").alias("c"), F.concat(F.lit("T"), (F.col("c_custkey") % 5).cast("string")).alias("type"))
    of = lambda letter: F.concat(F.lit(letter), F.col("c"))
    frame, none = p.spark.createDataFrame, F.lit(None).cast("string")
    static = c.select("method", of("s").alias("site"), none.alias("receiver"), F.lit("id").alias("name"), F.lit("id").alias("target"), of("r").alias("result"))
    run = c.select("method", of("t").alias("site"), of("x").alias("receiver"), F.lit("run").alias("name"), none.alias("target"), none.alias("result"))
    classes = frame([("Base", None), *((f"T{i}", "Base") for i in range(5))], "class string, super string")
    methods = frame([("Base.run", "Base", "run"), ("T1.run", "T1", "run"), ("T3.run", "T3", "run")], "method string, class string, name string")
    return pointers.Program(
        entries=c.select("method").distinct(), allocs=c.select("method", of("a").alias("var"), of("o").alias("obj"), "type"), copies=c.select("method", of("a").alias("src"), of("b").alias("dst")),
        loads=c.select("method", of("r").alias("base"), F.lit("f").alias("field"), of("x").alias("dst")), stores=c.select("method", of("r").alias("base"), F.lit("f").alias("field"), of("a").alias("src")),
        calls=static.unionByName(run), actuals=c.select(of("s").alias("site"), F.lit(0).alias("pos"), of("b").alias("var")),
        formals=methods.select("method", F.lit(-1).alias("pos"), F.lit("this").alias("var")).unionByName(frame([("id", 0, "p")], "method string, pos int, var string")),
        returns=frame([("id", "p")], "method string, var string"), dispatch=pointers.dispatch_table(classes, methods),
    )


_RUN = "CASE c_custkey % 5 WHEN 1 THEN 'T1.run' WHEN 3 THEN 'T3.run' ELSE 'Base.run' END"


@query("context_points_to", f"SELECT 'main' || c_nationkey AS method, v || c_custkey AS var, 'o' || c_custkey AS obj FROM customer, (VALUES ('a'), ('b'), ('r'), ('x')) t(v) UNION ALL SELECT 'id', 'p', 'o' || c_custkey FROM customer UNION ALL SELECT {_RUN}, 'this', 'o' || c_custkey FROM customer")
def _(p):
    return pointers.without_contexts(pointers.solve(_objects(p), 1)[0])


@query("context_calls", f"SELECT 'main' || c_nationkey AS method, s || c_custkey AS site, CASE s WHEN 's' THEN 'id' ELSE {_RUN} END AS target, s || c_custkey AS inner_context FROM customer, (VALUES ('s'), ('t')) t(s)")
def _(p):
    return pointers.solve(_objects(p), 1)[1].select("method", "site", "target", F.array_join("inner", "<").alias("inner_context"))


@query("points_to_statistics", "WITH o AS (SELECT o_custkey AS node, count(DISTINCT o_orderpriority) AS n_objects FROM orders GROUP BY 1) SELECT n_objects, count(*) AS n_nodes FROM o GROUP BY 1")
def _(p):
    return pointers.set_statistics(p.table("orders").select(F.col("o_custkey").alias("node"), F.col("o_orderpriority").alias("obj")))


@query("type_differences", "SELECT o_custkey AS node, 'F' AS declared, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS found FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus <> 'F')")
def _(p):
    points = p.table("orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("obj"))
    found = pointers.type_differences(points, points.select("node", F.lit("F").alias("declared")).distinct(), p.table("orders").select(F.col("o_orderkey").alias("obj"), F.col("o_orderstatus").alias("type")))
    return found.withColumn("found", F.array_join("found", ","))


# Printed code

_CODE = _FLOW + ", code AS (SELECT method, (idx - 1) // 4 AS block, idx, kind || ' \"v' || var || '\"' AS text FROM statements)"


def _code(p):
    text = F.concat("kind", F.lit(' "v'), F.col("var").cast("string"), F.lit('"'))
    return p.statements().select("method", F.floor((F.col("idx") - 1) / 4).cast("long").alias("block"), "idx", text.alias("text"))


@query("method_graphs", _CODE + """, l AS (SELECT method, 0 AS part, block AS a, 0 AS b, 0 AS x, '  Node' || block || ' [label="id:' || block || '\\n    ' || string_agg(replace(text, '"', '\\"'), '\\n    ' ORDER BY idx) || '"];' AS line FROM code GROUP BY method, block
UNION SELECT method, 1, src, dst, (succ_idx = 9)::INT, '  Node' || src || ' -> Node' || dst || CASE WHEN succ_idx = 9 THEN '[style="dotted"];' ELSE ';' END FROM block_edges)
SELECT method, 'digraph "' || method || '" {' || chr(10) || string_agg(line, chr(10) ORDER BY part, a, b, x) || chr(10) || '}' AS text FROM l GROUP BY method""")
def _(p):
    return report.method_graphs(_code(p), p.block_edges())


@query("method_json", _CODE + """, s AS (SELECT method, block, list(text ORDER BY idx) AS statements FROM code GROUP BY 1, 2), e AS (SELECT method, src AS block, coalesce(list_sort(list(DISTINCT dst) FILTER (succ_idx <> 9)), []) AS successors, coalesce(list_sort(list(DISTINCT dst) FILTER (succ_idx = 9)), []) AS handlers FROM block_edges GROUP BY 1, 2)
SELECT method, to_json({'method': method, 'blocks': list({'id': block, 'statements': statements, 'successors': coalesce(successors, []), 'handlers': coalesce(handlers, [])} ORDER BY block)})::VARCHAR AS json FROM s LEFT JOIN e USING (method, block) GROUP BY method""")
def _(p):
    return report.method_json(_code(p), p.block_edges())


@query("method_listings", _CODE + ", b AS (SELECT method, block, 'label' || block || ':' || chr(10) || string_agg('  ' || text, chr(10) ORDER BY idx) AS part FROM code GROUP BY 1, 2) SELECT method, string_agg(part, chr(10) ORDER BY block) AS text FROM b GROUP BY 1")
def _(p):
    return report.method_listings(_code(p))


# Names

@query("enclosing_names", """WITH u AS (SELECT o_orderkey AS use, 'C' || o_custkey AS scope, 'x' || (o_orderkey % 6) AS name FROM orders),
up AS (SELECT 'C' || c_custkey AS c, 'N' || c_nationkey AS n, 'R' || n_regionkey AS r, c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT use, name, CASE WHEN i = c_custkey % 6 THEN c WHEN i = c_nationkey % 6 THEN n WHEN i = n_regionkey THEN r END AS scope, CASE WHEN i = c_custkey % 6 THEN 'c' WHEN i = c_nationkey % 6 THEN 'n' ELSE 'r' END AS value, CASE WHEN i = c_custkey % 6 THEN 0 WHEN i = c_nationkey % 6 THEN 1 ELSE 2 END AS up
FROM (SELECT *, right(name, 1)::INT AS i FROM u) JOIN up ON c = scope WHERE i IN (c_custkey % 6, c_nationkey % 6, n_regionkey)""")
def _(p):
    text = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    name = lambda c: F.concat(F.lit("x"), (F.col(c) % 6).cast("string")).alias("name")
    uses = p.table("orders").select(F.col("o_orderkey").alias("use"), text("C", "o_custkey").alias("scope"), name("o_orderkey"))
    customer, nation = p.table("customer"), p.table("nation")
    parents = customer.select(text("C", "c_custkey").alias("scope"), text("N", "c_nationkey").alias("parent")).unionByName(nation.select(text("N", "n_nationkey").alias("scope"), text("R", "n_regionkey").alias("parent")))
    made = [customer.select(text("C", "c_custkey").alias("scope"), name("c_custkey"), F.lit("c").alias("value")), nation.select(text("N", "n_nationkey").alias("scope"), name("n_nationkey"), F.lit("n").alias("value")), p.table("region").select(text("R", "r_regionkey").alias("scope"), name("r_regionkey"), F.lit("r").alias("value"))]
    return scopes.enclosing(uses, parents, made[0].unionByName(made[1]).unionByName(made[2]))


@query("imported_names", """SELECT o_orderkey AS import_id, CASE i WHEN 0 THEN 'C' || o_custkey WHEN 1 THEN 'N' || c_nationkey ELSE 'R' || n_regionkey END AS file, CASE i WHEN 0 THEN 'own' WHEN 1 THEN 'inner' ELSE 'far' END AS name, i AS hops
FROM (SELECT *, (o_orderkey % 4)::INT AS i FROM orders) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE i < 3""")
def _(p):
    text = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    row = lambda t, file, name, origin, other: t.select(file.alias("file"), F.lit(name).cast("string").alias("name"), origin.alias("from_file"), F.lit(other).cast("string").alias("from_name"))
    c, n, r = p.table("customer"), p.table("nation"), p.table("region")
    of_c, of_n = (text("C", "c_custkey"), text("N", "c_nationkey")), (text("N", "n_nationkey"), text("R", "n_regionkey"))
    rows = [row(c, of_c[0], "own", none, None), row(c, *of_c[:1], "named", of_c[1], "inner"), row(c, of_c[0], None, of_c[1], None), row(n, of_n[0], "inner", none, None), row(n, of_n[0], None, of_n[1], None), row(r, text("R", "r_regionkey"), "far", none, None), row(n, of_n[1], None, of_n[0], None)]
    exports = rows[0]
    for one in rows[1:]:
        exports = exports.unionByName(one)
    name = F.expr("element_at(array('own', 'named', 'far', 'nowhere'), CAST(o_orderkey % 4 AS INT) + 1)")
    return scopes.imported(p.table("orders").select(F.col("o_orderkey").alias("import_id"), text("C", "o_custkey").alias("from_file"), name.alias("name")), exports)
