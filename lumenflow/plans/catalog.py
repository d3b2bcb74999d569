"""All queries of the library and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, sinks
from ..operators import collaboration, controlflow, dataflow, graph, matching
from ..sources.projection import SQL, Project, with_tables

FLAGSHIP = "collab_same_method"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rules on (category, kind of use): category, direct_call, profiling_category, rule_ord.
RULES = (("AF", True, "identity", 1), ("NF", False, "location", 2), ("NO", None, "device", 3), ("RF", True, "contacts", 4), ("NO", True, "network", 5), ("RF", False, "media", 6), ("AF", None, "sensor", 7))
RULES_SQL = "rules(category, direct_call, profiling_category, rule_ord) AS (VALUES " + ", ".join(f"('{c}', {'NULL' if d is None else str(d).lower()}, '{p}', {o})" for c, d, p, o in RULES) + ")"
LIFECYCLE = (("signup", "view"), ("view", "click"), ("click", "purchase"), ("purchase", "error"))


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Project], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Project(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rules(p: Project) -> DataFrame:
    return p.spark.createDataFrame(RULES, "category string, direct_call boolean, profiling_category string, rule_ord int")


# Aggregation of usages

_TOGETHER = """SELECT {key}, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(DISTINCT category) AS n_categories, count(DISTINCT (category, api)) AS n_apis,
  CASE WHEN count(DISTINCT category) >= 4 THEN 'high' WHEN count(DISTINCT category) >= 3 THEN 'medium' ELSE 'low' END AS risk
  FROM usages GROUP BY 1 HAVING count(DISTINCT category) >= 2"""


@query("collab_same_method", with_tables("usages") + _TOGETHER.format(key="method"))
def _(p):
    return collaboration.together(p.usages(), "method")


_FINE = "usages AS (SELECT l_orderkey AS method, 'c' || (l_suppkey % 30) AS category, l_partkey AS api, o_orderpriority AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("collab_file", f"WITH {_FINE}, m AS ({_TOGETHER.format(key='method')}), f AS ({_TOGETHER.format(key='file')}) SELECT * FROM f WHERE categories NOT IN (SELECT categories FROM m)")
def _(p):
    fine = p.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("c"), (F.col("l_suppkey") % 30).cast("string")).alias("category"), F.col("l_partkey").alias("api"))
    return collaboration.in_files(fine.join(p.table("orders").select("o_orderkey", F.col("o_orderpriority").alias("file")), "o_orderkey").withColumnRenamed("o_orderkey", "method"))


@query("collab_app", with_tables("usages") + """SELECT string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(DISTINCT category) AS n_categories, count(DISTINCT (category, api)) AS n_apis,
  count(DISTINCT file) AS n_files, CASE WHEN count(DISTINCT category) >= 4 THEN 'high' WHEN count(DISTINCT category) >= 3 THEN 'medium' ELSE 'low' END AS risk FROM usages""")
def _(p):
    return collaboration.in_application(p.usages())


def _part_usages(p: Project) -> DataFrame:
    lines = p.table("lineitem")
    return lines.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("method"), F.concat("l_returnflag", "l_linestatus").alias("category"), F.col("l_suppkey").alias("api"))


def _upper_calls(p: Project) -> DataFrame:
    return p.raw_calls().filter("layer <= 1").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


def _neighbours(p: Project) -> DataFrame:
    lines = p.table("lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("m"))
    a, b = lines.filter("l_linenumber = 1").select("l_orderkey", F.col("m").alias("a")), lines.filter("l_linenumber = 2").select("l_orderkey", F.col("m").alias("b"))
    return a.join(b, "l_orderkey").select("a", "b").filter("a <> b").distinct()


_LCA = with_tables("calls") + """, up AS (SELECT DISTINCT callee AS start, caller AS node, 1 AS depth FROM calls WHERE layer = 1
  UNION ALL SELECT DISTINCT a.callee, b.caller, 2 FROM calls a JOIN calls b ON b.callee = a.caller WHERE a.layer = 1 AND b.layer = 0
  UNION ALL SELECT DISTINCT callee, callee, 0 FROM calls WHERE layer = 1),
pairs AS (SELECT DISTINCT 'P' || x.l_partkey AS a, 'P' || y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = 1 AND y.l_linenumber = 2 WHERE x.l_partkey <> y.l_partkey),
lca AS (SELECT a, b, arg_min(v.node, (v.depth, v.node)) AS lca, min(v.depth) AS depth FROM pairs JOIN up u ON u.start = a JOIN up v ON v.start = b AND v.node = u.node GROUP BY 1, 2)"""


@query("lca_pairs", _LCA + "SELECT a, b, lca, depth FROM lca")
def _(p):
    return graph.common_ancestor(_upper_calls(p), _neighbours(p))


@query("collab_cross_method", _LCA + """, pu AS (SELECT 'P' || l_partkey AS method, l_returnflag || l_linestatus AS category, l_suppkey AS api FROM lineitem),
s AS (SELECT method, min(category) AS lo, max(category) AS hi FROM pu GROUP BY 1),
used AS (SELECT DISTINCT lca, unnest([a, b]) AS method FROM lca JOIN s x ON x.method = a JOIN s y ON y.method = b WHERE NOT (x.lo = x.hi AND y.lo = y.hi AND x.lo = y.lo))
SELECT lca, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(DISTINCT category) AS n_categories, count(DISTINCT (category, api)) AS n_apis,
  CASE WHEN count(DISTINCT category) >= 4 THEN 'high' WHEN count(DISTINCT category) >= 3 THEN 'medium' ELSE 'low' END AS risk FROM used JOIN pu USING (method) GROUP BY 1""")
def _(p):
    return collaboration.across_methods(_part_usages(p), _upper_calls(p), _neighbours(p))


@query("collab_cross_method_all")
def _(p):
    return collaboration.across_all(_part_usages(p), _upper_calls(p))


@query("api_category_count", f"WITH {RULES_SQL}," + SQL["usages"] + " SELECT coalesce(profiling_category, u.category) AS category, count(*) AS n FROM usages u LEFT JOIN (SELECT category, arg_min(profiling_category, rule_ord) AS profiling_category FROM rules WHERE direct_call GROUP BY 1) r ON r.category = u.category GROUP BY 1")
def _(p):
    first = rules(p).filter("direct_call").groupBy("category").agg(F.min_by("profiling_category", "rule_ord").alias("profiling_category"))
    return p.usages().join(F.broadcast(first), "category", "left").groupBy(F.coalesce("profiling_category", "category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


for _name, _where in (("direct", "direct_call"), ("indirect", "NOT direct_call"), ("constant", "direct_call IS NULL")):

    @query(f"api_match_{_name}", f"WITH {RULES_SQL}," + SQL["usages"] + f" SELECT method, line, u.category, profiling_category, rule_ord FROM usages u JOIN (SELECT category, arg_min(profiling_category, rule_ord) AS profiling_category, min(rule_ord) AS rule_ord FROM rules WHERE {_where} GROUP BY 1) r ON r.category = u.category")
    def _(p, where=_where):
        return matching.match_rules(p.usages().select("method", "line", "category"), rules(p).filter(where), ["category"], ["method", "line"]).select("method", "line", "category", "profiling_category", "rule_ord")


@query("import_semi", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(p):
    known = p.table("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("package"))
    return matching.known_packages(p.table("customer").select("c_custkey", "c_nationkey", F.col("c_nationkey").alias("package")), known).select("c_custkey", "c_nationkey")


@query("unused_permission", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7)")
def _(p):
    return p.table("part").select("p_partkey").join(p.table("lineitem").filter("l_returnflag = 'R' AND l_linenumber = 7").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("usage_first_match", with_tables("usages") + "SELECT method, line, category, api FROM (SELECT *, row_number() OVER (PARTITION BY method, category ORDER BY line) AS n FROM usages) WHERE n = 1")
def _(p):  # usages of one line keep the table's order, which the SQL leaves open
    first = matching.first_per(p.usages(placed=True), ["method", "category"], ["line", "part_file", "part_row"])
    return first.select("method", "line", "category", "api")


# Sinks

_SINK_TEXTS = "texts AS (SELECT conv_id AS id, 'c' || turn AS part, text FROM conversations UNION ALL SELECT page_id, 'h', html FROM pages UNION ALL SELECT page_id, 'u', url FROM pages UNION ALL SELECT l_orderkey, 'l' || l_linenumber, CASE l_partkey % 7 WHEN 0 THEN 'http' WHEN 1 THEN 'Session' WHEN 2 THEN 'preferences' WHEN 3 THEN 'console' WHEN 4 THEN 'hilog' WHEN 5 THEN 'TextInput' ELSE 'local' END || CASE l_suppkey % 6 WHEN 0 THEN '.request(' WHEN 1 THEN '.get(' WHEN 2 THEN '.putSync(' WHEN 3 THEN '.log(' WHEN 4 THEN '.setText(' ELSE '.map(' END FROM lineitem)"


def _sink_texts(p: Project) -> DataFrame:
    owner = F.expr("CASE l_partkey % 7 WHEN 0 THEN 'http' WHEN 1 THEN 'Session' WHEN 2 THEN 'preferences' WHEN 3 THEN 'console' WHEN 4 THEN 'hilog' WHEN 5 THEN 'TextInput' ELSE 'local' END")
    call = F.expr("CASE l_suppkey % 6 WHEN 0 THEN '.request(' WHEN 1 THEN '.get(' WHEN 2 THEN '.putSync(' WHEN 3 THEN '.log(' WHEN 4 THEN '.setText(' ELSE '.map(' END")
    parts = [
        p.table("conversations").select(F.col("conv_id").cast("long").alias("id"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("part"), "text"),
        p.table("pages").select(F.col("page_id").alias("id"), F.lit("h").alias("part"), F.col("html").alias("text")),
        p.table("pages").select(F.col("page_id").alias("id"), F.lit("u").alias("part"), F.col("url").alias("text")),
        p.table("lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("part"), F.concat(owner, call).alias("text")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("sink_classify", f"WITH {_SINK_TEXTS} SELECT id, part, kind, api FROM (SELECT id, part, {sinks.case_sql('text', 0)} AS kind, {sinks.case_sql('text', 3)} AS api FROM texts) WHERE kind IS NOT NULL")
def _(p):
    return _sink_texts(p).withColumn("s", sinks.classify(F.col("text"))).filter("s IS NOT NULL").select("id", "part", "s.kind", "s.api")


@query("sink_counts", f"WITH {_SINK_TEXTS} SELECT count(*) FILTER (kind = 'network') AS network, count(*) FILTER (kind = 'storage') AS storage, count(*) FILTER (kind = 'ui_display') AS ui_display, count(*) FILTER (kind = 'log') AS log, count(kind) AS total FROM (SELECT {sinks.case_sql('text', 0)} AS kind FROM texts)")
def _(p):
    kind = _sink_texts(p).select(sinks.classify(F.col("text"))["kind"].alias("kind"))
    return kind.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("network", "storage", "ui_display", "log")), F.count("kind").alias("total"))


@query("sink_dedup", f"WITH {_SINK_TEXTS} SELECT id, api, min(part) AS part FROM (SELECT id, part, {sinks.case_sql('text', 3)} AS api FROM texts) WHERE api IS NOT NULL GROUP BY 1, 2")
def _(p):
    return _sink_texts(p).select("id", "part", sinks.classify(F.col("text"))["api"].alias("api")).filter("api IS NOT NULL").groupBy("id", "api").agg(F.min("part").alias("part"))


# Scalar functions on names

_SIG = "sigs AS (SELECT p_partkey AS id, '@' || p_brand || '/src/' || replace(p_type, ' ', '/') || CASE p_size % 2 WHEN 0 THEN '.ets' ELSE '.ts' END || ': ' || replace(p_name, ' ', '_') || '.' || CASE p_size % 5 WHEN 0 THEN '%AM' || p_size || '$run' WHEN 1 THEN 'build' WHEN 2 THEN 'onClick' WHEN 3 THEN 'onCreate' ELSE 'load' END || '(number, string)' AS sig FROM part)"


def _sigs(p: Project) -> DataFrame:
    return p.table("part").selectExpr("p_partkey AS id", "'@' || p_brand || '/src/' || replace(p_type, ' ', '/') || CASE p_size % 2 WHEN 0 THEN '.ets' ELSE '.ts' END || ': ' || replace(p_name, ' ', '_') || '.' || CASE p_size % 5 WHEN 0 THEN '%AM' || p_size || '$run' WHEN 1 THEN 'build' WHEN 2 THEN 'onClick' WHEN 3 THEN 'onCreate' ELSE 'load' END || '(number, string)' AS sig")


_DISPLAY_SQL = "split_part(split_part(sig, ': ', -1), '(', 1)"


@query("method_name_parts", f"WITH {_SIG} SELECT id, {_DISPLAY_SQL} AS display, split_part(split_part(sig, '.', -1), '(', 1) AS name, regexp_replace(split_part(sig, ': ', 1), '^[^/]*/', '') AS path, regexp_replace(regexp_replace(split_part(split_part(sig, ': ', 1), '/', -1), '\\.ets$', ''), '\\.ts$', '') AS page FROM sigs")
def _(p):
    sig = F.col("sig")
    path = names.file_path(sig)
    return _sigs(p).select("id", names.display_name(sig).alias("display"), names.method_name(sig).alias("name"), path.alias("path"), names.page_name(path).alias("page"))


@query("readable_names", f"WITH {_SIG} SELECT id, CASE WHEN regexp_matches(d, '^(.+)\\.%AM(\\d+)\\$(.+)$') THEN regexp_replace(d, '^(.+)\\.%AM(\\d+)\\$(.+)$', '\\1.\\3_callback_\\2') END AS label FROM (SELECT id, {_DISPLAY_SQL} AS d FROM sigs)")
def _(p):
    return _sigs(p).select("id", names.readable(names.display_name(F.col("sig"))).alias("label"))


_NAME_SQL = "split_part(split_part(sig, '.', -1), '(', 1)"


@query("call_type", f"WITH {_SIG} SELECT id, CASE WHEN contains(name, '%AM') THEN 'callback' WHEN name IN ('aboutToAppear', 'build', 'onCreate', 'onForeground') THEN 'lifecycle_implicit' ELSE 'direct' END AS call_type, CASE name WHEN 'onClick' THEN 'user_interaction' WHEN 'build' THEN 'component_lifecycle' WHEN 'onCreate' THEN 'app_lifecycle' ELSE 'unknown' END AS entry_type, name IN ('onClick', 'build', 'onCreate') AS is_entry, NOT (name = 'build' OR starts_with(name, '%AM')) AS semantic FROM (SELECT id, {_NAME_SQL} AS name FROM sigs)")
def _(p):
    name = names.method_name(F.col("sig"))
    return _sigs(p).select("id", names.call_type(name).alias("call_type"), names.entry_type(name).alias("entry_type"), names.is_entry(name).alias("is_entry"), names.is_semantic(name).alias("semantic"))


@query("dot_escape", f"""WITH {_SIG} SELECT id, '"m_' || regexp_replace(sig, '[^a-zA-Z0-9_]', '_', 'g') || '"' AS node, replace(replace(sig, '"', '\\"'), chr(10), '\\n') AS text, regexp_replace(d, '%AM(\\d+)\\$(\\w+)', '\\2_cb\\1', 'g') AS label FROM (SELECT *, {_DISPLAY_SQL} AS d FROM sigs)""")
def _(p):
    sig = F.col("sig")
    return _sigs(p).select("id", names.dot_id("m", sig).alias("node"), names.dot_text(sig).alias("text"), names.dot_label(names.display_name(sig)).alias("label"))


@query("guard_conditions", "SELECT conv_id, turn, regexp_matches(text, '(?i)permission|granted|authorized|allowed|checkAccessToken|requestPermission|isLocationEnabled|hasPermission|canUse|isAvailable|isSupported|verify|enable|isActive') AS guard FROM conversations")
def _(p):
    return p.table("conversations").select("conv_id", "turn", names.is_guard(F.col("text")).alias("guard"))


@query("callback_refs", f"WITH {_SIG} SELECT id, unnest(regexp_extract_all(sig, '%AM\\d+(?:\\$%AM\\d+)*(?:\\$\\w+)*')) AS ref FROM sigs")
def _(p):
    return _sigs(p).select("id", F.explode(F.regexp_extract_all("sig", F.lit(r"%AM\d+(?:\$%AM\d+)*(?:\$\w+)*"), F.lit(0))).alias("ref"))


@query("modifier_bits", "SELECT p_partkey, (p_size & 1) > 0 AS is_static, (p_size & 4) > 0 AS is_private, bit_count(p_size) AS n FROM part")
def _(p):
    size = F.col("p_size")
    return p.table("part").select("p_partkey", (size.bitwiseAND(1) > 0).alias("is_static"), (size.bitwiseAND(4) > 0).alias("is_private"), F.bit_count(size).cast("tinyint").alias("n"))


# Call graphs

@query("call_edges_dedup", with_tables("calls") + "SELECT caller, callee, layer FROM calls")
def _(p):
    return p.calls()


@query("lifecycle_edges", f"WITH m AS (SELECT DISTINCT user_id AS class, event_type AS name FROM events), e AS (SELECT DISTINCT user_id AS class, event_type || '@' || user_id AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) || '@' || user_id AS dst FROM events), p(a, b) AS (VALUES {', '.join(map(str, LIFECYCLE))}) SELECT x.class, x.name || '@' || x.class AS src, y.name || '@' || y.class AS dst FROM m x JOIN p ON p.a = x.name JOIN m y ON y.class = x.class AND y.name = p.b WHERE NOT EXISTS (FROM e WHERE e.class = x.class AND e.src = x.name || '@' || x.class AND e.dst = y.name || '@' || y.class)")
def _(p):
    from pyspark.sql import Window

    events = p.table("events").select(F.col("user_id").alias("class"), F.col("event_type").alias("name"), "ts", "event_id")
    tag = lambda name: F.concat(name, F.lit("@"), F.col("class").cast("string"))
    methods = events.select("class", "name").distinct().withColumn("method", tag(F.col("name")))
    follows = F.lead("name").over(Window.partitionBy("class").orderBy("ts", "event_id"))
    existing = events.select("class", tag(F.col("name")).alias("src"), tag(follows).alias("dst")).distinct()
    return matching.pairs_in_class(methods, p.spark.createDataFrame(LIFECYCLE, "first string, then string"), existing)


@query("cg_entries", with_tables("calls") + "SELECT DISTINCT caller AS node FROM calls WHERE caller NOT IN (SELECT callee FROM calls)")
def _(p):
    calls = p.calls()
    return calls.select(F.col("caller").alias("node")).distinct().join(calls.select(F.col("callee").alias("node")), "node", "left_anti")


@query("cg_stats", with_tables("calls") + "SELECT kind, count(*) AS n FROM (SELECT DISTINCT left(node, 1) AS kind, node FROM (SELECT caller AS node FROM calls UNION ALL SELECT callee FROM calls)) GROUP BY 1")
def _(p):
    calls = p.calls()
    return calls.select(F.explode(F.array("caller", "callee")).alias("node")).distinct().groupBy(F.left("node", F.lit(1)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _links(p: Project) -> DataFrame:
    return p.raw_calls().select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


@query("reach_bounded", with_tables("calls", recursive=True) + ", r AS (SELECT DISTINCT caller AS node, 0 AS depth FROM calls WHERE caller LIKE 'C%' UNION SELECT callee, depth + 1 FROM r JOIN calls ON caller = node WHERE depth < 15) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def _(p):
    return graph.reach(_links(p), p.raw_calls().filter("caller LIKE 'C%'").select(F.col("caller").alias("node")))


@query("bfs_nearest_entry", with_tables("calls") + ", two AS (SELECT a.callee AS start, b.caller AS entry, [a.callee, a.caller, b.caller] AS path FROM calls a JOIN calls b ON b.callee = a.caller WHERE a.layer = 1 AND b.layer = 0), best AS (SELECT start, min(entry) AS entry FROM two GROUP BY 1) SELECT start, entry, 2 AS depth, min(array_to_string(path, ' <- ')) AS path FROM two JOIN best USING (start, entry) GROUP BY 1, 2")
def _(p):
    starts = p.raw_calls().filter("layer = 1").select(F.col("callee").alias("node"))
    entries = p.raw_calls().filter("layer = 0").select(F.col("caller").alias("node"))
    return graph.nearest(_links(p), starts, entries).select("start", "entry", "depth", F.array_join("path", " <- ").alias("path"))


@query("class_closure", "WITH RECURSIVE e AS (SELECT DISTINCT p_brand AS src, p_type AS dst FROM part UNION SELECT DISTINCT p_type, 'size' || p_size FROM part), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst) SELECT src, dst FROM c")
def _(p):
    part = p.table("part")
    e = part.select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).unionByName(part.select(F.col("p_type").alias("src"), F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("dst")))
    return graph.closure(e)


@query("cha_resolve", "WITH sub AS (SELECT DISTINCT p_brand AS class, p_type AS receiver FROM part), own AS (SELECT p_brand AS class, count(DISTINCT p_size) AS n FROM part GROUP BY 1), t AS (SELECT receiver, count(*) AS n_classes, sum(n)::BIGINT AS n_targets FROM sub JOIN own USING (class) GROUP BY 1) SELECT DISTINCT l_orderkey AS site, receiver, n_classes, n_targets FROM lineitem JOIN part ON l_partkey = p_partkey JOIN t ON receiver = p_type")
def _(p):
    part = p.table("part")
    own = part.groupBy(F.col("p_brand").alias("class")).agg(F.countDistinct("p_size").alias("n"))
    targets = part.select(F.col("p_brand").alias("class"), F.col("p_type").alias("receiver")).distinct().join(own, "class").groupBy("receiver").agg(F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("n_targets"))
    sites = p.table("lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_partkey").alias("p_partkey")).join(part.select("p_partkey", F.col("p_type").alias("receiver")), "p_partkey").select("site", "receiver").distinct()
    return sites.join(targets, "receiver").select("site", "receiver", "n_classes", "n_targets")


@query("copy_components", "WITH RECURSIVE e AS (SELECT l_partkey AS a, 1000000 + l_suppkey AS b FROM lineitem WHERE l_linenumber = 1 UNION SELECT 1000000 + l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 1), c AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE c.root < e.b) SELECT node, min(root) AS root FROM c GROUP BY 1")
def _(p):
    lines = p.table("lineitem").filter("l_linenumber = 1")
    return graph.components(lines.select(F.col("l_partkey").cast("long").alias("src"), (F.col("l_suppkey") + 1_000_000).cast("long").alias("dst")))


# Control flow

_FLOW = with_tables("statements", "blocks", "block_edges")


@query("cfg_branches", _FLOW + ", s AS (SELECT e.method, e.src, coalesce(bool_or(b.invokes) FILTER (succ_idx = 0), false) AS yes, coalesce(bool_or(b.invokes) FILTER (succ_idx = 1), false) AS no FROM block_edges e JOIN blocks b ON b.method = e.method AND b.block = e.dst GROUP BY 1, 2) SELECT b.method, b.block, CASE WHEN yes AND no THEN 'both_branches' WHEN yes THEN 'true_branch' WHEN no THEN 'false_branch' ELSE 'unknown' END AS branch_side FROM blocks b LEFT JOIN s ON s.method = b.method AND s.src = b.block WHERE last_kind = 'invoke'")
def _(p):
    return controlflow.branches(p.blocks(), p.block_edges())


@query("cfg_try", _FLOW + "SELECT b.method, b.block, CASE WHEN b.invokes THEN 'try_body' ELSE 'catch_handler' END AS branch_side, bool_or(h.invokes) AS has_fallback FROM blocks b JOIN block_edges e ON e.method = b.method AND e.src = b.block AND e.succ_idx = 9 JOIN blocks h ON h.method = e.method AND h.block = e.dst GROUP BY ALL")
def _(p):
    return controlflow.tries(p.blocks(), p.block_edges())


@query("cfg_loops", _FLOW + "SELECT method, src AS block, min(dst) AS header FROM block_edges WHERE dst <= src GROUP BY 1, 2")
def _(p):
    return controlflow.loops(p.block_edges())


@query("cfg_flaws", _FLOW + "SELECT method, block FROM blocks b WHERE block > 0 AND NOT EXISTS (FROM block_edges e WHERE e.dst % 3 <> 1 AND e.method = b.method AND e.dst = b.block)")
def _(p):
    return controlflow.flaws(p.blocks(), p.block_edges().filter("dst % 3 <> 1"))


_DOMINATORS = _FLOW.replace("WITH ", "WITH RECURSIVE ", 1) + """, ways AS (SELECT DISTINCT method, src, dst FROM block_edges), base AS (SELECT method, 0 AS node FROM ways UNION SELECT w.method, w.dst FROM base b JOIN ways w ON w.method = b.method AND w.src = b.node),
past AS (SELECT method, node AS removed, 0 AS node FROM base WHERE node > 0 UNION SELECT w.method, p.removed, w.dst FROM past p JOIN ways w ON w.method = p.method AND w.src = p.node AND w.dst <> p.removed),
dom AS (SELECT n.method, n.node AS block, d.node AS above FROM base n JOIN base d ON d.method = n.method AND d.node <> n.node AND NOT EXISTS (FROM past p WHERE p.method = n.method AND p.removed = d.node AND p.node = n.node) WHERE n.node > 0),
deep AS (SELECT method, block, count(*) AS k FROM dom GROUP BY 1, 2)"""


@query("dominators", _DOMINATORS + " SELECT dom.method, dom.block, arg_max(above, coalesce(k, 0)) AS idom FROM dom LEFT JOIN deep ON deep.method = dom.method AND deep.block = above GROUP BY 1, 2")
def _(p):
    return controlflow.dominators(p.block_edges())


# Dataflow

_ST = with_tables("statements")


@query("def_use", _ST + ", d AS (SELECT method, idx, var FROM statements WHERE kind IN ('source', 'clear', 'copy')), u AS (SELECT method, idx, CASE kind WHEN 'copy' THEN from_var ELSE var END AS var FROM statements WHERE kind IN ('copy', 'sink')) SELECT u.method, u.var, u.idx AS use_idx, max(d.idx) AS def_idx FROM u JOIN d ON d.method = u.method AND d.var = u.var AND d.idx < u.idx GROUP BY 1, 2, 3")
def _(p):
    return dataflow.def_use(p.statements())


@query("taint_straightline", _ST + ", w AS (SELECT method, idx, var, kind FROM statements WHERE kind IN ('source', 'clear')), s AS (SELECT x.method, x.var, x.idx AS sink_idx, max(w.idx) AS source_idx FROM statements x JOIN w ON w.method = x.method AND w.var = x.var AND w.idx < x.idx WHERE x.kind = 'sink' GROUP BY 1, 2, 3) SELECT s.method, s.var, s.source_idx, s.sink_idx FROM s JOIN w ON w.method = s.method AND w.idx = s.source_idx WHERE w.kind = 'source'")
def _(p):
    return dataflow.straight_taint(p.statements())


@query("taint_ifds", with_tables("statements", recursive=True) + """, d AS (SELECT method, idx, var, from_var, kind FROM statements WHERE kind IN ('source', 'clear', 'copy')),
v AS (SELECT d.method, d.idx, CASE WHEN d.kind = 'copy' THEN max(e.idx) END AS prev, d.kind, d.var FROM d LEFT JOIN d e ON e.method = d.method AND e.var = d.from_var AND e.idx < d.idx AND d.kind = 'copy' GROUP BY d.method, d.idx, d.kind, d.var),
t AS (SELECT method, idx, idx AS source_idx FROM v WHERE kind = 'source' UNION SELECT v.method, v.idx, t.source_idx FROM t JOIN v ON v.method = t.method AND v.prev = t.idx),
s AS (SELECT x.method, x.var, x.idx AS sink_idx, max(d.idx) AS def_idx FROM statements x JOIN d ON d.method = x.method AND d.var = x.var AND d.idx < x.idx WHERE x.kind = 'sink' GROUP BY 1, 2, 3)
SELECT s.method, s.var, t.source_idx, s.sink_idx FROM s JOIN t ON t.method = s.method AND t.idx = s.def_idx""")
def _(p):
    return dataflow.tainted_sinks(p.statements())


@query("tracked_vars", _ST + "SELECT method, var, count(*) AS n_defs, min(idx) AS first_idx FROM statements WHERE kind = 'source' GROUP BY 1, 2")
def _(p):
    return p.statements().filter("kind = 'source'").groupBy("method", "var").agg(F.count(F.lit(1)).alias("n_defs"), F.min("idx").alias("first_idx"))


@query("sink_scan", _ST + ", v AS (SELECT method, var, min(idx) AS first_idx FROM statements WHERE kind = 'source' GROUP BY 1, 2) SELECT s.method, s.idx, CASE WHEN v.var IS NOT NULL THEN s.var END AS tracked FROM statements s LEFT JOIN v ON v.method = s.method AND v.var = s.var WHERE s.kind = 'sink'")
def _(p):
    st = p.statements()
    known = st.filter("kind = 'source'").select("method", F.col("var").alias("tracked")).distinct()
    s = st.filter("kind = 'sink'").select("method", "idx", F.col("var").alias("tracked"))
    return s.join(known.withColumn("hit", F.lit(True)), ["method", "tracked"], "left").select("method", "idx", F.when(F.col("hit"), F.col("tracked")).alias("tracked"))


@query("reaching_defs", _FLOW.replace("WITH ", "WITH RECURSIVE ", 1) + """, g AS (SELECT method, (idx - 1) // 4 AS block, var, max(idx) AS def_idx FROM statements WHERE kind IN ('source', 'clear', 'copy') GROUP BY ALL), ways AS (SELECT DISTINCT method, src, dst FROM block_edges),
f AS (SELECT g.method, dst AS block, var, def_idx FROM g JOIN ways w ON w.method = g.method AND w.src = g.block
  UNION SELECT f.method, w.dst, f.var, f.def_idx FROM f JOIN ways w ON w.method = f.method AND w.src = f.block WHERE NOT EXISTS (FROM g WHERE g.method = f.method AND g.block = f.block AND g.var = f.var)) SELECT method, block, var, def_idx FROM f""")
def _(p):
    gen, kill = dataflow.block_summaries(p.statements())
    return dataflow.reaching(gen, kill, p.block_edges())


def _heap(p: Project) -> tuple[DataFrame, ...]:
    """Objects are nations; customers hold theirs, orders copy from customers, and write to and read from fields."""
    orders = p.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c, o = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    allocs = p.table("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("obj"))
    copies = orders.select(c.alias("src"), o.alias("dst"))
    stores = orders.filter("o_orderpriority = '1-URGENT'").select(o.alias("base"), F.lit("f").alias("field"), c.alias("src"))
    loads = orders.filter("o_orderpriority = '2-HIGH'").select(o.alias("base"), F.lit("f").alias("field"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("dst"))
    return allocs, copies, loads, stores


_HEAP = """WITH RECURSIVE own AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS obj FROM customer UNION SELECT 'o' || o_orderkey, 'n' || c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey),
fields AS (SELECT DISTINCT a.obj || '.f' AS node, b.obj FROM orders JOIN own a ON a.node = 'o' || o_orderkey JOIN own b ON b.node = 'c' || o_custkey WHERE o_orderpriority = '1-URGENT'),
loaded AS (SELECT DISTINCT 'v' || o_orderkey AS node, f.obj FROM orders JOIN own a ON a.node = 'o' || o_orderkey JOIN fields f ON f.node = a.obj || '.f' WHERE o_orderpriority = '2-HIGH'),
pts AS (SELECT * FROM own UNION SELECT * FROM fields UNION SELECT * FROM loaded)"""


@query("points_to", _HEAP + " SELECT node, obj FROM pts")
def _(p):
    return dataflow.points_to(*_heap(p))


@query("may_alias", _HEAP + " SELECT obj, count(DISTINCT node) AS n_nodes, min(node) AS first_node FROM pts GROUP BY 1")
def _(p):
    return dataflow.may_alias(dataflow.points_to(*_heap(p)))


# Permissions and reports

@query("permission_reasons", "WITH p AS (SELECT event_id, event_type AS module, 'perm.' || (props->>'k') AS permission, '$string:' || (((props->>'k')::INT) % 40) AS reason FROM events) SELECT event_id, module, permission, coalesce(nullif(n_name, ''), reason) AS reason FROM p LEFT JOIN nation ON '$string:' || n_nationkey = reason")
def _(p):
    k = F.from_json("props", "k int")["k"]
    rows = p.table("events").select("event_id", F.col("event_type").alias("module"), F.concat(F.lit("perm."), k.cast("string")).alias("permission"), F.concat(F.lit("$string:"), (k % 40).cast("string")).alias("reason"))
    strings = p.table("nation").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("value"))
    return matching.resolved_reasons(rows, strings).select("event_id", "module", "permission", "reason")


@query("batch_summary", "WITH o AS (SELECT c_nationkey AS project, count(*) AS chains_total, count(*) FILTER (o_orderstatus = 'F') AS chains_with_path FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1), f AS (SELECT c_nationkey AS project, count(*) AS files FROM customer GROUP BY 1), a AS (SELECT f.project, files, coalesce(chains_total, 0) AS chains_total, coalesce(chains_with_path, 0) AS chains_with_path FROM f LEFT JOIN o USING (project)), t AS (SELECT n_name AS project, files, chains_total, chains_with_path FROM a JOIN nation ON n_nationkey = project UNION ALL SELECT 'TOTAL', sum(files)::BIGINT, sum(chains_total)::BIGINT, sum(chains_with_path)::BIGINT FROM a) SELECT project, files, chains_total, chains_with_path, CASE WHEN chains_total = 0 THEN 'N/A' ELSE printf('%.1f%%', 100.0 * chains_with_path / chains_total) END AS chain_rate FROM t")
def _(p):
    customers = p.table("customer").select("c_custkey", "c_nationkey")
    orders = p.table("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").join(customers, "c_custkey").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("chains_total"), F.count_if(F.col("o_orderstatus") == "F").alias("chains_with_path"))
    files = customers.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("files"))
    each = files.join(orders, "c_nationkey", "left").fillna(0, ["chains_total", "chains_with_path"]).join(F.broadcast(p.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey")
    sums = [F.sum(c).alias(c) for c in ("files", "chains_total", "chains_with_path")]
    rows = each.rollup("n_name").agg(*sums).withColumn("project", F.coalesce("n_name", F.lit("TOTAL")))
    rate = F.when(F.col("chains_total") == 0, "N/A").otherwise(F.format_string("%.1f%%", F.lit(100.0) * F.col("chains_with_path") / F.col("chains_total")))
    return rows.select("project", "files", "chains_total", "chains_with_path", rate.alias("chain_rate"))


@query("report_json", with_tables("usages") + """SELECT file, '{"file":"' || file || '","statistics":{"n_usages":' || count(*) || ',"n_methods":' || count(DISTINCT method) || '},"categories":["' || string_agg(DISTINCT category, '","' ORDER BY category) || '"]}' AS report FROM usages GROUP BY 1""")
def _(p):
    u = p.usages()
    per = u.groupBy("file").agg(F.count(F.lit(1)).alias("n_usages"), F.countDistinct("method").alias("n_methods"), F.sort_array(F.collect_set("category")).alias("categories"))
    return per.select("file", F.to_json(F.struct("file", F.struct("n_usages", "n_methods").alias("statistics"), "categories")).alias("report"))


@query("dot_export", with_tables("calls") + """SELECT '"n_' || caller || '"' AS src, '"n_' || callee || '"' AS dst, '  "n_' || caller || '" -> "n_' || callee || '" [label="' || CASE layer WHEN 0 THEN 'direct' WHEN 1 THEN 'direct' ELSE 'implicit' END || '"];' AS line FROM calls""")
def _(p):
    src, dst = names.dot_id("n", F.col("caller")), names.dot_id("n", F.col("callee"))
    label = F.when(F.col("layer") <= 1, "direct").otherwise("implicit")
    return p.calls().select(src.alias("src"), dst.alias("dst"), F.concat(F.lit("  "), src, F.lit(" -> "), dst, F.lit(' [label="'), label, F.lit('"];')).alias("line"))


@query("category_sets", with_tables("usages") + "SELECT category FROM usages WHERE method IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') INTERSECT SELECT category FROM usages WHERE line = 7 EXCEPT SELECT category FROM usages WHERE line > 100")
def _(p):
    u = p.usages()
    return u.filter("file = '1-URGENT'").select("category").intersect(u.filter("line = 7").select("category")).subtract(u.filter("line > 100").select("category"))
