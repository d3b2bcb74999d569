"""Reports: context of a call chain in words, statistics, graph clusters, tables of text.

Chains: (api_idx, entry, entry_type, file, chain, namespace, method, category, sinks), where chain is an array of
(caller, callee, call_type) from the entry down and sinks one of (type, api).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import category_colour, category_label
from ..functions.names import dot_id, dot_label, dot_text, is_semantic, page_name, readable


def _shown(name: Column) -> Column:
    return F.concat(F.coalesce(readable(name), name), F.lit("()"))


def semantic_context(chains: DataFrame) -> DataFrame:
    """api_idx, page, component, anchor, simplified, hint.

    The anchor is the first name with a meaning from the api's end up, a link's callee before its caller.
    """
    upward = F.flatten(F.reverse(F.transform("chain", lambda x: F.array(x["callee"], x["caller"]))))
    anchor = F.get(F.filter(upward, is_semantic), F.lit(0))
    api = F.concat_ws(".", "namespace", "method")
    parts = F.when(F.size("chain") > 0, F.concat(F.array(_shown(F.get("chain", F.lit(0))["caller"])), F.transform("chain", lambda x: _shown(x["callee"]))))
    named = F.when(F.size("chain") == 0, F.array(api)).when(F.contains(F.element_at(parts, -1), F.col("method")), parts).otherwise(F.concat(parts, F.array(api)))
    page = page_name(F.col("file"))
    distinct = lambda field: F.array_distinct(F.transform("sinks", lambda s: s[field]))
    reached = F.concat(F.lit(", data flows to "), F.array_join(distinct("type"), "/"), F.lit(" ("), F.array_join(distinct("api"), ", "), F.lit(")"))
    flows = F.when(F.size("sinks") > 0, reached).otherwise(", data destination: not traced")
    where = F.coalesce(F.concat(F.lit(", function "), anchor, F.lit("()")), F.lit(""))
    hint = F.concat(F.lit("In "), page, F.lit(".ets"), where, F.lit(" calls "), F.col("method"), F.lit(" ["), F.col("category"), F.lit("]"), flows)
    return chains.select("api_idx", page.alias("page"), F.substring_index("entry", ".", 1).alias("component"), anchor.alias("anchor"), F.array_join(named, " -> ").alias("simplified"), hint.alias("hint"))


def clusters(chains: DataFrame) -> DataFrame:
    """category, entry, label, colour, n_apis, nodes, edges: one graph cluster for each category and entry.

    Nodes are lines for the entry, inner methods, apis and sinks, each once; edges join them, each pair once. The last
    callee of a chain is drawn as the api.
    """
    api = F.concat_ws(".", "namespace", "method")
    label = category_label(F.col("category"))

    def node(kind: str, name: Column, text: Column) -> Column:
        return F.concat(F.lit("    "), dot_id("s", name), F.lit(' [label="'), text, F.lit(f'"]; // {kind}'))

    def edge(a: Column, b: Column, style: Column) -> Column:
        return F.concat(F.lit("    "), dot_id("s", a), F.lit(" -> "), dot_id("s", b), F.lit(" [style="), style, F.lit("];"))

    last = F.size("chain") - 1
    callee = lambda x, i: F.when(i == last, api).otherwise(x["callee"])
    caller = lambda x, i: F.when(i == 0, F.col("entry")).otherwise(x["caller"])
    sink = lambda x: F.concat(F.lit("sink_"), x["api"], F.lit("_"), x["type"])
    style = lambda x: F.when(x["call_type"] == "callback", "dashed").otherwise("solid")
    inner = F.filter(F.transform("chain", lambda x, i: F.when(i < last, node("internal", x["callee"], dot_text(dot_label(x["callee"]))))), lambda x: x.isNotNull())
    nodes = F.concat(
        F.array(node("entry", F.col("entry"), F.concat(dot_text(dot_label(F.col("entry"))), F.lit("\\n["), F.col("entry_type"), F.lit("]"))), node("api", api, F.concat(dot_text(api), F.lit("\\n["), label, F.lit("]")))),
        inner, F.transform("sinks", lambda x: node("sink", sink(x), F.concat(dot_text(x["api"]), F.lit("\\n["), F.upper(x["type"]), F.lit("]")))),
    )
    edges = F.concat(F.transform("chain", lambda x, i: edge(caller(x, i), callee(x, i), style(x))), F.transform("sinks", lambda x: edge(api, sink(x), F.lit("bold"))))
    lines = chains.select("category", "entry", "api_idx", nodes.alias("nodes"), edges.alias("edges"))
    gathered = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    out = lines.groupBy("category", "entry").agg(F.count(F.lit(1)).alias("n_apis"), gathered("nodes"), gathered("edges"))
    return out.select("category", "entry", category_label(F.col("category")).alias("label"), category_colour(F.col("category")).alias("colour"), "n_apis", "nodes", "edges")


def document(found: DataFrame) -> DataFrame:
    """One text row: the graph of all clusters."""
    body = F.concat_ws("\n", F.format_string('  subgraph "cluster_%s_%s" {\n    label="%s (%d APIs)"; color="%s";', "category", "entry", "label", "n_apis", "colour"), F.array_join("nodes", "\n"), F.array_join("edges", "\n"), F.lit("  }"))
    every = F.array_sort(F.collect_list(F.struct("category", "entry", body.alias("text"))))
    return found.agg(F.concat(F.lit("digraph apis {\n"), F.array_join(F.transform(every, lambda x: x["text"]), "\n"), F.lit("\n}")).alias("text"))


def statistics(files: DataFrame, methods: DataFrame, usages: DataFrame, chains: DataFrame, collaborations: DataFrame) -> DataFrame:
    """One row: files, methods, apis, chains with a link, all chains, collaborations."""
    counts = [
        files.agg(F.count(F.lit(1)).alias("files")), methods.agg(F.count(F.lit(1)).alias("methods")), usages.agg(F.count(F.lit(1)).alias("apis")),
        chains.agg(F.count_if(F.size("chain") > 0).alias("chains_with_path"), F.count(F.lit(1)).alias("chains_total")), collaborations.agg(F.count(F.lit(1)).alias("collaborations")),
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.join(one)  # a row with a row
    return out


def sink_counts(chains: DataFrame) -> DataFrame:
    """One row: sinks by type, and all of them."""
    each = chains.select(F.explode("sinks").alias("s"))
    return each.agg(*(F.count_if(F.col("s.type") == t).alias(t) for t in ("network", "storage", "ui_display", "log")), F.count(F.lit(1)).alias("total"))


def padded(text: Column, width: int, left: bool = False) -> Column:
    """Text filled up with spaces to a width; longer text stays whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " ") if left else F.rpad(text, width, " "))


def table_lines(summary: DataFrame, name: str, columns: list[str], width: int = 12) -> DataFrame:
    """name, line: rows as text of fixed width, numbers to the right."""
    cells = [padded(F.col(name), 24), *(padded(F.col(c).cast("string"), width, True) for c in columns)]
    return summary.select(name, F.concat(*cells).alias("line"))


def unhandled(sites: DataFrame, handled: DataFrame) -> DataFrame:
    """Lines for sites (site, name) that nothing resolved."""
    return sites.join(handled.select("site").distinct(), "site", "left_anti").select("site", F.concat(F.lit("unhandled: "), "name").alias("line"))


def subgraphs(groups: DataFrame, entry_paths: DataFrame, branches: DataFrame, sinks: DataFrame) -> DataFrame:
    """lca, entry_path, branches: for each group the way from the entry, and each api's way from the common ancestor.

    groups: (lca, method, api); entry_paths: (lca, path); branches: (top, target, path); sinks: (method, api, sinks).
    """
    each = groups.join(branches.select(F.col("top").alias("lca"), F.col("target").alias("method"), "path"), ["lca", "method"], "left").join(sinks, ["method", "api"], "left")
    one = F.struct("api", "method", F.coalesce("path", F.array().cast("array<string>")).alias("path"), F.coalesce("sinks", F.array().cast(sinks.schema["sinks"].dataType)).alias("sinks"))
    return each.groupBy("lca").agg(F.array_sort(F.collect_list(one)).alias("branches")).join(entry_paths.withColumnRenamed("path", "entry_path"), "lca", "left")


def _gathered(statements: DataFrame) -> DataFrame:
    """method, block, texts: a block's statements (method, block, idx, text) in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"])
    return statements.groupBy("method", "block").agg(texts.alias("texts"))


def method_graphs(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """method, text: each method's control flow as a graph of its own; ways to handlers are dotted.

    edges: (method, src, dst, exceptional). One row holds a method, so what is gathered is as large as its code.
    """
    body = F.concat_ws("\\n    ", F.concat(F.lit("id:"), F.col("block").cast("string")), F.transform("texts", lambda t: F.replace(t, F.lit('"'), F.lit('\\"'))))
    nodes = _gathered(statements).select("method", F.lit(0).alias("part"), F.col("block").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(False).alias("x"), F.concat(F.lit("  Node"), F.col("block").cast("string"), F.lit(' [label="'), body, F.lit('"];')).alias("line"))
    ways = edges.select("method", F.lit(1).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("exceptional").alias("x"), F.concat(F.lit("  Node"), F.col("src").cast("string"), F.lit(" -> Node"), F.col("dst").cast("string"), F.when(F.col("exceptional"), '[style="dotted"];').otherwise(";")).alias("line"))
    lines = nodes.unionByName(ways).distinct().groupBy("method").agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "x", "line"))).alias("lines"))
    return lines.select("method", F.concat(F.lit('digraph "'), F.col("method").cast("string"), F.lit('" {\n'), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n}")).alias("text"))


def method_json(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """method, json: blocks in order with statements, successors and handlers."""
    out = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("dst"))))
    after = edges.groupBy("method", F.col("src").alias("block")).agg(out(~F.col("exceptional")).alias("successors"), out(F.col("exceptional")).alias("handlers"))
    none = F.array().cast("array<bigint>")
    blocks = _gathered(statements).join(after, ["method", "block"], "left")
    one = F.struct(F.col("block").alias("id"), F.col("texts").alias("statements"), F.coalesce("successors", none).alias("successors"), F.coalesce("handlers", none).alias("handlers"))
    return blocks.groupBy("method").agg(F.array_sort(F.collect_list(one)).alias("blocks")).select("method", F.to_json(F.struct("method", "blocks")).alias("json"))


def method_listings(statements: DataFrame) -> DataFrame:
    """method, text: a method's statements by block, each block under its label."""
    part = F.concat(F.lit("label"), F.col("block").cast("string"), F.lit(":\n"), F.array_join(F.transform("texts", lambda t: F.concat(F.lit("  "), t)), "\n"))
    blocks = _gathered(statements).groupBy("method").agg(F.array_sort(F.collect_list(F.struct("block", part.alias("text")))).alias("parts"))
    return blocks.select("method", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))
