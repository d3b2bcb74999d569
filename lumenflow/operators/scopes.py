"""What names stand for: enclosing scopes, imports through other files' exports, methods meant by textual rules."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored

# Where library files lie, what stands for a default class or no namespace, and a type whose arguments
# don't matter.
LIBRARY, ENDING, NOTHING, CALLBACK = "api/", ".d.ts", "_", "AsyncCallback"


def enclosing(uses: DataFrame, scopes: DataFrame, declarations: DataFrame) -> DataFrame:
    """use, name, scope, value, up: each use's declaration in the nearest scope around it, ``up`` scopes out; unresolved
    ones are left out. uses (use, scope, name), scopes (scope, parent), declarations (scope, name, value).

    All uses climb together, and those that found theirs stop. Of several declarations in a scope the least value holds.
    """
    declared = stored(declarations.groupBy("scope", "name").agg(F.min("value").alias("value")), "declared")
    parents = stored(scopes.filter("parent IS NOT NULL").select("scope", "parent").distinct(), "parents")
    open_, done = stored(uses.select("use", "name", "scope").distinct(), "open"), None
    for k in count():
        tried = open_.join(declared.withColumn("found", F.lit(True)), ["scope", "name"], "left")
        tried = stored(tried, "tried")
        hit = tried.filter("found").select("use", "name", "scope", "value", F.lit(k).alias("up"))
        done = hit if done is None else done.unionByName(hit)
        open_ = stored(tried.filter("found IS NULL").join(parents, "scope").select("use", "name", F.col("parent").alias("scope")), "open")
        if open_.limit(1).count() == 0:
            return done


def imported(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """import_id, file, name, hops: where the thing an import names is declared, through any number of re-exports.

    imports (import_id, from_file, name). exports (file, name, from_file, from_name): without ``from_file`` the file
    itself declares the name; with one it hands on another file's; a null name hands on all of them. A file's own
    declaration comes before names it hands on, those before whole files. Of several ways the shortest holds, then the
    first in file order; circles end.
    """
    exports = stored(exports.select("file", "name", "from_file", "from_name").distinct(), "exports")
    own = exports.filter("from_file IS NULL").select("file", "name").distinct()
    handed = exports.filter("from_file IS NOT NULL AND name IS NOT NULL").select("file", "name", "from_file", F.coalesce("from_name", "name").alias("as"))
    whole = exports.filter("from_file IS NOT NULL AND name IS NULL").select("file", "from_file").distinct()
    key = ["import_id", "file", "name"]
    at = stored(imports.select("import_id", F.col("from_file").alias("file"), "name").distinct(), "at")
    seen, done = at, None
    for k in count():
        hit = at.join(own, ["file", "name"], "left_semi").select(*key, F.lit(k).alias("hops"))
        hit = stored(hit.groupBy("import_id").agg(F.min(F.struct("file", "name")).alias("m"), F.first("hops").alias("hops")).select("import_id", "m.*", "hops"), "declared")
        done = hit if done is None else done.unionByName(hit)
        left = at.join(hit, "import_id", "left_anti")
        named = left.join(handed, ["file", "name"]).select("import_id", F.col("from_file").alias("file"), F.col("as").alias("name"))
        every = left.join(handed.select("file", "name").distinct(), ["file", "name"], "left_anti").join(whole, "file").select("import_id", F.col("from_file").alias("file"), "name")
        at = stored(named.unionByName(every).distinct().join(seen, key, "left_anti"), "at")
        if at.limit(1).count() == 0:
            return done
        seen = seen.unionByName(at)


def _preferred(methods: DataFrame, by: list[str]) -> DataFrame:
    """Without static methods where the class has another of that name."""
    return methods.withColumn("_plain", F.bool_or(~F.col("static")).over(Window.partitionBy(*by))).filter("NOT (static AND _plain)").drop("_plain")


def rule_methods(rules: DataFrame, methods: DataFrame) -> DataFrame:
    """rule, signature, step: the library methods each rule means, all fitting overloads of the first class that has one.

    rules (rule, module, namespace, class, name, params), ``params`` names, null or empty for none. methods (file,
    namespace, namespace_ord, class, class_ord, default_class, name, static, declared, signature, params), ``params`` an
    array of (name, type), namespace null for the file's own classes. Searched are, in this order: 1 the named class of
    the named namespace, or without a class its default class, then the others; 2 the file's default class; 3 its other
    classes; 4 all namespaces. Names of parameters must agree; a method without declared signatures fits a rule without
    any, whatever its own.
    """
    place = ["file", "namespace_ord", "class_ord", "name"]
    m = _preferred(methods, place)
    m = m.select("file", "name", F.col("namespace").alias("m_namespace"), "namespace_ord", F.col("class").alias("m_class"), "class_ord", "default_class", "declared", "signature", F.transform("params", lambda x: x["name"]).alias("m_params"))
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    r = rules.withColumn("file", F.concat(F.lit(LIBRARY), "module", F.lit(ENDING))).withColumn("params", F.coalesce("params", F.array().cast("array<string>")))
    c = r.join(m, ["file", "name"])
    fits = (F.col("params") == F.col("m_params")) | (~F.col("declared") & (F.size("params") == 0))
    inside = given("namespace") & F.col("namespace").eqNullSafe(F.col("m_namespace"))
    step = F.when(inside & F.when(given("class"), F.col("class") == F.col("m_class")).otherwise(True), 1).when(F.col("m_namespace").isNull(), F.when(F.col("default_class"), 2).otherwise(3)).otherwise(4)
    rank = F.struct(F.col("step").alias("a"), F.coalesce("namespace_ord", F.lit(0)).alias("b"), (~F.col("default_class")).alias("c"), F.col("class_ord").alias("d"))
    ranked = c.filter(fits).withColumn("step", step).withColumn("rank", rank)
    best = ranked.withColumn("best", F.min("rank").over(Window.partitionBy("rule")))
    return best.filter("rank = best").select("rule", "signature", "step").distinct()


def parsed_rule(text: Column) -> Column:
    """(file, namespace, class, name, params) of 'file: namespace.class.method(name: type, ...)'; null if it isn't one."""
    file, rest = F.regexp_extract(text, r"^(.*?): ", 1), F.regexp_extract(text, r"^.*?: (.*)$", 1)
    parts = F.split(rest, r"\.")
    method = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), ".")
    inner = F.regexp_extract(method, r"\((.*?)\)", 1)
    one = lambda p: F.replace(F.regexp_replace(p, r"\s", ""), F.lit("..."), F.lit(""))
    params = F.filter(F.transform(F.split(inner, ","), one), lambda p: p != "")
    named = F.transform(params, lambda p: F.struct(F.get(F.split(p, ":"), F.lit(0)).alias("name"), F.coalesce(F.get(F.split(p, ":"), F.lit(1)), F.lit("")).alias("type")))
    return F.when((F.size(parts) >= 3) & method.rlike(r"\(.*?\)") & text.contains(": "), F.struct(F.concat(F.lit(LIBRARY), file).alias("file"), F.get(parts, F.lit(0)).alias("namespace"), F.get(parts, F.lit(1)).alias("class"), F.substring_index(method, "(", 1).alias("name"), named.alias("params")))


def _type_fits(want: Column, have: Column) -> Column:
    """Each alternative of a union type is part of the alternative in its place; callbacks fit whatever they get."""
    pairs = F.zip_with(F.split(want, r"\|"), F.split(have, r"\|"), lambda a, b: F.coalesce(F.contains(b, a), F.lit(False)))
    same = (F.size(F.split(want, r"\|")) == F.size(F.split(have, r"\|"))) & F.forall(pairs, lambda x: x)
    return same | (have.startswith(CALLBACK) & want.startswith(CALLBACK + "<"))


def text_rule_methods(rules: DataFrame, methods: DataFrame) -> DataFrame:
    """rule, signature: for rules (rule, text) the first signature, in order, whose parameters agree in name and type.

    methods as in ``rule_methods``; in a rule '_' stands for no namespace and for a default class.
    """
    r = rules.select("rule", parsed_rule(F.col("text")).alias("p")).filter("p IS NOT NULL").select("rule", "p.file", "p.name", F.col("p.namespace").alias("w_namespace"), F.col("p.class").alias("w_class"), F.col("p.params").alias("w_params"))
    c = r.join(methods, ["file", "name"])
    place = F.when(F.col("w_namespace") == NOTHING, F.col("namespace").isNull()).otherwise(F.col("namespace").eqNullSafe(F.col("w_namespace")))
    kind = F.when(F.col("w_class") == NOTHING, F.col("default_class")).otherwise(F.col("class") == F.col("w_class"))
    fits = F.forall(F.zip_with("w_params", "params", lambda a, b: F.coalesce((a["name"] == b["name"]) & _type_fits(a["type"], b["type"]), F.lit(False))), lambda x: x)
    good = c.filter(place & kind & (F.size("params") == F.size("w_params")) & fits)
    return good.groupBy("rule").agg(F.min(F.struct(F.coalesce("namespace_ord", F.lit(0)).alias("n"), "class_ord", "signature")).alias("m")).select("rule", "m.signature")
