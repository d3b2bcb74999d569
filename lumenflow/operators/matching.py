"""Matching of imports and statements with rules about sensitive APIs. Spark broadcasts tables it finds small; only rules, which are
written by hand, are broadcast by hint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_rules(usages: DataFrame, rules: DataFrame, on: list[str], usage_key: list[str]) -> DataFrame:
    """Each usage with the first rule (by rule_ord) that agrees in ``on``; usages without a rule are left out."""
    first = rules.groupBy(*on).agg(F.min_by(F.struct(*[c for c in rules.columns if c not in on]), "rule_ord").alias("rule"))
    return usages.join(F.broadcast(first), on).select(*usages.columns, "rule.*")


def check_units(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """file, alias, import_ord and the rule's columns for each import that brings in a rule's namespace.

    imports: (file, origin_name, clause_name, import_from, import_ord).
    """
    met = (F.col("import_from") == F.col("package")) & (F.col("origin_name") == F.col("namespace"))
    return imports.join(rules, met).select("file", F.col("clause_name").alias("alias"), "import_ord", *rules.columns)


def used_at(statements: DataFrame, uses: DataFrame) -> DataFrame:
    """Statements with ``base``, the text of the use that a rule is held against, and its type.

    For an assigned call that is its first use, for a bare call and a constant the second: the object of an instance call,
    the first argument of a static one. statements: (file, stmt, shape, callee, field), shape 'assigned', 'bare' or
    'constant'; uses: (stmt, use_idx, text, type).
    """
    place = F.when(F.col("shape") == "assigned", 0).otherwise(1)
    return statements.withColumn("use_idx", place).join(uses.select("stmt", "use_idx", F.col("text").alias("base"), "type"), ["stmt", "use_idx"]).drop("use_idx")


def api_usages(statements: DataFrame, uses: DataFrame, imports: DataFrame, rules: DataFrame) -> DataFrame:
    """stmt, pattern, namespace, method, rule_ord: each statement's first rule by import and rule order.

    Patterns: 'assigned' and 'bare' calls of a direct rule by alias and callee; 'indirect' calls, whose receiver's type is
    the alias and a class, of a dotted rule; 'constant' fields of rules that are neither.
    """
    base, units = used_at(statements, uses), check_units(imports, rules)
    same_file = ["file"]
    direct = base.filter("shape <> 'constant'").join(units.filter("direct_call"), same_file).filter("base = alias AND callee = method").withColumn("pattern", F.col("shape"))
    dotted = F.concat_ws(".", F.concat(F.col("namespace"), F.expr("substring(type, length(alias) + 1)")), F.col("callee"))
    typed = F.startswith("type", F.concat("alias", F.lit("."))) | (F.col("type") == F.col("alias"))
    indirect = base.filter("shape <> 'constant'").join(units.filter("NOT direct_call"), same_file).filter(typed & (dotted == F.concat_ws(".", "namespace", "method"))).withColumn("pattern", F.lit("indirect"))
    constant = base.filter("shape = 'constant'").join(units.filter("direct_call IS NULL"), same_file).filter("base = alias AND field = method").withColumn("pattern", F.lit("constant"))
    every = direct.unionByName(indirect).unionByName(constant)
    first = every.groupBy("stmt", F.when(F.col("pattern").isin("assigned", "bare"), "direct").otherwise(F.col("pattern")).alias("p")).agg(F.min_by(F.struct("pattern", "namespace", "method", "rule_ord"), F.struct("import_ord", "rule_ord")).alias("m"))
    return first.select("stmt", "m.*")


def outer_usages(usages: DataFrame, chains: DataFrame) -> DataFrame:
    """Usages (api_idx) with their call chain, if they have one."""
    return usages.join(chains, "api_idx", "left")


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; nulls come last."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order]))).filter("_n = 1").drop("_n")


def known_packages(imports: DataFrame, packages: DataFrame) -> DataFrame:
    return imports.join(packages, "package", "left_semi")


def pairs_in_class(methods: DataFrame, pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """class, src, dst of ordered method pairs (first, then) of one class that ``existing`` (class, src, dst) lacks."""
    a, b = methods.select("class", F.col("name").alias("first"), F.col("method").alias("src")), methods.select("class", F.col("name").alias("then"), F.col("method").alias("dst"))
    return a.join(F.broadcast(pairs), "first").join(b, ["class", "then"]).select("class", "src", "dst").join(existing, ["class", "src", "dst"], "left_anti")


def resolved_reasons(permissions: DataFrame, strings: DataFrame) -> DataFrame:
    """A '$string:' reason becomes the string of that name; missing and empty strings leave the reference."""
    key = F.when(F.col("reason").startswith("$string:"), F.substring("reason", 9, 1_000_000))
    joined = permissions.withColumn("name", key).join(strings, "name", "left")
    return joined.withColumn("reason", F.coalesce(F.nullif("value", F.lit("")), "reason")).drop("name", "value")
