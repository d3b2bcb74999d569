"""Files of a project as tables: rules, permission manifests, string resources, source listings. Spark reads all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a file's name that mark it as generated.
GENERATED = ("build", "cache", "node_modules", "oh_modules", ".preview")
#: What JSON5 allows beyond JSON and Spark's reader takes as options.
LENIENT = {"allowComments": "true", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"}
_RULES = "array<struct<package:string,apis:array<struct<directCall:boolean,namespace:string,method:string,permission:string,profilingCategory:string>>>>"
_MANIFEST = "module struct<name:string,requestPermissions:array<struct<name:string,reason:string>>>"
_STRINGS = "string array<struct<name:string,value:string>>"


def texts(spark: SparkSession, folder: str, names: str = "*.json") -> DataFrame:
    """path, text of all files below a folder whose names match; a folder is followed once, links to it are not."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(folder)
    return files.select("path", F.col("content").cast("string").alias("text"))


def sources(spark: SparkSession, folder: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """path, text of source files, but for generated ones and those below a folder named in ``ignored``."""
    rows = texts(spark, folder, "*.{ets,ts}")
    below = F.array(*(F.lit(x) for x in ignored)).cast("array<string>")
    return rows.filter(~is_generated(F.col("path")) & ~F.arrays_overlap(F.split("path", "/"), below))


def is_generated(name: Column) -> Column:
    out = F.lit(False)
    for part in GENERATED:
        out = out | name.contains(part)
    return out


def named(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """path, text of files of exactly that name; none of those whose path below the folder holds 'build' or 'cache'."""
    return texts(spark, folder, name).filter(~F.col("path").contains("build") & ~F.col("path").contains("cache"))


def strict(text: Column) -> Column:
    """JSON5 without what Spark's reader doesn't take: commas before a closing bracket go."""
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")


def rule_rows(files: DataFrame) -> DataFrame:
    """package, direct_call, namespace, method, permission, profiling_category, rule_ord of rule files (path, text).

    Rules keep their order; ``direct_call`` is true, false, or null for constants.
    """
    packages = files.select(F.posexplode(F.from_json(strict(F.col("text")), _RULES, LENIENT)).alias("p", "package"))
    apis = packages.select("p", F.col("package.package").alias("package"), F.posexplode("package.apis").alias("i", "api"))
    order = (F.col("p") * 1_000_000 + F.col("i")).alias("rule_ord")
    return apis.select("package", F.col("api.directCall").alias("direct_call"), "api.namespace", "api.method", F.nullif("api.permission", F.lit("")).alias("permission"), F.nullif("api.profilingCategory", F.lit("")).alias("profiling_category"), order)


def permission_rows(manifests: DataFrame) -> DataFrame:
    """path, module, permission, reason of manifests (path, text) in JSON5."""
    parsed = manifests.select("path", F.from_json(strict(F.col("text")), _MANIFEST, LENIENT).alias("m"))
    each = parsed.select("path", F.col("m.module.name").alias("module"), F.explode("m.module.requestPermissions").alias("r"))
    return each.select("path", "module", F.col("r.name").alias("permission"), "r.reason")


def string_rows(files: DataFrame) -> DataFrame:
    """name, value of string resources (path, text); the file that comes last by path wins."""
    each = files.select("path", F.posexplode(F.from_json(strict(F.col("text")), _STRINGS, LENIENT)["string"]).alias("i", "s"))
    return each.groupBy("s.name").agg(F.max_by("s.value", F.struct("path", "i")).alias("value"))


def module_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Files (path) with the module (module, root) they lie below, the deepest; files below none are left out."""
    met = files.join(modules, F.col("path").startswith(F.concat("root", F.lit("/"))))
    deepest = met.groupBy("path").agg(F.max_by("module", F.length("root")).alias("module"))
    return files.join(deepest, "path")


def projects(files: DataFrame, folder: str) -> DataFrame:
    """Files (path) with their project: the first folder below ``folder``. Files directly in it belong to none."""
    rest = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    return files.withColumn("project", F.substring_index(rest, "/", 1)).filter(F.instr(rest, "/") > 0)


def source_lines(files: DataFrame, spans: DataFrame, context: int = 2) -> DataFrame:
    """path, first, last, code: lines first - context to last + context of each span (path, first, last), lines from 1."""
    lines, begin = F.split("text", "\n"), F.greatest(F.col("first") - context, F.lit(1))
    return spans.join(files, "path").select("path", "first", "last", F.array_join(F.slice(lines, begin, F.col("last") + context - begin + 1), "\n").alias("code"))


#: Where a taint rule finds the value it speaks of.
_TAINT = "array<struct<module:string,namespace:string,`class`:string,api:string,kind:string,index:int>>"


def taint_rules(files: DataFrame) -> DataFrame:
    """signature, kind (return, argument or callback), place of source, sink or sanitizer rules in files (path, text).

    A rule without an index speaks of the returned value if it is a source's, and of the first argument otherwise.
    """
    each = files.select(F.explode(F.from_json(strict(F.col("text")), _TAINT, LENIENT)).alias("r"))
    signature = F.concat(F.coalesce("r.module", F.lit("")), F.lit(": "), F.concat_ws(".", F.nullif("r.namespace", F.lit("")), F.nullif("r.class", F.lit("")), "r.api"))
    kind = F.when(F.lower("r.kind").rlike("arg"), "argument").when(F.lower("r.kind").rlike("callback"), "callback").otherwise("return")
    return each.select(signature.alias("signature"), kind.alias("kind"), F.coalesce("r.index", F.lit(0)).alias("place"))
